"""Queries over sessions, events and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review
from ..sinks.local import merge_checkpoint
from ..sources.tables import by_id, by_prefix
from ..storage import table
from .catalog import query
from .pipeline import latest, stage_counts


@query("q32_semi_tracked", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def q32(spark, sf):
    tracked = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(tracked, "c_custkey", "left_semi")


@query("q37_stage_counts", "SELECT 'pages' AS stage, count(*) AS n FROM pages UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations")
def q37(spark, sf):
    return stage_counts({n: table(spark, sf, n) for n in ("pages", "documents", "conversations")})


@query("q38_status_counts", "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def q38(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query(
    "q39_checkpoint_merge",
    """WITH a AS (SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n, greatest(coalesce(a.last_id, 0), coalesce(b.last_id, 0)) AS last_id FROM a FULL JOIN b USING (user_id)""",
)
def q39(spark, sf):
    half = lambda k: table(spark, sf, "events").where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    return merge_checkpoint(half(0), half(1), "user_id", ["n", "last_id"])


@query(
    "q41_cost_cap",
    """WITH b AS (SELECT o_orderkey // 100 AS batch, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cost FROM orders GROUP BY 1),
s AS (SELECT batch, cost, CAST(coalesce(sum(cost) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM b)
SELECT * FROM s WHERE spent < 20000000000""",
)
def q41(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    b = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("batch")).agg(F.sum(cents).alias("cost"))
    return review.affordable(b, 20_000_000_000).select("batch", "cost", "spent")


@query("q42_latest_session", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def q42(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), "event_type", F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    return latest(e, ["user_id"]).select("user_id", F.col("id").alias("event_id"), "event_type")


@query("q55_usage_totals", "SELECT event_type AS model, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost_cents, count(*) FILTER (value < 1) AS small_calls FROM events GROUP BY 1")
def q55(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cost_cents"), F.count_if(F.col("value") < 1).alias("small_calls"))


@query("q66_point_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def q66(spark, sf):
    o = table(spark, sf, "orders")
    return by_id(o, "o_orderkey", o.agg(F.min("o_orderkey")).first()[0]).select("o_orderkey", "o_orderstatus")


@query("q67_prefix_lookup", "SELECT c_name, c_acctbal FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def q67(spark, sf):
    c = table(spark, sf, "customer").select("c_name", "c_acctbal")
    return by_prefix(c, "c_name", c.agg(F.min("c_name")).first()[0])


@query("q68_review_estimate", "SELECT CAST(ceil(count(DISTINCT conv_id) / 5) AS BIGINT) AS calls, CAST(ceil(count(DISTINCT conv_id) / 5) * 600 AS BIGINT) AS tokens, round(ceil(count(DISTINCT conv_id) / 5) * 600 / 1e6 * 2.0, 9) AS dollars FROM conversations")
def q68(spark, sf):
    n = table(spark, sf, "conversations").agg(F.countDistinct("conv_id").alias("n"))
    calls = F.ceil(F.col("n") / 5)
    return n.select(calls.alias("calls"), (calls * 600).alias("tokens"), F.round(calls * 600 / 1e6 * 2.0, 9).alias("dollars"))
