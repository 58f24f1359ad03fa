"""The robots gate: bodies parsed once a host into rules, each URL decided by the rules whose paths begin its own.

A body is read line by line as a state machine, which here is a window over one host's lines: a record is the agents that
follow one another and the rules after them, and an empty line ends it. The record that applies is the first that names the
agent, else the first for ``*``. Of its rules the first whose path begins the URL's path decides, in the order of the file; a ``*``
inside a path stands for itself. A URL meets only the rules of its host that have one of the host's rule lengths and the same
prefix, so no body and no list of rules travels beside a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import WORD_SAFE, percent_encoded
from ..storage import written

# What ends a line, and the fields that belong to a record.
LINE_END = r"\r\n|[\n\x0B\f\r\x1c-\x1e\u0085\u2028\u2029]"
RULES = ["allow", "disallow", "crawl-delay", "request-rate"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _unquoted(c: Column) -> Column:
    """Percent escapes decoded as UTF-8; a plus sign and a broken escape stay."""
    safe = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(c, F.lit("%")), F.url_decode(safe)).otherwise(c)


def _quoted(c: Column) -> Column:
    return percent_encoded(c, "[/" + WORD_SAFE[1:])


def _comparable(c: Column) -> Column:
    """A decoded path, with its query and fragment, without empty parts, encoded in one way."""
    c = F.regexp_replace(c, r"#$", "")
    c = F.regexp_replace(c, r"^([^?#]*)\?(?=#|$)", "$1")
    return _quoted(F.regexp_replace(c, r"^((?:[^?#]*/)?[^/;?#]*);(?=[?#]|$)", "$1"))


def url_path(url: Column) -> Column:
    """What of a URL rules are compared with; ``/`` where nothing follows the host."""
    rest = _comparable(F.regexp_replace(_unquoted(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""))
    return F.when(rest == "", "/").otherwise(rest)


def records(robots: DataFrame) -> DataFrame:
    """(host, record, pos, field, value): the lines of records with rules, agents and rules in the order of the file.

    robots: (host, body). A host has one body; of several the greatest counts. A window spans one body's lines.
    """
    bodies = robots.where("body IS NOT NULL").groupBy("host").agg(F.max("body").alias("body"))
    lines = bodies.select("host", F.posexplode(F.split("body", LINE_END)).alias("pos", "line"))
    text = _strip(F.regexp_replace("line", "(?s)#.*", ""))
    field = F.when(F.contains(text, F.lit(":")), F.lower(_strip(F.substring_index(text, ":", 1))))
    value = _unquoted(_strip(F.substr(text, F.instr(text, ":") + 1)))
    lines = lines.select("host", "pos", F.when(F.col("line") == "", "").otherwise(field).alias("field"), value.alias("value")).where(F.col("field").isin("", "user-agent", *RULES))
    order = Window.partitionBy("host").orderBy("pos")
    opens = (F.col("field") == "user-agent") & ~F.lag("field").over(order).eqNullSafe("user-agent")
    lines = lines.withColumn("opens", opens)
    lines = lines.withColumns({"record": F.count_if("opens").over(order), "blanks": F.count_if(F.col("field") == "").over(order)})
    # an empty line ends a record: what follows belongs to it no more
    start = F.min("blanks").over(Window.partitionBy("host", "record"))
    lines = lines.withColumn("within", (F.col("record") > 0) & (F.col("blanks") == start) & (F.col("field") != ""))
    lines = lines.withColumn("rules", F.count_if(F.col("within") & (F.col("field") != "user-agent")).over(Window.partitionBy("host", "record")))
    return lines.where("within AND rules > 0").select("host", "record", "pos", "field", "value")


def record_for(found: DataFrame, agent: str) -> DataFrame:
    """found, only the record of each host that applies to the agent."""
    named = F.col("field") == "user-agent"
    agents = found.where(named).groupBy("host", "record").agg(
        F.bool_or(F.col("value") == "*").alias("default"),
        F.bool_or(F.lit(agent.split("/")[0].lower()).contains(F.lower("value"))).alias("names"),
    )
    chosen = agents.groupBy("host").agg(F.coalesce(F.min(F.when(F.col("names") & ~F.col("default"), F.col("record"))), F.min(F.when(F.col("default"), F.col("record")))).alias("record"))
    return found.join(chosen, ["host", "record"], "left_semi").where(~named)


def rules_for(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, pos, prefix, allow): the rules of each host for the agent. An empty path to disallow allows all."""
    rules = record_for(written(records(robots), "robots"), agent).where(F.col("field").isin("allow", "disallow"))
    return rules.select("host", "pos", _comparable(F.col("value")).alias("prefix"), ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"))


def crawl_delays(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, delay): whole seconds that a host asks the agent to wait; the last line of its record counts."""
    delays = record_for(written(records(robots), "robots"), agent).where((F.col("field") == "crawl-delay") & F.col("value").rlike(r"^\s*\d+\s*$"))
    return delays.groupBy("host").agg(F.max_by(_strip(F.col("value")).cast("int"), "pos").alias("delay"))


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls (host, url, ...) plus allowed; a host whose body is null or missing denies everything, one without a rule that applies nothing.

    A host and path is decided once, however many rows have it; a host of most URLs is spread by its paths.
    """
    rules = written(rules_for(robots, agent).withColumn("length", F.length("prefix")), "rules")
    known = robots.where("body IS NOT NULL").select("host").distinct()
    hosts = known.join(rules.groupBy("host").agg(F.collect_set("length").alias("lengths")), "host", "left")
    keyed = urls.withColumn("_path", url_path(F.col("url")))
    targets = keyed.select("host", "_path").distinct().join(hosts, "host")
    fitting = F.filter(F.coalesce("lengths", F.expr("cast(array() as array<int>)")), lambda n: n <= F.length("_path"))
    tries = targets.withColumn("length", F.explode_outer(fitting)).withColumn("prefix", F.substr(F.col("_path"), F.lit(1), F.col("length")))
    hits = tries.join(rules, ["host", "length", "prefix"], "left")
    decided = hits.groupBy("host", "_path").agg(F.coalesce(F.min_by("allow", "pos"), F.lit(True)).alias("allowed"))
    return keyed.join(decided, ["host", "_path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False))).select(*urls.columns, "allowed")
