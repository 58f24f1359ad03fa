"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

A turn is kept, reroled (to user or assistant, 1) or deleted (2; blank turns and repeats of an earlier role and text must be);
turns with an empty text are inserted (5); a turn that ends without ``.!?`` and stays adds 5. Of the cheapest edits those
whose initials in order (D, I, K, R) are the least string are made.

Retained-subsequence DP. Deletions are priced by their running sum, so leaving a turn out costs nothing more: in front of each
turn stands, for each role that the last retained turn can have (none, s, u, a), the running minimum of what retaining later turns costs
less the deletions they save. A turn lowers a minimum by being kept or reroled after that role, and the pair of roles says what
is inserted between them (u after a or none or s, a after u). The minima are made from the end, so the audit is read from the front letter by letter: the
least letter that loses nothing begins the least audit.

In front of a block of turns the minima are min-plus linear in those behind it: a block of at most ``BLOCK`` turns is a 4 x 4 matrix. Blocks
are made from a range sort, so a conversation of most rows is spread over tasks; only its matrices (a turn is one byte and a
four-thousandth of a matrix) meet in order, then every block is walked from each role it may begin after. Texts stay in
Spark's sorted rows throughout and pass once, in order, through the digest that the contract asks for, which no
two tasks can share.

Defined results: null role, text, and null ids inside the damage key, read as one space. Rows of a conversation stand by turn (nulls first), then role and
text. A role's initial counts, whatever follows; an empty role has none and is never kept. A null conv_id is a conversation.
Repeated rows are duplicates. A conversation without rows has zeros, an empty audit and the digest of nothing. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_buffer, written

DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
#: Rows of a block, as a power of two.
BLOCK_BITS = 12
SPACES = " \t\n\x0b\f\r"
#: Roles of the last retained turn: none, system, user, assistant; what may be inserted or reroled after each.
NONE, S, U, A = range(4)
NEXT = (U, U, A, U)
#: By initial (s, u, a, other): the role after which such a turn can be kept, and that which it gives.
KEEPS = ({NONE: S}, {NONE: U, S: U, A: U}, {U: A}, {})
#: What ends a conversation after each role.
END = (0.0, 2.0 * INSERT, 1.0 * INSERT, 0.0)
SOUND, OPEN, GONE = range(3)
INF = float("inf")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with the damage of a crc32 of ``conv_id:turn`` modulo 20, null role and text as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    d = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return d.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


# --- the recurrence -------------------------------------------------------------------------


def in_front(best: tuple, code: int) -> tuple:
    """The minima in front of a turn, given those behind it. code: 3 * initial + (SOUND, OPEN or GONE)."""
    initial, state = divmod(code, 3)
    if state == GONE:
        return best
    own, new = (CUT if state == OPEN else 0) - DELETE, list(best)
    for role, after in enumerate(NEXT):
        new[role] = min(new[role], own + REROLE + best[after])
    for role, after in KEEPS[initial].items():
        new[role] = min(new[role], own + best[after])
    new[U], new[A] = min(new[U], INSERT + new[A]), min(new[A], INSERT + new[U])
    new[NONE], new[S] = min(new[NONE], INSERT + new[U]), min(new[S], INSERT + new[U])
    return tuple(new)


def matrix(codes: list[int]) -> list[list[float]]:
    """[role in front][role behind]: the cheapest edits of a block between them."""
    out = []
    for behind in range(4):
        best = tuple(0.0 if role == behind else INF for role in range(4))
        for code in reversed(codes):
            best = in_front(best, code)
        out.append([x + DELETE * len(codes) for x in best])
    return [[out[behind][front] for behind in range(4)] for front in range(4)]


def walk(codes: list[int], behind: tuple, role: int, minima: list[tuple] | None = None) -> tuple[str, int]:
    """The least audit of a block after ``role`` and the role it ends with, given the minima behind it."""
    minima = minima or front_minima(codes, behind)
    letters = []
    for i, code in enumerate(codes):
        here, there = minima[i], minima[i + 1]
        initial, state = divmod(code, 3)
        own = (CUT if state == OPEN else 0) - DELETE
        while True:
            if there[role] == here[role]:
                letters.append("D")
                break
            if INSERT + here[NEXT[role]] == here[role]:
                letters.append("I")
                role = NEXT[role]
                continue
            kept = KEEPS[initial].get(role)
            if kept is not None and own + there[kept] == here[role]:
                letters.append("K")
                role = kept
            else:
                letters.append("R")
                role = NEXT[role]
            break
    return "".join(letters), role


def front_minima(codes: list[int], behind: tuple) -> list[tuple]:
    """The minima in front of every turn of a block, and behind the last."""
    minima = [tuple(behind)]
    for code in reversed(codes):
        minima.append(in_front(minima[-1], code))
    return minima[::-1]


# --- passes over blocks ---------------------------------------------------------------------

LETTERS = "ABCDEFGHIJKL"
LEGAL = {(0, 1), (1, 2), (2, 1)}


def coded(codes: str) -> list[int]:
    return [ord(c) - 65 for c in codes]


def _matrices(batches):
    for b in batches:
        blocks = [coded(c) for c in b.column("codes").to_pylist()]
        roles = [[c // 3 for c in block] for block in blocks]
        wrong = [sum(pair not in LEGAL for pair in zip(r, r[1:], strict=False)) for r in roles]
        flat = pa.array([[x for row in matrix(block) for x in row] for block in blocks], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("place"), b.column("codes"), flat, pa.array(wrong, pa.int64())], ["conv_id", "place", "codes", "matrix", "wrong"])


def runs(batches):
    """The rows of each run of one conv_id, as dicts, from batches sorted by it."""
    run: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if run and row["conv_id"] != run[0]["conv_id"]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _behind(kind):
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("codes", pa.string()), ("behind", pa.list_(pa.float64())), ("leads", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])

    def run(batches):
        out = []
        for blocks in runs(batches):
            behind = END
            for block in reversed(blocks):
                block["behind"] = behind
                flat = block["matrix"]
                behind = tuple(min(flat[4 * front + b] + behind[b] for b in range(4)) for front in range(4))
            seams = sum((coded(x["codes"][-1])[0] // 3, coded(y["codes"][0])[0] // 3) not in LEGAL for x, y in zip(blocks, blocks[1:], strict=False))
            illegal = sum(b["wrong"] for b in blocks) + seams
            out += [{"conv_id": b["conv_id"], "place": b["place"], "codes": b["codes"], "behind": list(b["behind"]), "leads": i == 0, "cost": int(behind[NONE]), "illegal": illegal} for i, b in enumerate(blocks)]
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _walks(batches):
    for b in batches:
        audits, ends = [], []
        for codes, behind, leads in zip(b.column("codes").to_pylist(), b.column("behind").to_pylist(), b.column("leads").to_pylist(), strict=True):
            codes = coded(codes)
            minima = front_minima(codes, tuple(behind))
            found = [walk(codes, behind, role, minima) for role in ((NONE,) if leads else range(4))]
            audits.append([x for x, _ in found])
            ends.append([x for _, x in found])
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("place"), pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int64())), b.column("cost"), b.column("illegal")],
            ["conv_id", "place", "audits", "ends", "cost", "illegal"],
        )


def _repaired(kind):
    """Blocks and turns of each conversation in order: its audit and the digest of its repaired turns."""
    schema = pa.schema([("conv_id", kind), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    named = {U: b"user", A: b"assistant"}

    class Open:
        def __init__(self, block):
            self.conv_id, self.cost, self.illegal = block["conv_id"], block["cost"], block["illegal"]
            self.role, self.first, self.digest, self.audit, self.letters = NONE, True, hashlib.sha256(), [], iter(())

        def begin(self, block):
            letters = block["audits"][self.role if len(block["audits"]) > 1 else 0]
            self.audit.append(letters)
            self.letters = iter(letters)

        def put(self, role, text):
            self.digest.update((b"" if self.first else b"\n") + role + b":")
            self.digest.update(text)
            self.first = False

        def insert(self):
            self.role = NEXT[self.role]
            self.put(named[self.role], b"")

        def turn(self, role, text):
            for letter in self.letters:
                if letter == "I":
                    self.insert()
                    continue
                if letter == "R":
                    self.role = NEXT[self.role]
                    self.put(named[self.role], text)
                elif letter == "K":
                    self.role = KEEPS["sua".index(chr(role[0]))][self.role]
                    self.put(role, text)
                return

        def close(self):
            while END[self.role]:
                self.audit.append("I")
                self.insert()
            return {"conv_id": self.conv_id, "cost": self.cost, "illegal": self.illegal, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}

    def run(batches):
        now, out = None, []
        for b in batches:
            roles, role_at = text_buffer(b.column("role"))
            texts, text_at = text_buffer(b.column("text"))
            roles, texts, role_at, text_at = memoryview(roles), memoryview(texts), role_at.tolist(), text_at.tolist()
            ids, heads = b.column("conv_id").to_pylist(), b.column("block").to_pylist()
            for i, head in enumerate(heads):
                if head is not None:
                    head["conv_id"] = ids[i]
                    if now is None or now.conv_id != ids[i]:
                        if now is not None:
                            out.append(now.close())
                        now = Open(head)
                    now.begin(head)
                else:
                    now.turn(bytes(roles[role_at[i] : role_at[i + 1]]), texts[text_at[i] : text_at[i + 1]])
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            out.append(now.close())
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations with conv_id, turn, role, text."""
    ident = rows.dtypes[rows.columns.index("conv_id")][1]
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    # a prefix of the text keeps the order of the whole; the sampled bounds of the ranges stay small
    t = t.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    t = written(t.withColumn("place", F.monotonically_increasing_id()), "turns")

    body = F.rtrim(F.col("text"), F.lit(SPACES))
    state = F.when(body == "", "blank").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated").otherwise("sound")
    seen = t.select("conv_id", "turn", "role", "place", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), state.alias("state"))
    firsts = seen.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    fault = F.when(F.col("state") == "blank", "blank").when(F.col("is_first").isNull(), "duplicate").otherwise(F.col("state"))
    turns = written(seen.drop("digest").join(firsts, "place", "left").select("conv_id", "turn", "place", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "faults")

    is_fault = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), is_fault("blank"), is_fault("duplicate"), is_fault("truncated"))

    code = F.expr("3 * CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CASE fault WHEN 'sound' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END")
    letter = F.substring(F.lit(LETTERS), code + 1, F.lit(1))
    blocks = turns.groupBy("conv_id", F.shiftright("place", BLOCK_BITS).alias("block")).agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", letter.alias("code")))).alias("turns"))
    blocks = blocks.select("conv_id", F.col("first").alias("place"), F.array_join(F.transform("turns", lambda x: x["code"]), "").alias("codes"))
    kind = pa.string() if ident == "string" else pa.int64() if ident == "bigint" else pa.int32()
    blocks = blocks.mapInArrow(_matrices, f"conv_id {ident}, place long, codes string, matrix array<double>, wrong long")
    blocks = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    blocks = blocks.mapInArrow(_behind(kind), f"conv_id {ident}, place long, codes string, behind array<double>, leads boolean, cost long, illegal long")
    blocks = blocks.repartition("place").mapInArrow(_walks, f"conv_id {ident}, place long, audits array<string>, ends array<long>, cost long, illegal long")

    heads = blocks.select("conv_id", "place", F.lit(0).alias("which"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct("audits", "cost", "illegal").alias("block"))
    rest = t.select("conv_id", "place", F.lit(1).alias("which"), "role", "text", F.lit(None).cast(heads.schema["block"].dataType).alias("block"))
    stream = heads.unionByName(rest).repartition("conv_id").sortWithinPartitions("conv_id", "place", "which").select("conv_id", "role", "text", "block")
    made = stream.mapInArrow(_repaired(kind), f"conv_id {ident}, cost long, illegal long, audit string, repaired_sha256 string")
    return made.unionByName(counts, allowMissingColumns=True).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])


def with_empty(found: DataFrame, originals: DataFrame) -> DataFrame:
    """found, and every other conv_id of the originals with the result of no rows."""
    both = found.unionByName(originals.select("conv_id").distinct(), allowMissingColumns=True)
    zeros = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest()))
    return both.groupBy("conv_id").agg(*zeros, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), digest.alias("repaired_sha256"))


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return with_empty(repair(damaged(rows)), rows)


ORACLE = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS bytes
  FROM conversations
), c AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS kind FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS r,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d
), f AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
), n AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM f GROUP BY conv_id
), s AS (
  -- e: nothing, s, u or a retained last; the cheapest ends after each, from the end on
  SELECT conv_id, last AS i, e, c AS cost, x AS audit, y AS lines FROM n, (VALUES ('e', 0, '', []::VARCHAR[]), ('s', 10, 'II', ['user:', 'assistant:']), ('u', 5, 'I', ['assistant:']), ('a', 0, '', []::VARCHAR[])) v(e, c, x, y)
  UNION ALL
  SELECT conv_id, i - 1, e, p.cost, p.audit, p.lines FROM (
    SELECT conv_id, i, e, min({'cost': cost, 'audit': audit, 'lines': lines}) AS p FROM (
      SELECT s.conv_id, s.i, z.e, 2 + s.cost AS cost, 'D' || s.audit AS audit, s.lines AS lines FROM s, (VALUES ('e'), ('s'), ('u'), ('a')) z(e) WHERE s.e = z.e AND s.i > 0
      UNION ALL
      SELECT s.conv_id, s.i, m.e, 5 * len(m.ins) + m.more + CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END + s.cost, repeat('I', len(m.ins)) || m.letter || s.audit,
        list_concat(list_transform(m.ins, lambda q: q || ':'), [CASE WHEN m.letter = 'K' THEN f.role WHEN m.gives = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text], s.lines)
      FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i AND f.fault IN ('sound', 'truncated')
      JOIN (VALUES ('e', 's', 'K', 0, []::VARCHAR[]),
        ('e', 'u', 'K', 0, []), ('s', 'u', 'K', 0, []), ('a', 'u', 'K', 0, []), ('u', 'a', 'K', 0, []),
        ('u', 'u', 'K', 0, ['assistant']), ('e', 'a', 'K', 0, ['user']), ('s', 'a', 'K', 0, ['user']), ('a', 'a', 'K', 0, ['user']),
        ('e', 'u', 'R', 1, []), ('s', 'u', 'R', 1, []), ('a', 'u', 'R', 1, []), ('u', 'a', 'R', 1, []),
        ('u', 'u', 'R', 1, ['assistant']), ('e', 'a', 'R', 1, ['user']), ('s', 'a', 'R', 1, ['user']), ('a', 'a', 'R', 1, ['user'])
      ) m(e, gives, letter, more, ins) ON m.gives = s.e AND (m.letter = 'R' OR f.r = m.gives)
    ) GROUP BY conv_id, i, e
  )
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(s.cost, 0) AS BIGINT) AS cost, coalesce(s.audit, '') AS audit, sha256(coalesce(array_to_string(s.lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id AND s.i = 0 AND s.e = 'e'
"""
