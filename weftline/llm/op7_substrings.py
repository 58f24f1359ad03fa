"""Exact substring dedup: bytes covered by a 50-byte string that also starts in an earlier document go.

Suffix sorting, sparsely: every 50-byte window has one anchor, the leftmost position of the smallest hash among
its K-byte strings. Equal windows have their anchor at the same offset, so only suffixes that start at anchors
(about one byte in 14) need sorting, and of those only the suffixes whose K bytes occur in two different texts.

1. Equal texts become one (aggregated before any shuffle); later copies of at least 50 bytes go whole.
2. Batches of texts send the distinct hashes of their anchors to hash buckets and get back those that another
   text has too.
3. The remaining suffixes (with the bytes before them that their windows need; equal ones of a batch are one,
   with their smallest document) are range-partitioned by their leading bytes between splitters from a bounded sample; with
   more than RANGES buckets each range is dealt on by a hash of the same bytes. A
   bucket sorts its suffixes by multikey quicksort (word by word, only inside runs of ties). Suffixes with equal
   leading bytes never part, so no comparison crosses a bucket's boundary. Neighbours that agree on all
   their bytes share all windows; in runs that agree on the first K bytes only, the windows are compared.
4. Every window's smallest document goes back to its batch, which takes off the covered bytes.

A passage in a third of all documents costs a bucket one record a batch, whatever its number of copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, BYTE_CODES, mix64, parts_for, powers, table, written

K, BATCH_BYTES, SEGMENT, ASK_BUCKET, SORT_BUCKET = 24, 6_000_000, 1_000_000, 1_500_000, 400_000
#: Ranges at most, sampled suffixes a range, and sampled suffixes of one text at most: what the driver sees is bounded by them.
RANGES, PER_RANGE, PER_TEXT = 1024, 64, 4096
POSITION = np.uint64((1 << 24) - 1)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values (van Herk: prefix and suffix minima of blocks of w)."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = np.concatenate((x, np.full(-n % w, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: np.ndarray, offsets: np.ndarray, window: int = 50, k: int = K):
    """(text, place, first window, last window, hash) of each anchor with the windows it stands for, in order."""
    spread = window - k + 1
    out = []
    inv, pw = powers(BASE_INV, SEGMENT + window), powers(BASE, SEGMENT + window)
    for s in range(0, max(0, len(raw) - window + 1), SEGMENT):
        part = raw[s : s + SEGMENT + window - 1]
        n = len(part)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[part] * pw[:n], out=prefix[1:])
        h = mix64((prefix[k:] - prefix[:-k]) * inv[: n - k + 1])
        low = window_min((h & ~POSITION) | np.arange(len(h), dtype=np.uint64), spread)
        at = (low & POSITION).astype(np.int64)
        first = np.arange(len(at)) + s
        doc = np.searchsorted(offsets, first, side="right") - 1
        ok = first + window <= offsets[doc + 1]
        at, first, doc = at[ok], first[ok], doc[ok]
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
        last = np.concatenate((new[1:], [len(at)])) - 1
        out.append((doc[new], at[new] + s, first[new], first[last], h[at[new]]))
    if not out:
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x stand in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def batch_buffer(pdf: pd.DataFrame):
    """The texts of a batch in one buffer, in the order of their digests."""
    pdf = pdf.sort_values("digest", kind="stable")
    texts = [bytes(x) for x in pdf["raw"]]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return pdf, np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def asked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a batch, and which of them two of its texts have."""
    _, raw, offsets = batch_buffer(pdf)
    doc, _, _, _, h = anchors(raw, offsets)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    end = np.concatenate((start[1:], [len(h)]))[: len(start)] - 1
    return h[start], doc[start] != doc[end]


def records(pdf: pd.DataFrame, shared: np.ndarray, window: int = 50):
    """The suffixes of a batch that others may share.

    Returns (frame, buffer, offsets, anchors' text, place, first and last window, record of each anchor, records'
    bytes, low, high): a record is the bytes from window - K before the anchor to window after it, zero
    outside the anchor's windows, with the windows' offsets before the anchor from low to high.
    """
    pdf, raw, offsets = batch_buffer(pdf)
    doc, at, first, last, h = anchors(raw, offsets, window)
    keep = among(h, np.sort(shared))
    doc, at, first, last = doc[keep], at[keep], first[keep], last[keep]
    left = window - K
    cols = np.arange(-left, window)
    ctx = np.zeros((len(at), len(cols) + 2), dtype=np.uint8)
    for s in range(0, len(at), 200_000):
        e = slice(s, s + 200_000)
        place = at[e, None] + cols[None, :]
        inside = (place >= first[e, None]) & (place < last[e, None] + window)
        ctx[e, :-2] = np.where(inside, raw[np.clip(place, 0, max(0, len(raw) - 1))], 0)
    ctx[:, -2], ctx[:, -1] = at - last, at - first
    rec, of = np.unique(ctx.view(f"V{ctx.shape[1]}").ravel(), return_inverse=True) if len(ctx) else (ctx[:0].view(f"V{ctx.shape[1]}").ravel(), np.zeros(0, np.int64))
    rec = rec.view(np.uint8).reshape(-1, ctx.shape[1])
    return pdf, raw, offsets, doc, at, of.ravel(), rec[:, :-2], rec[:, -2], rec[:, -1]


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 8-byte words, so that words compare like bytes."""
    pad = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    pad[:, : rows.shape[1]] = rows
    return pad.view(">u8").astype(np.uint64)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the run of equal rows each sorted place belongs to: one word at a time, in runs of ties only."""
    n = len(words)
    order, run = np.arange(n), np.zeros(n, dtype=np.int64)
    todo = np.arange(n)
    for c in range(words.shape[1]):
        if len(todo) < 2:
            break
        key = words[order[todo], c]
        by = np.lexsort((key, run[todo]))
        order[todo], key = order[todo][by], key[by]
        r = run[todo]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (key[1:] != key[:-1])))
        start = np.flatnonzero(new)
        run[todo] = todo[start][np.cumsum(new) - 1]
        size = np.diff(np.concatenate((start, [len(todo)])))
        todo = todo[np.repeat(size, size) > 1]
    return order, run


def least_docs(ctx: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, window: int = 50):
    """(record, from, to, doc): the windows at offsets from..to before a record's anchor start first in doc.

    Only windows that a smaller document than the record's own has are returned.
    """
    left = window - K
    full = np.column_stack((ctx[:, left:], ctx[:, :left], low[:, None], high[:, None]))
    order, run = multikey_sort(words_of(full))
    best = np.full(len(ctx), np.iinfo(np.int64).max)
    np.minimum.at(best, run, doc[order])
    first = order[np.unique(run)]  # one of each kind of record
    kind = np.searchsorted(np.unique(run), run)
    of = np.empty(len(ctx), dtype=np.int64)
    of[order] = kind
    kind_doc = best[np.unique(run)]
    lead = words_of(ctx[first, left : left + K])
    new = np.concatenate(([True], (lead[1:] != lead[:-1]).any(axis=1))) if len(lead) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    size = np.bincount(group, minlength=0)
    out_kind, out_j, out_doc = [], [], []
    many = np.flatnonzero(size[group] > 1) if len(group) else np.zeros(0, np.int64)
    total = np.cumsum((high[first] - low[first] + 1)[many].astype(np.int64)) if len(many) else many
    s = 0
    while s < len(many):
        e = int(np.searchsorted(total, (total[s - 1] if s else 0) + 400_000)) + 1
        while e < len(many) and group[many[e]] == group[many[e - 1]]:
            e += 1
        k = many[s:e]
        count = (high[first[k]].astype(np.int64) - low[first[k]] + 1)
        rep = np.repeat(np.arange(len(k)), count)
        j = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + low[first[k]][rep]
        rows = np.empty((len(rep), window + 4), dtype=np.uint8)
        rows[:, :4] = group[k][rep].astype(">u4").view(np.uint8).reshape(-1, 4)
        for t in range(0, len(rep), 100_000):
            x = slice(t, t + 100_000)
            rows[x, 4:] = ctx[first[k][rep[x]][:, None], (left - j[x])[:, None] + np.arange(window)[None, :]]
        o, r = multikey_sort(words_of(rows))
        b = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(b, r, kind_doc[k][rep[o]])
        mine = np.empty(len(rep), dtype=np.int64)
        mine[o] = b[r]
        out_kind.append(k[rep])
        out_j.append(j)
        out_doc.append(mine)
        s = e
    alone = np.flatnonzero(size[group] == 1) if len(group) else np.zeros(0, np.int64)
    if out_kind:
        wk, wj, wd = np.concatenate(out_kind), np.concatenate(out_j), np.concatenate(out_doc)
        cut = np.concatenate(([True], (wk[1:] != wk[:-1]) | (wd[1:] != wd[:-1]) | (wj[1:] != wj[:-1] + 1)))
        a = np.flatnonzero(cut)
        z = np.concatenate((a[1:], [len(wk)])) - 1
        seg = pd.DataFrame({"kind": wk[a], "lo": wj[a], "hi": wj[z], "doc": wd[a]})
    else:
        seg = pd.DataFrame({"kind": [], "lo": [], "hi": [], "doc": []}, dtype="int64")
    seg = pd.concat([seg, pd.DataFrame({"kind": alone, "lo": low[first[alone]].astype(np.int64), "hi": high[first[alone]].astype(np.int64), "doc": kind_doc[alone]})])
    got = pd.DataFrame({"record": np.arange(len(ctx)), "kind": of, "own": doc}).merge(seg.astype("int64"), on="kind")
    return got


def removed(n: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals [start, end)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1]))) if len(s) else np.zeros(0, np.int64)
    stop = np.concatenate((new[1:], [len(s)])) - 1 if len(new) else new
    return list(zip(s[new].tolist(), e[stop].tolist(), strict=True))


def by_bucket(bucket: np.ndarray):
    """(bucket, its places in order) of the buckets that occur; the work is that of the places, however many buckets there are."""
    order = np.argsort(bucket, kind="stable")
    found = bucket[order]
    new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
    for x, y in zip(new.tolist(), [*new[1:].tolist(), len(found)], strict=False):
        yield int(found[x]), order[x:y]


def repeated_bytes(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, digest, n_bytes, spans, kept_sha256) a row of docs (doc_id, text); spans are the removed [start, end).

    Null and empty texts have no bytes. A null doc_id takes no part and keeps all. Rows that repeat a
    doc_id are not earlier than one another. An empty table gives no rows. Works on texts of any length.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    rows = rows.withColumn("digest", F.md5("raw")).withColumn("n_bytes", F.length("raw").cast("long"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = parts_for(total, BATCH_BYTES)
    unique = rows.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= window)).groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("raw").alias("raw"))
    unique = written(unique.withColumn("batch", F.pmod(F.xxhash64("digest"), F.lit(n_batches)).cast("int")), "texts")
    ask_buckets = parts_for(total // 14, ASK_BUCKET)

    def ask(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, many = asked(pdf)
        out = [(int(key[0]), b, h[i].tobytes(), many[i].tobytes()) for b, i in by_bucket((h >> np.uint64(32)) % np.uint64(ask_buckets))]
        return pd.DataFrame(out, columns=["batch", "bucket", "h", "many"])

    def answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]])
        many = np.concatenate([np.frombuffer(x, bool) for x in pdf["many"]])
        every = np.sort(np.concatenate((every, every[many])))
        both = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for batch, x in zip(pdf["batch"], pdf["h"], strict=True):
            h = np.frombuffer(x, np.uint64)
            h = h[among(h, both)]
            if len(h):
                out.append((int(batch), h.tobytes()))
        return pd.DataFrame(out, columns=["batch", "h"])

    texts = unique.select("batch", "digest", "first", "raw")
    asks = texts.groupBy("batch").applyInPandas(ask, "batch int, bucket int, h binary, many binary")
    replies = written(asks.groupBy("bucket").applyInPandas(answer, "batch int, h binary"), "shared")

    def shared_of(pdf: pd.DataFrame) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]] or [np.zeros(0, np.uint64)])

    expected = replies.agg(F.sum(F.length("h") / 8)).first()[0] or 0
    buckets = parts_for(int(expected), SORT_BUCKET)
    ranges = min(buckets, RANGES)
    splitters, deals = sampled_splitters(texts, total, ranges), parts_for(buckets, ranges)
    buckets = ranges * deals

    def send(key, mine: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        cols = ["batch", "bucket", "ids", "docs", "ctx", "low", "high"]
        if not len(mine) or not len(shared):
            return pd.DataFrame([], columns=cols)
        pdf, _, _, doc, _, of, ctx, low, high = records(mine, shared_of(shared), window)
        first = pdf["first"].to_numpy(np.int64)
        least = np.full(len(ctx), np.iinfo(np.int64).max)
        np.minimum.at(least, of, first[doc])
        left = window - K
        lead = np.ascontiguousarray(ctx[:, left : left + K])
        bucket = np.searchsorted(splitters, lead.view(f"S{K}").ravel(), side="right") * deals + dealt(lead, deals)
        out = [(int(key[0]), b, i.astype(np.int32).tobytes(), least[i].tobytes(), ctx[i].tobytes(), low[i].tobytes(), high[i].tobytes()) for b, i in by_bucket(bucket)]
        return pd.DataFrame(out, columns=cols)

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = [np.frombuffer(x, np.int32) for x in pdf["ids"]]
        batch = np.repeat(pdf["batch"].to_numpy(np.int64), [len(x) for x in ids])
        ctx = np.concatenate([np.frombuffer(x, np.uint8).reshape(len(i), -1) for x, i in zip(pdf["ctx"], ids, strict=True)])
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["docs"]])
        low, high = (np.concatenate([np.frombuffer(x, np.uint8) for x in pdf[c]]) for c in ("low", "high"))
        ids = np.concatenate(ids)
        got = least_docs(ctx, low, high, doc, window)
        i = got["record"].to_numpy()
        got["batch"], got["id"] = batch[i], ids[i]
        out = [(int(b), *(g[c].to_numpy(np.int64 if c == "doc" else np.int32).tobytes() for c in ("id", "lo", "hi", "doc"))) for b, g in got.groupby("batch")]
        return pd.DataFrame(out, columns=["batch", "id", "lo", "hi", "doc"])

    def take_off(key, mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        cols = ["digest", "first", "spans", "kept"]
        if not len(mine):
            return pd.DataFrame([], columns=cols)
        is_ask = found["doc"].isna() if len(found) else found["batch"]
        shared = found[is_ask] if len(found) else found
        if not len(shared):
            pdf, raw, offsets = batch_buffer(mine)
            starts = ends = texts = np.zeros(0, np.int64)
        else:
            pdf, raw, offsets, doc, at, of, ctx, _, _ = records(mine, shared_of(shared), window)
            segs = found[~is_ask]
            seg = {c: np.concatenate([np.frombuffer(x, np.int64 if c == "doc" else np.int32) for x in segs[c]] or [np.zeros(0, np.int32)]).astype(np.int64) for c in ("id", "lo", "hi", "doc")}
            order = np.argsort(seg["id"], kind="stable")
            seg = {c: x[order] for c, x in seg.items()}
            a, z = np.searchsorted(seg["id"], of, side="left"), np.searchsorted(seg["id"], of, side="right")
            n = z - a
            who = np.repeat(np.arange(len(of)), n)
            s = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            hit = seg["doc"][s] < pdf["first"].to_numpy(np.int64)[doc[who]]
            who, s = who[hit], s[hit]
            texts = doc[who]
            starts, ends = at[who] - seg["hi"][s], at[who] - seg["lo"][s] + window
            order = np.argsort(texts, kind="stable")
            texts, starts, ends = texts[order], starts[order], ends[order]
        cut = np.searchsorted(texts, np.arange(len(pdf) + 1))
        data, out = raw.tobytes(), []
        for i, (digest, first) in enumerate(zip(pdf["digest"], pdf["first"], strict=True)):
            o, end = int(offsets[i]), int(offsets[i + 1])
            spans = removed(end - o, starts[cut[i] : cut[i + 1]] - o, ends[cut[i] : cut[i + 1]] - o)
            bounds = [0, *(x for span in spans for x in span), end - o]
            kept = b"".join([data[o + x : o + y] for x, y in zip(bounds[::2], bounds[1::2], strict=True)])
            out.append((digest, int(first), [{"start": x, "end": y} for x, y in spans], hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=cols)

    by_batch = texts.groupBy("batch")
    sent = by_batch.cogroup(replies.groupBy("batch")).applyInPandas(send, "batch int, bucket int, ids binary, docs binary, ctx binary, low binary, high binary")
    found = sent.groupBy("bucket").applyInPandas(compare, "batch int, id binary, lo binary, hi binary, doc binary")
    none = F.lit(None).cast("binary")
    found = found.withColumn("h", none).unionByName(replies.select("batch", "h", none.alias("id"), none.alias("lo"), none.alias("hi"), none.alias("doc")))
    known = by_batch.cogroup(found.groupBy("batch")).applyInPandas(take_off, "digest string, first long, spans array<struct<start:long,end:long>>, kept string")
    known = written(known, "spans")
    out = rows.join(known, "digest", "left")
    copy = F.col("first").isNotNull() & (F.col("doc_id") > F.col("first"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    own = F.col("first").isNotNull() & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        "digest",
        "n_bytes",
        F.when(copy, whole).when(own, F.col("spans")).otherwise(empty).alias("spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.col("kept")).otherwise(F.sha2("raw", 256)).alias("kept_sha256"),
    )


def dealt(lead: np.ndarray, deals: int) -> np.ndarray:
    """Which of the deals of its range a row of leading bytes goes to; equal ones together."""
    if deals < 2:
        return np.zeros(len(lead), dtype=np.int64)
    h = np.zeros(len(lead), dtype=np.uint64)
    for word in words_of(lead).T:
        h = mix64(h + word)
    return (h % np.uint64(deals)).astype(np.int64)


def sampled_splitters(texts: DataFrame, total_bytes: int, ranges: int) -> np.ndarray:
    """Splitters of the suffixes' leading bytes from texts drawn by hash, about 2 * PER_RANGE suffixes a range at most.

    One anchor in 16 of a drawn text is taken, fewer where that is more than PER_TEXT; an anchor stands for about 14 bytes.
    """
    if ranges < 2:
        return np.zeros(0, dtype=f"S{K}")
    one_in = max(1, total_bytes // (ranges * PER_RANGE * 14 * 16 * 2))
    some = texts.where(F.pmod(F.xxhash64("digest", F.lit("sample")), F.lit(one_in)) == 0).select("raw")

    def leads(batches):
        for pdf in batches:
            for raw in pdf["raw"]:
                data = bytes(raw)
                _, at, _, _, h = anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                pick = at[(h >> np.uint64(40)) % np.uint64(max(16, -(-len(at) // PER_TEXT))) == 0]
                yield pd.DataFrame({"lead": [data[p : p + K] for p in pick.tolist()]})

    got = [bytes(r.lead) for r in some.mapInPandas(leads, "lead binary").collect()]
    got = np.sort(np.array(got, dtype=f"S{K}"))
    return np.unique(got[[len(got) * i // ranges for i in range(1, ranges)]]) if len(got) else got


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


