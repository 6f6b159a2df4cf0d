"""Substring deduplication by difference-cover anchors.

A window is `window` consecutive words of one document; a word goes if some window that covers it also starts in a
document with a smaller doc_id. Hashing every window of the corpus would move one entry a word. Instead:

1. Anchors of `span` words are hashed only at positions whose residue modulo `period` lies in a difference cover, so any
   two equal windows hold one equal anchor at aligned positions (period - 1 + span = window). Each batch of documents
   sends the distinct anchors to buckets by hash, 5 bytes each, and gets back one bit each: found in another document.
2. Only windows around a shared anchor are extended: their full hash goes to buckets with the batch's smallest doc_id,
   and one bit comes back: some other batch has a smaller one.
3. The batch marks covered words and joins what is left.

Buckets receive one entry a batch for any hash, however frequent the passage, so copies and boilerplate make no hot
group, and no pairs are ever formed. Batches are dealt by doc_id; the shuffled text is read by all three steps.

Nulls: a null text counts as empty; a null doc_id neither removes nor loses words. Rows that share a doc_id do not remove
each other's words. Texts under `window` words are kept whole. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words, workers

#: A difference cover modulo 7; every residue is a difference of two of its members.
COVER = (0, 1, 3)
PERIOD = 7
_LOW40 = np.uint64((1 << 40) - 1)


class _Batch:
    """The documents of one batch in a fixed order, with everything the steps recompute from their texts."""

    def __init__(self, rows: pa.Table, window: int, buckets: int):
        ids = rows["doc_id"].to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.window, self.buckets, self.span = window, buckets, window - PERIOD + 1
        self.h, self.at = words.all_word_hashes(self.texts)
        size = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(self.h)) - self.at[:-1][self.doc]
        left = size[self.doc] - inside  # words from here to the end of the document
        known = np.array([i is not None for i in self.ids], bool)
        fits = (size >= window) & known
        self.fits = fits[self.doc]
        self.left = left
        self.anchor = np.flatnonzero(self.fits & (left >= self.span) & np.isin(inside % PERIOD, COVER))
        #: Documents of the same doc_id count as one.
        same = np.array([0, *(int(a != b) for a, b in zip(self.ids, self.ids[1:]))], np.int64)[: len(self.ids)]
        self.rank = np.cumsum(same)

    def anchors(self):
        """Distinct anchor keys (bucket << 40 | 40 bits), sorted; for each anchor position its key's number; shared in this batch."""
        h = words.rolling(self.h, self.span, words.coefficients(self.span, 11))[self.anchor]
        key = ((h >> np.uint64(40)) % np.uint64(self.buckets) << np.uint64(40)) | (h & _LOW40)
        keys, number = np.unique(key, return_inverse=True)
        rank = self.rank[self.doc[self.anchor]]
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
        np.minimum.at(low, number, rank)
        np.maximum.at(high, number, rank)
        return keys, number, low < high

    def windows(self, number: np.ndarray, shared: np.ndarray):
        """Candidate window starts; their distinct (bucket, hash, check) with the batch's smallest rank; number of each start's entry."""
        n = len(self.h)
        hit = np.zeros(n + PERIOD + 1, np.int64)
        hit[self.anchor[shared[number]] + 1] = 1
        np.cumsum(hit, out=hit)
        start = np.flatnonzero((hit[PERIOD : PERIOD + n] > hit[:n]) & self.fits & (self.left >= self.window))
        one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for k, (a, b) in enumerate(zip(words.coefficients(self.window, 12), words.coefficients(self.window, 13))):
            w = self.h[start + k]
            one += w * a
            two += w * b
        one, two = words.mix(one), words.mix(two)
        order = np.lexsort((start, two, one))  # start also orders by rank: documents lie in order of doc_id
        o, t = one[order], two[order]
        first = np.ones(len(order), bool)
        first[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
        group = np.cumsum(first) - 1
        number = np.empty(len(order), np.int64)
        number[order] = group
        rank = self.rank[self.doc[start[order][first]]]
        bucket = (t[first] >> np.uint64(40)) % np.uint64(self.buckets)
        turn = np.argsort(bucket, kind="stable")
        back = np.empty(len(turn), np.int64)
        back[turn] = np.arange(len(turn))
        return start, bucket[turn], o[first][turn], t[first][turn].astype(np.uint32), rank[turn], back[number] if len(turn) else number

    def first_id(self) -> np.ndarray:
        """doc_id by rank."""
        ids = np.zeros(int(self.rank[-1]) + 1 if len(self.rank) else 0, np.int64)
        for r, i in zip(self.rank, self.ids):
            ids[r] = i if i is not None else 0
        return ids


def _slices(bucket: np.ndarray):
    """(bucket, from, to) of each run in a sorted array."""
    if len(bucket):
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        yield from zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)])


def _bits(replies: list[tuple[int, bytes]], bucket: np.ndarray) -> np.ndarray:
    """The replies' bits in the order of the sorted entries."""
    by = dict(replies)
    parts = [np.unpackbits(np.frombuffer(by[b], np.uint8), count=to - at) for b, at, to in _slices(bucket)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


_SENT = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("entries", pa.binary()), ("bits", pa.binary())])
_REPLY = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _send(batch: int, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([batch] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=_SENT)


def _answer(rows: pa.Table, bits: np.ndarray, sizes: list[int]) -> pa.Table:
    out, at = [], 0
    for n in sizes:
        out.append(np.packbits(bits[at : at + n]).tobytes())
        at += n
    return pa.table([rows["batch"], rows["bucket"], pa.array(out, pa.binary())], schema=_REPLY)


def _anchor_bucket(rows):
    entries = rows["entries"].to_pylist()
    sizes = [len(e) // 5 for e in entries]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(entries), np.uint8).reshape(-1, 5)
    key = wide.view(np.uint64).ravel()
    flag = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows["bits"].to_pylist(), sizes)])
    order = np.argsort(key, kind="stable")
    first = np.r_[True, key[order][1:] != key[order][:-1]]
    group = np.cumsum(first) - 1
    many = (np.bincount(group) > 1) | (np.bincount(group, weights=flag[order]) > 0)
    bits = np.empty(len(key), bool)
    bits[order] = many[group]
    return _answer(rows, bits, sizes)


_WINDOW = np.dtype([("hash", "<u8"), ("check", "<u4"), ("doc", "<i8")])


def _window_bucket(rows):
    entries = rows["entries"].to_pylist()
    sizes = [len(e) // _WINDOW.itemsize for e in entries]
    x = np.frombuffer(b"".join(entries), _WINDOW)
    order = np.lexsort((x["doc"], x["check"], x["hash"]))
    s = x[order]
    first = np.ones(len(s), bool)
    first[1:] = (s["hash"][1:] != s["hash"][:-1]) | (s["check"][1:] != s["check"][:-1])
    least = s["doc"][first][np.cumsum(first) - 1]
    bits = np.empty(len(s), bool)
    bits[order] = least < s["doc"]
    return _answer(rows, bits, sizes)


def substring_dedup(documents: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, text without the removed words (joined by one space), n_words, n_removed, one row for each input row."""
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words at least")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n = common.pieces(docs)
    docs = docs.withColumn("batch", common.batch_of(n)).repartition(common.shuffle_partitions(docs.sparkSession), "batch")

    def send_anchors(key, rows):
        b = _Batch(rows, window, n)
        keys, _, shared = b.anchors()
        low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5]
        return _send(key[0].as_py(), [(k, low[i:j].tobytes(), np.packbits(shared[i:j]).tobytes()) for k, i, j in _slices(keys >> np.uint64(40))])

    def candidates(b: _Batch, replies: list[tuple[int, bytes]]):
        keys, number, _ = b.anchors()
        return b.windows(number, _bits(replies, keys >> np.uint64(40)))

    def replies_of(rows: pa.Table, kind: int) -> list[tuple[int, bytes]]:
        kinds = rows["kind"].to_pylist() if "kind" in rows.column_names else [kind] * len(rows)
        return [(b, x) for k, b, x in zip(kinds, rows["bucket"].to_pylist(), rows["bits"].to_pylist()) if k == kind]

    def send_windows(key, rows, replies):
        b = _Batch(rows, window, n)
        _, bucket, one, two, rank, _ = candidates(b, replies_of(replies, 0))
        x = np.empty(len(one), _WINDOW)
        x["hash"], x["check"], x["doc"] = one, two, b.first_id()[rank]
        return _send(key[0].as_py(), [(k, x[i:j].tobytes(), b"") for k, i, j in _slices(bucket)])

    def finish(key, rows, replies):
        b = _Batch(rows, window, n)
        start, bucket, _, _, rank, number = candidates(b, replies_of(replies, 0))
        smaller = _bits(replies_of(replies, 1), bucket)
        gone = smaller[number] | (rank[number] < b.rank[b.doc[start]]) if len(start) else np.zeros(0, bool)
        step = np.zeros(len(b.h) + 1, np.int64)
        np.add.at(step, start[gone], 1)
        np.add.at(step, start[gone] + window, -1)
        keep = np.cumsum(step)[:-1] == 0
        texts, sizes, removed = [], [], []
        for i, t in enumerate(b.texts):
            k = keep[b.at[i] : b.at[i + 1]]
            w = t.split()
            n_gone = len(k) - int(np.count_nonzero(k))
            texts.append(b" ".join(compress(w, k.tolist()) if n_gone else w).decode("utf-8", "surrogatepass"))
            sizes.append(len(w))
            removed.append(n_gone)
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "text": pa.array(texts, pa.string()), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    sent, reply = "batch int, bucket int, entries binary, bits binary", "batch int, bucket int, bits binary"
    known = docs.groupBy("batch").applyInArrow(workers.by_group(send_anchors), sent).groupBy("bucket").applyInArrow(workers.by_group(_anchor_bucket), reply)
    found = docs.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(workers.by_group(send_windows), sent).groupBy("bucket").applyInArrow(workers.by_group(_window_bucket), reply)
    both = known.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1)))
    return docs.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(workers.by_group(finish), "doc_id long, text string, n_words long, n_removed long")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(common.table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: every window of every document, no anchors.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS p FROM w
), h AS (
  SELECT doc_id, p, array_to_string(ws[p:p+12], ' ') AS s FROM g
), m AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM h
), c AS (
  SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM m WHERE gone) GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(qs), 0) AS n_removed,
         CASE WHEN qs IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(qs, x[2])), lambda x: x[1]) END AS kept
  FROM w LEFT JOIN c USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
