"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right: the shortest piece not yet in the text's dictionary is its next phrase and enters
the dictionary. The phrases that enter are hashed, and the least hashes are the fingerprint: two texts that compress
each other well have many phrases in common, and the share of common values among the least of both estimates that.

fingerprints() works on any table. The query also compares each text with an edited one that ends as the next document
(in descending order of doc_id, the first after the last) begins. Documents are dealt by ranges of doc_id and each range
is streamed in order; its last document finds the next one in a row of the following range that is sent along, so no text
is sent more than twice and no task holds more than a batch.

Nulls: a null text counts as empty; a null doc_id comes last. An empty text has an empty fingerprint; it is like another
empty one (1) and unlike all others (0). Of equal doc_ids, the lesser text comes first; a table of one row is its own
next. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, workers

#: Hashes in a fingerprint, at most.
LEAST = 64
#: Stored bytes of a range of doc_id, about; ranges are streamed, so this bounds a task's time and not its memory.
RANGE_BYTES = 128 << 20
#: Ranges up to which their last rows are sent along by a broadcast of one small row a range; beyond it, by a join.
BROADCAST_RANGES = 1 << 17


def parse(text: str, at: int, start: int, seen: set[str]) -> tuple[int, list[str]]:
    """Parse text from position at, in the middle of the phrase that began at start: (start of the open phrase, new phrases)."""
    new = []
    for end in range(at + 1, len(text) + 1):
        piece = text[start:end]
        if piece not in seen:
            seen.add(piece)
            new.append(piece)
            start = end
    return start, new


def least(phrases: list[str], more: list[int] = ()) -> list[int]:
    """The least distinct hashes of phrases and of hashes found before, in order."""
    h = xxhash.xxh3_64_intdigest
    return heapq.nsmallest(LEAST, {*(h(p) >> 32 for p in phrases), *more})


def name(values: list[int]) -> str:
    return "".join([f"{v:08x}" for v in values])


def likeness(a: list[int], b: list[int]) -> float:
    """Estimate of the common share of two phrase sets: among the least values of both together, those in both."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    x, y = set(a), set(b)
    both = heapq.nsmallest(LEAST, x | y)
    return sum(v in x and v in y for v in both) / len(both)


class _Doc:
    """A text parsed to its end, with the state at the position where the edited text departs."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.keep = len(text) - len(text) // 2
        seen: set[str] = set()
        self.start, first = parse(text[: self.keep], 0, 0, seen)
        self.first = least(first)
        self.seen = seen.copy()
        _, rest = parse(text, self.keep, self.start, seen)
        self.print = least(rest, self.first)

    def edited(self, other: str) -> tuple[str, list[int]]:
        text = self.text[: self.keep] + other[: len(self.text) // 2]
        _, rest = parse(text, self.keep, self.start, self.seen)
        return text, least(rest, self.first)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, one row for each input row."""

    def run(batches):
        for b in batches:
            out = [name(least(parse(t or "", 0, 0, set())[1])) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fingerprint": pa.array(out, pa.string())})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    """Rows sorted by bucket, then descending; each is compared with the row after it; the bucket's last row is sent along."""
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows: list[tuple] = []
    open_, bucket = None, None
    for b in batches:
        for k, halo, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text"))):
            if k != bucket:
                open_, bucket = None, k
            elif open_ is None:  # further rows of the doc_id that was sent along
                continue
            doc = _Doc(doc_id, text or "")
            if open_ is not None:
                edited, print_ = open_.edited(doc.text)
                rows.append((open_.doc_id, len(open_.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), name(open_.print), name(print_), likeness(open_.print, print_), likeness(open_.print, doc.print)))
            open_ = None if halo else doc
            if len(rows) >= 500:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], columns)
                rows = []
    if rows:
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], columns)


def _range_of(at: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most `at`: looked up in blocks of about the square root of their number."""
    width = max(1, math.isqrt(len(cuts)))
    blocks = F.from_json(F.lit(json.dumps([cuts[i : i + width] for i in range(0, len(cuts), width)])), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps(cuts[::width])), "array<bigint>")
    block = F.size(F.filter(heads, lambda c: c <= at)) - 1
    return F.when(block < 0, 0).otherwise(block * width + F.size(F.filter(F.get(blocks, block), lambda c: c <= at)))


def edited_likeness(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row for each input row."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"))
    n = common.pieces(docs, RANGE_BYTES)
    cut = docs.agg(F.percentile_approx("at", [i / n for i in range(1, n)] or [0.5], max(10_000, 2 * n))).first()[0] or []
    docs = docs.withColumn("bucket", _range_of(F.col("at"), sorted(set(cut))))
    # one small row a range
    tops = sorted(((r["bucket"], r["top"]) for r in docs.groupBy("bucket").agg(F.max("at").alias("top")).collect()), reverse=True)
    after = [(tops[(i + 1) % len(tops)][0], tops[(i + 1) % len(tops)][1], k) for i, (k, _) in enumerate(tops)]
    halo = spark.createDataFrame(after, "bucket int, top long, into int")
    halo = F.broadcast(halo) if len(after) <= BROADCAST_RANGES else halo
    sent = docs.join(halo, "bucket", "left").select(F.explode(F.filter(F.array(F.struct("bucket", F.lit(False).alias("halo")), F.struct(F.when(F.col("at") == F.col("top"), F.col("into")).alias("bucket"), F.lit(True).alias("halo"))), lambda x: x["bucket"].isNotNull())).alias("x"), "at", "doc_id", "text").select("x.bucket", "x.halo", "at", "doc_id", "text")
    order = [F.col("bucket"), F.col("halo"), F.col("at").desc(), F.col("text")]
    dealt = sent.repartition(max(n, common.shuffle_partitions(spark)), "bucket").sortWithinPartitions(*order)
    return dealt.select("bucket", "halo", "doc_id", "text").mapInArrow(workers.by_task(_pairs), _OUT)


def op4_lempel_ziv(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(common.table(spark, sf_dir, "documents"))
