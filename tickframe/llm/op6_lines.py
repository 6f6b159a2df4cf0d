"""Line deduplication: lines whose normalised form is frequent across documents stay in one document only.

A line's key is the line without white space at its ends, A-Z in lower case. Each document's distinct long keys are
exploded as 128-bit hashes and made distinct by (key, doc_id); grouped aggregation (combined before the shuffle, so a line
of every document costs one row a task) counts documents and finds the largest doc_id. Hashes over the threshold are
written to the shared folder before they are joined back: their size is then known, so they are broadcast where they are
few, and where they are many the join reads two plain shuffles, which adaptive execution splits at a hot hash. The keys to
drop are written by document and, as they grow with the documents, never broadcast; the document is put together again
from the lines left, in order.

Nulls: a null text counts as one empty line; a null doc_id counts as no document: its lines are neither counted nor
dropped, and such rows are not shuffled. Rows that share a doc_id count as one document and all keep or lose a line alike.
Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, workers

#: The white space stripped from a line.
STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, if the key has at least min_chars code points."""
    k = line.strip(STRIP).lower()  # bytes.lower() changes A-Z only
    if len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(k)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_dedup(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (of the lines left), n_lines, n_dropped and the columns of extra, one row for each input row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *extra)

    def keys(batches):
        for b in batches:
            found = [list({h for x in set(_lines(t)) if (h := _key(x, min_chars))}) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "keys": pa.array(found, pa.list_(pa.binary()))})

    held = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(workers.by_task(keys), "doc_id long, keys array<binary>").select("doc_id", F.explode("keys").alias("key"))
    once = held.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    often = once.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= min_docs)
    frequent = common.materialize(often.select("key", "last")).df
    lost = held.join(frequent, "key").where(F.col("doc_id") < F.col("last")).groupBy("doc_id").agg(F.collect_set("key").alias("drop"))
    drop = common.materialize(lost).df

    def cut(batches):
        for b in batches:
            texts, sizes, dropped = [], [], []
            for t, d in zip(b.column("text").to_pylist(), b.column("drop").to_pylist()):
                lines = _lines(t)
                sizes.append(len(lines))
                if d:
                    d = set(d)
                    kept = [x for x in lines if _key(x, min_chars) not in d]
                    dropped.append(len(lines) - len(kept))
                    t = b"\n".join(kept).decode("utf-8", "surrogatepass")
                else:
                    dropped.append(0)
                texts.append(t or "")
            yield pa.record_batch({"doc_id": b.column("doc_id"), **{c: b.column(c) for c in extra}, "text": pa.array(texts, pa.string()), "n_lines": pa.array(sizes, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    named = docs.where("doc_id IS NOT NULL").join(drop.hint("merge"), "doc_id", "left").select("doc_id", *extra, "text", "drop")
    nameless = docs.where("doc_id IS NULL").select("doc_id", *extra, "text", F.lit(None).cast("array<binary>").alias("drop"))
    return named.unionByName(nameless).mapInArrow(workers.by_task(cut), f"doc_id long, {kept}text string, n_lines long, n_dropped long")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(common.table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, f.key IS NOT NULL AND doc_id < last AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
