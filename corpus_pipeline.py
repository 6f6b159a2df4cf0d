"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

language     rejects documents without text in a known language
lines        cuts lines that many documents repeat
near_copies  keeps the document with the least doc_id of each group of linked ones
mix          takes each document as often as the sources' target weights ask for
pieces       encodes what is left
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import common, op3_jaccard, op6_lines, op7_pieces, op9_language, op10_mix

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language of the corpus; `lang` is the declared language, the source stands for the host."""
    model = op9_language.fit(docs.select("text", "lang"))
    if not model.languages:
        return docs.where("false").select(*COLUMNS)
    found = op9_language.identify(docs.select(*COLUMNS), model, declared="lang", host="source")
    return found.where("NOT rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines cut from the texts, n_chars counted anew; a document stays even if none of its lines does."""
    cut = op6_lines.line_dedup(docs, extra=("lang", "source"))
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the least doc_id; documents that link with nothing stay."""
    found = op3_jaccard.jaccard_components(docs, width=5, num=80, den=100)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times. Equal rows share their copies; nothing is collected."""
    key = F.xxhash64(*COLUMNS)
    taken = op10_mix.allot(docs, key=key).where("total > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("key").alias("k"), "n", "total")
    taken = common.materialize(taken).df
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("own"))
    keyed = docs.select(*COLUMNS, key.alias("own"))
    # what is taken grows with the documents, so it is never broadcast; both joins read one shuffle of the documents
    one = keyed.join(taken.where("n = 1").hint("merge"), same).select(*COLUMNS, "total")
    # groups of equal rows are combined to one before they are taken as often as all of them together
    many = keyed.join(taken.where("n > 1").hint("merge"), same).groupBy(*COLUMNS, "total").agg(F.count(F.lit(1)).alias("rows")).select(*COLUMNS, "total")
    return op10_mix.repeated(one.unionByName(many), F.col("total"), "copy").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of every document taken, and of the text they decode to."""
    return op7_pieces.sentencepiece_digest(docs, op7_pieces.default_model())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pieces", pieces)]

#: Language models, random rounding and tokenisation are not expressible; tests compare lines, near_copies and pieces with
#: brute force, language by the rows that go and stay, mix by targets, copies a document and residuals.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the table between two of them lies in the shared folder until the second is done."""
    docs = common.table(spark, sf_dir, "documents")
    out = f"{common.shared_dir(spark)}/corpus-pipeline/{uuid.uuid4().hex}"
    done = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done is not None:  # its rows are all in the table just written
            common.delete(spark, done)
        done = path
    common.delete_at_exit(spark, out)
    return docs
