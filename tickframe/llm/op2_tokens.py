"""Token counts: batches balanced by bytes are encoded in Arrow functions that return lengths only.

Texts are cut at boundaries the tokenizer's own splitting never crosses (see units), so a long text is encoded in short
parts and the counts add up to those of the whole text. Only distinct parts reach the tokenizer.

Nulls: a null text counts as empty and has no tokens. Rows are independent: repeated rows give repeated results. Other
columns of the input are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, units, workers

_loaded: dict = {}


def _counter(path: str):
    """(tokenizer, counts known) of this worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = (t, units.Memory())
    return _loaded[path]


def _counts(path: str, distinct: list[str]) -> np.ndarray:
    tokenizer, known = _counter(path)
    counts = [known.get(u) for u in distinct]
    new = [k for k, n in enumerate(counts) if n is None]
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        for k, e in zip(part, tokenizer.encode_batch_fast([distinct[k] for k in part], add_special_tokens=False)):
            counts[k] = n = len(e.ids)
            known.keep(distinct[k], n)
    return np.array(counts, np.int64)


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens), one row for each input row.

    tokenizer: path of a .json file of a byte-level BPE that splits words before white space.
    """

    def count(batches):
        for b in units.balanced(batches):
            text = pc.fill_null(b.column("text"), "")
            distinct, number, offsets = units.split(text)
            n = units.sums(_counts(tokenizer, distinct.to_pylist())[number], offsets)
            size = pc.binary_length(text.cast(pa.binary())).cast(pa.int64())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})
        _counter(tokenizer)[1].clear()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return docs.mapInArrow(workers.by_task(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
