"""Token counts by heap-and-linked-list byte-pair merging, without ids."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .arrays import small_batches


def _count(path: str):
    def run(batches):
        counter = bpe.counter(path)
        try:
            for batch in batches:
                column = batch.column(batch.num_columns - 1)
                n = [counter.count(t.as_py() or "") for t in column]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])
        finally:  # the worker goes on to other tasks
            counter.forget()

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > `limit`) of each row.

    Counted as the library for the byte-level BPE .json `tokenizer` does, special
    strings in a text being one token each. A null text is empty (0 tokens), a null
    doc_id stays null, repeated rows are counted each, other columns are left out."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_count(tokenizer), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
