"""Continuous extraction: each batch of files is read whole and published once."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..common import checkpointed
from ..plans.intake import Extracted, run_extract
from ..sources import ledger

PARTS = ("sources", "records", "warnings", "counters")
_KEYS = ["source_id", "sha256"]


def _fresh(files: DataFrame, root: str) -> DataFrame:
    """(source_id, sha256) of the files whose bytes no published batch has taken."""
    keys = checkpointed(files.select("source_id", F.sha2("content", 256).alias("sha256")).distinct())
    try:
        taken = ledger.published(files.sparkSession, root, "intake")
    except ledger.NotPublished:
        return keys
    # The batch is the small side: of all that was ever taken only its own keys are kept.
    return checkpointed(keys.join(taken.join(keys, _KEYS, "left_semi"), _KEYS, "left_anti"))


def extract_feed(feed: DataFrame, root: str, job: Callable[[DataFrame], Extracted] = run_extract) -> DataStreamWriter:
    """A stream of files(source_id, source_file, file_path, content), each once in a
    batch, to records and the job's log under `root`.

    A batch is one run of the ledger: its tables and the hashes of its files appear
    together or not at all. A batch that is given again (after a failure, or by a new
    stream whose own log was lost) finds its hashes there and writes nothing; one that
    failed half-way is read anew. A file whose bytes change is read again, and both
    readings stay, told apart by `_run`. Give the writer its checkpoint location."""

    def take(batch: DataFrame, batch_id: int) -> None:
        keys = _fresh(batch, root)
        n = keys.count()
        if n == 0:
            return
        files = batch.join(keys.select("source_id"), "source_id", "left_semi")
        done = job(files)
        tables = {"intake": keys, **{part: getattr(done, part) for part in PARTS}}
        ledger.publish(root, tables, f"batch-{batch_id}-{uuid.uuid4().hex[:8]}", {"intake": n})

    return feed.writeStream.foreachBatch(take)


def extracted(spark: SparkSession, root: str) -> Extracted:
    """All that published batches hold."""
    return Extracted(*[ledger.published(spark, root, part) for part in PARTS])
