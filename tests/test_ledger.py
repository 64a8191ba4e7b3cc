"""Results appear whole or not at all; continuous extraction takes each file once."""
import pytest
from pyspark.sql import functions as F

from rosterlake.plans.intake import Extracted
from rosterlake.sources import ledger as G
from rosterlake.streaming.extraction import PARTS, extract_feed, extracted

FILES = "source_id string, source_file string, file_path string, content binary"


def test_a_rerun_replaces_and_a_failed_one_leaves_the_former(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda n, v: spark.range(n).withColumn("v", F.lit(v))
    with pytest.raises(G.NotPublished):
        G.published(spark, root, "cells")
    G.publish(root, {"cells": rows(5, "a"), "notes": rows(0, "a")}, planned={"cells": 5})
    G.publish(root, {"cells": rows(2, "x"), "notes": rows(1, "x")}, "other one/2")
    with pytest.raises(G.WrongSize):
        G.publish(root, {"notes": rows(9, "b"), "cells": rows(7, "b")}, planned={"cells": 8})
    bad = rows(4, "c").withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        G.publish(root, {"notes": rows(3, "c"), "cells": bad})
    read = lambda name, **o: sorted((r.id, r.v) for r in G.published(spark, root, name, **o).collect())
    assert read("cells", run="job") == [(k, "a") for k in range(5)] and read("notes", run="job") == []
    G.publish(root, {"cells": rows(3, "d"), "notes": rows(1, "d")})
    assert read("cells", run="job") == [(k, "d") for k in range(3)] and read("notes", run="job") == [(0, "d")]
    assert read("cells", run="other one/2") == [(0, "x"), (1, "x")]
    assert len(read("cells")) == 5
    assert [r.n for r in G.manifest(spark, root).filter("name = 'cells'").orderBy("seq").collect()] == [5, 2, 3]


def test_own_column_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="_run"):
        G.publish(str(tmp_path), {"t": spark.range(1).withColumn("_run", F.lit(1))})


def _job(fail=()):
    """Sizes of files as records; a stand-in for the whole job that can be made to fail."""

    def run(files):
        stop = F.col("source_id").isin(*fail) if fail else F.lit(False)
        n = F.when(stop, F.raise_error(F.lit("executor lost"))).otherwise(F.octet_length("content"))
        return Extracted(*[files.select("source_id", n.alias("n"), F.lit(part).alias("part")) for part in PARTS])

    return run


def _put(spark, path, names, text="x"):
    spark.createDataFrame([(k, f"{k}.txt", f"/{k}.txt", bytearray((text * (i + 1)).encode())) for i, k in enumerate(names)], FILES).coalesce(1).write.mode("append").parquet(path)


def _run(spark, tmp_path, job, log="log"):
    feed = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = extract_feed(feed, str(tmp_path / "out"), job).option("checkpointLocation", str(tmp_path / log)).trigger(availableNow=True).start()
    q.awaitTermination()


def _records(spark, tmp_path):
    return sorted((r.source_id, r.n) for r in extracted(spark, str(tmp_path / "out")).records.collect())


def test_a_stopped_stream_goes_on_and_writes_nothing_twice(spark, tmp_path):
    _put(spark, str(tmp_path / "in"), ["a", "b"])
    _run(spark, tmp_path, _job())
    _put(spark, str(tmp_path / "in"), ["c", "d"])
    with pytest.raises(Exception):
        _run(spark, tmp_path, _job(fail=("d",)))
    assert _records(spark, tmp_path) == [("a", 1), ("b", 2)]
    _put(spark, str(tmp_path / "in"), ["e"])
    _run(spark, tmp_path, _job())
    want = [("a", 1), ("b", 2), ("c", 1), ("d", 2), ("e", 1)]
    assert _records(spark, tmp_path) == want
    # A stream that lost its own log is given every file again.
    _run(spark, tmp_path, _job(fail=("a", "b", "c", "d", "e")), "new log")
    assert _records(spark, tmp_path) == want
    # Changed bytes are read again, the same bytes under the same id are not.
    _put(spark, str(tmp_path / "in"), ["a", "b"], "yz")
    _put(spark, str(tmp_path / "in"), ["c", "d"])
    _run(spark, tmp_path, _job(), "new log")
    assert _records(spark, tmp_path) == sorted(want + [("a", 2), ("b", 4)])
