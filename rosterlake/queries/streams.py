"""Queries run as streams over the given tables, once over what is there."""
from pyspark.sql import functions as F

from ..streaming import feeds as Y
from .files import PAGES_BACK, page_files, pages_in
from .registry import query


def _stream(t, name: str):
    one = getattr(t, name)
    return t.spark.readStream.schema(one.schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.root)


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM {events}")
def stream_dedupe(t):
    feed = _stream(t, "events").withColumn("k", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256))
    out = Y.drain(Y.dedupe_feed(feed, "k", "ts", "400 days"), "dedupe")
    return out.select("user_id", "event_type")


@query("stream_counts", "SELECT date_trunc('day', ts) AS window_start, event_type AS kind, count(*) AS n FROM {events} GROUP BY 1, 2 HAVING window_start < (SELECT date_trunc('day', max(ts) - INTERVAL 1 DAY) FROM {events})")
def stream_counts(t):
    return Y.drain(Y.counts_feed(_stream(t, "events"), "event_type", "ts"), "counts")


@query("stream_intake", PAGES_BACK)
def stream_intake(t):
    return Y.drain(pages_in(Y.file_feed(t.spark, page_files(t))), "intake")
