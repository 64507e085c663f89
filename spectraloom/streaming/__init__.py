"""Shortening of streams: stateless, so any streaming source, sink and trigger will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spectraloom.plans.compress import Options, compress


def compress_folder(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options = Options(), schema: str = "doc_id long, text string", **trigger: object) -> StreamingQuery:  # noqa: B008
    """Shorten the Parquet files that come into ``source``; results go to ``target``, exactly once.

    ``trigger`` is as for ``writeStream.trigger``; by default what is there now, then it ends.
    """
    out = compress(spark.readStream.schema(schema).parquet(source), options)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_totals(shortened: DataFrame, ts: str = "ts", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Texts and tokens saved by time window of a stream ``(ts, tokens_saved, ..)``; rows later than ``late`` are dropped by the watermark."""
    by = shortened.withWatermark(ts, late).groupBy(F.window(ts, window))
    return by.agg(F.count("*").alias("texts"), F.sum("tokens_saved").alias("tokens_saved"))
