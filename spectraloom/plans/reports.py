"""Figures for reports: percentiles, stage times, survival tables and bootstrap intervals."""

from __future__ import annotations

import time
import tracemalloc
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.functions.digest import Weights
from spectraloom.operators.graph import MAX_CHUNKS
from spectraloom.operators.spectral import DEGREE_SHARE, SPECTRAL_SHARE, second_eigenpair
from spectraloom.plans import kernel

SIZES = (100, 500, 1000, 5000, 10000, 25000, 50000, 100000)
STAGES = ("chunking", "similarity", "eigendecomposition", "scoring", "zone_detection", "compression", "total")
TIMINGS = "target_tokens int, actual_chars int, chunk_count int, stage string, run int, ms double, peak_bytes long, skipped boolean"


def stage_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median and the 95th and 99th percentiles, by linear interpolation, of ``value`` for each group."""
    at = lambda p: F.percentile(value, F.lit(p))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def eigen_warning(median_ms: Column) -> Column:
    """``CRITICAL``, ``WARNING`` or ``NOTE`` for an eigen-solve of over 30, 5 or 1 seconds, else null."""
    return F.when(median_ms > 30_000, "CRITICAL").when(median_ms > 5_000, "WARNING").when(median_ms > 1_000, "NOTE")


def made_text(tokens: int, seed: int = 42) -> str:
    """Invented prose of at least ``4 * tokens`` characters, the same for the same arguments."""
    things, acts = ("river", "ledger", "garden", "engine", "letter", "harbour", "lantern", "valley", "market", "signal", "archive", "bridge"), ("follows", "carries", "measures", "hides", "opens", "joins", "leaves", "shapes")
    state, out, size = seed * 2654435761 % (1 << 32) or 1, [], 0
    while size < 4 * tokens:
        picks = []
        for _ in range(6):
            state = (state * 1664525 + 1013904223) % (1 << 32)
            picks.append(state >> 16)
        a, b, c = (things[p % len(things)] for p in picks[:3])
        s = f"The {a} {acts[picks[3] % len(acts)]} a {b} of section {picks[4] % 900 + 100}, and each {c} {acts[picks[5] % len(acts)]} it in turn."
        out.append(s)
        size += len(s) + 1
    return " ".join(out)


def profile(spark: SparkSession, sizes: Sequence[int] = SIZES, runs: int = 5, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """``TIMINGS`` of the kernel's stages on made texts, on the driver; sizes over the limit of chunks are marked as skipped."""
    rows = []
    for tokens in sizes:
        text = made_text(tokens, seed)
        n = len(kernel.chunk(text))
        if n > MAX_CHUNKS:
            rows.append((tokens, len(text), n, None, None, None, None, True))
            continue
        tracemalloc.start()
        for run in range(runs):
            at = [time.perf_counter()]
            chunks = kernel.chunk(text)
            at.append(time.perf_counter())
            graph = kernel.adjacency(kernel.similarity(chunks))
            at.append(time.perf_counter())
            v, _ = second_eigenpair(graph)
            at.append(time.perf_counter())
            degree = graph.sum(1)
            scores = DEGREE_SHARE * degree / (degree.max() or 1) + SPECTRAL_SHARE * (1 - abs(v))
            at.append(time.perf_counter())
            weighted = [s * kernel.zone(c)[2] for s, c in zip(scores, chunks, strict=True)]
            at.append(time.perf_counter())
            gone = set(sorted(range(n), key=weighted.__getitem__)[: max(1, int(n * ratio))])
            "\n\n".join(c for k, c in enumerate(chunks) if k not in gone)
            at.append(time.perf_counter())
            spent = [b - a for a, b in zip(at, at[1:], strict=False)]
            rows += [(tokens, len(text), n, stage, run, round(1000 * s, 3), tracemalloc.get_traced_memory()[1], False) for stage, s in zip(STAGES, [*spent, at[-1] - at[0]], strict=True)]
        tracemalloc.stop()
    return spark.createDataFrame(rows, TIMINGS)


def latency(timings: DataFrame) -> DataFrame:
    """One row for each size and stage of ``TIMINGS``, in order: figures, share of the total and warning; a skipped size has one row without a stage."""
    sizes = ["target_tokens", "actual_chars", "chunk_count", "skipped"]
    rows = stage_stats(timings, [*sizes, "stage"], "ms").join(timings.groupBy("target_tokens").agg((F.max("peak_bytes") / 2**20).alias("peak_mb")), "target_tokens")
    total = F.max(F.when(F.col("stage") == "total", F.col("median"))).over(Window.partitionBy("target_tokens"))
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    rows = rows.withColumns({"share": F.col("median") / F.nullif(total, F.lit(0)), "warning": F.when(F.col("stage") == "eigendecomposition", eigen_warning(F.col("median")))})
    return rows.orderBy("target_tokens", place).select(*sizes, "stage", "mean", "median", "p95", "p99", "share", "peak_mb", "warning")


def survival_filtered(values: DataFrame, leaks: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """``model, cond, all_n, all_mean, filtered_n, filtered_mean`` of ``values(model, cond, qid, value)``; the filtered ones leave out ``leaks(model, qid)``, all of them the models ``without``."""
    marks = leaks.select("model", "qid").distinct().withColumn("leaked", F.lit(True))
    values = values.where(~F.col("model").isin(*without)) if without else values
    rows = values.join(marks, ["model", "qid"], "left")
    clean = F.when(F.col("leaked").isNull(), F.col("value"))
    return rows.groupBy("model", "cond").agg(F.count("value").alias("all_n"), F.avg("value").alias("all_mean"), F.count(clean).alias("filtered_n"), F.avg(clean).alias("filtered_mean")).where("all_n > 0")


def survival_values(results: DataFrame, qids: DataFrame) -> DataFrame:
    """``model, cond, idx, qid, value`` of ``results(model, cond, values array<double>)`` and ``qids(idx, qid)``: values stand in the order of the questions."""
    rows = results.select("model", "cond", F.posexplode("values").alias("idx", "value"))
    return rows.join(qids, "idx", "left").select("model", "cond", "idx", "qid", "value")


#: Tasks for each core, and groups whose sums a task holds at once.
WAVES, GROUPS = 8, 64


def bootstrap_means(rows: DataFrame, key: str, row: str, value: str, reps: int = 10_000, seed: int = 20260714, alpha: float = 0.05) -> DataFrame:
    """``key, n, mean, lo, hi``: percentile interval of the mean over Poisson resamples.

    Every row meets every replicate, as arrays of all replicates of a row; only sums leave a task: a row
    for each group and replicate. Few bytes are many meetings, so rows are dealt over all cores.
    """
    each = rows.select(key, row, F.col(value).cast("double").alias("x")).where("x is not null")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held, kind = Weights(reps, seed), {}, None

        def flushed() -> Iterator[pa.RecordBatch]:
            for group, (w, wx) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([group] * reps, kind), pa.array(np.arange(reps, dtype=np.int32)), pa.array(w), pa.array(wx)], [key, "rep", "w", "wx"])
            held.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            for group, name, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if group not in held:
                    if len(held) >= GROUPS:
                        yield from flushed()
                    held[group] = np.zeros(reps, np.int64), np.zeros(reps)
                w = weights.of(name)
                held[group][0][:] += w
                held[group][1][:] += x * w
        yield from flushed()

    # a given number of partitions, as Spark would merge these few bytes into one
    dealt = each.select(key, F.col(row).cast("string").alias("_row"), "x").repartition(WAVES * rows.sparkSession.sparkContext.defaultParallelism)
    drawn = dealt.mapInArrow(sums, f"{key} {each.schema[key].dataType.simpleString()}, rep int, w long, wx double")
    means = drawn.groupBy(key, "rep").agg((F.sum("wx") / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.groupBy(key).agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    # a null group is a group
    own = each.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return own.join(ends.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def sweep_rows(per_item: DataFrame, leaks: DataFrame) -> DataFrame:
    """``model, cond, factor, achieved, em, em_filtered, f1, f1_filtered`` of ``per_item(model, cond, qid, em_rate, f1_mean, achieved_tok_ratio)``."""
    marks = leaks.select("model", "qid").distinct().withColumn("leaked", F.lit(True))
    rows = per_item.join(marks, ["model", "qid"], "left")
    clean = lambda c: F.avg(F.when(F.col("leaked").isNull(), F.col(c)))
    out = rows.groupBy("model", "cond").agg(F.avg("achieved_tok_ratio").alias("achieved"), F.avg("em_rate").alias("em"), clean("em_rate").alias("em_filtered"), F.avg("f1_mean").alias("f1"), clean("f1_mean").alias("f1_filtered"))
    return out.withColumn("factor", F.when(F.col("achieved") < 1, 1 / (1 - F.col("achieved"))).otherwise(1.0))


def in_order(rows: DataFrame, conditions: Sequence[str], last: str = "nocontext") -> DataFrame:
    """Rows by model and by the given order of conditions; ``last`` comes after all."""
    place = F.when(F.col("cond") == last, len(conditions) + 1)
    for k, c in enumerate(conditions):
        place = place.when(F.col("cond") == c, k)
    return rows.orderBy("model", place.otherwise(len(conditions)), "cond")
