"""The second eigenpair of each document's graph Laplacian, and centrality scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEGREE_SHARE, SPECTRAL_SHARE = 0.6, 0.4


def second_eigenpair(adjacency: np.ndarray) -> tuple[np.ndarray, float]:
    """Second eigenvector, scaled to a largest size of 1, and eigenvalue of degrees minus adjacency; ones and 0 below three nodes."""
    n = len(adjacency)
    if n <= 2:
        return np.ones(n), 0.0
    lap = np.diag(adjacency.sum(1)) - adjacency
    values, vectors = np.linalg.eigh(lap)
    v = vectors[:, 1]
    top = np.abs(v).max()
    return (v / top if top > 0 else v), float(values[1])


def second_eigenvalue(adjacency: np.ndarray) -> float:
    """The eigenvalue of ``second_eigenpair`` alone, which takes a fraction of its time."""
    return float(np.linalg.eigvalsh(np.diag(adjacency.sum(1)) - adjacency)[1]) if len(adjacency) > 2 else 0.0


def spectra(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc_id, n, lambda2, fiedler array<double>`` (sizes of the entries) for each document of ``sizes(doc_id, n)``.

    One row a document holds its edges: at most ``MAX_CHUNKS`` nodes, 32 MB as a matrix.
    """

    @F.pandas_udf("lambda2 double, fiedler array<double>")
    def solve(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ns, ii, jj, ww in parts:
            found = []
            for n, i, j, w in zip(ns, ii, jj, ww, strict=True):
                a = np.zeros((n, n))
                if i is not None and len(i):
                    a[np.asarray(i), np.asarray(j)] = a[np.asarray(j), np.asarray(i)] = w
                found.append(second_eigenpair(a))
            yield pd.DataFrame({"lambda2": [x[1] for x in found], "fiedler": [np.abs(x[0]) for x in found]})

    lists = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "w"))).alias("e"))
    rows = sizes.join(lists, "doc_id", "left").select("doc_id", F.col("n").cast("int").alias("n"), F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.w").alias("w"))
    return rows.select("doc_id", "n", solve("n", "i", "j", "w").alias("s")).select("doc_id", "n", "s.lambda2", "s.fiedler")


def centrality(degrees: DataFrame, spectra: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, degree_centrality, score``; a lower score is more removable."""
    top = F.max("degree").over(Window.partitionBy("doc_id"))
    share = F.when(top > 0, F.col("degree") / top).otherwise(F.col("degree"))
    deg = degrees.withColumn("degree_centrality", share).select("doc_id", "chunk_index", "degree_centrality")
    spread = spectra.select("doc_id", F.posexplode("fiedler").alias("chunk_index", "f"))
    both = spread.join(deg, ["doc_id", "chunk_index"], "left").withColumn("degree_centrality", F.coalesce("degree_centrality", F.lit(0.0)))
    return both.select("doc_id", "chunk_index", "degree_centrality", (DEGREE_SHARE * F.col("degree_centrality") + SPECTRAL_SHARE * (1 - F.col("f"))).alias("score"))
