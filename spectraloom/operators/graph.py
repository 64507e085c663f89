"""Similarity graphs of chunks: edge lists ``(doc_id, i, j, w)`` with i < j, each edge once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.operators import tfidf

THRESHOLD, PROXIMITY = 0.05, 0.10
#: Chunks of a document beyond which it has no graph.
MAX_CHUNKS = 2000


def cosine_pairs(weights: DataFrame) -> DataFrame:
    """``doc_id, i, j, w``: sums of weight products over shared terms; an equi-join on document and term."""
    a = weights.select("doc_id", "term", F.col("chunk_index").alias("i"), F.col("weight").alias("wi"))
    b = weights.select("doc_id", "term", F.col("chunk_index").alias("j"), F.col("weight").alias("wj"))
    return a.join(b, ["doc_id", "term"]).where("i < j").groupBy("doc_id", "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("w"))


def connected(pairs: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of at least ``threshold``, and ``PROXIMITY`` between neighbours below it; ``sizes(doc_id, n)``."""
    strong = pairs.where(F.col("w") >= threshold)
    steps = sizes.where("n >= 2").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 2).cast("int"))).alias("i")).withColumn("j", F.col("i") + 1).withColumn("w", F.lit(PROXIMITY))
    # one shuffle for both: the real edge of a pair beats its proximity edge
    both = strong.select("doc_id", "i", "j", "w", F.lit(1).alias("real")).unionByName(steps.select("doc_id", "i", "j", "w", F.lit(0).alias("real")))
    return both.groupBy("doc_id", "i", "j").agg(F.max_by("w", "real").alias("w"))


def text_graph(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges of every document of at most ``MAX_CHUNKS`` chunks, from their term weights."""
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    small = chunks.join(sizes.where(F.col("n") > MAX_CHUNKS), "doc_id", "left_anti")
    return connected(cosine_pairs(tfidf.weights(small)), sizes.where(F.col("n") <= MAX_CHUNKS), threshold)


def vector_pairs(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, i, j, w`` of ``vectors(doc_id, chunk_index, vector)``, taken as they are: dot products of at least ``threshold``.

    All pairs of a document are the definition; documents hold at most ``MAX_CHUNKS``.
    """
    v = vectors.select("doc_id", "chunk_index", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    a, b = v.select("doc_id", F.col("chunk_index").alias("i"), F.col("v").alias("a")), v.select("doc_id", F.col("chunk_index").alias("j"), F.col("v").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "doc_id").where("i < j").select("doc_id", "i", "j", F.greatest(dot, F.lit(0.0)).alias("w")).where(F.col("w") >= threshold)


def vector_graph(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges of every document of at most ``MAX_CHUNKS`` vectors."""
    sizes = vectors.groupBy("doc_id").agg(F.count("*").alias("n"))
    small = vectors.join(sizes.where(F.col("n") > MAX_CHUNKS), "doc_id", "left_anti")
    return connected(vector_pairs(small, threshold), sizes.where(F.col("n") <= MAX_CHUNKS), threshold)


def degrees(edges: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, degree``: sums of the weights at each end."""
    ends = edges.select("doc_id", F.explode(F.array("i", "j")).alias("chunk_index"), "w")
    return ends.groupBy("doc_id", "chunk_index").agg(F.sum("w").alias("degree"))
