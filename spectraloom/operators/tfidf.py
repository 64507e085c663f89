"""Term weights of chunks, within their document.

``chunks(doc_id, chunk_index, text, ...)``; a document is the corpus of its own chunks. Everything is
keyed by ``doc_id`` first, so one dealing of the chunks by ``doc_id`` serves every aggregate and window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import text as T

#: Terms of a document beyond which the ones in fewest chunks are left out.
MAX_VOCABULARY = 50_000


def term_frequency(chunks: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, term, n``."""
    terms = chunks.select("doc_id", "chunk_index", F.explode_outer(T.tokens(F.col("text"))).alias("term")).where("term is not null")
    return terms.groupBy("doc_id", "chunk_index", "term").agg(F.count("*").alias("n"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """``doc_id, term, n``: chunks that hold the term."""
    return tf.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def weights(chunks: DataFrame, max_vocabulary: int = MAX_VOCABULARY) -> DataFrame:
    """``doc_id, chunk_index, term, weight``: augmented frequency times smoothed inverse frequency, of unit length per chunk.

    Chunks without tokens count in the inverse frequency but have no rows.
    """
    sized = chunks.withColumn("chunks", F.count("*").over(Window.partitionBy("doc_id")))
    terms = sized.select("doc_id", "chunks", "chunk_index", F.posexplode_outer(T.tokens(F.col("text"))).alias("pos", "term")).where("term is not null")
    tf = terms.groupBy("doc_id", "chunk_index", "term").agg(F.count("*").alias("n"), F.first("chunks").alias("chunks"), F.min("pos").alias("pos"))
    of_term, of_chunk, of_doc = Window.partitionBy("doc_id", "term"), Window.partitionBy("doc_id", "chunk_index"), Window.partitionBy("doc_id")
    tf = tf.withColumn("df", F.count("*").over(of_term)).withColumn("seen", F.min(F.struct("chunk_index", "pos")).over(of_term))
    # a document with more tokens than the cap may have too many terms; dense_rank is only then over the cap
    tf = tf.withColumn("place", F.dense_rank().over(of_doc.orderBy(F.desc("df"), "seen"))).where(F.col("place") <= max_vocabulary)
    raw = (0.5 + 0.5 * F.col("n") / F.max("n").over(of_chunk)) * (F.log((F.col("chunks") + 1.0) / (F.col("df") + 1.0)) + 1.0)
    tf = tf.withColumn("raw", raw)
    return tf.select("doc_id", "chunk_index", "term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(of_chunk))).alias("weight"))
