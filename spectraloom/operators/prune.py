"""Greedy removal of the lowest-scored chunks, and what is left of the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.pins import pinned
from spectraloom.functions.text import approx_tokens
from spectraloom.functions.zones import PROTECTED

#: Words removed may exceed the target ratio by this factor.
SLACK = 1.5


def removed_ids(ranked: Column, total_words: Column, ratio: float) -> Column:
    """Chunk indexes removed, from ``array<struct<chunk_index, words, held>>`` in order of removal.

    The number removed is at most ``ratio`` of the chunks, at least one; a held chunk is passed over,
    and so is one that would take the removed words over ``SLACK * ratio`` of all words.
    """
    budget = F.greatest(F.lit(1), F.floor(F.size(ranked) * F.lit(float(ratio))).cast("int"))
    kind = "struct<ids:array<int>,words:int>"

    def step(acc: Column, x: Column) -> Column:
        share = (acc["words"] + x["words"]) / total_words
        go = (F.size(acc["ids"]) < budget) & ~x["held"] & ~F.coalesce(share > F.lit(float(ratio)) * F.lit(SLACK), F.lit(False))
        return F.struct(F.when(go, F.concat(acc["ids"], F.array(x["chunk_index"]))).otherwise(acc["ids"]).alias("ids"), F.when(go, acc["words"] + x["words"]).otherwise(acc["words"]).alias("words")).cast(kind)

    return F.aggregate(ranked, F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("words")).cast(kind), step, lambda acc: acc["ids"])


def pruned(scored: DataFrame, ratio: float = 0.2, protect: bool = True) -> DataFrame:
    """``doc_id, parts, removed`` of ``scored(doc_id, chunk_index, text, word_count, score[, zone, confidence, protection_weight, pinned])``.

    Weighted scores are ranked as rounded to 9 places, ties by chunk index, so the order does not hang
    on the last bits of a sum.
    """
    has = set(scored.columns)
    score = F.col("score") * F.col("protection_weight") if protect and "protection_weight" in has else F.col("score")
    held = F.col("pinned") if "pinned" in has else F.lit(False)
    if protect and "zone" in has:
        held = held | ((F.col("zone") == "instruction") & (F.col("confidence") > PROTECTED))
    docs = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(ranked(score, held, F.struct("chunk_index", "text", "word_count", "score")))).alias("r"))
    return _greedy(docs, ratio)


def ranked(score: Column, held: Column, chunk: Column) -> Column:
    """A chunk as ``_greedy`` sorts it; ``chunk`` has its number, text, words and unweighted score."""
    return F.struct(F.round(score, 9).alias("rank"), chunk["chunk_index"].cast("int").alias("chunk_index"), chunk["word_count"].cast("int").alias("words"), held.alias("held"), chunk["text"].alias("text"), chunk["score"].alias("score"))


def _greedy(docs: DataFrame, ratio: float) -> DataFrame:
    """``pruned`` of documents with their chunks in order of removal as ``r``; other columns stay."""
    others = [c for c in docs.columns if c not in ("doc_id", "r")]
    total = F.aggregate("r", F.lit(0), lambda n, x: n + x["words"])
    docs = docs.withColumn("removed", F.array_sort(removed_ids(F.col("r"), total, ratio)))
    in_order = F.array_sort(F.transform("r", lambda x: F.struct(x["chunk_index"].alias("chunk_index"), x["text"].alias("text"), x["score"].alias("score"))))
    return docs.select("doc_id", *others, in_order.alias("parts"), "removed")


def pruned_documents(docs: DataFrame, ratio: float = 0.2, protect: bool = True, pins: Sequence[str] = ()) -> DataFrame:
    """``pruned`` of documents with their scored chunks as an array ``parts``, without a shuffle; other columns stay."""

    def row(x: Column) -> Column:
        if not protect:
            return ranked(x["score"], pinned(x["text"], pins), x)
        return ranked(x["score"] * x["protection_weight"], pinned(x["text"], pins) | (x["zone"] == "instruction") & (x["confidence"] > PROTECTED), x)

    return _greedy(docs.withColumn("r", F.array_sort(F.transform("parts", row))).drop("parts"), ratio)


def rebuilt(pruned: DataFrame) -> DataFrame:
    """``doc_id, compressed, chunks_total, chunks_removed, removed_chunks, chunk_scores``; other columns stay."""
    others = [c for c in pruned.columns if c not in ("doc_id", "parts", "removed")]
    kept = F.filter("parts", lambda x: ~F.array_contains("removed", x["chunk_index"]))
    gone = F.filter("parts", lambda x: F.array_contains("removed", x["chunk_index"]))
    return pruned.select("doc_id", *others, F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n").alias("compressed"), F.size("parts").alias("chunks_total"), F.size("removed").alias("chunks_removed"), F.transform(gone, lambda x: x["text"]).alias("removed_chunks"), F.transform("parts", lambda x: x["score"]).alias("chunk_scores"))


def metrics(original: Column, compressed: Column) -> dict[str, Column]:
    """``compression_ratio`` by characters (negative if the text grew) and ``tokens_saved``."""
    return {
        "compression_ratio": 1 - F.char_length(compressed) / F.greatest(F.char_length(original), F.lit(1)),
        "tokens_saved": F.greatest(F.lit(0), approx_tokens(original) - approx_tokens(compressed)),
    }
