"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import text as T


#: Texts of one output batch.
TEXTS = 256


def _known(strategy: str) -> None:
    if strategy not in T.STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(T.STRATEGIES)}")


def with_strategy(docs: DataFrame, strategy: str = "adaptive") -> DataFrame:
    """``docs(doc_id, text)`` with normalised ``text``, its ``sentences``, ``paragraphs`` and the ``strategy`` chosen."""
    _known(strategy)
    rows = docs.select("doc_id", T.normalised(F.col("text")).alias("text"))
    if strategy != "adaptive":
        return rows.withColumn("strategy", F.lit(strategy))
    rows = rows.withColumns({"paragraphs": T.paragraphs(F.col("text")), "sentences": T.sentences(F.col("text"))})
    return rows.withColumn("strategy", T.strategy_of(F.col("paragraphs"), F.col("sentences")))


def chunk_lists(docs: DataFrame, strategy: str = "adaptive", min_words: int = T.MIN_CHUNK_WORDS, size: int = T.WINDOW_WORDS, stride: int = T.STRIDE_WORDS) -> DataFrame:
    """``doc_id, text, strategy, parts``: the merged chunks of each document as an array; a null text has none."""
    rows, text = with_strategy(docs, strategy), F.col("text")
    cut = {
        "sentence": F.col("sentences") if strategy == "adaptive" else T.sentences(text),
        "paragraph": F.col("paragraphs") if strategy == "adaptive" else T.paragraphs(text),
        "window": T.windows(text, size, stride),
    }
    parts = cut[strategy] if strategy != "adaptive" else F.when(F.col("strategy") == "paragraph", cut["paragraph"]).when(F.col("strategy") == "sentence", cut["sentence"]).otherwise(cut["window"])
    parts = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(T.merged(F.filter(parts, lambda p: p != ""), min_words))
    return rows.select("doc_id", "text", "strategy", parts.alias("parts"))


def chunks(docs: DataFrame, strategy: str = "adaptive", **sizes: int) -> DataFrame:
    """``doc_id, chunk_index, text, word_count``: one row a chunk, without a shuffle."""
    # the outer form, then a filter: Spark would else compute the arrays again to filter empty ones out beforehand
    rows = chunk_lists(docs, strategy, **sizes).select("doc_id", F.posexplode_outer("parts").alias("chunk_index", "text")).where("chunk_index is not null")
    return rows.withColumn("word_count", T.word_count(F.col("text")))


def chunks_with_offsets(docs: DataFrame, strategy: str = "adaptive", **sizes: int) -> DataFrame:
    """``chunks`` with ``start_char`` and ``end_char`` in the normalised text, found by each chunk's first 40 characters.

    By the kernel: a column function has to walk a text from its start to find a place in it, once for each chunk.
    """
    _known(strategy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, TEXTS) for lo in range(0, batch.num_rows, TEXTS)):
                rows = [(d, k, c, *at, len(c.split())) for d, t in enumerate(part.column(1).to_pylist()) if t is not None for k, (c, at) in enumerate(_placed(t, strategy, sizes))]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int32())), *(pa.array(c, kind) for c, kind in zip(cols[1:], (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True))], ["doc_id", "chunk_index", "text", "start_char", "end_char", "word_count"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk_index int, text string, start_char int, end_char int, word_count int")


def _placed(text: str, strategy: str, sizes: dict[str, int]) -> Iterator[tuple[str, tuple[int, int]]]:
    from spectraloom.plans import kernel  # which imports the operators

    parts = kernel.chunk(text, strategy, **sizes)
    return zip(parts, kernel.offsets(kernel.normalise(text), parts), strict=True)


def truncated(docs: DataFrame, most: int = 1900) -> DataFrame:
    """``doc_id, text, chunks_total, was_cut``: texts of over ``most`` chunks end where chunk ``most`` ends; one pass, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, TEXTS) for lo in range(0, batch.num_rows, TEXTS)):
                out = []
                for t in part.column(1).to_pylist():
                    got = list(_placed(t, "adaptive", {})) if t is not None else []
                    cut = len(got) > most
                    out.append((t[: got[most - 1][1][1]] if cut else t, len(got), cut))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.bool_()), strict=True))], ["doc_id", "text", "chunks_total", "was_cut"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, chunks_total int, was_cut boolean")
