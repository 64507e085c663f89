"""Scores of an answer against a truth, 0 to 1, as columns; null counts as the empty text."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spectraloom.functions.text import bound, stripped

NUMBER = r"[-+]?\d[\d,]*\.?\d*"
# Weights of the marker categories.
INSTRUCTION_WEIGHTS = {"format": 0.30, "key": 0.30, "rule": 0.40}
CONTEXT_WEIGHTS = {"answer": 0.50, "tool_ref": 0.30, "stale": 0.20}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _bag(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"(?U)\w+"), F.lit(0))


def number_match(predicted: Column, truth: Column) -> Column:
    """1 if the last numbers of both are equal; thousands separators do not count."""
    last = lambda c: F.replace(F.try_element_at(F.regexp_extract_all(_text(c), F.lit(NUMBER), F.lit(0)), F.lit(-1)), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(F.when(last(predicted) == last(truth), 1.0), F.lit(0.0))


def exact_match(predicted: Column, truth: Column) -> Column:
    same = F.lower(stripped(_text(predicted))) == F.lower(stripped(_text(truth)))
    return F.when(same, 1.0).otherwise(0.0)


def f1_scores(pairs: DataFrame) -> DataFrame:
    """``id, score`` of ``pairs(id, predicted, ground_truth)``: F1 over bags of words, by one aggregate per word and one per pair."""
    sides = pairs.select("id", F.posexplode(F.array(_bag(F.col("predicted")), _bag(F.col("ground_truth")))).alias("side", "bag"))
    counts = sides.select("id", "side", F.explode_outer("bag").alias("word")).groupBy("id", "word").agg(F.count(F.when((F.col("side") == 0) & F.col("word").isNotNull(), 1)).alias("p"), F.count(F.when((F.col("side") == 1) & F.col("word").isNotNull(), 1)).alias("t"))
    total = counts.groupBy("id").agg(F.sum(F.least("p", "t")).alias("both"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    score = F.when((F.col("p") == 0) & (F.col("t") == 0), 1.0).when(F.col("both") == 0, 0.0).otherwise(2.0 * F.col("both") / (F.col("p") + F.col("t")))
    return total.select("id", score.alias("score"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, 64 and more cells of the table at a time in one integer."""
    where: dict[str, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l_of(predicted: str | None, truth: str | None) -> float:
    p, t = (re.findall(r"\w+", (x or "").lower()) for x in (predicted, truth))
    if not p or not t:
        return float(not p and not t)
    return 2.0 * lcs_length(t, p) / (len(p) + len(t))


@F.pandas_udf(DoubleType())
def rouge_l(predicted: pd.Series, truth: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of words."""
    return pd.Series([rouge_l_of(p, t) for p, t in zip(predicted, truth, strict=True)], dtype=float)


def has_json(text: Column) -> Column:
    """Whether a flat ``{..}`` in the text, or all of it, is JSON."""
    flat = F.regexp_extract_all(_text(text), F.lit(r"\{[^{}]*\}"), F.lit(0))
    return F.exists(flat, lambda x: F.try_parse_json(x).isNotNull()) | F.try_parse_json(stripped(_text(text))).isNotNull()


def _markers(truth: Column) -> Column:
    """``array<struct<tag, value>>`` of lines ``tag:value``."""
    lines = F.filter(F.transform(F.split(_text(truth), r"\R"), stripped), lambda x: F.contains(x, F.lit(":")))
    return F.transform(lines, lambda x: F.struct(F.lower(stripped(F.substring_index(x, ":", 1))).alias("tag"), F.lower(stripped(F.regexp_replace(x, r"(?s)^[^:]*:", ""))).alias("value")))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: (x["kind"] == kind) & x["s"].isNotNull()


def _weighed(scored: Column, weights: dict[str, float]) -> Column:
    """Weighted mean of the category means of ``array<struct<kind, s>>``, over the categories that occur."""
    top, low = F.lit(0.0), F.lit(0.0)
    for kind, w in weights.items():
        own = F.filter(scored, _of_kind(kind))
        mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["s"]) / F.nullif(F.size(own), F.lit(0))
        top, low = top + F.coalesce(mean * w, F.lit(0.0)), low + F.when(F.size(own) > 0, w).otherwise(0.0)
    return F.when(low > 0, top / low).otherwise(0.0)


def _unless_blank(predicted: Column, truth: Column, score: Column) -> Column:
    blank = lambda c: stripped(_text(c)) == ""
    return F.when(~blank(truth), score).when(blank(predicted), 1.0).otherwise(0.0)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def instruction_score(predicted: Column, truth: Column) -> Column:
    """Format, key and rule markers of ``truth`` that the answer meets; an unknown format does not count."""
    p, low = _text(predicted), F.lower(_text(predicted))

    def scored(m: Column) -> Column:
        tag, v = m["tag"], m["value"]
        form = F.when(v == "json", _flag(has_json(p))).when(v == "markdown_table", _flag(p.rlike(r"\|.+\|"))).when(v == "markdown_headers", _flag(p.rlike(r"(?md)^#{1,3}\s+\S"))).when(v == "numbered_list", _flag(p.rlike(r"(?md)^\d+\.\s")))
        kind = F.when(tag.isin("format", "key"), tag).when(tag.isin("rule", "contains", "not_contains", "section"), "rule")
        s = F.when(tag == "format", form).when(tag == "not_contains", _flag(~F.contains(low, v))).when(kind.isNotNull(), _flag(F.contains(low, v)))
        return F.struct(kind.alias("kind"), s.alias("s"))

    return _unless_blank(predicted, truth, bound(F.transform(_markers(truth), scored), lambda x: _weighed(x, INSTRUCTION_WEIGHTS)))


def context_score(predicted: Column, truth: Column) -> Column:
    """Answers and tool values that the answer holds, and facts whose newer value it uses."""
    low = F.lower(_text(predicted))

    def scored(m: Column) -> Column:
        tag, v = m["tag"], m["value"]
        old, new = stripped(F.substring_index(v, "|", 1)), stripped(F.regexp_replace(v, r"(?s)^[^|]*\|", ""))
        stale = F.when(F.contains(v, F.lit("|")), F.when(F.contains(low, new), 1.0).when(F.contains(low, old), 0.0).otherwise(0.5))
        return F.struct(tag.alias("kind"), F.when(tag == "stale", stale).when(tag.isin("answer", "tool_ref"), _flag(F.contains(low, v))).alias("s"))

    return _unless_blank(predicted, truth, bound(F.transform(_markers(truth), scored), lambda x: _weighed(x, CONTEXT_WEIGHTS)))


def phrase_score(predicted: Column, truth: Column) -> Column:
    """Share of the non-blank lines of ``truth`` that the answer holds, whatever their case."""
    low = F.lower(_text(predicted))
    lines = F.filter(F.transform(F.split(_text(truth), r"\R"), stripped), lambda x: x != "")
    return _unless_blank(predicted, truth, bound(lines, lambda x: F.size(F.filter(x, lambda y: F.contains(low, F.lower(y)))) / F.size(x)))
