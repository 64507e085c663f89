"""Pins: patterns whose chunks are kept whatever their score, sections and spans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_PATTERNS, MAX_LENGTH = 100, 1000
#: One quantified atom or class in a group that is itself repeated.
NESTED_QUANTIFIER = re.compile(r"\((?:\[[^\]]*\]|\\?[^()\[\]])[*+]\)[*+]")

# Patterns that pin instructions.
INSTRUCTION_PRESET = (
    r"^\d+\.\s",
    r"\b(?:must|always|never|required|do not|shall not|mandatory|prohibited)\b",
    r'\{[^{}]*(?:"type"|"properties"|"required"|"enum")[^{}]*\}',
    r"^#{1,3}\s+\S",
)
# Fixed value: a tool result runs to the next turn or the end.
TOOL_RESULT = r"(?s)\[tool_result\]\n.*?(?=\n\[(?:user|assistant|system|tool_call|tool_result|assistant_reasoning)\]|\z)"


def validated(patterns: Sequence[str] | None) -> list[str]:
    """The patterns, or ValueError: too many, too long, or open to catastrophic backtracking."""
    patterns = list(patterns or [])
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"{len(patterns)} pin patterns; the limit is {MAX_PATTERNS}")
    for p in patterns:
        if len(p) > MAX_LENGTH:
            raise ValueError(f"a pin pattern of {len(p)} characters; the limit is {MAX_LENGTH}")
        if NESTED_QUANTIFIER.search(p):
            raise ValueError(f"pin pattern with a nested quantifier: {p[:80]!r}")
    return patterns


def compiled(spark: SparkSession, patterns: Sequence[str] | None) -> list[str]:
    """Java patterns: case-insensitive, a dot matches newlines; what is no valid pattern is a literal."""
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    out = []
    for p in validated(patterns):
        try:
            java.compile(p)
            out.append(f"(?isu){p}")
        except Exception:  # noqa: BLE001  the JVM's PatternSyntaxException
            out.append("(?iu)" + java.quote(p))
    return out


def pinned(text: Column, java_patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in java_patterns:
        out = out | text.rlike(p)
    return out


def section_lines(prompts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``id, line_no, literal`` of ``prompts(id, text)``: the first 60 characters of each line of over 10 in a section whose markdown header holds a keyword.

    A section runs to the next header of the same or a higher level. Per line, the header that decides
    is the nearest matching one above that no header of its level or higher has closed since.
    """
    lines = prompts.select("id", F.posexplode(F.split("text", r"\n")).alias("line_no", "line"))
    # a header's text starts in its own line: a bare run of # has none
    head = r"(?d)^(#{1,6})\s+(.+)$"
    title = F.lower(F.regexp_extract("line", head, 2))
    level = F.length(F.regexp_extract("line", head, 1))
    wanted = F.lit(False)
    for k in keywords:
        wanted = wanted | F.contains(title, F.lit(k.lower()))
    marked = lines.withColumn("level", level).withColumn("wanted", (F.col("level") > 0) & wanted)
    up = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # for each level, the last wanted header of it and the last header that closes it
    inside = F.lit(False)
    for n in range(1, 7):
        opened = F.max(F.when((F.col("level") == n) & F.col("wanted"), F.col("line_no"))).over(up)
        closed = F.max(F.when((F.col("level") > 0) & (F.col("level") <= n) & ~((F.col("level") == n) & F.col("wanted")), F.col("line_no"))).over(up)
        inside = inside | (opened.isNotNull() & (opened > F.coalesce(closed, F.lit(-1))))
    text = F.trim("line")
    return marked.withColumn("inside", inside).where(F.col("inside") & (F.char_length(text) > 10)).select("id", "line_no", F.substring(text, 1, 60).alias("literal"))


def section_patterns(keywords: Sequence[str], text: str) -> list[str]:
    """The same for one text on the driver: escaped literals for ``pin_patterns``."""
    out: list[str] = []
    keys = [k.lower() for k in keywords]
    heads = [(m.start(), len(m[1]), m[2].strip().lower()) for m in re.finditer(r"^(#{1,6})\s+(.+)$", text or "", re.MULTILINE)]
    for at, level, title in heads:
        if any(k in title for k in keys):
            end = min((a for a, other, _ in heads if a > at and other <= level), default=len(text))
            out += [re.escape(s[:60]) for line in text[at:end].splitlines() if len(s := line.strip()) > 10]
    return out


def span_columns(text: Column) -> dict[str, Column]:
    """``spans`` (tool results, in order) and ``open_text``, where ``<<PIN_k>>`` stands for span k."""
    spans = F.regexp_extract_all(text, F.lit(TOOL_RESULT), F.lit(0))
    # cut the text at the spans and put numbered tags between the pieces
    pieces = F.split(text, TOOL_RESULT)
    joined = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), F.struct(F.element_at(pieces, 1).alias("s"), F.lit(0).alias("k")), lambda acc, p: F.struct(F.concat(acc["s"], F.lit("<<PIN_"), acc["k"].cast("string"), F.lit(">>"), p).alias("s"), (acc["k"] + 1).alias("k")), lambda acc: acc["s"])
    return {"spans": spans, "open_text": joined}


def restored(text: Column, spans: Column) -> Column:
    """Tags replaced by their spans."""
    return F.aggregate(spans, F.struct(text.alias("s"), F.lit(0).alias("k")), lambda acc, x: F.struct(F.replace(acc["s"], F.concat(F.lit("<<PIN_"), acc["k"].cast("string"), F.lit(">>")), x).alias("s"), (acc["k"] + 1).alias("k")), lambda acc: acc["s"])


def adjusted_target(target: Column, total: Column, open_chars: Column) -> Column:
    """The ratio for the open text that removes ``target`` of all of it: at most 0.95; 0 if nothing is open."""
    return F.when(open_chars > 0, F.least(total * target / open_chars, F.lit(0.95))).otherwise(F.lit(0.0))
