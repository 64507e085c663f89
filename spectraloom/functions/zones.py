"""Instruction and context zones of chunks, and the weight that protects instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of either zone, case-insensitive; ^ is the start of the chunk.
INSTRUCTION = (
    r"^\s*(you must|you should|always|never|do not|ensure|make sure|output|return|respond|format|use|include|exclude|avoid|follow|write|list|provide|generate|create|summarize|analyze|explain)",
    r"\b(must not|shall not|required to|constraint|requirement|rule|guideline|specification|mandatory|prohibited)\b",
    r"\b(format|json|xml|markdown|csv|table|bullet|numbered list|heading|section)\s*(:|as|in|using|with)",
    r"\b(you are|act as|role:|persona:|behave as|pretend to be|your (role|job|task|goal) is)\b",
    r"^\s*#{1,3}\s*(instructions?|rules?|constraints?|requirements?|guidelines?|system|task)",
    r"^\s*<(system|instructions?|rules?|constraints?)>",
    r"^\s*(task|question|query|prompt|input|objective|goal)(\s*:|\s+is)",
)
CONTEXT = (
    r"^\s*(background|context|for reference|note that|keep in mind|fyi|the following|here is|below is|consider)",
    r"^\s*(example|e\.g\.|for instance|such as|sample|demonstration|here's an example)",
    r"^\s*(document|article|text|content|data|source|excerpt|passage):",
    r"^\s*<(context|document|reference|example|data)>",
    r"\b(was founded|is located|has been|according to|published in|reported that)\b",
)
#: An instruction of more confidence than this is never removed.
PROTECTED = 0.7


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur."""
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(f"(?iu){p}").cast("int")
    return out


def zone_columns(text: Column) -> dict[str, Column]:
    """``zone``, ``confidence`` and ``protection_weight`` of a chunk."""
    a, b = hits(text, INSTRUCTION), hits(text, CONTEXT)
    zone = F.when(a + b == 0, "unknown").when(a >= b, "instruction").otherwise("context")
    sure = F.when(a + b == 0, F.lit(0.0)).when(a == b, F.lit(0.5)).otherwise(F.greatest(a, b) / (a + b))
    weight = F.when((a + b > 0) & (a >= b), F.lit(2.0) + sure).otherwise(F.lit(1.0))
    return {"zone": zone, "confidence": sure.cast("double"), "protection_weight": weight.cast("double")}
