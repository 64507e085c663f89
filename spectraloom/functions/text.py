"""Native column functions for text: normalising, splitting into chunks, counting words and tokens.

Everything here is a ``Column`` expression that stays in the JVM, but for the Unicode composition of
texts that may need it. Whitespace means Unicode whitespace throughout.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STRATEGIES = ("adaptive", "sentence", "paragraph", "window")
WINDOW_WORDS, STRIDE_WORDS, MIN_CHUNK_WORDS = 50, 25, 3

# Characters that normalising replaces.
REPLACED = (("—", "--"), ("–", "-"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("…", "..."), (" ", " "))

#: Unicode whitespace as Python splits on it, for a Java pattern under (?U).
SPACE = r"[\s\x1c-\x1f]"
SENTENCE_END = rf"(?mdU)(?<=(?<![A-Z])[.!?])(?={SPACE}+[A-Z\"']|{SPACE}*$)"
PARAGRAPH_GAP = rf"(?U)\n{SPACE}*\n"
#: Texts without a character of this class are in composed form already.
MAY_NEED_COMPOSING = r"[^\x{0}-\x{2FF}\x{2010}-\x{2027}]"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalised(text: Column) -> Column:
    """Composed form (NFC) with plain dashes, quotes, dots and spaces."""
    needs = F.when(text.rlike(MAY_NEED_COMPOSING), text)
    out = F.coalesce(_composed(needs), text)
    for old, new in REPLACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Lower-cased runs of word characters that hold nothing but two or more ASCII letters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: t.rlike("^[a-z]{2,}$"))


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Cut after ``.!?`` that no capital precedes, before a capital or quote, or at the end of a line."""
    return _pieces(F.split(text, SENTENCE_END))


def paragraphs(text: Column) -> Column:
    return _pieces(F.split(text, PARAGRAPH_GAP))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(text: Column, size: int = WINDOW_WORDS, stride: int = STRIDE_WORDS) -> Column:
    """Overlapping windows of words, then one shorter tail if the last full window stops before the end."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.floor((n - size) / stride).cast("int") * stride
        starts = F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.when(last + size < n, F.array(last + stride)).otherwise(F.array().cast("array<int>")))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))

    return F.when(F.char_length(text) == 0, F.array(text)).otherwise(bound(words(text), lambda w: F.when(F.size(w) <= size, F.array(stripped(text))).otherwise(cut(w))))


def strategy_of(paras: Column, sents: Column) -> Column:
    """The adaptive choice, from the paragraphs and sentences of a text."""
    total = F.aggregate(paras, F.lit(0), lambda n, p: n + word_count(p))
    some = F.size(paras) >= 4
    fits = bound(F.when(some, total / F.size(paras)), lambda mean: (mean >= 20) & (mean <= 200))
    return F.when(some & fits, "paragraph").when(F.size(sents) >= 6, "sentence").otherwise("window")


def merged(pieces: Column, least: int = MIN_CHUNK_WORDS) -> Column:
    """Pieces of too few words run on into the next one; what is left over joins the last chunk."""
    kind = "struct<done:array<string>,held:string,n:int>"

    def step(acc: Column, piece: Column) -> Column:
        n = acc["n"] + piece["n"]
        both = F.concat(acc["held"], piece["s"])
        held = F.struct(acc["done"].alias("done"), F.concat(both, F.lit(" ")).alias("held"), n.alias("n"))
        full = F.struct(F.concat(acc["done"], F.array(both)).alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))
        return F.when(n < least, held.cast(kind)).otherwise(full.cast(kind))

    def last(acc: Column) -> Column:
        n, rest = F.size(acc["done"]), F.rtrim(acc["held"])
        joined = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc["done"], n), rest)))
        return F.when(rest == "", acc["done"]).when(n == 0, F.array(rest)).otherwise(joined)

    counted = F.transform(pieces, lambda p: F.struct(p.alias("s"), word_count(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n")).cast(kind)
    return F.aggregate(counted, start, step, last)


def approx_tokens(text: Column) -> Column:
    """A quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("int")
