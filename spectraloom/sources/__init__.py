"""Sources and sinks: guarded text files, JSON-lines suites, result files, JSON, text and Markdown output."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path, PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024


def checked_path(path: str, label: str = "file") -> str:
    """The resolved path, or ValueError: a parent reference, a null byte, missing, no regular file, or over ``MAX_BYTES``."""
    if not path or "\0" in path:
        raise ValueError(f"{label}: an empty path or one with a null byte")
    if ".." in PurePath(path.replace("\\", "/")).parts:
        raise ValueError(f"{label}: the path must not hold '..'")
    at = Path(path).resolve()
    if not at.exists():
        raise ValueError(f"{label}: not found: {path}")
    if not at.is_file():
        raise ValueError(f"{label}: not a regular file: {path}")
    if at.stat().st_size > MAX_BYTES:
        raise ValueError(f"{label}: over {MAX_BYTES} bytes: {path}")
    return str(at)


def checked_output(path: str, label: str = "output") -> str:
    if not path or "\0" in path or ".." in PurePath(path.replace("\\", "/")).parts:
        raise ValueError(f"{label}: the path must be given without '..' or null bytes")
    return str(Path(path).resolve())


def literal(spark: SparkSession, *words: str) -> DataFrame:
    """One row ``doc_id, text`` of the words joined by spaces."""
    return spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string")


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, text``: whole files, read where they lie; local single files may be passed through ``checked_path`` first."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def without_blank(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)))


def suite(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, name, text`` of a JSON-lines file; the first bad line or one without text raises with its number.

    Lines are numbered, so the file is one row at first; suites are small, guarded files.
    """
    rows = spark.read.text(checked_path(path, "suite"), wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("k", "line")).where(F.trim("line") != "")
    rows = rows.select((F.col("k") + 1).alias("line_no"), F.from_json("line", "name string, text string, bad string", {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}).alias("j"))
    rows = rows.select("line_no", F.coalesce("j.name", F.lit("Unnamed")).alias("name"), F.col("j.text").alias("text"), F.col("j.bad").alias("bad"))
    wrong = rows.where("bad is not null or text is null").orderBy("line_no").first()
    if wrong is not None:
        raise ValueError(f"suite: line {wrong['line_no']}: " + ("not JSON" if wrong["bad"] is not None else "no text"))
    return rows.drop("bad")


def survival_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(model, cond, values)`` and leaks ``(model, qid)`` of a survival result file."""
    raw = spark.read.schema("results map<string,map<string,array<double>>>, memleak map<string,array<string>>").json(path, multiLine=True)
    values = raw.select(F.explode("results").alias("model", "c")).select("model", F.explode("c").alias("cond", "values"))
    return values, _leaks(raw)


def depth_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(model, qid, band, cond, value)`` and leaks of a depth result file."""
    raw = spark.read.schema("records array<struct<model:string,qid:string,band:string,cond:string,survival:double>>, memleak map<string,array<string>>").json(path, multiLine=True)
    return raw.select(F.inline("records")).withColumnRenamed("survival", "value"), _leaks(raw)


def sweep_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(model, cond, qid, em_rate, f1_mean, achieved_tok_ratio)`` and leaks of a sweep result file."""
    raw = spark.read.schema("per_item map<string,map<string,array<struct<qid:string,em_rate:double,f1_mean:double,achieved_tok_ratio:double>>>>, memleak map<string,array<string>>").json(path, multiLine=True)
    rows = raw.select(F.explode("per_item").alias("model", "c")).select("model", F.explode("c").alias("cond", "r"))
    return rows.select("model", "cond", F.inline("r")), _leaks(raw)


def _leaks(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("memleak").alias("model", "q")).select("model", F.explode("q").alias("qid"))


def as_json(shortened: DataFrame, verbose: bool = False) -> DataFrame:
    """``doc_id, json``: the figures of a shortened text; ``verbose`` adds what was removed and the scores."""
    names = ["compressed", "compression_ratio", "tokens_saved", "algebraic_connectivity", "chunks_total", "chunks_removed", *(["removed_chunks", "chunk_scores"] if verbose else [])]
    return shortened.select("doc_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))


def preview(text: Column, most: int = 100) -> Column:
    """The first characters on one line, with dots if there is more."""
    return F.concat(F.regexp_replace(F.substring(text, 1, most), r"\n", " "), F.when(F.char_length(text) > most, "...").otherwise(""))


def as_report(shortened: DataFrame, verbose: bool = False) -> DataFrame:
    """``doc_id, report``: a text report of each shortened document."""
    head = F.format_string("Compression ratio: %.1f%%\nTokens saved: %d\nChunks: %d total, %d removed\nAlgebraic connectivity: %.6f", F.col("compression_ratio") * 100, "tokens_saved", "chunks_total", "chunks_removed", "algebraic_connectivity")
    gone = F.array_join(F.transform("removed_chunks", lambda c, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), preview(c))), "\n")
    parts = [head, *([F.when(F.size("removed_chunks") > 0, F.concat(F.lit("Removed:\n"), gone))] if verbose else []), F.concat(F.lit("Output:\n"), "compressed")]
    return shortened.select("doc_id", F.concat_ws("\n\n", *parts).alias("report"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def markdown(report: DataFrame, percent: Sequence[str] = ()) -> str:
    """A Markdown table of a report, whose rows are few by nature (models times conditions); ``percent`` columns as percentages."""
    rows = report.collect()
    cell = lambda name, v: "n/a" if v is None else f"{v:.1%}" if name in percent else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(n, r[n]) for n in report.columns) + " |" for r in rows)])
