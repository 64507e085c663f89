"""Quality evaluation: samples, the runner and its summary. The model that answers is a callable of the caller's."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from inspect import signature
from json import dumps, loads

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.functions import pins as P
from spectraloom.functions import scorers as S
from spectraloom.functions.text import word_count
from spectraloom.operators import chunks
from spectraloom.plans import kernel
from spectraloom.plans.kernel import Options
from spectraloom.sources import generators

MULTIPLIERS = (2.0, 4.0, 8.0, 16.0)
#: Scorers of one answer and one truth, by name; F1 is relational and joined on.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"exact_match_number": S.number_match, "exact_match": S.exact_match, "rouge_l": S.rouge_l, "instruction": S.instruction_score, "context": S.context_score, "phrases": S.phrase_score}


def target_ratio(multiplier: float) -> float:
    """Share to remove for a compression of ``multiplier`` times."""
    if multiplier < 1:
        raise ValueError(f"a multiplier of {multiplier}; at least 1 is needed")
    return round(1 - 1 / multiplier, 6)


def target_column(multiplier: Column) -> Column:
    """The same as a column; null for a multiplier below 1."""
    return F.when(multiplier >= 1, F.round(1 - 1 / multiplier, 6))


# samples from public question sets, given as DataFrames: (id, prompt, ground_truth)


def sample_by_hash(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same for the same key values whatever the partitions; a sample is what is asked for."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def math_word_samples(train: DataFrame, test: DataFrame, shots: int = 4, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Worked examples before each question of ``(id, question, answer)``; the truth stands after the last ``####``."""
    shown = sample_by_hash(train, "id", shots, seed).select(F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("qa")).collect()
    prefix = "\n\n".join(r["qa"] for r in shown) + "\n\n" if shown else ""
    rows = test.orderBy("id").limit(limit) if limit else test
    return rows.select(F.col("id").cast("string").alias("id"), F.concat(F.lit(prefix), F.lit("Q: "), "question", F.lit("\nA:")).alias("prompt"), F.trim(F.element_at(F.split("answer", "####"), -1)).alias("ground_truth"))


def task_samples(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """``(id, input, target)`` as samples."""
    rows = rows.orderBy("id").limit(limit) if limit else rows
    return rows.select(F.col("id").cast("string").alias("id"), F.col("input").alias("prompt"), F.col("target").alias("ground_truth"))


def open_question_samples(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """``(id, question, tokens, is_html, short_answers)``: the document without markup, then the question; unanswerable rows go."""
    answers = F.filter("short_answers", lambda a: F.trim(a) != "")
    body = F.array_join(F.transform(F.filter(F.arrays_zip("tokens", "is_html"), lambda t: ~t["is_html"]), lambda t: t["tokens"]), " ")
    rows = rows.where(F.size(answers) > 0)
    rows = rows.orderBy("id").limit(limit) if limit else rows
    return rows.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Document:\n"), body, F.lit("\n\nQuestion: "), "question", F.lit("\nAnswer:")).alias("prompt"), F.element_at(answers, 1).alias("ground_truth"))


def meeting_samples(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """``(id, transcript, summary)`` under an instruction to summarise."""
    rows = rows.orderBy("id").limit(limit) if limit else rows
    return rows.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Summarize the following meeting transcript.\n\n"), "transcript").alias("prompt"), F.col("summary").alias("ground_truth"))


def paragraph_samples(rows: DataFrame, n: int = 40, seed: int = 20260620, least: int = 60, most: int = 320) -> DataFrame:
    """``(id, context, answers)`` with ``least`` to ``most`` words and an answer: the first ``n`` in hash order."""
    words = word_count(F.col("context"))
    return sample_by_hash(rows.where((F.size("answers") > 0) & (words >= least) & (words <= most)), "id", n, seed)


#: Evaluation sets: name -> (loader, scorer, tables of the caller's that it reads).
DATASETS: dict[str, tuple[Callable, str, tuple[str, ...]]] = {
    "gsm8k": (math_word_samples, "exact_match_number", ("train", "test")),
    "bbh": (task_samples, "exact_match", ("test",)),
    "natural_questions": (open_question_samples, "f1", ("test",)),
    "meetingbank": (meeting_samples, "rouge_l", ("test",)),
    "system_prompts": (generators.system_prompts, "instruction", ()),
    "agentic_contexts": (generators.agent_transcripts, "context", ()),
    "adversarial": (generators.hard_texts, "phrases", ()),
}
#: Samples of a dry run at most.
DRY = 10


def dataset(spark: SparkSession, name: str, data: str | None = None, limit: int | None = None, dry_run: bool = False, **more: object) -> tuple[DataFrame, str]:
    """Samples of ``name`` in ``DATASETS`` and their scorer; ``data`` is a folder with its tables as Parquet.

    The first ``limit`` samples by id are taken, in a dry run ``DRY`` at most; of ``more`` a loader gets the arguments it knows.
    """
    if name not in DATASETS:
        raise ValueError(f"no dataset {name!r}; there are {', '.join(sorted(DATASETS))}")
    load, scorer, tables = DATASETS[name]
    if tables and data is None:
        raise ValueError(f"{name} needs a folder with {' and '.join(f'{t}.parquet' for t in tables)}")
    if limit is not None and limit < 1:
        raise ValueError("a limit must be 1 or more")
    if dry_run:
        limit = min(limit or DRY, DRY)
    known = signature(load).parameters
    given = {k: v for k, v in more.items() if k in known and v is not None}
    if "limit" in known:
        return load(*(spark.read.parquet(f"{data}/{t}.parquet") for t in tables), limit=limit, **given), scorer
    rows = load(spark, **given)
    return (rows.orderBy("id").limit(limit) if limit else rows), scorer


def assembled_prompts(turns: DataFrame) -> DataFrame:
    """``conv_id, prompt, tokens`` of ``turns(conv_id, turn, role, text)``: ``[role]`` and text of each turn, in order."""
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("t"))
    prompt = F.array_join(F.transform("t", lambda x: x["line"]), "\n")
    return rows.select("conv_id", prompt.alias("prompt")).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.char_length("prompt") / 4)).cast("int"))


class ChatCompleter:
    """``complete(prompt)`` over HTTP with a chat-style JSON body; address, key and model are the caller's."""

    def __init__(self, url: str, key: str, model: str, timeout: float = 60) -> None:
        self.url, self.key, self.model, self.timeout = url, key, model, timeout

    def __call__(self, prompt: str) -> str:
        body = dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}).encode()
        ask = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(ask, timeout=self.timeout) as got:
            said = loads(got.read())
        try:
            out = said["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError):
            out = None
        if not isinstance(out, str):
            raise ValueError("the answer does not hold choices[0].message.content")
        return out


class PartsCompleter(ChatCompleter):
    """The same for services that take and give ``contents`` of ``parts``."""

    def __call__(self, prompt: str) -> str:
        body = dumps({"contents": [{"parts": [{"text": prompt}]}]}).encode()
        ask = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "x-goog-api-key": self.key})
        with urllib.request.urlopen(ask, timeout=self.timeout) as got:
            said = loads(got.read())
        try:
            out = said["candidates"][0]["content"]["parts"][0]["text"]
        except (KeyError, IndexError, TypeError):
            out = None
        if not isinstance(out, str):
            raise ValueError("the answer does not hold candidates[0].content.parts[0].text")
        return out


ANSWERS = "id string, ground_truth string, multiplier double, target_ratio double, compression_achieved double, tokens_saved int, original_response string, compressed_response string, failures int, compress_time_ms double"


def answers(samples: DataFrame, complete: Callable[[str], str], multipliers: Sequence[float] = MULTIPLIERS, pins: Sequence[str] = (), pin_spans: bool = False, most_chunks: int = 1900) -> DataFrame:
    """``ANSWERS`` for each sample and multiplier: the model answers each whole prompt once and each shortened one.

    A call that fails counts in ``failures`` and gives an empty answer. Texts are cut to ``most_chunks``.
    """
    ratios = [(float(m), target_ratio(m)) for m in multipliers]
    kernel.pin_patterns(pins)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(prompt: str) -> tuple[str, int]:
            try:
                return complete(prompt), 0
            except Exception:  # noqa: BLE001  whatever the caller's model raises
                return "", 1

        own = kernel.pin_patterns((*pins, r"<<PIN_\d+>>") if pin_spans else pins)
        for part in parts:
            rows = []
            for sid, prompt, truth in zip(part["id"], part["prompt"], part["ground_truth"], strict=True):
                spans = kernel.tool_spans(prompt) if pin_spans else []
                body = kernel.tagged(prompt, spans)
                first, failed = ask(prompt)
                for m, ratio in ratios:
                    began = time.perf_counter()
                    aim = ratio
                    if spans:
                        free = len(prompt) - sum(b - a for a, b in spans)
                        aim = min(len(prompt) * ratio / free, 0.95) if free > 0 else 0.0
                    got = kernel.optimize(body, Options(max(aim, 0.01)), pins=own)
                    short = kernel.untagged(got.compressed, prompt, spans)
                    ms = (time.perf_counter() - began) * 1000
                    reply, lost = ask(short)
                    achieved = 1 - len(short) / max(len(prompt), 1) if spans else got.compression_ratio
                    saved = max(0, kernel.estimate(prompt) - kernel.estimate(short)) if spans else got.tokens_saved
                    rows.append((sid, truth, m, ratio, achieved, saved, first, reply, failed + lost, round(ms, 2)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    rows = samples.select(F.col("id").cast("string").alias("id"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"))
    cut = chunks.truncated(rows.select(F.col("id").alias("doc_id"), F.col("prompt").alias("text")), most_chunks) if most_chunks else None
    if cut is not None:
        rows = rows.drop("prompt").join(cut.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt")), "id")
    return rows.select("id", "prompt", "ground_truth").mapInPandas(run, ANSWERS)


def results(answers: DataFrame, scorer: str) -> DataFrame:
    """Scores of both answers, their difference and quotient, rounded to 4 places."""
    truth = F.col("ground_truth")
    if scorer == "f1":
        keys = answers.withColumn("k", F.monotonically_increasing_id())
        one = lambda c, name: S.f1_scores(keys.select(F.struct("id", "multiplier").alias("id"), F.col(c).alias("predicted"), "ground_truth")).select("id.id", "id.multiplier", F.col("score").alias(name))
        rows = answers.join(one("original_response", "o"), ["id", "multiplier"]).join(one("compressed_response", "c"), ["id", "multiplier"])
    else:
        score = SCORERS[scorer]
        rows = answers.withColumns({"o": score(F.col("original_response"), truth), "c": score(F.col("compressed_response"), truth)})
    quotient = F.when(F.col("o") > 0, F.col("c") / F.col("o")).otherwise(1.0)
    return rows.select("id", "multiplier", "target_ratio", "compression_achieved", "tokens_saved", F.round("o", 4).alias("original_score"), F.round("c", 4).alias("compressed_score"), F.round(F.col("c") - F.col("o"), 4).alias("score_delta"), F.round(quotient, 4).alias("relative_quality"), "compress_time_ms", "failures")


def summary(results: DataFrame) -> DataFrame:
    """Means and the deviation of the difference for each multiplier, in numeric order."""
    mean = lambda c, places=4: F.round(F.avg(c), places)
    return results.groupBy("multiplier").agg(
        F.count("*").alias("n_samples"), mean("original_score").alias("mean_original_score"), mean("compressed_score").alias("mean_compressed_score"), mean("relative_quality").alias("mean_relative_quality"),
        mean("score_delta").alias("mean_score_delta"), F.round(F.coalesce(F.stddev_samp("score_delta"), F.lit(0.0)), 4).alias("std_score_delta"), mean("compression_achieved").alias("mean_compression_achieved"), mean("compress_time_ms", 2).alias("mean_compress_time_ms"),
    ).orderBy("multiplier")


def labelled(summary: DataFrame) -> DataFrame:
    """With ``label``, such as ``2x``, and ``place``, its numeric rank."""
    return summary.withColumns({"label": F.concat(F.regexp_replace(F.col("multiplier").cast("string"), r"\.0$", ""), F.lit("x")), "place": F.row_number().over(Window.orderBy("multiplier"))})


__all__ = ["ANSWERS", "SCORERS", "answers", "labelled", "results", "summary", "target_ratio", "P"]
