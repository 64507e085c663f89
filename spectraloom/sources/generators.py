"""Made-up evaluation prompts: system prompts, agent transcripts and texts that are hard to shorten.

All are built by rule from small lists, so the same arguments give the same samples.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

SAMPLE = "id string, prompt string, ground_truth string"
_TRADES = ("billing", "travel", "garden", "library", "fitness", "kitchen", "housing", "transit", "insurance")
_FORMS = (("json", "Return one JSON object with the keys {keys}."), ("markdown_table", "Return a Markdown table with the columns {keys}."))
_KEYS = ("summary", "severity", "owner", "deadline", "next_step", "confidence")
_QUERIES = ("A customer reports that order {n} came late. What now?", "Explain the open points of case {n}.", "Which of the {n} requests goes first?")


def system_prompts(spark: SparkSession, n: int = 50) -> DataFrame:
    """Instructions in sections, then a question; the truth lists formats, keys and rules to meet."""
    rows = []
    for k, (trade, (form, ask), query) in enumerate(product(_TRADES, _FORMS, _QUERIES)):
        if k >= n:
            break
        keys = [_KEYS[(k + j) % len(_KEYS)] for j in range(3)]
        rule = f"cite case file {k + 100}"
        prompt = "\n\n".join((f"# {trade.title()} assistant", f"## Role\nYou are an assistant for {trade}.", f"## Rules\n1. You must {rule}.\n2. Never guess a {keys[0]}.", f"## Format\n{ask.format(keys=', '.join(keys))}", f"## Background\nThe {trade} team was founded in {1980 + k}. It has been open on weekdays since then.", f"## Examples\nFor instance, a {trade} note of ten words.", "## Safety\nDo not share private data.", f"## Tone\nKeep it plain.\n\nQuestion: {query.format(n=k + 3)}"))
        rows.append((f"system_{k}", prompt, "\n".join([f"format:{form}", *(f"key:{x}" for x in keys), f"rule:{rule}"])))
    return spark.createDataFrame(rows, SAMPLE)


def agent_transcripts(spark: SparkSession, variants: int = 10) -> DataFrame:
    """Turns of five kinds of task with tool results, one value of which a later turn replaces."""
    rows = []
    for kind, v in product(("deploy", "order", "search", "report", "repair"), range(variants)):
        old, new, code = 100 + 7 * v, 200 + 11 * v, f"{kind[:2].upper()}-{v}{len(kind)}"
        turns = [("system", f"You are an agent for {kind} tasks. Always cite the reference code."), ("user", f"Start the {kind} task {v}."), ("tool_call", f"{kind}.lookup(id={v})"), ("tool_result", f"reference: {code}\namount: {old}\nstatus: open"), ("assistant", f"The {kind} task is open and stands at {old}."), *[("assistant_reasoning", f"Step {j} of the {kind} task needs no change, as the notes of day {j} say.") for j in range(6)], ("tool_result", f"reference: {code}\namount: {new}\nstatus: closed"), ("user", f"What is the final amount of {code}?")]
        rows.append((f"agent_{kind}_{v}", "\n".join(f"[{r}]\n{t}\n" for r, t in turns), f"answer:{new}\ntool_ref:{code}\nstale:{old}|{new}"))
    return spark.createDataFrame(rows, SAMPLE)


def hard_texts(spark: SparkSession, n: int = 10) -> DataFrame:
    """Dense facts, key facts that look like filler, and repetitive or odd shapes; the truth lists phrases to keep."""
    rows = []
    for k in range(n):
        facts = [f"Unit {k}{j} weighs {3 * j + k} grams" for j in range(12)]
        rows.append((f"dense_{k}", ". ".join(facts) + ".", "\n".join(facts[::4])))
        key = f"the code word is lantern{k}"
        rows.append((f"deceptive_{k}", f"The weather was mild. By the way, {key}. " + " ".join(f"Nothing much happened on day {j} of the trip." for j in range(10)), key))
        odd = f"Marker {k} stands alone here."
        rows.append((f"pathological_{k}", ("Same line again and again here. " * (5 + k)) + odd + " " + "x " * 20, odd))
    return spark.createDataFrame(rows, SAMPLE)


def small_suite(spark: SparkSession) -> DataFrame:
    """Three prompts to try things out: ``name, text``."""
    rows = [("support", system_prompts(spark, 1).first()["prompt"]), ("agent", agent_transcripts(spark, 1).first()["prompt"]), ("dense", hard_texts(spark, 1).first()["prompt"])]
    return spark.createDataFrame(rows, "name string, text string")
