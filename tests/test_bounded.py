"""What a task holds and how often it walks a text does not grow with the table or the text."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectraloom import catalog
from spectraloom.functions import digest
from spectraloom.functions import strip as S
from spectraloom.operators import chunks
from spectraloom.plans import compress as plans
from spectraloom.plans import kernel, reports

LONG = " ".join(f"Boat number {k} came into the harbour." for k in range(30))


def test_truncated_is_a_row_for_each_row(spark):
    """Before, texts were joined with their ends by id: two of one id made four rows, one without an id none."""
    rows = [(1, LONG), (1, "One boat is here. It is early."), (None, LONG), (2, None), (3, "")]
    got = sorted(map(tuple, chunks.truncated(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()), key=str)
    end = kernel.offsets(LONG, kernel.chunk(LONG))[19][1]
    want = [(1, LONG[:end], 30, True), (1, rows[1][1], len(kernel.chunk(rows[1][1])), False), (None, LONG[:end], 30, True), (2, None, 0, False), (3, "", 0, False)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("name", ["truncate_prompts", "chunk_offsets"])
def test_places_are_found_in_one_walk(name, spark, sf):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_column_chunks_equal_the_kernel(spark):
    odd = [(1, LONG), (2, None), (3, " \n "), (4, 'Dr. Smith went. U.S. Army said no! "Yes" it is.\nNew line. 3.5 is. End'), (5, "word " * 76)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    for strategy in ("adaptive", "sentence", "paragraph", "window"):
        got: dict = {}
        for r in chunks.chunks(docs, strategy).orderBy("chunk_index").collect():
            got.setdefault(r.doc_id, []).append((r.text, r.word_count))
        assert got == {k: [(c, len(c.split())) for c in parts] for k, t in odd if (parts := kernel.chunk(t or "", strategy))}


def by_rules(text, level):
    """The rules as they are written, one after another."""
    for p, to in [*S._RULES[level], *S._TIDY]:
        text = p.sub(to, text)
    return text.strip()


@pytest.mark.parametrize("level", S.LEVELS)
def test_rules_are_tried_where_their_words_occur(level, spark, sf, monkeypatch):
    docs = [t or "" for (t,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    odd = ["It is juſt the surely measured, and THE boats are very\t slow , no   problem.", "Kind of course an end, yet we go\n\n\n\n - happy to  \n  rest", "xof coursetheof course the", ",and, I was , you are. It"]
    for t in odd + docs:
        assert S._tidy(S._ruled(t, level)).strip() == by_rules(t, level)
    tried = []
    monkeypatch.setattr(S, "_these", lambda words: tried.append(words) or S.re.compile(S._any(words)))
    S._ruled("No boat came in.", level)
    S._ruled("The boat went away.", level)
    assert tried == ([] if level == "lite" else [("The",)])


def batches(run, texts):
    table = pa.table({"doc_id": range(len(texts)), "text": texts})
    return list(run(iter(table.to_batches())))


def test_stripped_and_staged_rows_leave_in_small_batches(spark, monkeypatch):
    """Before, a batch of 10,000 rows was held as Python objects, results and all, before the first row left."""
    docs, kept = spark.createDataFrame([(k, "It is a day.") for k in range(3)], "doc_id long, text string"), []
    for kind in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), kind, lambda self, f, schema, *a, _f=getattr(type(docs), kind), **b: kept.append(f) or _f(self, f, schema, *a, **b))
    assert plans.staged(docs, pre="lite").count() == 3
    out = batches(kept[0], ["It is a fine day. " * 6] * 600)
    assert [b.num_rows for b in out] == [256, 256, 88]
    made = []
    monkeypatch.setattr(S.F, "pandas_udf", lambda schema: lambda f: made.append(f) or (lambda text: text))
    S.stripped_column(F.col("text"), "lite")
    assert [len(d) for d in made[0](iter([pd.Series(["It is just a day."] * 600), pd.Series([], dtype=object)]))] == [256, 256, 88, 0]


@pytest.mark.parametrize("row", ["7", "123456", None, "ü" * 9, "x" * 38, "x" * 39, "x" * 80])
def test_poisson_weights_are_those_of_the_digest(row):
    got = digest.Weights(1203, 20260714).of(row)
    names = [f"20260714:{k}" + (f":{row}" if row is not None else "") for k in range(1203)]
    u = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in names]
    assert got.tolist() == [sum(x >= cut for cut in digest.POISSON_CUTS) for x in u]


def test_bootstrap_deals_rows_not_their_replicates(spark, monkeypatch):
    """More groups than a task holds sums of; null values and a null group; no row for each row and replicate."""
    monkeypatch.setattr(reports, "GROUPS", 2)
    monkeypatch.setattr(reports, "WAVES", 1)
    rows = [(None if k % 7 == 0 else f"g{k % 5}", k, None if k % 11 == 0 else k * 0.25) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, k long, x double").coalesce(1)
    out = reports.bootstrap_means(df, "g", "k", "x", reps=50)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.g: (r.n, r["mean"], r.lo, r.hi) for r in out.collect()}
    weight = digest.Weights(50, 20260714)
    for g in {r[0] for r in rows}:
        mine = [(weight.of(str(k)).astype(int), x) for a, k, x in rows if a == g and x is not None]
        means = [sum(w[j] * x for w, x in mine) / n for j in range(50) if (n := sum(w[j] for w, _ in mine))]
        lo, hi = np.quantile(means, [0.025, 0.975])
        assert got[g] == pytest.approx((len(mine), np.mean([x for _, x in mine]), lo, hi))
