import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from spectraloom import fixtures as X
from spectraloom import sources, streaming
from spectraloom.functions import scorers as S
from spectraloom.functions.strip import strip_text
from spectraloom.plans import compress as plans
from spectraloom.plans import evaluate, reports
from spectraloom.sources import generators


@pytest.mark.parametrize("kept", ["```\nx = the a\n```", "`the a`", "https://a.b/the/a", "/usr/the/a.txt", '"the very a"', "v1.2.3-beta", "2024-01-15", "3.50"])
def test_strip_keeps(kept):
    got = strip_text(f"It is the {kept} here", "ultra")
    assert kept in got["text"] and kept in got["preserved_blocks"] and "the " not in got["text"].replace(kept, "")


def test_strip_levels_and_terms():
    t = "The boats were really very slow, and they stop."
    sizes = [strip_text(t, level)["compressed_tokens"] for level in ("lite", "full", "ultra")]
    assert sizes == sorted(sizes, reverse=True) and strip_text(t, "LITE")["original_tokens"] == 9
    assert "very" in strip_text(t, "full", ["very"])["text"]
    assert strip_text("measure", "lite")["text"] == "mea"
    with pytest.raises(ValueError):
        strip_text(t, "extreme")
    assert strip_text("")["compression_ratio"] == 0.0


def test_staged(spark):
    docs = spark.createDataFrame([(1, "It is really the case. " * 12), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in plans.staged(docs, post="full").collect()}
    assert [s.name for s in rows[1].stages] == ["spectral", "strip"] and rows[1].total_output_tokens < rows[1].total_input_tokens
    assert rows[3].shortened is None and rows[2].total_ratio == 0
    with pytest.raises(ValueError):
        plans.staged(docs, pre="lite", only="full")


def test_sql_functions(spark):
    plans.register(spark)
    text = "It is a fine day here. " * 10
    spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("texts")
    row = spark.sql("SELECT spectral_compress(t, 0.3D) AS r, grammar_strip(t, 'full') AS s FROM texts").first()
    assert row.r.chunks_removed == 3 and row.s.startswith("It is fine day")
    assert spark.sql("SELECT c.* FROM texts, LATERAL chunk_text(t) c").count() == 10


def test_paths(tmp_path):
    ok = tmp_path / "a.txt"
    ok.write_text("hi")
    assert sources.checked_path(str(ok)) == str(ok)
    big = tmp_path / "big"
    big.write_bytes(b"x" * (sources.MAX_BYTES + 1))
    for bad in ("", "a\0b", "../x", f"{tmp_path}/../y", "a/../../b", str(tmp_path), str(tmp_path / "none"), str(big), "..\\x"):
        with pytest.raises(ValueError):
            sources.checked_path(bad)
    with pytest.raises(ValueError):
        sources.checked_output("../out")


def test_suite(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text('{"name": "a", "text": "one"}\n\n{"text": "two"}\n')
    assert [(r.line_no, r.name, r.text) for r in sources.suite(spark, str(f)).orderBy("line_no").collect()] == [(1, "a", "one"), (3, "Unnamed", "two")]
    for bad in ("{nope}", '{"name": "x"}'):
        f.write_text('{"text": "one"}\n' + bad)
        with pytest.raises(ValueError, match="line 2"):
            sources.suite(spark, str(f))


def test_result_files(spark, tmp_path):
    f = tmp_path / "r.json"
    f.write_text(json.dumps({"results": {"m": {"base": [1.0, 0.5], "none": []}}, "memleak": {"m": ["q1"]}}))
    values, leaks = sources.survival_file(spark, str(f))
    qids = spark.createDataFrame([(0, "q0"), (1, "q1")], "idx int, qid string")
    rows = reports.survival_filtered(reports.survival_values(values, qids), leaks).collect()
    assert [(r.cond, r.all_n, r.all_mean, r.filtered_n, r.filtered_mean) for r in rows] == [("base", 2, 0.75, 1, 1.0)]
    f.write_text(json.dumps({"records": [{"model": "m", "qid": "q", "band": "b", "cond": "c", "survival": 0.5}], "memleak": {}}))
    assert sources.depth_file(spark, str(f))[0].first().value == 0.5
    f.write_text(json.dumps({"per_item": {"m": {"c": [{"qid": "q", "em_rate": 1, "f1_mean": 0.5, "achieved_tok_ratio": 0.5}]}}, "memleak": {}}))
    assert reports.sweep_rows(*sources.sweep_file(spark, str(f))).first().factor == 2.0


def test_output(spark):
    docs = spark.createDataFrame([(1, "It is a fine day here. " * 10)], "doc_id long, text string")
    done = plans.compress(docs, plans.Options(0.3))
    said = json.loads(sources.as_json(done, True).first().json)
    assert said["chunks_removed"] == 3 and len(said["removed_chunks"]) == 3
    assert "[3] It is a fine" in sources.as_report(done, True).first().report
    assert sources.markdown(done.select("doc_id", "chunks_total")).endswith("| 1 | 10 |")


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(k, f"Day {k} is a fine day. " * 8) for k in range(5)], "doc_id long, text string")
    docs.write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        q = streaming.compress_folder(spark, src, out, str(tmp_path / "cp"))
        q.awaitTermination(60)
    got = {r.doc_id: r.compressed for r in spark.read.parquet(out).collect()}
    assert got == {r.doc_id: r.compressed for r in plans.compress(docs).collect()} and len(got) == 5


def test_scorers():
    assert S.lcs_length("a b c d".split(), "b x d".split()) == 2 and S.lcs_length([], ["a"]) == 0
    assert S.rouge_l_of("the cat", "the cat") == 1.0 and S.rouge_l_of("", "") == 1.0 and S.rouge_l_of("a", "") == 0.0


def test_runner(spark):
    samples = generators.agent_transcripts(spark, 2)

    def broken(prompt):
        if "DE-" in prompt:
            raise RuntimeError("no answer")
        return prompt

    rows = evaluate.answers(samples, broken, (1.0, 4.0), pin_spans=True)
    out = evaluate.results(rows, "context").collect()
    assert len(out) == 20 and sum(r.failures for r in out) == 8
    assert all(r.original_score > 0.9 for r in out if not r.failures)
    f1 = evaluate.results(evaluate.answers(generators.hard_texts(spark, 2), str, (2.0,)), "f1")
    assert f1.count() == 6
    table = evaluate.labelled(evaluate.summary(evaluate.results(rows, "context")))
    assert [r.label for r in table.orderBy("place").collect()] == ["1x", "4x"]
    with pytest.raises(ValueError):
        evaluate.target_ratio(0.5)


def test_loaders(spark):
    qa = spark.createDataFrame([(k, f"q{k}", f"so {k} #### {k}") for k in range(6)], "id int, question string, answer string")
    got = evaluate.math_word_samples(qa, qa, 2, 3).orderBy("id").collect()
    assert len(got) == 3 and got[1].ground_truth == "1" and got[0].prompt.count("Q: ") == 3
    open_q = spark.createDataFrame([(1, "who", ["<p>", "Ann", "ran"], [True, False, False], ["", "Ann"]), (2, "what", ["x"], [False], [""])], "id int, question string, tokens array<string>, is_html array<boolean>, short_answers array<string>")
    row = evaluate.open_question_samples(open_q).collect()
    assert len(row) == 1 and row[0].ground_truth == "Ann" and "Ann ran" in row[0].prompt and "<p>" not in row[0].prompt
    assert evaluate.meeting_samples(spark.createDataFrame([(1, "t", "s")], "id int, transcript string, summary string")).first().ground_truth == "s"
    assert evaluate.task_samples(spark.createDataFrame([(1, "t", "s")], "id int, input string, target string"), 1).count() == 1
    para = spark.createDataFrame([(k, "w " * (50 + 20 * k), ["a"]) for k in range(20)], "id int, context string, answers array<string>")
    assert evaluate.paragraph_samples(para, 5).count() == 5


def test_datasets(spark, tmp_path):
    for name, n, scorer in (("system_prompts", 50, "instruction"), ("agentic_contexts", 50, "context"), ("adversarial", 30, "phrases")):
        rows, by = evaluate.dataset(spark, name)
        assert rows.count() == n and by == scorer
        assert evaluate.dataset(spark, name, dry_run=True)[0].count() == 10 and evaluate.dataset(spark, name, limit=3, dry_run=True)[0].count() == 3
    assert evaluate.dataset(spark, "agentic_contexts", variants=2, shots=9)[0].count() == 10
    qa = spark.createDataFrame([(k, f"q{k}", f"so {k} #### {k}") for k in range(15)], "id int, question string, answer string")
    for part in ("train", "test"):
        qa.write.parquet(f"{tmp_path}/{part}.parquet")
    rows, by = evaluate.dataset(spark, "gsm8k", str(tmp_path), dry_run=True, shots=2)
    assert by == "exact_match_number" and sorted(int(r.id) for r in rows.collect()) == list(range(10)) and rows.first().prompt.count("Q: ") == 3
    assert len(evaluate.DATASETS) == 7
    for wrong in ({"name": "none"}, {"name": "bbh"}, {"name": "adversarial", "limit": 0}):
        with pytest.raises(ValueError):
            evaluate.dataset(spark, **wrong)


def test_latency_table(spark):
    rows = reports.latency(reports.profile(spark, (100, 100_000), runs=2)).collect()
    assert [r.stage for r in rows] == [*reports.STAGES, None] and rows[-1].skipped and rows[-1]["median"] is None
    assert rows[6].share == 1 and all(r.peak_mb > 0 and r.warning is None for r in rows[:7])


def test_generators(spark):
    assert generators.system_prompts(spark).count() == 50 and generators.agent_transcripts(spark).count() == 50 and generators.hard_texts(spark).count() == 30
    assert generators.small_suite(spark).count() == 3


def test_profile(spark):
    rows = reports.profile(spark, (100, 500), runs=2)
    assert rows.select("stage").distinct().count() == 7 and rows.where("ms < 0").count() == 0
    assert reports.profile(spark, (100_000,), runs=1).where("skipped").count() == 1
    assert reports.made_text(100) == reports.made_text(100) != reports.made_text(100, 7) and len(reports.made_text(100)) >= 400
    levels = spark.createDataFrame([(500.0,), (2000.0,), (6000.0,), (40_000.0,)], "ms double").select(reports.eigen_warning(F.col("ms")).alias("w"))
    assert [r.w for r in levels.collect()] == [None, "NOTE", "WARNING", "CRITICAL"]


def test_command_line(tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", "spectraloom", *a], capture_output=True, text=True, timeout=60)
    text = "It is a fine day here. " * 10
    said = json.loads(run("optimize", text, "--target", "0.3", "--json", "--post-strip").stdout)
    assert said["chunks_removed"] == 3 and [s["name"] for s in said["pipeline"]["stages"]] == ["spectral", "strip"]
    assert run("optimize", text, "--target", "1.5").returncode == 1 and run("optimize", "--file", "../x").returncode == 1
    assert run("optimize", text, "--pre-strip", "--strip-only").returncode == 2
    assert "Compression ratio" in run("optimize", X.PROMPTS[0][1], "--pin-sections", "rule", "--pin-instructions").stdout
