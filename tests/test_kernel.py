import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraloom import fixtures as X
from spectraloom.functions import pins
from spectraloom.operators import chunks, graph
from spectraloom.operators.spectral import second_eigenpair
from spectraloom.plans import compress as plans
from spectraloom.plans import kernel as K

RULES = "You must answer in json. Always name the pier first, never guess. " + " ".join(f"The boat number {w} came in at noon with much grain." for w in ("one", "two", "three", "four", "five", "six", "seven", "eight"))


def test_passing():
    assert K.optimize("Hello world.").compressed == "Hello world."
    assert K.optimize("Hello world.").chunks_total == 1
    assert K.optimize("").status == "passed" and K.optimize(None).compressed is None and K.optimize(" \n").chunks_total == 0


@pytest.mark.parametrize("n", [3, 7, 20])
def test_path_graph(n):
    parts = K.chunk(X.disjoint(n), "sentence")
    assert len(parts) == n
    v, lam = second_eigenpair(K.adjacency(K.similarity(parts)))
    assert lam == pytest.approx(0.2 * (1 - math.cos(math.pi / n)), abs=1e-12)
    want = [abs(math.cos(math.pi * (i + 0.5) / n)) / math.cos(math.pi / (2 * n)) for i in range(n)]
    assert np.allclose(np.abs(v), want, atol=1e-8)


def test_complete_graph():
    a = np.ones((5, 5)) - np.eye(5)
    assert second_eigenpair(a)[1] == pytest.approx(5)


def test_graph_shape():
    a = K.adjacency(K.similarity(K.chunk(RULES, "sentence")))
    assert (a == a.T).all() and (np.diag(a) == 0).all() and (a >= 0).all() and (np.diag(a, 1) > 0).all()
    assert (K.adjacency(np.ones((1, 1))) == 1).all()


def test_kept_and_removed_are_all():
    r = K.optimize(RULES, K.Options(0.5))
    assert 0 < r.chunks_removed <= r.chunks_total * 0.5
    assert sorted([*r.compressed.split("\n\n"), *r.removed_chunks]) == sorted(K.chunk(RULES))


def test_protection_and_pins():
    r = K.optimize(RULES, K.Options(0.9))
    assert "You must answer in json." in r.compressed
    assert K.optimize(RULES, K.Options(0.5, pins=("boat|json|pier",))).chunks_removed == 0
    assert "number three" in K.optimize(RULES, K.Options(0.7, pins=("number THREE",))).compressed
    assert K.optimize(RULES, K.Options(0.0)).chunks_removed == 0


def test_bad_pins():
    for bad in (["(a+)+"], ["x"] * 101, ["y" * 1001]):
        with pytest.raises(ValueError):
            pins.validated(bad)
    assert K.pin_patterns(["[unclosed"])[0].search("an [unclosed one")


def test_too_large_and_vocabulary():
    r = K.optimize(X.disjoint(2001))
    assert r.status == "too_large" and r.compressed == X.disjoint(2001) and r.chunks_total == 2001
    some = K.similarity(["one two three", "one two four", "one five six"], max_vocabulary=2)
    assert some[0, 1] == pytest.approx(1) and 0 < some[0, 2] < 1


def test_vectors():
    parts = K.chunk(RULES)
    v = np.eye(len(parts))
    assert K.optimize(RULES, vectors=v).algebraic_connectivity == pytest.approx(0.2 * (1 - math.cos(math.pi / len(parts))))
    with pytest.raises(ValueError):
        K.optimize(RULES, vectors=v[:2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb c", "Dd ee ff. ", "x! ", "\n\n", '"Q" ', "U.S. ", "1.5 "]), max_size=120).map(" ".join))
def test_chunks_keep_all_words(text):
    for strategy in ("sentence", "paragraph"):
        assert " ".join(K.chunk(text, strategy)).split() == text.split()
    assert all(len(c.split()) >= 3 for c in K.chunk(text)[:-1])


def test_relational_equals_fused(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rel = {r.doc_id: r for r in plans.compress_relational(docs).collect()}
    fused = {r.doc_id: r for r in plans.compress(docs).collect()}
    assert rel.keys() == fused.keys() and {r.status for r in rel.values()} == {"ok", "passed"}
    for k, r in rel.items():
        f = fused[k]
        assert (r.compressed, r.chunks_total, r.chunks_removed, r.removed_chunks, r.tokens_saved, r.status) == (f.compressed, f.chunks_total, f.chunks_removed, f.removed_chunks, f.tokens_saved, f.status)
        assert r.compression_ratio == pytest.approx(f.compression_ratio) and np.allclose(r.chunk_scores, f.chunk_scores)


def test_relational_keeps_every_document(spark, monkeypatch):
    """Null, blank, short and too large documents have a row and a status, as in the fused plan."""
    monkeypatch.setattr("spectraloom.operators.graph.MAX_CHUNKS", 12)
    monkeypatch.setattr("spectraloom.plans.kernel.MAX_CHUNKS", 12)
    rows = [(1, None), (2, " \n"), (3, "Short text here."), (4, "It is a fine day here. " * 10), (5, "It is a fine day here. " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rel = {r.doc_id: (r.compressed, r.chunks_total, r.chunks_removed, r.status) for r in plans.compress_relational(docs).collect()}
    alone = {i: K.optimize(t) for i, t in rows}
    assert rel == {i: (r.compressed, r.chunks_total, r.chunks_removed, r.status) for i, r in alone.items()} and [rel[k][3] for k in range(1, 6)] == ["passed", "passed", "passed", "ok", "too_large"]


def test_native_chunks_equal_kernel(spark):
    odd = [(0, "Dr. Smith went. U.S. Army said no! \"Yes\" it is.\nNew line. über alles. 3.5 is. End"), (1, "Tab\there. Next\x0bone.  A  b c d."), (2, None), (3, ""), (4, "  \n "), (5, "One. Two. " * 40), (6, "word " * 50), (7, "word " * 51), (8, "word " * 76), (9, "para one is here\n\n\npara two is here\n \npara three is here\n\nfour")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    for strategy in ("adaptive", "sentence", "paragraph", "window"):
        got: dict = {}
        for r in chunks.chunks_with_offsets(docs, strategy).orderBy("chunk_index").collect():
            got.setdefault(r.doc_id, []).append((r.text, r.start_char, r.end_char, r.word_count))
        for k, t in odd:
            parts = K.chunk(t or "", strategy)
            want = [(c, a, b, len(c.split())) for c, (a, b) in zip(parts, K.offsets(K.normalise(t or ""), parts), strict=True)]
            assert got.get(k, []) == want, (strategy, k)


def test_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert plans.compress(none).count() == 0 and graph.text_graph(chunks.chunks(none)).count() == 0
    more = spark.createDataFrame([(1, RULES, "x", 3.0)], "doc_id long, text string, status string, compressed double")
    assert plans.compress(more).first().chunks_total == K.optimize(RULES).chunks_total


def test_pinned_spans(spark):
    text = X.PROMPTS[5][1] + "\n[user]\n" + RULES
    docs = spark.createDataFrame([(1, text), (2, None), (3, RULES)], "doc_id long, text string")
    rows = {r.doc_id: r for r in plans.with_pinned_spans(docs, K.Options(0.4)).collect()}
    assert "[tool_result]\nstatus: open\nowner: pier" in rows[1].compressed and "<<PIN" not in rows[1].compressed
    assert rows[2].compressed is None and rows[1].spans == 2 and rows[3].spans == 0
    spans = K.tool_spans(text)
    assert K.untagged(K.tagged(text, spans), text, spans) == text


def test_sections():
    got = pins.section_patterns(["rule"], X.PROMPTS[0][1])
    assert any("Name" in p for p in got) and any("Safety" in p for p in got) and not any("founded" in p for p in got)
