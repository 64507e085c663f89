import pytest
from pyspark.sql import functions as F
from tests.conftest import plain

from spectraloom import catalog
from spectraloom.functions import zones
from spectraloom.operators import by_document, chunks, graph, prune, spectral, tfidf
from spectraloom.plans import compress as plans
from spectraloom.plans import kernel

TEXT = "The first boat came in early. The second boat came in late at night. Nobody saw the third boat at all. The pier was empty then. A last boat left the pier."
#: Null, blank, short, long, equal and word-less texts; an id that occurs twice, apart; more chunks than a graph may have.
ROWS = [(1, TEXT), (2, None), (3, ""), (4, "One two three."), (5, "12 34 56. 78 90 12. Then 1 2 3 4."), (6, TEXT + " " + TEXT), (7, "The pier. " * 40), (8, "One boat here. No boat there."), (9, "Ünder die Brücke kam das Boot. Das Boot war ALT und K\u212arank."), (1, "Another boat came in first. It was the last boat of the day."), (10, TEXT.replace("boat", "ship"))]
MOST = 12


@pytest.fixture
def docs(spark, monkeypatch):
    monkeypatch.setattr("spectraloom.operators.graph.MAX_CHUNKS", MOST)
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3, F.rand(1))


def rows_of(df):
    return sorted(tuple(plain(round(x, 9) if isinstance(x, float) else x) for x in r) for r in df.collect())


def test_equals_the_relational_steps(docs):
    rows = chunks.chunks(docs, "sentence")
    tf, edges = tfidf.term_frequency(rows), graph.text_graph(rows)
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") <= MOST)
    degrees = graph.degrees(edges)
    top = degrees.groupBy("doc_id").agg(F.max("degree").alias("top"))
    for got, want in (
        (by_document.term_frequency(docs), tf),
        (by_document.document_frequency(docs), tfidf.document_frequency(tf)),
        (by_document.weights(docs), tfidf.weights(rows)),
        (by_document.edges(docs), edges),
        (by_document.degrees(docs), degrees),
        (by_document.degrees(docs, shares=True), degrees.join(top, "doc_id").select("doc_id", "chunk_index", F.col("degree") / F.col("top"))),
        (by_document.connectivity(docs), spectral.spectra(edges, sizes).select("doc_id", "n", "lambda2")),
    ):
        assert [c.split(":")[0] for c in got.columns][0] == "doc_id" and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        have = rows_of(got)
        assert have and have == rows_of(want)


def test_removals_equal_the_relational_steps(docs):
    once = docs.where("doc_id > 1")
    rows = chunks.chunks(once, "sentence")
    degrees = graph.degrees(graph.text_graph(rows))
    big = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("doc_id")).where("n >= 4").select("doc_id")
    top = degrees.groupBy("doc_id").agg(F.max("degree").alias("top"))
    scored = rows.join(big, "doc_id", "left_semi").join(degrees.join(top, "doc_id").select("doc_id", "chunk_index", (F.col("degree") / F.col("top")).alias("score")), ["doc_id", "chunk_index"])
    want = prune.pruned(scored, 0.2)
    marks = want.select("doc_id", "removed", F.explode(F.transform("parts", lambda x: x["chunk_index"])).alias("chunk_index"))
    assert rows_of(by_document.removals(once)) == rows_of(marks.select("doc_id", "chunk_index", F.array_contains("removed", F.col("chunk_index"))))
    built = prune.rebuilt(want).select("doc_id", "compressed", "chunks_removed")
    assert rows_of(by_document.rebuilt(once).select("doc_id", "compressed", "chunks_removed")) == rows_of(built)
    assert {r.doc_id for r in by_document.rebuilt(docs).where("doc_id = 1").collect()} == {1} and by_document.rebuilt(docs).where("doc_id = 1").count() == 2


def test_ids_of_any_kind(spark):
    named = spark.createDataFrame([("a", TEXT), (None, TEXT), ("b", TEXT)], "doc_id string, text string")
    got = by_document.edges(named).collect()
    assert {r.doc_id for r in got} == {"a", None, "b"} and {r.w for r in got if r.doc_id is None} == {graph.PROXIMITY}
    assert {r.doc_id for r in by_document.weights(named).collect()} == {"a", "b"}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert by_document.edges(none).count() == 0 and by_document.rebuilt(none).count() == 0


@pytest.mark.parametrize("name", ["term_frequency", "document_frequency", "tfidf_weights", "similarity_edges", "weighted_degree", "degree_centrality", "algebraic_connectivity", "prune_greedy", "reconstruct_metrics"])
def test_terms_and_edges_are_never_dealt_out(name, spark, sf):
    """One shuffle, of the texts; before, every term, pair and edge was a row of some shuffle."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and not any(x in plan for x in ("Generate", "Join", "Window", "Aggregate"))


def joined(docs, options):
    """The scores by joins and aggregates."""
    rows = chunks.chunks(docs, options.strategy)
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") >= options.min_chunks) & (F.col("n") <= MOST))
    edges = graph.text_graph(rows.join(sizes.select("doc_id"), "doc_id", "left_semi"))
    return rows.join(spectral.centrality(graph.degrees(edges), spectral.spectra(edges, sizes)), ["doc_id", "chunk_index"])


@pytest.mark.parametrize("options", [plans.Options(), plans.Options(0.5, "sentence", pins=("pier",)), plans.Options(0.4, "window", protect=False, min_chunks=2)])
def test_scores_equal_the_joined_ones(docs, options):
    marks = [(20, "You must name the boat. Always answer in full. The pier is made of wood. It was built long ago. Never guess. You should act as a clerk with json in hand.")]
    once = docs.where("doc_id > 1").union(docs.sparkSession.createDataFrame(marks, "doc_id long, text string"))
    names = ["doc_id", "chunk_index", "text", "word_count", "degree_centrality", "score"]
    assert rows_of(plans.scored_chunks(once, options).select(names)) == rows_of(joined(once, options).select(names))
    scored = plans.scored_chunks(once, options)
    want = prune.rebuilt(prune.pruned(scored, options.target_ratio, options.protect))
    got = plans.compress_relational(once, options).where("status = 'ok'")
    assert rows_of(got.select(want.columns)) == rows_of(want) and got.count() > 1
    few = F.col("doc_id") != 7  # the fused plan's own limit of chunks is not lowered here
    assert rows_of(got.select(want.columns).where(few)) == rows_of(plans.compress(once.where(few), options).where("status = 'ok'").select(want.columns))
    native = scored.withColumns({f"native_{k}": c for k, c in zones.zone_columns(F.col("text")).items()})
    assert native.where("native_zone <> zone or abs(native_confidence - confidence) > 1e-12 or abs(native_protection_weight - protection_weight) > 1e-12").count() == 0


@pytest.mark.parametrize("name", ["compress_by_operators", "chunk_scores"])
def test_scored_documents_are_not_dealt_out_again(name, spark, sf):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 1 and "hashpartitioning" not in plan and not any(x in plan for x in ("Join", "Window", "Aggregate"))


def test_equal_ids_stay_texts_of_their_own(docs):
    rows = plans.compress_relational(docs).where("doc_id = 1").collect()
    assert sorted(r.chunks_total for r in rows) == sorted(len(kernel.chunk(t)) for i, t in ROWS if i == 1)
