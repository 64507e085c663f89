"""Registered queries: one callable (spark, sf_dir) -> DataFrame for each operator. Their SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom import fixtures as X
from spectraloom import oracles
from spectraloom.functions import pins, scorers, zones
from spectraloom.functions import strip as strips
from spectraloom.functions import text as T
from spectraloom.operators import by_document, chunks, graph, prune, spectral
from spectraloom.plans import compress as plans
from spectraloom.plans import evaluate, reports
from spectraloom.sources import generators

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = oracles.SQL


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts, dealt over all cores where the table comes as a few files only."""
    return plans.spread(texts(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts, for steps that deal them by id themselves."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def prompts(spark: SparkSession, key: str = "doc_id") -> DataFrame:
    return X.frame(spark, X.PROMPTS, f"{key} long, text string")


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.frame(spark, X.PLAIN, "id long, text string").select("id", T.normalised(F.col("text")).alias("text"))


@query
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(documents(spark, sf_dir), "sentence")


@query
def chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(documents(spark, sf_dir), "window")


@query
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(prompts(spark), "paragraph")


@query
def chunk_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = documents(spark, sf_dir).unionByName(prompts(spark).withColumn("doc_id", -F.col("doc_id")))
    return chunks.with_strategy(every).select("doc_id", "strategy")


@query
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks_with_offsets(documents(spark, sf_dir), "sentence").select("doc_id", "chunk_index", "start_char", "end_char")


@query
def truncate_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of over 20 chunks are cut, so that the tables hold some; the runner's own bound is 1,900."""
    return chunks.truncated(documents(spark, sf_dir), 20)


@query
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.approx_tokens(F.col("text")).alias("approx_tokens"), T.word_count(F.col("text")).alias("words"))


@query
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document.term_frequency(texts(spark, sf_dir))


@query
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document.document_frequency(texts(spark, sf_dir))


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document.weights(texts(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document.edges(texts(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), place.alias("chunk_index"), F.col("embedding").alias("vector"))
    return graph.vector_graph(vectors).select(F.col("doc_id").alias("label"), "i", "j", F.round("w", 6).alias("w"))


@query
def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document.degrees(texts(spark, sf_dir)).withColumn("degree", F.round("degree", 6))


@query
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document.degrees(texts(spark, sf_dir), shares=True).select("doc_id", "chunk_index", F.round("degree", 6).alias("degree_centrality"))


@query
def spectral_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.chunks(X.frame(spark, X.DISJOINT, "doc_id long, text string"), "sentence")
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    found = spectral.spectra(graph.text_graph(rows), sizes)
    return found.select(F.col("doc_id").alias("n"), F.round("lambda2", 6).alias("lambda2"), F.posexplode("fiedler").alias("chunk_index", "f")).select("n", "chunk_index", "lambda2", F.round("f", 6).alias("fiedler"))


@query
def algebraic_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document.connectivity(texts(spark, sf_dir)).withColumn("lambda2", F.round("lambda2", 6))


@query
def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.scored_chunks(documents(spark, sf_dir)).select("doc_id", "chunk_index", F.round("score", 6).alias("score"), "zone")


@query
def zone_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = X.frame(spark, X.ZONES, "id long, text string").withColumns(zones.zone_columns(F.col("text")))
    return marked.select("id", "zone", F.round("confidence", 6).alias("confidence"), F.round("protection_weight", 6).alias("protection_weight"))


@query
def pin_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    java = pins.compiled(spark, pins.INSTRUCTION_PRESET)
    return chunks.chunks(prompts(spark), "sentence").select("doc_id", "chunk_index", pins.pinned(F.col("text"), java).alias("pinned"))


@query
def section_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pins.section_lines(prompts(spark, "id"), ["rule", "background"])


@query
def span_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prompts(spark, "id").withColumns(pins.span_columns(F.col("text")))
    return rows.select("id", F.size("spans").alias("spans"), F.aggregate("spans", F.lit(0), lambda n, s: n + F.char_length(s)).alias("pinned_chars"))


@query
def compress_pinned_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = generators.agent_transcripts(spark).select(F.col("id").alias("doc_id"), F.col("prompt").alias("text"))
    return plans.with_pinned_spans(turns, plans.Options(0.3))


@query
def prune_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document.removals(texts(spark, sf_dir))


@query
def reconstruct_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prune.metrics(F.col("text"), F.col("compressed"))
    return by_document.rebuilt(texts(spark, sf_dir)).select("doc_id", "compressed", "chunks_removed", F.round(got["compression_ratio"], 6).alias("compression_ratio"), got["tokens_saved"].alias("tokens_saved"))


@query
def compress_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document shortened by the fused plan."""
    return plans.compress(documents(spark, sf_dir))


@query
def compress_by_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins and aggregates."""
    return plans.compress_relational(documents(spark, sf_dir))


@query
def compress_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of as many chunks as there are vectors of their id's label use these; others say so in their status."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("chunk_index"), F.col("embedding").alias("vector"))
    sizes = vectors.groupBy("doc_id").agg(F.count("*").alias("n"))
    made = sizes.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat(F.lit("Vector number "), k.cast("string"), F.lit(" of this label stands here."))), " ").alias("text"))
    return plans.compress_with_vectors(made, vectors)


def strip_query(level: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = X.frame(spark, X.STRIP, "id long, text string").select("id", strips.stripped_column(F.col("text"), level).alias("r"))
        return rows.select("id", "r.text", "r.original_tokens", "r.compressed_tokens", F.round("r.compression_ratio", 6).alias("ratio"))

    return run


for _level in strips.LEVELS:
    QUERIES[f"strip_{_level}"] = strip_query(_level)


@query
def strip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", strips.stripped_column(F.col("text"), "ultra").alias("r"))
    return rows.select("doc_id", "r.*")


@query
def pipeline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.staged(documents(spark, sf_dir), pre="lite").select("doc_id", F.posexplode("stages").alias("place", "s"), "total_ratio").select("doc_id", "place", "s.*", "total_ratio")


@query
def suite_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    done = plans.compress(docs).join(docs, "doc_id")
    return done.agg(F.count("*").alias("texts"), F.sum("tokens_saved").alias("tokens_saved"), (F.sum("tokens_saved") / F.greatest(F.sum(F.floor(F.char_length("text") / 4)), F.lit(1))).alias("saved_share"))


@query
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.assembled_prompts(table(spark, sf_dir, "conversations"))


def pair_query(rows: list, score: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = X.frame(spark, rows, "id long, predicted string, ground_truth string")
        return pairs.select("id", F.round(score(F.col("predicted"), F.col("ground_truth")), 6).alias("score"))

    return run


QUERIES["score_number"] = pair_query(X.PAIRS, scorers.number_match)
QUERIES["score_exact"] = pair_query(X.PAIRS, scorers.exact_match)
QUERIES["score_rouge_l"] = pair_query(X.PAIRS, scorers.rouge_l)
QUERIES["score_instruction"] = pair_query(X.MARKERS, scorers.instruction_score)
QUERIES["score_context"] = pair_query(X.CONTEXTS, scorers.context_score)
QUERIES["score_phrases"] = pair_query(X.PHRASES, scorers.phrase_score)


@query
def score_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorers.f1_scores(X.frame(spark, X.PAIRS, "id long, predicted string, ground_truth string")).withColumn("score", F.round("score", 6))


@query
def score_f1_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("ground_truth"))
    pairs = items.join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("predicted")), "id")
    return scorers.f1_scores(pairs).withColumn("score", F.round("score", 6))


@query
def multiplier_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.frame(spark, X.MULTIPLIERS, "multiplier double").withColumn("target", evaluate.target_column(F.col("multiplier")))


@query
def span_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.frame(spark, X.BUDGETS, "id long, target double, total long, open_chars long")
    return rows.select("id", F.round(pins.adjusted_target(F.col("target"), F.col("total"), F.col("open_chars")), 6).alias("adjusted"))


@query
def quality_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation of made-up agent transcripts with a stand-in model that answers with its prompt."""
    got = evaluate.answers(generators.agent_transcripts(spark), str, (2.0, 4.0), pin_spans=True)
    return evaluate.results(got, "context").drop("compress_time_ms")


@query
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.frame(spark, X.RESULTS, "id string, multiplier double, original_score double, compressed_score double, score_delta double, relative_quality double, compression_achieved double, compress_time_ms double")
    return evaluate.summary(rows)


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.stage_stats(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "p99")])


@query
def survival_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.frame(spark, X.SURVIVAL, "model string, cond string, idx int, qid string, value double")
    nested = rows.groupBy("model", "cond").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("values"))
    values = reports.survival_values(nested, rows.select("idx", "qid").distinct())
    out = reports.survival_filtered(values, X.frame(spark, X.LEAKS, "model string, qid string"))
    return out.withColumns({c: F.round(c, 6) for c in ("all_mean", "filtered_mean")})


@query
def depth_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of records with a depth band each, one model left out as its run was broken."""
    rows = X.frame(spark, X.DEPTH, "model string, qid string, band string, cond string, value double")
    out = reports.survival_filtered(rows, X.frame(spark, X.LEAKS, "model string, qid string"), ["broken"])
    return out.withColumns({c: F.round(c, 6) for c in ("all_mean", "filtered_mean")})


@query
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.frame(spark, X.SWEEP, "model string, cond string, qid string, em_rate double, f1_mean double, achieved_tok_ratio double")
    out = reports.in_order(reports.sweep_rows(rows, X.frame(spark, X.LEAKS, "model string, qid string")), ["base", "half"])
    return out.select("model", "cond", *[F.round(c, 6).alias(c) for c in ("achieved", "em", "em_filtered", "f1", "f1_filtered", "factor")])


@query
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    out = reports.bootstrap_means(rows, "lang", "doc_id", "quality")
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])
