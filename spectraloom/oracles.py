"""DuckDB SQL for the registered queries: the same results by another engine, from the same tables."""

from __future__ import annotations

from spectraloom import fixtures as X
from spectraloom.functions import pins as P
from spectraloom.functions import strip as S
from spectraloom.functions import zones as Z
from spectraloom.functions.digest import POISSON_CUTS

WORDS = r"len(regexp_extract_all({}, '\S+'))"
TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sentences(t: str) -> str:
    marked = rf"""regexp_replace(regexp_replace({t}, '([.!?])([^\S\n]*(?:\n|$)|\s+[A-Z"''])', '\1' || chr(1) || '\2', 'g'), '([A-Z][.!?])' || chr(1), '\1', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {TRIM.format('x')}), lambda x: x <> '')"


def paragraphs(t: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({t}, '\n\s*\n'), lambda x: {TRIM.format('x')}), lambda x: x <> '')"


def windows(t: str) -> str:
    w = rf"regexp_extract_all({t}, '\S+')"
    last = f"((len({w}) - 50) // 25 * 25)"
    starts = f"list_concat(range(0, {last} + 1, 25), CASE WHEN {last} + 50 < len({w}) THEN [{last} + 25] ELSE []::BIGINT[] END)"
    return f"CASE WHEN {t} = '' THEN [{t}] WHEN len({w}) <= 50 THEN [{TRIM.format(t)}] ELSE list_transform({starts}, lambda s: array_to_string({w}[s + 1 : s + 50], ' ')) END"


def merged(source: str, parts: str, extra: str = "") -> str:
    """Common table expressions that end in ``chunk_lists(doc_id, parts{extra})``."""
    wc = WORDS.format("x")
    return f"""raw_lists AS MATERIALIZED (SELECT doc_id{extra}, list_filter({parts}, lambda x: x <> '') AS p FROM {source}),
folded AS MATERIALIZED (SELECT doc_id{extra}, list_reduce(p, lambda a, x: CASE WHEN a.n + {wc} < 3 THEN {{'done': a.done, 'held': a.held || x || ' ', 'n': a.n + {wc}}}
  ELSE {{'done': list_append(a.done, a.held || x), 'held': '', 'n': 0::BIGINT}} END, {{'done': []::VARCHAR[], 'held': '', 'n': 0::BIGINT}}) AS m FROM raw_lists),
chunk_lists AS MATERIALIZED (SELECT doc_id{extra}, CASE WHEN rtrim(m.held) = '' THEN m.done WHEN len(m.done) = 0 THEN [rtrim(m.held)]
  ELSE list_append(m.done[1 : len(m.done) - 1], m.done[len(m.done)] || ' ' || rtrim(m.held)) END AS parts FROM folded),
chunks AS MATERIALIZED (SELECT doc_id, (unnest(range(len(parts))))::INT AS chunk_index, unnest(parts) AS text FROM chunk_lists)"""


SENTENCES = merged("documents", sentences("text"))
CHUNK_ROWS = f"SELECT doc_id, chunk_index, text, ({WORDS.format('text')})::INT AS word_count FROM chunks"

TF = r"""tok AS (SELECT doc_id, chunk_index, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{2,}'))) AS term FROM chunks),
tf AS MATERIALIZED (SELECT doc_id, chunk_index, term, count(*) AS n FROM tok GROUP BY ALL)"""
SIZED = "sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)"
WEIGHTS = f"""{TF}, {SIZED}, df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
r AS (SELECT tf.*, (0.5::DOUBLE + 0.5::DOUBLE * tf.n / max(tf.n) OVER (PARTITION BY doc_id, chunk_index)) * (ln((sizes.n + 1)::DOUBLE / (df.df + 1)) + 1) AS raw
  FROM tf JOIN df USING (doc_id, term) JOIN sizes USING (doc_id)),
w AS MATERIALIZED (SELECT doc_id, chunk_index, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id, chunk_index)) AS weight FROM r)"""
JOINED = """steps AS (SELECT doc_id, unnest(range(n - 1))::INT AS i FROM sizes WHERE n >= 2 AND n <= 2000),
strong AS (SELECT * FROM pairs WHERE w >= 0.05::DOUBLE),
edges AS MATERIALIZED (SELECT doc_id, i, j, w FROM strong UNION ALL SELECT s.doc_id, s.i, s.i + 1, 0.1::DOUBLE FROM steps s ANTI JOIN strong e ON e.doc_id = s.doc_id AND e.i = s.i AND e.j = s.i + 1)"""
GRAPH = f"""{SENTENCES}, {WEIGHTS},
pairs AS (SELECT a.doc_id, a.chunk_index AS i, b.chunk_index AS j, sum(a.weight * b.weight) AS w FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term = b.term AND a.chunk_index < b.chunk_index
  JOIN sizes s ON s.doc_id = a.doc_id AND s.n <= 2000 GROUP BY ALL), {JOINED}"""
DEGREES = f"""{GRAPH}, ends AS (SELECT doc_id, i AS chunk_index, w FROM edges UNION ALL SELECT doc_id, j, w FROM edges),
degrees AS MATERIALIZED (SELECT doc_id, chunk_index, sum(w) AS degree FROM ends GROUP BY ALL)"""
CENTRAL = f"{DEGREES}, central AS MATERIALIZED (SELECT doc_id, chunk_index, degree / max(degree) OVER (PARTITION BY doc_id) AS score FROM degrees)"
PRUNED = f"""{CENTRAL}, scored AS (SELECT chunk_index, doc_id, text, ({WORDS.format('text')})::BIGINT AS words, score FROM central JOIN chunks USING (doc_id, chunk_index)),
lists AS (SELECT doc_id, list({{'c': chunk_index, 'w': words}} ORDER BY round(score, 9), chunk_index) AS l, list({{'c': chunk_index, 't': text}} ORDER BY chunk_index) AS t, sum(words)::BIGINT AS total, greatest(1, floor(count(*) * 0.2::DOUBLE)::INT) AS budget
  FROM scored GROUP BY doc_id HAVING count(*) >= 4),
gone AS MATERIALIZED (SELECT doc_id, t, (list_reduce(l, lambda a, x: CASE WHEN len(a.ids) < budget AND NOT ((a.w + x.w)::DOUBLE / total > 0.2::DOUBLE * 1.5::DOUBLE)
  THEN {{'ids': list_append(a.ids, x.c), 'w': a.w + x.w}} ELSE a END, {{'ids': []::INT[], 'w': 0::BIGINT}})).ids AS removed FROM lists)"""


def zone_hits(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(text, {q(p)}, 'i')::INT" for p in patterns)


def strip(level: str) -> str:
    """The rules of a level by chained replacements, for ASCII texts without anything to mask."""
    out = "text"

    def sub(pattern: str, to: str = "", flags: str = "gi") -> None:
        nonlocal out
        out = f"regexp_replace({out}, {q(pattern)}, {q(to)}, '{flags}')"

    words = lambda ws: r"\b(?:" + "|".join(ws) + r")\b"
    sub(words(S.FILLERS))
    for phrases in (S.PLEASANTRIES, S.HEDGES):
        for p in sorted(phrases, key=len, reverse=True):
            sub(p)
    if level != "lite":
        sub(words(S.ARTICLES))
        sub(words(S.ADVERBS))
        sub(r",\s*" + words(S.CONJUNCTIONS), ",")
    if level == "ultra":
        sub(words(S.COPULAS))
        sub(r"(^|\.\s|,\s)" + words(S.PRONOUNS) + r"\s*", r"\1")
    for pattern, to in ((r"[ \t]{2,}", " "), (r"\s+([.,;:!?])", r"\1"), (r"(?m) +$", ""), (r"(?m)^[ \t]+", ""), (r"\n{3,}", "\n\n")):
        sub(pattern, to, "g")
    return TRIM.format(out)


def strip_sql(level: str) -> str:
    return f"""WITH {X.values(X.STRIP, 'r', 'id', 'text')}, s AS (SELECT id, text AS old, {strip(level)} AS text FROM r),
n AS (SELECT *, {WORDS.format('old')} AS a, {WORDS.format('text')} AS b FROM s)
SELECT id, text, a::INT AS original_tokens, b::INT AS compressed_tokens, round(CASE WHEN a > 0 THEN 1 - b::DOUBLE / a ELSE 0 END, 6) AS ratio FROM n"""


F1 = r"""bags AS (SELECT id, 0 AS side, unnest(regexp_extract_all(lower(predicted), '[\p{L}\p{N}_]+')) AS word FROM r UNION ALL SELECT id, 1, unnest(regexp_extract_all(lower(ground_truth), '[\p{L}\p{N}_]+')) FROM r),
c AS (SELECT id, word, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS t FROM bags GROUP BY ALL),
s AS (SELECT id, sum(least(p, t)) AS b, sum(p) AS p, sum(t) AS t FROM c GROUP BY id)
SELECT r.id, round(CASE WHEN s.id IS NULL THEN 1.0::DOUBLE WHEN b = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * b / (s.p + s.t) END, 6) AS score FROM r LEFT JOIN s ON r.id = s.id"""
LCS = r"""b AS (SELECT id, regexp_extract_all(lower(predicted), '[\p{L}\p{N}_]+') AS p, regexp_extract_all(lower(ground_truth), '[\p{L}\p{N}_]+') AS t FROM r),
l AS (SELECT id, p, t, CASE WHEN len(p) = 0 OR len(t) = 0 THEN 0 ELSE list_last(list_reduce(p, lambda row, w: list_reduce(range(1, len(t) + 1), lambda new, i: list_append(new, CASE WHEN t[i] = w THEN row[i] + 1 ELSE greatest(row[i + 1], new[i]) END), [0::BIGINT]),
  list_transform(range(len(t) + 1), lambda z: 0::BIGINT))) END AS n FROM b)
SELECT id, round(CASE WHEN len(p) = 0 OR len(t) = 0 THEN (len(p) + len(t) = 0)::INT::DOUBLE ELSE 2.0::DOUBLE * n / (len(p) + len(t)) END, 6) AS score FROM l"""


def marker_sql(rows: list, kinds: str, score: str, weights: dict[str, float]) -> str:
    """Scores of ``tag:value`` lines: category means, weighted over the categories that occur."""
    w = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " END"
    return rf"""WITH {X.values(rows, 'r', 'id', 'predicted', 'ground_truth')},
lines AS (SELECT id, predicted, lower(predicted) AS low, trim(unnest(string_split(ground_truth, chr(10)))) AS line FROM r),
m AS (SELECT id, predicted, low, lower(trim(split_part(line, ':', 1))) AS tag, lower(trim(substr(line, instr(line, ':') + 1))) AS v FROM lines WHERE contains(line, ':')),
k AS (SELECT id, {kinds} AS kind, ({score})::DOUBLE AS s FROM m),
a AS (SELECT id, kind, avg(s) AS s FROM k WHERE s IS NOT NULL AND kind IS NOT NULL GROUP BY ALL),
t AS (SELECT id, sum(s * {w}) / sum({w}) AS s FROM a GROUP BY id)
SELECT r.id, round(CASE WHEN trim(ground_truth) = '' THEN (trim(predicted) = '')::INT::DOUBLE ELSE coalesce(t.s, 0) END, 6) AS score FROM r LEFT JOIN t ON r.id = t.id"""


_WEIGHT = " + ".join(f"(u >= {c})::INT" for c in POISSON_CUTS)

SQL: dict[str, str] = {
    "normalize_text": f"WITH {X.values(X.PLAIN, 'r', 'id', 'text')} SELECT id, replace(replace(replace(replace(replace(replace(replace(replace(nfc_normalize(text), '—', '--'), '–', '-'), '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '…', '...'), chr(160), ' ') AS text FROM r",
    "chunk_sentence": f"WITH {SENTENCES} {CHUNK_ROWS}",
    "chunk_window": f"WITH {merged('documents', windows('text'))} {CHUNK_ROWS}",
    "chunk_paragraph": f"WITH {X.values(X.PROMPTS, 'prompts', 'doc_id', 'text')}, {merged('prompts', paragraphs('text'))} {CHUNK_ROWS}",
    "chunk_strategy": f"""WITH {X.values(X.PROMPTS, 'prompts', 'doc_id', 'text')}, d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM prompts),
p AS (SELECT doc_id, {paragraphs('text')} AS p, {sentences('text')} AS s FROM d),
n AS (SELECT *, list_sum(list_transform(p, lambda x: {WORDS.format('x')}))::DOUBLE / len(p) AS mean FROM p)
SELECT doc_id, CASE WHEN len(p) >= 4 AND mean >= 20 AND mean <= 200 THEN 'paragraph' WHEN len(s) >= 6 THEN 'sentence' ELSE 'window' END AS strategy FROM n""",
    "chunk_offsets": rf"""WITH {merged('documents', sentences('text'), ', text')},
placed AS (SELECT doc_id, (list_reduce(parts, lambda a, x: CASE WHEN instr(substr(text, a.at + 1), trim(regexp_replace(x, '\s+', ' ', 'g'))[1:40]) > 0
  THEN {{'at': a.at + instr(substr(text, a.at + 1), trim(regexp_replace(x, '\s+', ' ', 'g'))[1:40]), 'o': list_append(a.o, a.at + instr(substr(text, a.at + 1), trim(regexp_replace(x, '\s+', ' ', 'g'))[1:40]) - 1)}}
  ELSE {{'at': a.at + 1, 'o': list_append(a.o, a.at)}} END, {{'at': 0::BIGINT, 'o': []::BIGINT[]}})).o AS o, parts FROM chunk_lists)
SELECT doc_id, (unnest(range(len(parts))))::INT AS chunk_index, unnest(o)::INT AS start_char, unnest(list_transform(list_zip(o, parts), lambda z: z[1] + length(z[2])))::INT AS end_char FROM placed""",
    "term_frequency": f"WITH {SENTENCES}, {TF} SELECT doc_id, chunk_index, term, n FROM tf",
    "document_frequency": f"WITH {SENTENCES}, {TF} SELECT doc_id, term, count(*) AS n FROM tf GROUP BY ALL",
    "tfidf_weights": f"WITH {SENTENCES}, {WEIGHTS} SELECT doc_id, chunk_index, term, round(weight, 6) AS weight FROM w",
    "similarity_edges": f"WITH {GRAPH} SELECT doc_id, i, j, round(w, 6) AS w FROM edges",
    "vector_similarity": f"""WITH v AS MATERIALIZED (SELECT label AS doc_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS c, embedding::DOUBLE[] AS e FROM embeddings),
sizes AS (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id HAVING count(*) <= 2000),
pairs AS MATERIALIZED (SELECT a.doc_id, a.c AS i, b.c AS j, greatest(list_dot_product(a.e, b.e), 0) AS w FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.c < b.c JOIN sizes s ON s.doc_id = a.doc_id), {JOINED}
SELECT doc_id AS label, i, j, round(w, 6) AS w FROM edges""",
    "weighted_degree": f"WITH {DEGREES} SELECT doc_id, chunk_index, round(degree, 6) AS degree FROM degrees",
    "degree_centrality": f"WITH {CENTRAL} SELECT doc_id, chunk_index, round(score, 6) AS degree_centrality FROM central",
    "spectral_path": f"""WITH ns(n) AS (VALUES {', '.join(f'({n})' for n, _ in X.DISJOINT)}), c AS (SELECT n, unnest(range(n))::INT AS chunk_index FROM ns)
SELECT n::BIGINT AS n, chunk_index, round(0.2::DOUBLE * (1 - cos(pi() / n)), 6) AS lambda2, round(abs(cos(pi() * (chunk_index + 0.5::DOUBLE) / n)) / cos(pi() / (2 * n)), 6) AS fiedler FROM c""",
    "zone_classify": f"""WITH {X.values(X.ZONES, 'r', 'id', 'text')}, h AS (SELECT id, {zone_hits(Z.INSTRUCTION)} AS a, {zone_hits(Z.CONTEXT)} AS b FROM r),
z AS (SELECT id, CASE WHEN a + b = 0 THEN 'unknown' WHEN a >= b THEN 'instruction' ELSE 'context' END AS zone, CASE WHEN a + b = 0 THEN 0::DOUBLE WHEN a = b THEN 0.5::DOUBLE ELSE greatest(a, b)::DOUBLE / (a + b) END AS c FROM h)
SELECT id, zone, round(c, 6) AS confidence, round(CASE WHEN zone = 'instruction' THEN 2 + c ELSE 1 END, 6) AS protection_weight FROM z""",
    "pin_match": f"WITH {X.values(X.PROMPTS, 'prompts', 'doc_id', 'text')}, {merged('prompts', sentences('text'))} SELECT doc_id, chunk_index, {' OR '.join(f'regexp_matches(text, {q(p)}, {chr(39)}is{chr(39)})' for p in P.INSTRUCTION_PRESET)} AS pinned FROM chunks",
    "section_pins": rf"""WITH {X.values(X.PROMPTS, 'prompts', 'id', 'text')}, l AS (SELECT id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM prompts),
h AS (SELECT id, line_no, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS level, lower(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2)) AS title FROM l WHERE regexp_matches(line, '^#{{1,6}}\s+.+$')),
s AS (SELECT a.id, a.line_no AS lo, coalesce(min(b.line_no), 1000000) AS hi FROM h a LEFT JOIN h b ON a.id = b.id AND b.line_no > a.line_no AND b.level <= a.level WHERE contains(a.title, 'rule') OR contains(a.title, 'background') GROUP BY ALL)
SELECT DISTINCT l.id, l.line_no::INT AS line_no, substr(trim(line), 1, 60) AS literal FROM l JOIN s ON l.id = s.id AND l.line_no >= s.lo AND l.line_no < s.hi WHERE length(trim(line)) > 10""",
    "span_pins": rf"""WITH {X.values(X.PROMPTS, 'prompts', 'id', 'text')}, p AS (SELECT id, string_split(chr(10) || text, chr(10) || '[') AS turns FROM prompts),
t AS (SELECT id, list_filter(turns, lambda x: starts_with(x, 'tool_result]' || chr(10))) AS spans FROM p)
SELECT id, len(spans)::INT AS spans, coalesce(list_sum(list_transform(spans, lambda x: length(x) + 1)), 0)::INT AS pinned_chars FROM t""",
    "prune_greedy": f"WITH {PRUNED} SELECT doc_id, (unnest(range(len(t))))::INT AS chunk_index, unnest(list_transform(t, lambda x: list_contains(removed, x.c))) AS removed FROM gone",
    "reconstruct_metrics": f"""WITH {PRUNED}, k AS (SELECT doc_id, array_to_string(list_transform(list_filter(t, lambda x: NOT list_contains(removed, x.c)), lambda x: x.t), chr(10) || chr(10)) AS compressed, len(removed) AS n FROM gone)
SELECT doc_id, compressed, n::INT AS chunks_removed, round(1 - length(compressed)::DOUBLE / greatest(length(text), 1), 6) AS compression_ratio, greatest(0, greatest(1, length(text) // 4) - greatest(1, length(compressed) // 4))::INT AS tokens_saved FROM k JOIN documents USING (doc_id)""",
    "strip_lite": strip_sql("lite"),
    "strip_full": strip_sql("full"),
    "strip_ultra": strip_sql("ultra"),
    "prompt_assembly": """SELECT conv_id, string_agg('[' || coalesce(role, '') || ']' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn, role, text) AS prompt,
greatest(1, length(string_agg('[' || coalesce(role, '') || ']' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn, role, text)) // 4)::INT AS tokens FROM conversations GROUP BY conv_id""",
    "token_estimates": rf"SELECT doc_id, greatest(1, length(text) // 4)::INT AS approx_tokens, ({WORDS.format('text')})::INT AS words FROM documents",
    "score_number": rf"""WITH {X.values(X.PAIRS, 'r', 'id', 'predicted', 'ground_truth')}, n AS (SELECT id, TRY_CAST(replace(list_last(regexp_extract_all(predicted, '[-+]?\d[\d,]*\.?\d*')), ',', '') AS DOUBLE) AS a, TRY_CAST(replace(list_last(regexp_extract_all(ground_truth, '[-+]?\d[\d,]*\.?\d*')), ',', '') AS DOUBLE) AS b FROM r)
SELECT id, CASE WHEN a = b THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM n""",
    "score_exact": f"WITH {X.values(X.PAIRS, 'r', 'id', 'predicted', 'ground_truth')} SELECT id, CASE WHEN lower(trim(predicted)) = lower(trim(ground_truth)) THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM r",
    "score_f1": f"WITH {X.values(X.PAIRS, 'r', 'id', 'predicted', 'ground_truth')}, {F1}",
    "score_rouge_l": f"WITH {X.values(X.PAIRS, 'r', 'id', 'predicted', 'ground_truth')}, {LCS}",
    "score_f1_benchmark": "WITH r AS (SELECT b.item_id AS id, b.text AS ground_truth, d.text AS predicted FROM benchmark b JOIN documents d ON b.item_id = d.doc_id), " + F1,
    "score_instruction": marker_sql(
        X.MARKERS,
        "CASE WHEN tag IN ('format', 'key') THEN tag WHEN tag IN ('rule', 'contains', 'not_contains', 'section') THEN 'rule' END",
        r"""CASE WHEN tag = 'format' THEN CASE v WHEN 'json' THEN (json_valid(trim(predicted)) OR len(list_filter(regexp_extract_all(predicted, '\{[^{}]*\}'), lambda x: json_valid(x))) > 0)::INT
  WHEN 'markdown_table' THEN regexp_matches(predicted, '\|.+\|')::INT WHEN 'markdown_headers' THEN regexp_matches(predicted, '(?m)^#{1,3}\s+\S')::INT WHEN 'numbered_list' THEN regexp_matches(predicted, '(?m)^\d+\.\s')::INT END
  WHEN tag = 'not_contains' THEN (NOT contains(low, v))::INT WHEN tag IN ('key', 'rule', 'contains', 'section') THEN contains(low, v)::INT END""",
        {"format": 0.30, "key": 0.30, "rule": 0.40},
    ),
    "score_context": marker_sql(
        X.CONTEXTS,
        "CASE WHEN tag IN ('answer', 'tool_ref', 'stale') THEN tag END",
        "CASE WHEN tag = 'stale' THEN CASE WHEN contains(v, '|') THEN CASE WHEN contains(low, trim(split_part(v, '|', 2))) THEN 1 WHEN contains(low, trim(split_part(v, '|', 1))) THEN 0 ELSE 0.5 END END ELSE contains(low, v)::INT END",
        {"answer": 0.50, "tool_ref": 0.30, "stale": 0.20},
    ),
    "score_phrases": f"""WITH {X.values(X.PHRASES, 'r', 'id', 'predicted', 'ground_truth')}, l AS (SELECT id, predicted, ground_truth, list_filter(list_transform(string_split(ground_truth, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM r)
SELECT id, round(CASE WHEN trim(ground_truth) = '' THEN (trim(predicted) = '')::INT::DOUBLE ELSE len(list_filter(p, lambda x: contains(lower(predicted), lower(x))))::DOUBLE / len(p) END, 6) AS score FROM l""",
    "multiplier_target": f"WITH {X.values(X.MULTIPLIERS, 'r', 'multiplier')} SELECT multiplier, round(1 - 1 / multiplier, 6) AS target FROM r",
    "span_target": f"WITH {X.values(X.BUDGETS, 'r', 'id', 'target', 'total', 'open_chars')} SELECT id, round(CASE WHEN open_chars > 0 THEN least(total * target / open_chars, 0.95::DOUBLE) ELSE 0 END, 6) AS adjusted FROM r",
    "quality_summary": f"""WITH {X.values(X.RESULTS, 'r', 'id', 'multiplier', 'o', 'c', 'd', 'rel', 'ach', 'ms')} SELECT multiplier, count(*) AS n_samples, round(avg(o), 4) AS mean_original_score, round(avg(c), 4) AS mean_compressed_score, round(avg(rel), 4) AS mean_relative_quality,
round(avg(d), 4) AS mean_score_delta, round(coalesce(stddev_samp(d), 0), 4) AS std_score_delta, round(avg(ach), 4) AS mean_compression_achieved, round(avg(ms), 2) AS mean_compress_time_ms FROM r GROUP BY multiplier""",
    "latency_percentiles": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "survival_filtered": f"""WITH {X.values(X.SURVIVAL, 'r', 'model', 'cond', 'idx', 'qid', 'value')}, {X.values(X.LEAKS, 'l', 'model', 'qid')},
f AS (SELECT * FROM r ANTI JOIN l ON r.model = l.model AND r.qid = l.qid)
SELECT a.model, a.cond, a.n AS all_n, round(a.m, 6) AS all_mean, coalesce(b.n, 0) AS filtered_n, round(b.m, 6) AS filtered_mean FROM (SELECT model, cond, count(*) AS n, avg(value) AS m FROM r GROUP BY ALL) a LEFT JOIN (SELECT model, cond, count(*) AS n, avg(value) AS m FROM f GROUP BY ALL) b ON a.model = b.model AND a.cond = b.cond""",
    "depth_filtered": f"""WITH {X.values(X.DEPTH, 'r', 'model', 'qid', 'band', 'cond', 'value')}, {X.values(X.LEAKS, 'l', 'model', 'qid')},
m AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM l WHERE l.model = r.model AND l.qid = r.qid) AS clean FROM r WHERE r.model <> 'broken')
SELECT model, cond, count(*) AS all_n, round(avg(value), 6) AS all_mean, count(*) FILTER (clean) AS filtered_n, round(avg(value) FILTER (clean), 6) AS filtered_mean FROM m GROUP BY ALL""",
    "sweep_summary": f"""WITH {X.values(X.SWEEP, 'r', 'model', 'cond', 'qid', 'em', 'f1', 'ach')}, {X.values(X.LEAKS, 'l0', 'model', 'qid')}, l AS (SELECT DISTINCT * FROM l0),
m AS (SELECT r.*, l.qid IS NULL AS clean FROM r LEFT JOIN l ON r.model = l.model AND r.qid = l.qid),
a AS (SELECT model, cond, avg(ach) AS achieved, avg(em) AS em, avg(em) FILTER (clean) AS em_filtered, avg(f1) AS f1, avg(f1) FILTER (clean) AS f1_filtered FROM m GROUP BY ALL)
SELECT model, cond, round(achieved, 6) AS achieved, round(em, 6) AS em, round(em_filtered, 6) AS em_filtered, round(f1, 6) AS f1, round(f1_filtered, 6) AS f1_filtered, round(CASE WHEN achieved < 1 THEN 1 / (1 - achieved) ELSE 1 END, 6) AS factor FROM a""",
    "bootstrap_ci": f"""WITH e AS (SELECT d.lang, l.doc_id, l.quality::DOUBLE AS x FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL), reps AS (SELECT unnest(range(10000)) AS rep),
h AS (SELECT lang, rep, x, ('0x' || substr(md5('20260714:' || rep || ':' || doc_id), 1, 8))::BIGINT AS u FROM e, reps),
w AS (SELECT lang, rep, x, {_WEIGHT} AS w FROM h), m AS (SELECT lang, rep, sum(w * x) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL)
SELECT a.lang, a.n, round(a.mean, 6) AS mean, round(b.lo, 6) AS lo, round(b.hi, 6) AS hi FROM (SELECT lang, count(*) AS n, avg(x) AS mean FROM e GROUP BY lang) a
JOIN (SELECT lang, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY lang) b ON a.lang = b.lang OR (a.lang IS NULL AND b.lang IS NULL)""",
}
