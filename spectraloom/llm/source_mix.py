"""Operator 9: mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are summed into cells (source, language, topic) weighted by their tokens, before any
shuffle. Raking scales the cells to each target margin in turn until all agree; the ratio of raked to
present weight, scaled so that the expected number of tokens is the budget, is the probability with
which each document of the cell is kept. A hash of the id makes the draw, so it repeats.

Defined cases: null sources and languages are the category ``(null)``; null or empty texts have no
tokens, and a cell without tokens keeps its documents with probability 1; repeated rows share their
id's draw; empty tables give empty results. Where a margin has given targets, a category with none, or
with a share of 0 or null, has probability 0, with or without tokens; shares of one category add up;
targets of categories that do not occur are dropped and the rest scaled up. Raking ends when the
margins are met; where they cannot be (a cell that is needed is empty) it ends when the gap no longer
falls, ``met`` is false in the result, and ``mix`` warns. Columns of the input may have any names.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import materialize, unused

MARGINS = ("source", "lang", "topic")
#: Share of tokens to keep, the power that evens the present margins out, the most rounds of raking, and the gap at which a margin is met.
BUDGET, EVEN, ROUNDS, CLOSE = 0.8, 0.8, 40, 1e-6
SEED = "mix-1"
#: Cells that are raked in one task; a few MB.
FEW = 50_000


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by surface form: table, notice, contact or prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("icens"), "notice").when(t.contains("@") | t.contains("://"), "contact").otherwise("prose")


def draw_of(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) from the md5 of the id and the seed, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed)).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def described(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its margins and tokens in working columns, and the names of these by what they hold."""
    names = {x: unused("_" + x, docs) for x in (*MARGINS, "tokens", "p", "keep")}
    made = {"source": F.coalesce("source", F.lit("(null)")), "lang": F.coalesce("lang", F.lit("(null)")), "topic": topic_of(F.col("text")), "tokens": tokens_of(F.col("text"))}
    return docs.withColumns({names[x]: c for x, c in made.items()}), names


def with_targets(cells: DataFrame, targets: dict[str, DataFrame] | None = None, even: float = EVEN) -> DataFrame:
    """``cells(source, lang, topic, w)`` with the target share ``t_<margin>`` of each category: given as ``(category, share)``, else the present share to a power; scaled over the categories that occur."""
    out = cells
    for m in MARGINS:
        here = cells.groupBy(m).agg(F.sum("w").alias("w"))
        if targets and m in targets:
            share = targets[m].groupBy(F.col("category").alias(m)).agg(F.greatest(F.sum(F.col("share").cast("double")), F.lit(0.0)).alias("t"))
            share = here.join(share, m, "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
        else:
            share = here.withColumn("t", F.pow("w", F.lit(even)))
        # one row for each category, however many documents
        total = F.coalesce(F.nullif(F.sum(F.when(F.col("w") > 0, F.col("t"))).over(Window.partitionBy(F.lit(0))), F.lit(0.0)), F.lit(1.0))
        out = out.join(share.select(m, (F.col("t") / total).alias("t_" + m)), m)
    return out


def rake(cells: DataFrame, rounds: int = ROUNDS, tolerance: float = 1e-12) -> tuple[DataFrame, float]:
    """The cells with tokens and targets, with ``x``, the raked share, from ``w`` and ``t_<margin>``; and the largest gap of a margin.

    Up to ``FEW`` cells are raked in one task and one short plan. More are summed in the tasks before
    any shuffle and the factors joined back, so a margin of few categories is no bottleneck.
    """
    out = materialize(cells.where("w > 0" + "".join(f" AND t_{m} > 0" for m in MARGINS)))
    total, n = out.agg(F.sum("w"), F.count("*")).first()
    if not total:
        return out.withColumn("x", F.lit(0.0)), 0.0
    if n <= FEW:
        return _rake_few(out, total, rounds, tolerance)
    gap = 0.0
    out = out.withColumn("x", F.col("w") / F.lit(total))
    for _ in range(rounds):
        gaps = F.lit(0.0)
        for m in MARGINS:
            out = out.join(out.groupBy(m).agg(F.sum("x").alias("have")), m)
            # the gap before the first margin is the one that the round before has left
            out = out.withColumn("gap_" + m, F.greatest(gaps, F.abs(F.col("have") - F.col("t_" + m)))).withColumn("x", F.col("x") * F.col("t_" + m) / F.col("have")).drop("have")
            gaps = F.col("gap_" + m)
        out = materialize(out, -(-n // FEW))
        before, gap = gap, out.agg(F.max("gap_" + MARGINS[-1])).first()[0] or 0.0
        out = out.drop(*["gap_" + m for m in MARGINS])
        if gap < tolerance or before and gap > 0.99 * before:  # met, or no longer falling
            break
    return out, gap


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rake_few(cells: DataFrame, total: float, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """``rake`` over arrays of one row, so that the plan is as long for forty rounds as for one.

    For each margin the row holds each cell's category ``k_<m>``, the cells in the order of their
    categories ``o_<m>``, and the place in that order, from 1, at which each category starts ``s_<m>``.
    """
    names = cells.columns
    rows = cells.coalesce(1).withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*MARGINS)) - 1)
    for m in MARGINS:
        by = Window.partitionBy(F.lit(0)).orderBy(m)
        rows = rows.withColumns({"k_" + m: F.dense_rank().over(by) - 1, "s_" + m: F.rank().over(by)})
    row = rows.agg(F.sort_array(F.collect_list(F.struct("at", *names, *[c + m for m in MARGINS for c in ("k_", "s_")]))).alias("c"))

    def each(name: str) -> Column:
        return F.transform("c", lambda r: r[name])

    arrays = [F.transform("c", lambda r: r["w"] / F.lit(total)).alias("x")]
    for m in MARGINS:
        order = F.transform(F.sort_array(F.arrays_zip(each("k_" + m).alias("k"), each("at").alias("i"))), lambda r: r["i"])
        arrays += [each("k_" + m).alias("k_" + m), each("t_" + m).alias("t_" + m), order.alias("o_" + m), F.sort_array(F.array_distinct(each("s_" + m))).alias("s_" + m)]
    # cut here: an array made inside a round would be made again for every cell
    row = materialize(row.select("c", *arrays))

    def fit(now: Column, m: str) -> Column:
        """``x`` scaled to a margin, and the larger of its gap before and ``gap``."""
        kinds, aims, order, starts = (F.col(c + m) for c in ("k_", "t_", "o_", "s_"))
        have = F.transform(starts, lambda s, j: F.aggregate(F.slice(order, s, F.coalesce(F.get(starts, j + 1), F.size(order) + 1) - s), F.lit(0.0), lambda a, i: a + F.get(now["x"], i)))

        def scaled(h: Column) -> Column:
            off = F.array_max(F.transform(kinds, lambda k, i: F.abs(F.get(h, k) - F.get(aims, i))))
            return F.struct(F.transform(now["x"], lambda v, i: v * F.get(aims, i) / F.get(h, F.get(kinds, i))).alias("x"), F.greatest(now["gap"], off).alias("gap"))

        return _let(have, scaled)

    def turn(state: Column, k: Column) -> Column:
        """One round; every fourth and the last look whether the margins are met, or the gap no longer falls."""

        def closed(r: Column) -> Column:
            look = (k % 4 == 3) | (k == rounds - 1)
            end = (r["gap"] < tolerance) | ((state["gap"] > 0) & (r["gap"] > 0.99 * state["gap"]))
            return F.struct(r["x"].alias("x"), F.when(look, r["gap"]).otherwise(state["gap"]).alias("gap"), (look & end).alias("done"))

        first, second, third = MARGINS
        start = F.struct(state["x"].alias("x"), F.lit(0.0).alias("gap"))
        whole = _let(start, lambda r: _let(fit(r, first), lambda r: _let(fit(r, second), lambda r: _let(fit(r, third), closed))))
        return F.when(state["done"], state).otherwise(whole)

    state = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(F.col("x").alias("x"), F.lit(0.0).alias("gap"), F.lit(False).alias("done")), turn)
    raked = row.select("c", state.alias("state")).select(F.col("state.gap").alias("gap"), F.explode(F.arrays_zip("c", F.col("state.x").alias("x"))).alias("z"))
    out = materialize(raked.select(*[F.col("z.c")[c].alias(c) for c in names], F.col("z.x").alias("x"), "gap"))
    return out.drop("gap"), out.agg(F.max("gap")).first()[0]


def calibrate(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``source, lang, topic, p``: probabilities min(1, s * x / w) whose expected tokens are ``budget`` of all; s by repeated refinement of a grid."""
    total = raked.agg(F.sum("w")).first()[0] or 1.0
    top = float(raked.agg(F.max(F.col("w") / F.col("x"))).first()[0] or 1.0)
    lo, hi, n = 0.0, top, 64
    for _ in range(6):
        grid = [lo + (hi - lo) * k / n for k in range(n + 1)]
        sums = raked.agg(*[F.sum(F.least("w", F.lit(s) * F.col("x"))).alias(f"s{k}") for k, s in enumerate(grid)]).first()
        k = next((k for k in range(n + 1) if (sums[k] or 0.0) >= budget * total), n)
        lo, hi = grid[max(0, k - 1)], grid[k]
    return raked.select(*MARGINS, F.least(F.lit(1.0), F.lit(hi) * F.col("x") / F.col("w")).alias("p"))


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> tuple[DataFrame, dict[str, str], bool]:
    """The input's rows with tokens, probability and draw in working columns, the names of these, and whether the margins are met.

    Cells are joined back: one row each, no copy of the documents is shuffled while they fit a broadcast.
    """
    rows, names = described(docs)
    cells = materialize(rows.groupBy(*[F.col(names[m]).alias(m) for m in MARGINS]).agg(F.sum(names["tokens"]).cast("double").alias("w")))
    aimed = materialize(with_targets(cells, targets))
    raked, gap = rake(aimed)
    given = F.lit(True)
    for m in targets or {}:
        given = given & (F.col("t_" + m) > 0)
    # cells that were not raked: barred by a target of 0, or without tokens
    p = aimed.join(calibrate(raked, budget), list(MARGINS), "left").select(*[F.col(m).alias(names[m]) for m in MARGINS], F.when(~given, 0.0).otherwise(F.coalesce("p", F.lit(1.0))).alias(names["p"]))
    p = materialize(p)
    if p.count() <= 100_000:  # checked: at most a few MB
        p = F.broadcast(p)
    out = rows.join(p, [names[m] for m in MARGINS], "left")
    return out.withColumn(names["keep"], draw_of(F.col("doc_id")) < F.col(names["p"])), names, gap < CLOSE


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents drawn, with the columns of ``docs``; a warning says if the margins could not be met."""
    rows, names, met = probabilities(docs, targets, budget)
    if not met:
        warnings.warn("the target margins cannot all be met by the cells there are", stacklevel=2)
    return rows.where(F.col(names["keep"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def weigh(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``doc_id, topic, n_tokens, p, kept, met`` for every row of ``docs``; ``p`` is rounded to 6 places."""
    rows, names, met = probabilities(docs.select("doc_id", "text", "source", "lang"), targets)
    return rows.select("doc_id", F.col(names["topic"]).alias("topic"), F.col(names["tokens"]).alias("n_tokens"), F.round(names["p"], 6).alias("p"), F.col(names["keep"]).alias("kept"), F.lit(met).alias("met"))


def mix_sql(table: str = "documents", budget: float = BUDGET, even: float = EVEN, rounds: int = 24) -> str:
    """DuckDB SQL for ``weigh``: raking and grid refinement are unrolled."""
    ctes = [f"""d AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'icens') THEN 'notice'
       WHEN contains(coalesce(text, ''), '@') OR contains(coalesce(text, ''), '://') THEN 'contact' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {table})""",
            "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for m in MARGINS:
        ctes.append(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(sum(w), {even}) AS t FROM c GROUP BY {m})")
    parts = ", ".join(f"(SELECT t FROM t_{m} WHERE t_{m}.{m} = c.{m}) / (SELECT sum(t) FROM t_{m}) AS t_{m}" for m in MARGINS)
    ctes.append(f"x0 AS MATERIALIZED (SELECT *, {parts}, w / (SELECT sum(w) FROM c) AS x FROM c)")
    last = "x0"
    for k in range(rounds):
        for m in MARGINS:
            now = f"x{k}_{m}"
            ctes.append(f"{now} AS MATERIALIZED (SELECT * REPLACE (x * t_{m} / sum(x) OVER (PARTITION BY {m}) AS x) FROM {last})")
            last = now
    ctes.append(f"g0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS lo, max(w / x) AS hi FROM {last})")
    for k in range(6):
        ctes.append(f"""g{k + 1} AS MATERIALIZED (SELECT coalesce(max(s) FILTER (WHERE got < {budget}::DOUBLE * (SELECT sum(w) FROM c)), min(s)) AS lo,
  coalesce(min(s) FILTER (WHERE got >= {budget}::DOUBLE * (SELECT sum(w) FROM c)), max(s)) AS hi
  FROM (SELECT s, (SELECT sum(least(w, s * x)) FROM {last}) AS got FROM (SELECT lo + (hi - lo) * k / 64 AS s FROM g{k}, range(65) r(k))))""")
    gaps = " UNION ALL ".join(f"SELECT abs(sum(x) - max(t_{m})) AS gap FROM {last} GROUP BY {m}" for m in MARGINS)
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, topic, n_tokens, round(p, 6) AS p, (SELECT max(gap) FROM ({gaps})) < {CLOSE} AS met,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{SEED}'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < p AS kept
FROM (SELECT d.doc_id, d.topic, d.n_tokens, coalesce(least(1.0::DOUBLE, (SELECT hi FROM g6) * x / w), 1.0) AS p
      FROM d LEFT JOIN {last} USING (source, lang, topic))"""
