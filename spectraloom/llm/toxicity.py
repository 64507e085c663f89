"""Operator 4: toxic passages by maximum-scoring segments over token log-odds.

Fitting counts, over labelled training rows, the documents of either class that hold each unit: a word,
or its first six to three letters, so that inflected forms of a stem are learned from each other. A
unit's share of toxic documents has a Dirichlet prior centred on the share of the next shorter unit, and
the shortest one's on that of all documents, so every token has shrunken log-odds, negative ones too,
and one never seen has those of its longest known beginning. A token scores its log-odds less a drift;
the linear-time scan of Ruzzo and Tompa (1999) finds all maximal segments of positive score of a text.
Karlin-Altschul statistics, from the scores of tokens of clean documents, turn a segment's score into
an expected number of chance segments, and a logistic fit of the best and the summed evidence gives the
document's score, in which either class counts half. The drift and the logistic weights come from folds
of the training rows: each row is scored with counts that leave its own fold out. No held-out row has a part in them.

Defined cases: null and empty texts have no segment and get the score of no evidence; texts may be of
any length (the scan holds the scores of one text only); repeated rows give repeated rows; an empty
table an empty result; columns other than ``doc_id`` and ``text`` are never read. Labels of a null id
are not used; of several labels of one id a toxic one counts. Without both labels in the training rows
every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import fold_of, unit_hash

#: Bounds of what is fitted: labelled rows read, and units kept, those first that say most beyond their shorter form.
MAX_ROWS, MAX_UNITS = 12_000, 100_000
#: Letters of the units that are beginnings, folds, and what the folds choose from: drifts and weights of the prior.
BEGINNINGS, FOLDS, DRIFTS, PRIORS = (6, 5, 4, 3), 3, (0.5, 1.0, 1.5, 2.0), (2.0,)
#: Least difference of log-odds from the shorter unit for which a unit is kept.
WORTH = 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Words whose scores a worker remembers, and bins of a tenth for log-odds from -10 to 10.
MEMORY, BINS = 200_000, 200


def units_of(word: str) -> list[str]:
    """The word and its beginnings, longest first."""
    return [word, *[f"{n}:{word[:n]}" for n in BEGINNINGS if len(word) >= n]]


@dataclass
class Lexicon:
    """Log-odds of units, the drift, the extreme-value constants and the logistic weights."""

    units: dict[str, float]
    drift: float = 1.0
    rate: float = 1.0
    k: float = 0.1
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def token(self, word: str) -> float:
        """Log-odds of a lower-case word: its own, else those of its longest known beginning, else 0."""
        got = self.known.get(word)
        if got is None:
            units = self.units
            got = next((units[u] for u in units_of(word) if u in units), 0.0)
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = got
        return got

    def odds(self, words: list[str]) -> np.ndarray:
        got = list(map(self.known.get, words))
        if None in got:
            got = [self.token(w) if x is None else x for w, x in zip(words, got, strict=True)]
        return np.array(got, float)


def log_odds(counts: dict[str, tuple[float, float]], n1: float, n0: float, prior: float) -> dict[str, float]:
    """Log-odds against all documents of the units worth keeping, from their documents (toxic, clean) of n1 and n0."""
    root = (n1 + 1) / (n1 + n0 + 2)
    base = log(root / (1 - root))
    rate: dict[str, float] = {}
    effect: dict[str, float] = {}
    worth: list[tuple[float, str, float]] = []
    level = lambda u: int(u[0]) if u[1:2] == ":" else 99  # noqa: E731  shorter units first
    for u in sorted(counts, key=level):
        n = level(u)
        word = u[2:] if n < 99 else u
        up = next((f"{m}:{word[:m]}" for m in BEGINNINGS if m < n and len(word) >= m and f"{m}:{word[:m]}" in rate), None)
        c1, c0 = counts[u]
        r = rate[u] = (c1 + prior * (rate[up] if up else root)) / (c1 + c0 + prior)
        d, before = log(r / (1 - r)) - base, effect[up] if up else 0.0
        effect[u] = before
        if abs(d - before) >= WORTH:
            effect[u] = d
            worth.append((abs(d - before), u, d))
    if len(worth) > MAX_UNITS:
        worth = sorted(worth, key=lambda x: (-x[0], x[1]))[:MAX_UNITS]
    return {u: d for _, u, d in worth}


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence of scores.

    Ruzzo-Tompa: each positive score starts a candidate (left sum, right sum); it is merged back over
    candidates while the one found has the smaller right sum. Each candidate is pushed and popped once,
    so time is linear.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    hits = np.flatnonzero(scores > 0)
    found: list[tuple[int, int, float, float]] = []
    back: list[int] = []
    for place, left, right in zip(hits.tolist(), total[hits].tolist(), total[hits + 1].tolist(), strict=True):
        new = (place, place, left, right)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = back[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                back.append(j)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:], back[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def segments(text: str | None, lex: Lexicon, most: float = 1.0) -> tuple[list[tuple[int, int, float]], int]:
    """Significant segments of a whole text as character spans (start, end, expected chance segments), and its number of tokens."""
    places = list(WORD.finditer((text or "").lower()))
    out = []
    for a, b, s in maximal_segments(lex.odds([m[0] for m in places]) - lex.drift):
        e = lex.k * len(places) * exp(-lex.rate * s)
        if e <= most:
            out.append((places[a].start(), places[b].end(), e))
    return out, len(places)


def raw_evidence(odds: np.ndarray, drift: float) -> tuple[float, float]:
    """Scores of the best segment and of all segments together."""
    found = maximal_segments(odds - drift) if len(odds) and odds.max() > drift else []
    return max((s for _, _, s in found), default=0.0), sum(s for _, _, s in found)


def evidence(best: float, whole: float, n: int, rate: float, k: float) -> tuple[float, float]:
    """Minus log expected chance of the best segment, at least 0, and the log of the summed scores."""
    return max(0.0, rate * best - log(max(k * n, 1e-9))) if best > 0 else 0.0, log1p(whole)


def chance_rate(share: np.ndarray, drift: float) -> tuple[float, float]:
    """The positive root of E[exp(rate * score)] = 1 for tokens of clean documents, and the share of positive ones."""
    s = (np.arange(BINS) + 0.5) / 10 - BINS / 20 - drift
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (lo, mid)
    return lo, max(1e-6, float(share[s > 0].sum()))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit to weighted rows with a small penalty, by Newton steps."""
    w, pen = np.zeros(x.shape[1]), np.array([1e-2] * (x.shape[1] - 1) + [1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (weight * (y - p)) - pen * w)
        w += np.clip(step, -2, 2)
    return w


def _counts(rows: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Documents of either label in each fold that hold a unit, for units of three documents or more, and of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, Counter] = defaultdict(Counter)
            for label, fold, text in zip(*(batch.column(c) for c in ("label", "fold", "text")), strict=True):
                words = set(WORD.findall((text.as_py() or "").lower()))
                seen[2 * fold.as_py() + label.as_py()].update({u for w in words for u in units_of(w)} | {""})
            yield pa.RecordBatch.from_arrays([pa.array([u for c in seen.values() for u in c], pa.string()), pa.array([k for k, c in seen.items() for _ in c], pa.int32()), pa.array([n for c in seen.values() for n in c.values()], pa.int64())], ["unit", "cell", "n"])

    cells = rows.select("label", "fold", "text").mapInArrow(run, "unit string, cell int, n long")
    sums = cells.groupBy("unit").agg(*[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).cast("int").alias(f"c{k}") for k in range(2 * FOLDS)])
    got = sums.where(" + ".join(f"c{k}" for k in range(2 * FOLDS)) + " >= 3").toPandas()  # bounded by MAX_ROWS documents
    counts = dict(zip(got["unit"], got.drop(columns="unit").to_numpy(float), strict=True))
    total = counts.pop("", np.zeros(2 * FOLDS))
    return counts, total


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Lexicon | None:
    """Learn from ``labels(doc_id, toxic)`` outside the held-out fold; None unless both labels occur there."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")).where(fold_of("doc_id", folds) != held)
    n = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    # toxic rows first, as they are the fewer
    share1 = min(1.0, MAX_ROWS / 2 / n[1])
    share0 = min(1.0, (MAX_ROWS - share1 * n[1]) / n[0])
    marks = marks.where(unit_hash(F.col("doc_id"), F.lit(5)) < F.when(F.col("label") == 1, share1).otherwise(share0))
    marks = marks.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(FOLDS)).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # at most MAX_ROWS ids are broadcast
    counts, total = _counts(rows)
    c1, c0 = total[1::2], total[0::2]
    if not counts or not c1.sum() or not c0.sum():
        return None
    made = {}
    for prior in PRIORS:
        for f in range(FOLDS):
            without = {u: (x[1::2].sum() - x[2 * f + 1], x[0::2].sum() - x[2 * f]) for u, x in counts.items()}
            made[prior, f] = Lexicon(log_odds({u: c for u, c in without.items() if c[0] + c[1] > 0}, c1.sum() - c1[f], c0.sum() - c0[f], prior))
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row, prior and drift the raw evidence without the row's own fold; then counts of clean tokens by log-odds."""
        own, names = shared.value, ["prior", "drift", "label", "fold", "n", "best", "whole"]
        clean = np.zeros((len(PRIORS), BINS))
        for batch in batches:
            out: list[tuple] = []
            for label, fold, text in zip(*(batch.column(c).to_pylist() for c in ("label", "fold", "text")), strict=True):
                words = WORD.findall((text or "").lower())
                for p, prior in enumerate(PRIORS):
                    odds = own[prior, fold].odds(words)
                    if not label:
                        clean[p] += np.bincount(np.clip((odds + BINS / 20) * 10, 0, BINS - 1).astype(int), minlength=BINS)
                    out += [(p, d, label, fold, len(words), *raw_evidence(odds, drift)) for d, drift in enumerate(DRIFTS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.float64())] * 7, names)
        p, b = np.nonzero(clean)
        none = np.full(len(p), -1.0)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(float)) for x in (p, none, none, none, b, clean[p, b], none)], names)

    got = rows.select("label", "fold", "text").mapInArrow(tried, "prior double, drift double, label double, fold double, n double, best double, whole double").toPandas()
    marks_of, seen = got[got["drift"] < 0], got[got["drift"] >= 0]
    best = None
    for p, prior in enumerate(PRIORS):
        share = np.zeros(BINS)
        np.add.at(share, marks_of[marks_of["prior"] == p]["n"].to_numpy(int), marks_of[marks_of["prior"] == p]["best"].to_numpy())
        share /= max(share.sum(), 1.0)
        for d, drift in enumerate(DRIFTS):
            some = seen[(seen["prior"] == p) & (seen["drift"] == d)]
            rate, k = chance_rate(share, drift)
            x = np.array([(*evidence(b, s, int(m), rate, k), 1.0) for b, s, m in zip(some["best"], some["whole"], some["n"], strict=True)])
            y = some["label"].to_numpy()
            weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)  # either class counts half
            w = logistic(x, y, weight)
            z = np.clip(x @ w, -30, 30)
            loss = float((weight * (np.logaddexp(0, z) - y * z)).mean())
            if best is None or loss < best[0]:
                best = (loss, prior, drift, rate, k, tuple(map(float, w)))
    shared.destroy()
    _, prior, drift, rate, k, weights = best
    every = {u: (x[1::2].sum(), x[0::2].sum()) for u, x in counts.items()}
    return Lexicon(log_odds(every, c1.sum(), c0.sum(), prior), drift, rate, k, weights)


def score(docs: DataFrame, lex: Lexicon | None) -> DataFrame:
    """``doc_id, score`` for every row; one pass, no shuffle. The lexicon, of bounded size, is broadcast."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if lex is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = WORD.findall((text.as_py() or "").lower())
                a, b = evidence(*raw_evidence(own.odds(words), own.drift), len(words), own.rate, own.k)
                z = a * own.weights[0] + b * own.weights[1] + own.weights[2]
                out.append(1 / (1 + exp(-min(max(z, -500.0), 500.0))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def passages(docs: DataFrame, lex: Lexicon, most: float = 1.0) -> DataFrame:
    """Every significant toxic passage: ``doc_id, start, end`` (code points of the lower-cased text) and ``expected`` chance segments."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), *s) for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for s in segments(t.as_py(), shared.value, most)[0]]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "end", "expected"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, expected double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
