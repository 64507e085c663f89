"""Operator 1: quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text are set against each other through the non-negative unbiased
risk of Kiryo et al. (2017): ``pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])``, with the
logistic loss, so the sigmoid of the margin is the probability of a positive. The class prior ``pi`` is
always estimated: a first model is trained on one half of the sample, and on the other half the least
ratio of the unlabelled rows' tail mass to the positives' is taken. The two models, one of either half,
are scaled on the half that they have not seen, by the same risk. Rows labelled 0 are used nowhere.

Defined cases: a null text is the empty text, which gets a score like any other; rows repeat as they
repeat in the input; an empty table gives an empty result; columns other than ``doc_id`` and ``text``
are never read. Labels of a null id are not used; of several labels of one id a positive one counts.
Without any positive label every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import bounded_sample, byte_slices, byte_view, fold_of, unit_hash, words

#: Bounds of the fitted sample: trusted positives and unlabelled rows.
MAX_POSITIVE, MAX_UNLABELLED = 6000, 9000

_KIND = np.full(256, 9, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"'\"()[]-", b"|")):
    _KIND[list(_chars)] = _k
_KIND[128:] = 10
_KIND[0xC3] = 11
KINDS = 12
N_EXTRA = 8
N_FEATURES = 256 + KINDS * KINDS + N_EXTRA


def featurize(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of byte, byte-kind-pair, repetition and shape features for each whole text."""
    n, lens = len(offs) - 1, np.diff(offs)
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(raw):
        return out
    row = np.repeat(np.arange(n), lens)
    kind = _KIND[raw]
    size = np.maximum(lens, 1)[:, None]
    hist = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256)
    out[:, :256] = np.sqrt(hist / size)
    same = row[1:] == row[:-1]
    pairs = (row[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:])[same]
    out[:, 256:-N_EXTRA] = np.sqrt(np.bincount(pairs, minlength=n * KINDS * KINDS).reshape(n, -1) / size)
    of, ids, _ = words(raw, offs)
    count = np.bincount(of, minlength=n)
    repeat = np.bincount(of[1:], weights=(ids[1:] == ids[:-1]) & (of[1:] == of[:-1]), minlength=n) if len(of) else 0
    out[:, -1] = repeat / np.maximum(count, 1)
    out[:, -2] = np.minimum(np.log1p(lens / np.maximum(count, 1)), 8)
    out[:, -3] = np.log1p(count / (np.bincount(row[kind == 4], minlength=n) + 1))
    out[:, -4] = np.log1p(lens)
    view = memoryview(np.ascontiguousarray(raw))
    out[:, -5] = [len(zlib.compress(view[a:b], 1)) / max(1, b - a) if b > a else 0 for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    share = hist / size
    out[:, -6] = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
    upper, lower = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1)
    out[:, -7] = upper / np.maximum(upper + lower, 1)
    out[:, -8] = out[:, -5] * out[:, -4]
    return out


@dataclass
class Net:
    """A standardised one-hidden-layer network and the logistic scale of its margin."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2


@dataclass
class Pair:
    """Two networks, each fitted to one half of the sample and scaled on the other; their mean logit scores."""

    nets: list[Net]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = sum(n.slope * n.margin(x).astype(np.float64) + n.shift for n in self.nets) / len(self.nets)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 24, steps: int = 600, batch: int = 384, seed: int = 7) -> Net:
    """Minimise the non-negative risk with the logistic loss by Adam; where the negative part dips below zero its gradient is turned round."""
    rng = np.random.default_rng(seed)
    both = np.concatenate((pos, unl))
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (pos, unl))
    d = p.shape[1]
    params = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, hidden).astype(np.float32), np.zeros(1, np.float32)]
    m, v = ([np.zeros_like(a) for a in params] for _ in range(2))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        x = np.concatenate((xp, xu))
        a = x @ params[0] + params[1]
        h = np.maximum(a, 0)
        z = h @ params[2] + params[3]
        zp, zu = z[:batch], z[batch:]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos = np.concatenate((-prior * sig(-zp), np.zeros(batch))) / batch
        g_neg = np.concatenate((-prior * sig(zp), sig(zu))) / batch
        g = (g_pos + g_neg if negative >= 0 else -g_neg).astype(np.float32)
        gh = np.outer(g, params[2]) * (a > 0)
        grads = [x.T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()], np.float32)]
        rate = 3e-3 * (1 - t / (steps + 1))
        for k, gk in enumerate(grads):
            m[k] += 0.1 * (gk - m[k])
            v[k] += 0.001 * (gk * gk - v[k])
            params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Net(mean, scale, params[0], params[1], params[2], float(params[3][0]))


def estimate_prior(pos_margin: np.ndarray, unl_margin: np.ndarray) -> float:
    """The positives' share of unlabelled rows from margins that no fit has seen.

    Of the tails that hold a share of the positives, the one whose ratio of unlabelled to positive mass
    is least with a confidence allowance; its plain ratio is the estimate (Garg et al., 2021).
    """
    slack = (0.5 * np.log(20) / len(pos_margin)) ** 0.5 + (0.5 * np.log(20) / len(unl_margin)) ** 0.5
    best = (np.inf, 1.0)
    for q in np.linspace(0.05, 0.98, 63):
        cut = np.quantile(pos_margin, 1 - q)
        own, there = (pos_margin >= cut).mean(), (unl_margin >= cut).mean()
        best = min(best, (there / own + slack * (1 + there / own) / own, there / own))
    return float(np.clip(best[1], 0.01, 0.99))


def scaled(net: Net, pos: np.ndarray, unl: np.ndarray, prior: float) -> Net:
    """The net with slope and shift that minimise the unbiased risk of rows it was not fitted to.

    With the logistic loss that risk is ``E_u[log(1 + exp(g))] - pi * E_p[g]``, convex in both (du Plessis et al., 2015).
    """
    zp, zu = net.margin(pos).astype(np.float64), net.margin(unl).astype(np.float64)
    mean, scale = zu.mean(), zu.std() + 1e-6
    a = np.stack(((zu - mean) / scale, np.ones(len(zu))), 1)
    pull = prior * np.array([((zp - mean) / scale).mean(), 1.0])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(zu) + 1e-4 * np.eye(2), pull - (a * p[:, None]).mean(0) - 1e-4 * w)
        w += np.clip(step, -1, 1)
    net.slope = float(max(w[0], 0.0) / scale)
    net.shift = float(w[1] - net.slope * mean)
    return net


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = byte_view(batch.column("text"))
        for lo, hi, part, at in byte_slices(raw, offs):
            x = featurize(part, at).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Pair | None:
    """Train on the rows outside the held-out fold; ``labels(doc_id, quality)``. None without a positive."""
    train = docs.select("doc_id", "text").where(fold_of("doc_id", folds) != held)
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label = 1 and doc_id is not null").select("doc_id").distinct().where(fold_of("doc_id", folds) != held)
    n = marks.count()
    if not n:
        return None
    rate = min(1.0, MAX_POSITIVE / n)
    seen = train.join(F.broadcast(marks.where(unit_hash(F.col("doc_id"), F.lit(11)) < rate)), "doc_id").select("text", F.lit(1).alias("label"))  # at most about MAX_POSITIVE ids
    free = bounded_sample(train, "doc_id", MAX_UNLABELLED, 12).select("text", F.lit(-1).alias("label"))
    got = seen.unionByName(free).mapInArrow(_features, "label int, x binary").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES)
    y = got["label"].to_numpy()
    pos, unl = x[y == 1], x[y == -1]
    if not len(pos) or not len(unl):
        return None
    if len(pos) < 2 or len(unl) < 2:
        return Pair([fit_nnpu(pos, unl, 0.5)])
    halves = [(pos[h::2], unl[h::2]) for h in (0, 1)]
    first = [fit_nnpu(*half, 0.5, steps=300) for half in halves]
    prior = float(np.mean([estimate_prior(net.margin(p), net.margin(u)) for net, (p, u) in zip(first, halves[::-1], strict=True)]))
    nets = [fit_nnpu(*half, prior, seed=k) for k, half in enumerate(halves)]
    return Pair([scaled(net, p, u, prior) for net, (p, u) in zip(nets, halves[::-1], strict=True)])


def score(docs: DataFrame, net: Pair | None) -> DataFrame:
    """``docs(doc_id, text)`` plus ``score``, without the text; a pass over the input, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = byte_view(batch.column("text"))
            for lo, hi, part, at in byte_slices(raw, offs):
                s = net.score(featurize(part, at)) if net is not None else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def filter_rows(docs: DataFrame, net: Pair | None, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept; one pass, no join."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = byte_view(batch.column("text"))
            for lo, hi, part, at in byte_slices(raw, offs):
                yield batch.slice(lo, hi - lo).filter(pa.array(net.score(featurize(part, at)) >= threshold))

    return docs if net is None else docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
