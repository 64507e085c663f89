"""Operator 7: language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one reading forwards and one backwards, run over windows of the UTF-8
bytes; a softmax labels every position from both states, and the mean over all positions of a
document is its probability of each language. The network is trained here, in numpy, by
backpropagation through time. Gates use the piecewise-linear sigmoid and tanh, which cost a clip.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; any length is read to
its end, in windows; repeated rows give repeated rows; an empty table gives an empty result; languages
with null labels are never learned; columns other than ``doc_id`` and ``text`` are not read when
predicting. With no labelled row every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import byte_slices, byte_view, fold_of, unit_hash

#: Bytes of a window, hidden units of a direction, windows stepped together.
WINDOW, HIDDEN, WIDTH = 64, 8, 2048
#: Bounds of the fitted sample: documents of each language, windows of a document. Every language is learned.
MAX_DOCS, MAX_WINDOWS = 600, 6
UND = "und"


@dataclass
class Layer:
    """Byte table (3H, 256) and recurrent weights (2H, H) of the gates and (H, H) of the candidate."""

    table: np.ndarray
    gates: np.ndarray
    cand: np.ndarray

    def run(self, xs: np.ndarray) -> np.ndarray:
        """States (T, H, B) after each of the steps xs (T, B)."""
        h = np.zeros((HIDDEN, xs.shape[1]), np.float32)
        out = np.empty((len(xs), HIDDEN, xs.shape[1]), np.float32)
        for t, x in enumerate(xs):
            a = self.table.take(x, axis=1)
            g = self.gates @ h
            g += a[: 2 * HIDDEN]
            np.clip(g, 0, 1, out=g)
            c = self.cand @ (g[HIDDEN:] * h)
            c += a[2 * HIDDEN :]
            np.clip(c, -1, 1, out=c)
            c -= h
            c *= g[:HIDDEN]
            h = np.add(h, c, out=out[t])
        return out

    def grads(self, xs: np.ndarray, states: np.ndarray, douts: np.ndarray) -> list[np.ndarray]:
        """Gradients of the three weights by backpropagation through time, given those of the states."""
        hid, steps = HIDDEN, len(xs)
        das = np.empty((steps, 3 * hid, xs.shape[1]), np.float32)
        d_gates, d_cand = np.zeros_like(self.gates), np.zeros_like(self.cand)
        dh = np.zeros_like(states[0])
        for t in range(steps - 1, -1, -1):
            h = states[t - 1] if t else np.zeros_like(dh)
            a = self.table.take(xs[t], axis=1)
            raw = self.gates @ h + a[: 2 * hid]
            g = np.clip(raw, 0, 1)
            z, r = g[:hid], g[hid:]
            rc = self.cand @ (r * h) + a[2 * hid :]
            c = np.clip(rc, -1, 1)
            dh = dh + douts[t]
            dac = dh * z * (np.abs(rc) < 1)
            drh = self.cand.T @ dac
            dag = np.concatenate((dh * (c - h), drh * h)) * ((raw > 0) & (raw < 1))
            das[t, : 2 * hid], das[t, 2 * hid :] = dag, dac
            d_gates += dag @ h.T
            d_cand += dac @ (r * h).T
            dh = dh * (1 - z) + drh * r + self.gates.T @ dag
        flat = das.transpose(1, 0, 2).reshape(3 * hid, -1)
        d_table = np.stack([np.bincount(xs.ravel(), weights=row, minlength=256) for row in flat]).astype(np.float32)
        return [d_table, d_gates, d_cand]


@dataclass
class BiGru:
    """Both layers and the shared softmax; ``langs`` names its classes."""

    ahead: Layer
    back: Layer
    out: np.ndarray
    bias: np.ndarray
    langs: list[str]

    def positions(self, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class probabilities (T, L, B) at every position, and both layers' states in reading order."""
        fore, aft = self.ahead.run(xs), self.back.run(xs[::-1])
        logits = self.out[:, :HIDDEN] @ fore + self.out[:, HIDDEN:] @ aft[::-1]
        logits += self.bias[:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits, fore, aft

    def pool(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean probabilities (n, L) over all bytes of each of n texts; an empty text gets an even share."""
        lens = np.diff(offs)
        count = -(-lens // WINDOW)
        first = np.concatenate(([0], np.cumsum(count)))
        total = np.zeros((first[-1], len(self.langs)), np.float32)
        row = np.repeat(np.arange(len(lens)), count)
        begin = offs[:-1][row] + (np.arange(first[-1]) - first[:-1][row]) * WINDOW
        size = np.minimum(WINDOW, offs[1:][row] - begin)
        padded = np.append(raw, np.zeros(WINDOW, np.uint8))
        order = np.argsort(-size, kind="stable")  # short last windows together: steps stop early for them
        steps = np.arange(WINDOW)
        width = max(32, WIDTH * 64 // max(64, len(self.langs)))  # many languages, fewer windows at once
        for lo in range(0, len(order), width):
            some = order[lo : lo + width]
            long = int(size[some].max())
            xs = padded[begin[some][None, :] + steps[:long, None]]
            xs *= steps[:long, None] < size[some]  # no bytes of the next text
            probs, _, _ = self.positions(xs)
            if size[some].min() < long:
                probs *= (steps[:long, None] < size[some])[:, None, :]
            total[some] = probs.sum(0).T
        out = np.full((len(lens), len(self.langs)), 1 / len(self.langs))
        full = count > 0
        if full.any():
            out[full] = np.add.reduceat(total, first[:-1][full]) / lens[full, None]
        return out


def train(xs: np.ndarray, ys: np.ndarray, langs: list[str], sizes: np.ndarray | None = None, steps: int = 350, batch: int = 192, seed: int = 3) -> BiGru:
    """Fit on windows xs (n, WINDOW) of languages ys (n) by Adam on the mean position-wise cross-entropy.

    ``sizes`` are the bytes of each window where some are padded with zeros at their end, as ``pool`` pads
    them; padding has no loss, and every window weighs the same.
    """
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 0.25, s).astype(np.float32)

    def layer() -> Layer:
        table = draw(3 * HIDDEN, 256)
        table[: 2 * HIDDEN] += 0.4
        return Layer(table, draw(2 * HIDDEN, HIDDEN) * 0.5, draw(HIDDEN, HIDDEN))

    net = BiGru(layer(), layer(), draw(len(langs), 2 * HIDDEN), np.zeros(len(langs), np.float32), langs)
    params = [net.ahead.table, net.ahead.gates, net.ahead.cand, net.back.table, net.back.gates, net.back.cand, net.out, net.bias]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(xs), batch)
        x, y = xs[pick].T, ys[pick]
        d, fore, aft = net.positions(x)
        d[:, y, np.arange(batch)] -= 1
        if sizes is not None:
            d *= (np.arange(WINDOW)[:, None] < sizes[pick])[:, None, :]
            d *= WINDOW / sizes[pick]
        d /= d.shape[0] * batch
        grad_out = np.concatenate((np.einsum("tlb,thb->lh", d, fore), np.einsum("tlb,thb->lh", d, aft[::-1])), 1)
        ahead = net.ahead.grads(x, fore, net.out[:, :HIDDEN].T @ d)
        back = net.back.grads(x[::-1], aft, (net.out[:, HIDDEN:].T @ d)[::-1])
        rate = 0.02 * (1 - step / (steps + 1))
        for k, g in enumerate([*ahead, *back, grad_out, d.sum((0, 2))]):
            g = np.clip(g, -0.1, 0.1)
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            params[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows at evenly spread places of each text, the whole text if it is short."""
    for batch in batches:
        langs, found = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (text or "").encode()
            n = min(MAX_WINDOWS, max(len(data) // WINDOW, 1 if data else 0))
            for k in range(n):
                at = (len(data) - WINDOW) * k // max(1, n - 1) if n > 1 else 0
                langs.append(lang)
                found.append(data[at : at + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, folds: int = 4, held: int = 2) -> BiGru | None:
    """Learn ``lang`` from the texts outside the held-out fold; None without a usable row."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(fold_of("doc_id", folds) != held)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many rows as languages
    if not counts:
        return None
    often = {lang: MAX_DOCS / n for lang, n in counts.items() if n > MAX_DOCS}
    share = F.lit(1.0)
    if often:
        shares = docs.sparkSession.createDataFrame(list(often.items()), "lang string, share double")
        rows = rows.join(F.broadcast(shares), "lang", "left")
        share = F.coalesce("share", share)
    got = rows.where(unit_hash(F.col("doc_id"), F.lit(21)) < share).select("lang", "text").mapInArrow(_windows, "lang string, x binary").toPandas()
    langs = sorted(set(got["lang"]))
    if not langs:
        return None
    xs = np.frombuffer(b"".join(x.ljust(WINDOW, b"\0") for x in got["x"]), np.uint8).reshape(-1, WINDOW)
    sizes = got["x"].map(len).to_numpy()
    code = {lang: k for k, lang in enumerate(langs)}
    return train(xs, got["lang"].map(code).to_numpy(), langs, sizes, steps=max(350, 350 * len(langs) // 64))


def predict(docs: DataFrame, net: BiGru | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; one pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return rows.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.langs, UND])
        for batch in batches:
            raw, offs = byte_view(batch.column("text"))
            known = batch.column("letters").to_numpy(zero_copy_only=False)
            for lo, hi, part, at in byte_slices(raw, offs):
                probs = net.pool(part, at)
                best = np.where(known[lo:hi], probs.argmax(1), len(net.langs))
                score = np.where(known[lo:hi], probs.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
