"""The whole shortening of one text in Python and NumPy: no shuffle, so it serves batches and streams alike.

It gives the same result as the relational operators; tests hold the two against each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from spectraloom.functions import text as T
from spectraloom.functions import zones as Z
from spectraloom.functions.pins import TOOL_RESULT, validated
from spectraloom.operators.graph import MAX_CHUNKS, PROXIMITY, THRESHOLD
from spectraloom.operators.prune import SLACK
from spectraloom.operators.spectral import DEGREE_SHARE, SPECTRAL_SHARE, second_eigenpair
from spectraloom.operators.tfidf import MAX_VOCABULARY

_CUT = re.compile(r"(?<=[.!?])(?<![A-Z][.!?])(?=\s+[A-Z\"']|\s*$)", re.MULTILINE)
_GAP = re.compile(r"\n\s*\n")
_TOKEN = re.compile(r"\b[a-z]{2,}\b")
_SPACES = re.compile(r"\s+")
# a pattern that starts with ^ is tried at the start alone
_ZONES = [[(q := re.compile(p, re.IGNORECASE)).match if p[0] == "^" else q.search for p in ps] for ps in (Z.INSTRUCTION, Z.CONTEXT)]
_INNER = re.compile("|".join(p for p in (*Z.INSTRUCTION, *Z.CONTEXT) if p[0] != "^"))
_OPENING = re.compile("|".join(p for p in (*Z.INSTRUCTION, *Z.CONTEXT) if p[0] == "^"))
#: Columns of a block of the term matrix.
_BLOCK = 4096


def normalise(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        for old, new in T.REPLACED:
            if old in text:
                text = text.replace(old, new)
    return text


def _strip_all(parts: Sequence[str]) -> list[str]:
    return [s for p in parts if (s := p.strip())]


def cut(text: str, strategy: str = "adaptive", size: int = T.WINDOW_WORDS, stride: int = T.STRIDE_WORDS) -> list[str]:
    """Raw pieces of a normalised text."""
    if strategy not in T.STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(T.STRATEGIES)}")
    if strategy in ("adaptive", "paragraph"):
        paras = _strip_all(_GAP.split(text))
        if strategy == "paragraph" or len(paras) >= 4 and 20 <= sum(len(p.split()) for p in paras) / len(paras) <= 200:
            return paras
    if strategy in ("adaptive", "sentence"):
        sents = _strip_all(_CUT.split(text))
        if strategy == "sentence" or len(sents) >= 6:
            return sents
    w = text.split()
    if len(w) <= size:
        return _strip_all([text])
    starts = range(0, len(w) - size + 1, stride)
    ends_at = starts[-1] + size
    tail = [] if ends_at >= len(w) else [w[starts[-1] + stride :]]
    return [" ".join(x) for x in [*(w[s : s + size] for s in starts), *tail]]


def merge(parts: Sequence[str], least: int = T.MIN_CHUNK_WORDS) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    n = 0
    for p in parts:
        held.append(p)
        n += len(p.split())
        if n >= least:
            out.append(" ".join(held))
            held, n = [], 0
    if held:
        out[-1:] = [" ".join([*out[-1:], *held])]
    return out


def chunk(text: str, strategy: str = "adaptive", min_words: int = T.MIN_CHUNK_WORDS, size: int = T.WINDOW_WORDS, stride: int = T.STRIDE_WORDS) -> list[str]:
    return merge(cut(normalise(text), strategy, size, stride), min_words)


def offsets(text: str, chunks: Sequence[str]) -> list[tuple[int, int]]:
    """Start and end of each chunk in the normalised text, by its first 40 characters."""
    out, at = [], 0
    for c in chunks:
        found = text.find(_SPACES.sub(" ", c).strip()[:40], at)
        start = found if found >= 0 else at
        out.append((start, start + len(c)))
        at = start + 1
    return out


def cells(chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Chunk, term and count of each term of each chunk, and the terms in order of first appearance."""
    code: dict[str, int] = {}
    found = [[code.setdefault(t, len(code)) for t in _TOKEN.findall(c.lower())] for c in chunks]
    v = max(1, len(code))
    flat = np.repeat(np.arange(len(found), dtype=np.int64), [len(f) for f in found]) * v + np.array([t for f in found for t in f], np.int64)
    at, count = np.unique(flat, return_counts=True)
    return *np.divmod(at, v), count, list(code)


def weights(chunks: Sequence[str], max_vocabulary: int = MAX_VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Chunk, term and weight of each cell, the terms, and how many chunks hold each."""
    n = len(chunks)
    row, term, count, names = cells(chunks)
    v = len(names)
    df = np.bincount(term, minlength=v)
    if v > max_vocabulary:  # codes are in order of first appearance
        keep = np.zeros(v, bool)
        keep[np.lexsort((np.arange(v), -df))[:max_vocabulary]] = True
        on = keep[term]
        row, term, count = row[on], term[on], count[on]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row, count)
    raw = (0.5 + 0.5 * count / most[row]) * (np.log((n + 1) / (df[term] + 1)) + 1)
    return row, term, raw / np.sqrt(np.bincount(row, raw * raw, n))[row], names, df


def similarity(chunks: Sequence[str], max_vocabulary: int = MAX_VOCABULARY) -> np.ndarray:
    """Cosines of the chunks' term weights; terms of a single chunk only count in the lengths."""
    n = len(chunks)
    row, term, weight, _, df = weights(chunks, max_vocabulary)
    shared = df[term] > 1
    row, weight = row[shared], weight[shared]
    names, col = np.unique(term[shared], return_inverse=True)
    out = np.zeros((n, n))
    for lo in range(0, len(names), _BLOCK):
        on = (col >= lo) & (col < lo + _BLOCK)
        m = np.zeros((n, min(_BLOCK, len(names) - lo)))
        m[row[on], col[on] - lo] = weight[on]
        out += m @ m.T
    return out


def adjacency(cosines: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """A graph from cosines: no loops, nothing below the threshold, neighbours always joined."""
    n = len(cosines)
    if n < 2:
        return np.ones((n, n))
    a = np.where(cosines >= max(threshold, 0.0), cosines, 0.0)
    np.fill_diagonal(a, 0.0)
    i = np.arange(n - 1)
    weak = i[a[i, i + 1] < threshold]
    a[weak, weak + 1] = a[weak + 1, weak] = PROXIMITY
    return a


def zone(text: str) -> tuple[str, float, float]:
    """Zone, confidence and protection weight."""
    if text.isascii() and not _OPENING.match(low := text.lower()) and not _INNER.search(low):
        return "unknown", 0.0, 1.0
    a, b = (sum(find(text) is not None for find in ps) for ps in _ZONES)
    if not a + b:
        return "unknown", 0.0, 1.0
    if a < b:
        return "context", b / (a + b), 1.0
    sure = 0.5 if a == b else a / (a + b)
    return "instruction", sure, 2.0 + sure


def pin_patterns(patterns: Sequence[str] | None) -> list[re.Pattern]:
    out = []
    for p in validated(patterns):
        try:
            out.append(re.compile(p, re.IGNORECASE | re.DOTALL))
        except re.error:
            out.append(re.compile(re.escape(p), re.IGNORECASE))
    return out


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


@dataclass(frozen=True)
class Options:
    """How to shorten: ``target_ratio`` is the share of chunks to remove; texts of fewer than ``min_chunks`` chunks pass."""

    target_ratio: float = 0.2
    strategy: str = "adaptive"
    protect: bool = True
    min_chunks: int = 4
    pins: tuple[str, ...] = ()


@dataclass
class Result:
    compressed: str | None
    original_text: str | None
    compression_ratio: float = 0.0
    tokens_saved: int = 0
    algebraic_connectivity: float = 0.0
    chunks_total: int = 0
    chunks_removed: int = 0
    removed_chunks: list[str] = field(default_factory=list)
    chunk_scores: list[float] = field(default_factory=list)
    #: ``ok``, ``passed`` (blank or of too few chunks) or ``too_large`` (over the limit of chunks; unchanged)
    status: str = "ok"


def lowest(scores: np.ndarray, size: Sequence[int], ratio: float, held: Callable[[int], bool] | None = None) -> set[int]:
    """Chunks removed, by score and then by number: at most ``ratio`` of them, at least one, none that is ``held`` or takes the words removed over ``SLACK * ratio`` of all."""
    n, total = len(size), sum(size)
    budget, gone, words = max(1, int(n * ratio)), set(), 0
    for k in np.lexsort((np.arange(n), np.round(scores, 9))).tolist():
        if len(gone) >= budget:
            break
        if not (held and held(k)) and not (total and (words + size[k]) / total > ratio * SLACK):
            gone.add(k)
            words += size[k]
    return gone


def optimize(text: str | None, options: Options = Options(), vectors: np.ndarray | None = None, pins: Sequence[re.Pattern] | None = None) -> Result:  # noqa: B008
    """Shorten one text. ``vectors`` (chunks x d) take the place of term weights; ``pins`` saves compiling ``options.pins`` again."""
    if text is None or not text.strip():
        return Result(text, text, status="passed")
    chunks = chunk(text, options.strategy)
    n = len(chunks)
    if n < options.min_chunks:
        return Result(text, text, chunks_total=n, status="passed")
    if n > MAX_CHUNKS:
        return Result(text, text, chunks_total=n, status="too_large")
    if vectors is not None and len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} chunks")
    cosines = similarity(chunks) if vectors is None else np.asarray(vectors, float) @ np.asarray(vectors, float).T
    graph = adjacency(cosines)
    fiedler, lam = second_eigenpair(graph)
    degree = graph.sum(1)
    top = degree.max()
    scores = DEGREE_SHARE * (degree / top if top > 0 else degree) + SPECTRAL_SHARE * (1 - np.abs(fiedler))
    zones = [zone(c) for c in chunks] if options.protect else [("unknown", 0.0, 1.0)] * n
    pins = pin_patterns(options.pins) if pins is None else pins
    size = [len(c.split()) for c in chunks]
    held = lambda k: zones[k][0] == "instruction" and zones[k][1] > Z.PROTECTED or any(p.search(chunks[k]) for p in pins)
    gone = lowest(scores * np.array([z[2] for z in zones]), size, options.target_ratio, held)
    out = "\n\n".join(c for k, c in enumerate(chunks) if k not in gone)
    return Result(out, text, 1 - len(out) / max(len(text), 1), max(0, estimate(text) - estimate(out)), lam, n, len(gone), [chunks[k] for k in sorted(gone)], scores.tolist())


def tool_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each tool result."""
    return [m.span() for m in re.finditer(TOOL_RESULT.replace(r"\z", r"\Z"), text)]


def tagged(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """``text`` with ``<<PIN_k>>`` in place of span k."""
    out, at = [], 0
    for k, (a, b) in enumerate(spans):
        out += [text[at:a], f"<<PIN_{k}>>"]
        at = b
    return "".join([*out, text[at:]])


def untagged(short: str, text: str, spans: Sequence[tuple[int, int]]) -> str:
    for k, (a, b) in enumerate(spans):
        short = short.replace(f"<<PIN_{k}>>", text[a:b])
    return short
