"""Operator 10: SentencePiece encoding and decoding by streaming Viterbi.

The best path maximises the sum of the pieces' log-probabilities, as the lattice decoder of the public
library does for a unigram model. Only the scores and back pointers since the last commit are kept:
whenever the back-pointer paths of all boundaries that a piece may still start from, at most as many as
the longest piece has characters, meet in one boundary, the ids up to it are final and leave the
window. No piece holds a space after another character, so paths always meet before a word; words
between such boundaries that fit the window are solved in one go and remembered, in two generations of
bounded size, and not solved again.

The vocabulary file (``piece_bpe_32k.model``) holds no probabilities: its scores are byte-pair ranks,
whose sum means nothing. Tokenizers are not trained here, so a piece of rank r has the weight of the
Zipf-Mandelbrot law, ``1 / (SHIFT + r)``, which favours few and frequent pieces.

Text is neither lower-cased nor otherwise normalised: a dummy space is put in front and spaces become
U+2581. A U+2581 of the text itself, and any character that no piece holds, becomes its UTF-8 bytes,
so decoding gives back every text exactly. Defined cases: null and empty texts have no ids and decode
to the empty text; texts of any length need a window, not a lattice; repeated rows stay repeated;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from math import log
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import byte_slices, byte_view

#: The vocabulary file, unless the session's ``spectraloom.pieces.model`` or the caller names another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The shift of the Zipf-Mandelbrot law.
SHIFT = 1000.0
SPACE = "▁"
#: Words remembered in each of two generations.
MEMORY = 250_000
_NONE = float("-inf")


class Pieces:
    """Pieces, scores and byte ids of a SentencePiece model, and the two directions."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.unk = sp.unk_id()
        self.raw: list[bytes] = [b""] * n
        self.byte_ids = [self.unk] * 256
        #: piece or its prefix -> (score, id); a mere prefix has no score
        self.trie: dict[str, tuple[float, int]] = {}
        scores = []
        for k in range(n):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.raw[k] = bytes([int(piece[3:-1], 16)])
                self.byte_ids[self.raw[k][0]] = k
            elif not sp.is_control(k) and not sp.is_unknown(k) and not sp.is_unused(k):
                self.raw[k] = piece.replace(SPACE, " ").encode()
                scores.append(-log(SHIFT - min(sp.get_score(k), 0.0)))
                for end in range(1, len(piece)):
                    self.trie.setdefault(piece[:end].replace(SPACE, " "), (_NONE, -1))
                self.trie[piece.replace(SPACE, " ")] = (scores[-1], k)
        # the same as nested tables for short words: (children, score or None, id)
        self.root: tuple = ({}, None, -1)
        for piece, (score, k) in sorted(self.trie.items(), key=lambda kv: len(kv[0])):
            node = self.root
            for c in piece[:-1]:
                node = node[0][c]
            node[0][piece[-1]] = ({}, None if score == _NONE else score, k)
        self.longest = max((len(p) for p in self.trie), default=1)
        self.unknown = min(scores, default=0.0) - 10.0
        whole = [p for p, (s, _) in self.trie.items() if s != _NONE]
        inner = any(" " in p.lstrip(" ") for p in whole)
        joined = {c for p in whole if len(p) > 1 for c in p}
        cuts = "".join(c for c in "\n\t\r" if c not in joined)
        stop = re.escape(cuts)
        # where no piece can cross, all paths meet: before a space that follows another character, and round the cut characters
        self.split = None if inner else re.compile(rf" *[^ {stop}]+|[{stop}]| +" if cuts else r" *[^ ]+| +").findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def viterbi(self, text: str) -> Iterator[list[int]]:
        """Runs of final ids, as soon as all surviving paths agree on them. Spaces stand for the model's U+2581, which as a character of the text is unknown."""
        trie, unknown, longest = self.trie, self.unknown, self.longest
        n, base = len(text), 0
        best: list[float] = [0.0]
        back: list[tuple[int, int]] = [(0, -1)]  # (start, id) of the last piece that ends at boundary base + k
        for i in range(n):
            k = i - base
            here = best[k]
            solid = False
            for end in range(i + 1, min(n, i + longest) + 1):
                got = trie.get(text[i:end])
                if got is None:
                    break
                if got[0] != _NONE:
                    solid |= end == i + 1
                    s, j = here + got[0], end - base
                    while j >= len(best):
                        best.append(_NONE)
                        back.append((0, -1))
                    if s > best[j]:
                        best[j], back[j] = s, (i, got[1])
            if not solid:
                s = here + unknown
                if k + 1 >= len(best):
                    best.append(_NONE)
                    back.append((0, -1))
                if s > best[k + 1]:
                    best[k + 1], back[k + 1] = s, (i, self.unk)
            if k >= 4 * longest and k % longest == 0:
                # paths that may still matter end at i+1 .. the farthest boundary reached; find where they meet
                open_ends = {j + base for j in range(k + 1, len(best)) if best[j] != _NONE}
                while len(open_ends) > 1:
                    far = max(open_ends)
                    open_ends.remove(far)
                    open_ends.add(back[far - base][0])
                meet = open_ends.pop()
                if meet > base and meet <= i + 1:
                    yield self._path(text, back, base, meet)
                    drop = meet - base
                    del best[:drop], back[:drop]
                    base = meet
        if n > base:
            yield self._path(text, back, base, n)

    def short(self, text: str) -> list[int]:
        """The same path for a text no longer than the window, which needs no commits."""
        n, root, low = len(text), self.root[0], _NONE
        best, start, ids = [0.0] + [low] * n, [0] * (n + 1), [self.unk] * (n + 1)
        for i in range(n):
            here, node, end = best[i], root.get(text[i]), i + 1
            if node is None or node[1] is None:
                s = here + self.unknown
                if s > best[end]:
                    best[end], start[end], ids[end] = s, i, self.unk
            while node is not None:
                score = node[1]
                if score is not None:
                    score += here
                    if score > best[end]:
                        best[end], start[end], ids[end] = score, i, node[2]
                if end == n:
                    break
                node = node[0].get(text[end])
                end += 1
        out, end = [], n
        while end:
            i = start[end]
            if ids[end] == self.unk:
                out.extend(self.byte_ids[b] for b in reversed(text[i:end].encode()))
            else:
                out.append(ids[end])
            end = i
        out.reverse()
        return out

    def _path(self, text: str, back: list[tuple[int, int]], base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            start, k = back[end - base]
            if k == self.unk:
                out.extend(self.byte_ids[b] for b in reversed(text[start:end].encode()))
            else:
                out.append(k)
            end = start
        out.reverse()
        return out

    def _solve(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            ids = self.short(word) if len(word) <= 4 * self.longest else [k for run in self.viterbi(word) for k in run]
            got = array("i", ids).tobytes()
        if len(word) <= 64:
            if len(self.young) >= MEMORY:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        text = " " + text
        if self.split is None:
            return np.array([k for run in self.viterbi(text) for k in run], np.int32).tobytes()
        words = self.split(text)
        parts = list(map(self.young.get, words))
        if None in parts:
            solve, have = self._solve, self.young
            parts = [p if p is not None else have.get(w) or solve(w) for p, w in zip(parts, words, strict=True)]
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), np.int32).tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[k] for k in ids])[1:]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _model(df: DataFrame, path: str | None) -> bytes:
    return Path(path or df.sparkSession.conf.get("spectraloom.pieces.model", MODEL)).read_bytes()


def encode(docs: DataFrame, model_path: str | None = None, check: bool = True) -> DataFrame:
    """The rows of ``docs`` as ``doc_id, ids array<int>, n_ids, ids_sha256, decoded_sha256, exact``.

    ``decoded_sha256`` is of the text that decoding gives, ``exact`` whether it is the input. One
    pass, no shuffle; the model file (half a megabyte, read on the driver) goes along with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_model(docs, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(shared.value)
        for batch in batches:
            raw, offs = byte_view(batch.column("text"))
            for lo, hi, part, at in byte_slices(raw, offs):
                codes, decoded, same = [], [], []
                data = part.tobytes()
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = pieces.encode_bytes(data[a:b].decode())
                    codes.append(ids)
                    if check:
                        back = pieces.decode_bytes(np.frombuffer(ids, np.int32).tolist())
                        decoded.append(hashlib.sha256(back).hexdigest())
                        same.append(back == data[a:b])
                sizes = np.array([0, *(len(c) // 4 for c in codes)], np.int32).cumsum(dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(codes), np.int32)))
                cols = [batch.column("doc_id").slice(lo, hi - lo), ids, pa.array(np.diff(sizes).astype(np.int64)), pa.array([hashlib.sha256(c).hexdigest() for c in codes])]
                names = ["doc_id", "ids", "n_ids", "ids_sha256"]
                if check:
                    cols, names = [*cols, pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], [*names, "decoded_sha256", "exact"]
                yield pa.RecordBatch.from_arrays(cols, names)

    more = ", decoded_sha256 string, exact boolean" if check else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_sha256 string" + more)


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``encoded(doc_id, ids)``; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_model(encoded, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(shared.value)
        for batch in batches:
            texts = [pieces.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
