"""Operator 5: document fingerprints by randomised edit embedding.

The embedding of Chakraborty, Goldenberg and Koucky (2016): a pointer walks over the characters; at
step j it writes the character it stands on and advances if a random bit shared by all documents, of
j and that character, is set. Texts a few edits apart fall into step again, so edit distance becomes
Hamming distance. Walks run over blocks of ``BLOCK`` code points, so that long texts are as parallel
as many short ones; a shift moves a block's border, which costs the two blocks a few steps each.

A fingerprint is ``SAMPLES`` sampled places of the whole embedding, one hex digit each. Each sample has
a random order of all places, the same for every text, and takes the first of them that lies in the
text's embedding and stands on a character (min-wise sampling over absolute places). So two texts of any
lengths have a sample's place in common with the chance that the places of the shorter are among those
of the longer, and the likeness falls in proportion to the part that one of them lacks. Orders are not
drawn place by place: the ``RANKS`` first of the places up to any length change only a logarithmic number
of times, and these changes are drawn directly. Digit 0 is left where none of the ``RANKS`` places stands on a
character (a walk leaves a block after about two thirds of its steps, so about one sample in 6,000), and
for the empty text; where both fingerprints have it, it is not compared.

Defined cases: null is the empty text, whose fingerprint is all zeros and is alike (1.0) only to
itself; equal texts have equal fingerprints; equal ids are ordered by text, and the document after the
last is the first (with one document: itself); an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are ignored; any length of text is walked to its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import components, materialize

BLOCK, STEPS, WIDTH, SAMPLES = 1024, 3072, 2048, 256
#: Places held for a sample, and a bound of the places of any text (of 10^11 characters).
RANKS, MOST_PLACES = 8, 1 << 38
#: Characters that a text counts for at least where texts are gathered.
LEAST = 512
#: Texts of a bucket that are compared in one cell.
MEMBERS = 512
_rng = np.random.default_rng(20160619)
#: advance bits by step and character code; code 0 is past the end and never advances
_MOVE = _rng.integers(0, 2, (STEPS, 256), dtype=np.int8)
_MOVE[:, 0] = 0
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: one of 15 non-zero digits for each character code
_DIGIT = np.concatenate(([0], 1 + _rng.integers(0, 15, 255))).astype(np.uint8)


def _orders(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sample * MOST_PLACES + n from which on they hold, and the RANKS first places below n in the sample's order (-1: no more).

    A place's rank is uniform in [0, 1); with ``worst`` the last of the ranks held, the next place to enter
    is a geometric number of places on, and its rank is uniform below ``worst``.
    """
    keys, held = [], []
    for sample in range(SAMPLES):
        best, place = [], -1
        while True:
            worst = best[-1][0] if len(best) == RANKS else 1.0
            place += int(min(rng.geometric(worst), MOST_PLACES))
            if place >= MOST_PLACES - 1:
                break
            best = sorted([*best, (rng.random() * worst, place)])[:RANKS]
            keys.append(sample * MOST_PLACES + place + 1)
            held.append([p for _, p in best] + [-1] * (RANKS - len(best)))
    return np.array(keys), np.array(held)


_KEYS, _HELD = _orders(_rng)


def places_of(n: int) -> np.ndarray:
    """The first RANKS of the n first places in the order of each sample (SAMPLES, RANKS); -1 where there are fewer."""
    return _HELD[np.searchsorted(_KEYS, np.arange(SAMPLES) * MOST_PLACES + n, "right") - 1]


def codes_of(text: str) -> np.ndarray:
    """Non-zero 8-bit codes of the code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)


@cache
def moves(walk: int) -> np.ndarray:
    """Advance bits of a walk; those of different walks are independent, and walk 0 is that of ``compare``."""
    if walk == 0:
        return _MOVE
    bits = np.random.default_rng((20160619, walk)).integers(0, 2, (STEPS, 256), dtype=np.int8)
    bits[:, 0] = 0
    return bits


def walk(blocks: list[np.ndarray], bits: np.ndarray = _MOVE) -> np.ndarray:
    """Embeddings (len(blocks), STEPS) of blocks of at most BLOCK codes, padded with 0."""
    out = np.zeros((len(blocks), STEPS), np.uint8)
    size = np.array([len(b) for b in blocks])
    order = np.argsort(size, kind="stable")
    for lo in range(0, len(order), WIDTH):
        some = order[lo : lo + WIDTH]
        long, wide = int(size[some].max()), len(some)
        grid = np.zeros((long + 1, wide), np.uint8)
        for col, k in enumerate(some):
            grid[: size[k], col] = blocks[k]
        flat, at = grid.ravel(), np.arange(wide)
        got = np.empty((3 * long, wide), np.uint8)
        move = bits[: 3 * long].astype(np.int64) * wide
        for j in range(3 * long):
            c = flat.take(at)
            got[j] = c
            at += move[j].take(c)
        out[some, : 3 * long] = got.T
    return out


def fingerprints(texts: list[np.ndarray], number: int = 0) -> np.ndarray:
    """Sampled digits (n, SAMPLES) of each text given by its codes, on the walk of that number."""
    blocks, seen, firsts, places = [], {}, [], []
    for codes in texts:
        ids = []
        for lo in range(0, len(codes), BLOCK):
            b = codes[lo : lo + BLOCK]
            key = b.tobytes()
            k = seen.get(key)
            if k is None:
                k = seen[key] = len(blocks)
                blocks.append(b)
            ids.append(k)
        firsts.append(ids)
    walks = walk(blocks, moves(number)) if blocks else np.zeros((0, STEPS), np.uint8)
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    for row, (codes, ids) in enumerate(zip(texts, firsts, strict=True)):
        if len(codes):
            places = places_of(3 * len(codes))
            digits = np.where(places >= 0, _DIGIT[walks[np.array(ids)[places // STEPS], places % STEPS]], 0)
            out[row] = digits[np.arange(SAMPLES), (digits > 0).argmax(1)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal digits among the places where either has one; 1 where neither has any."""
    used = (a > 0) | (b > 0)
    n = used.sum(1)
    return np.where(n > 0, ((a == b) & used).sum(1) / np.maximum(n, 1), 1.0)


def as_text(prints: np.ndarray) -> list[str]:
    return [r.tobytes().decode() for r in _HEX[prints]]


def edited(text: str, nxt: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``nxt``."""
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


def _compare(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
    every = {t: k for k, t in enumerate(dict.fromkeys([*texts, *changed, *nexts]))}
    prints = fingerprints([codes_of(t) for t in every])
    own, alt, nxt = (prints[[every[t] for t in col]] for col in (texts, changed, nexts))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(as_text(own)), pa.array(as_text(alt)), pa.array(likeness(own, alt)), pa.array(likeness(own, nxt))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _stream(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (part, guest, doc_id, text); a guest row only serves as the next document of the row before it.

    Rows are compared together up to ``most`` characters of texts and next texts, where any text counts
    as ``LEAST`` at least: a block is walked in up to STEPS bytes however short it is.
    """
    ids, texts, nexts, held, size = [], [], [], None, 0
    for batch in batches:
        for part, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True):
            if held is not None and held[0] == part:
                ids.append(held[1])
                texts.append(held[2])
                nexts.append(text)
                size += max(len(held[2]), LEAST) + max(len(text) - len(held[2]), 0)
            held = None if guest else (part, doc_id, text)
            if size >= most:
                yield _compare(ids, texts, nexts)
                ids, texts, nexts, size = [], [], [], 0
    if ids:
        yield _compare(ids, texts, nexts)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of ``doc_id``, each range followed by the first row of the next as a guest; one shuffle of the texts.

    Borders come from quantiles of the ids and the first id of each range from a minimum: as many
    numbers on the driver as there are partitions.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(q) for q in rows.select("doc_id").stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    firsts = sorted((r[1], r[0]) for r in rows.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id")).collect())
    if not firsts:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("guest"), "doc_id", "text")
    before = {first: firsts[k - 1][1] for k, (first, _) in enumerate(firsts)}
    host = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]).cast("map<bigint,int>"), F.col("doc_id"))
    own = F.struct(part.cast("int").alias("part"), F.lit(False).alias("guest"))
    places = F.when(host.isNotNull(), F.array(own, F.struct(host.alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = rows.select(F.explode(places).alias("at"), "doc_id", "text").select("at.part", "at.guest", "doc_id", "text")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = with_next(docs).mapInArrow(_stream, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def within_edits(a: str, b: str, most: int) -> int | None:
    """The edit distance of two texts if it is at most ``most``, by furthest-reaching diagonals: O(n + most^2) steps."""
    if abs(len(a) - len(b)) > most:
        return None

    def slide(i: int, j: int) -> int:
        step = 64
        while step and i < len(a) and j < len(b):
            if a[i : i + step] == b[j : j + step] and i + step <= len(a) and j + step <= len(b):
                i, j, step = i + step, j + step, step * 2
            else:
                step //= 2
        return i

    goal = len(b) - len(a)
    reach = {0: slide(0, 0)}
    if goal == 0 and reach[0] == len(a):
        return 0
    for e in range(1, most + 1):
        new = {}
        for d in range(-e, e + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -2))
            i = min(i, len(a), len(b) - d)
            if i >= 0 and i + d >= 0:
                new[d] = slide(i, i + d)
        reach = new
        if reach.get(goal) == len(a):
            return e
    return None


def forest(texts: list[str], comps: list[int], side: list[int], most: int) -> list[tuple[int, int]]:
    """Pairs of members in different components within ``most`` edits, enough of them to join all that are linked.

    Members of side 0 meet those of side 1, or one another if there is no side 1. An edit changes the
    length by one and the counts of characters by two at most, so pairs that differ more are not read.
    """
    root = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    size = np.array([len(t) for t in texts])
    counts = np.stack([np.bincount(codes_of(t) & 63, minlength=64) for t in texts]).astype(np.int32)
    sides, of = np.array(side), np.array(comps)
    out = []
    for i in np.flatnonzero(sides == 0):
        others = np.flatnonzero(sides == 1) if sides.any() else np.arange(i + 1, len(texts))
        others = others[(of[others] != of[i]) & (np.abs(size[others] - size[i]) <= most)]
        others = others[np.abs(counts[others] - counts[i]).sum(1) <= 2 * most]
        for j in others.tolist():
            a, b = find(comps[i]), find(comps[j])
            if a != b and within_edits(texts[i], texts[j], most) is not None:
                root[a] = b
                out.append((int(i), j))
    return out


def _within_buckets(met: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Verified links ``src, dst`` between components of ``met(band, doc_id, component)``, found bucket by bucket.

    A bucket of more than ``MEMBERS`` texts is dealt into blocks, and each two blocks meet in a cell of
    their own, so no task holds a bucket.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell."""
        held, last = [], None

        def done() -> pa.RecordBatch:
            found = forest([x[3] for x in held], [x[2] for x in held], [x[4] for x in held], most) if len(held) > 1 else []
            ids = [(held[i][1], held[j][1]) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([max(p) for p in ids], pa.int64()), pa.array([min(p) for p in ids], pa.int64())], ["src", "dst"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "doc_id", "component", "text", "side")), strict=True):
                if row[0] != last and held:
                    yield done()
                    held = []
                held.append(row)
                last = row[0]
        if held:
            yield done()

    blocks = met.groupBy("band").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    rows = met.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.concat_ws("|", "band", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "doc_id", "component", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    n_parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(texts, "doc_id").repartition(n_parts, "cell").sortWithinPartitions("cell").select("cell", "doc_id", "component", "text", "side").mapInArrow(meet, "src long, dst long").distinct()


def near_copies(docs: DataFrame, most_edits: int = 16, walks: int = 8, bands: int = 24, digits: int = 6) -> DataFrame:
    """``doc_id, component_id`` by bit-sampled banding of fingerprints and verified edit distance, for texts of non-null ids.

    Each text has a fingerprint on each of several independent walks, and bands of its own for each: two
    texts whose pointers stay out of step after an edit on one walk fall into step on another.
    Equal texts are one text first. In each band each text meets the smallest id of its bucket, so a
    bucket of any size gives one pair a member; pairs are verified on whole texts. Where the members of
    a bucket are then still in several components, they are compared with one another, block by block.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codes_of(t or "") for t in batch.column("text").to_pylist()]
            every = np.concatenate([fingerprints(texts, w) for w in range(walks)], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(as_text(every))], ["doc_id", "fingerprint"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_edits(a, b, most_edits) is not None for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("src").filter(pa.array(ok)), batch.column("dst").filter(pa.array(ok))], ["src", "dst"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    hashed = rows.select("doc_id", F.sha2("text", 256).alias("h")).distinct()
    # a minimum in the tasks before the shuffle: the commonest text, the empty one maybe, is no bottleneck
    classes = materialize(hashed.join(hashed.groupBy("h").agg(F.min("doc_id").alias("rep")), "h").select("doc_id", "rep"))
    reps = rows.join(classes.where("doc_id = rep").select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "text"])
    marks = reps.mapInArrow(prints, "doc_id long, fingerprint string")
    rng = np.random.default_rng(5)
    picks = [w * SAMPLES + rng.choice(SAMPLES, digits, False) for w in range(walks) for _ in range(bands)]
    keys = [F.concat(F.lit(f"{k}:"), *[F.substring("fingerprint", int(p) + 1, 1) for p in some]) for k, some in enumerate(picks)]
    banded = materialize(marks.select("doc_id", F.explode(F.array(*keys)).alias("band")))
    low = banded.groupBy("band").agg(F.min("doc_id").alias("dst"))
    pairs = banded.join(low, "band").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst").distinct()
    both = pairs.join(reps.select(F.col("doc_id").alias("src"), F.col("text").alias("a")), "src").join(reps.select(F.col("doc_id").alias("dst"), F.col("text").alias("b")), "dst")
    links = materialize(both.mapInArrow(verify, "src long, dst long"))
    comps = components(links)
    at = banded.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = at.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    fresh = materialize(_within_buckets(materialize(at.join(mixed, "band")), reps, most_edits))
    if not fresh.isEmpty():
        comps = components(links.unionByName(fresh))
    out = classes.join(comps, classes.rep == comps.node, "left")
    return out.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
