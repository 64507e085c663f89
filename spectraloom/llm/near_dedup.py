"""Operator 2: near-duplicate groups by SetSketch registers.

A document is its set of distinct word shingles. Each element owns a Poisson stream of arrivals, dealt
to registers at random; a register keeps the earliest arrival of any element, truncated to an
exponentially spaced grid (Ertl, 2021). Registers of a union are elementwise maxima of the stored
exponents, so sketches merge; two sets agree in a register with a chance that grows with their
similarity. Only arrivals before a cut-off that shrinks with the set's size are generated, so a
sketch costs the same for any size; a register left open makes the cut-off double.

Bands of registers are bucket keys. Documents with equal sets are one class, represented by its
smallest id, before anything else. Each bucket's members first meet its smallest id, one pair a
member; these pairs pass a joint likelihood estimate of the Jaccard index from all registers, with a
margin of five standard deviations. Where the members of a bucket are then still in different
components, those outside its largest component are compared, set against set, with the rest of the
bucket in blocks, and only a forest of the links found leaves a block; a bucket whose members are one
component makes nothing further. So a group of copies of any size makes rows in proportion to its size.
All links are confirmed on the full sets of both texts.

With 48 bands of 6 registers and base 1.1, a pair at similarity 0.8 is missed by every band with a
chance of 2e-7, and by the estimate with less.

Defined cases: null or wordless texts have an empty set, link with nothing and are kept; a text with
fewer words than a shingle is one shingle of all its words; repeated rows stay repeated; rows of one id
are one document, linked by any of its texts; a null id has no component and is not kept; an empty
table gives an empty result; other columns, whatever their names, are ignored; texts of any length are
read whole. ``dedup`` keeps the documents that represent their group, each equal row of them once, and
all rows without an id as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import U64, byte_slices, byte_view, components, discard, materialize, mix64, pieces_of, stored, unused, words

BANDS, ROWS, BASE = 48, 6, 1.1
REGISTERS = BANDS * ROWS
OFFSET, CUTOFF = 30, 12.5
#: Sets under this size are sketched one by one.
SMALL = 64
MARGIN = 0.12
#: Least hashes of a set that stand for it, and the margin of a likeness taken from them (five standard deviations).
SIG, SIG_MARGIN = 1024, 0.063
#: Members of a block of those outside a bucket's largest component, and of a block of the others; pairs that share one copy of their hub's text.
LEFT, RIGHT, HUB = 512, 2048, 256
_STEP = U64(0xD1342543DE82EF95)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of k words, A-Z lower-cased."""
    _, ids, at = words(_FOLD[raw], offs)
    out = []
    many = np.zeros(len(ids), U64)
    for j in range(min(k, len(ids))):  # a slice may hold fewer words than a shingle
        many[: len(ids) - j] = mix64(many[: len(ids) - j] + ids[j:] * U64(2 * j + 3))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(many[lo : hi - k + 1]))
        elif hi > lo:
            whole = np.array([hi - lo], U64)
            for j in range(hi - lo):
                whole = mix64(whole + ids[lo + j : lo + j + 1] * U64(2 * j + 3))
            out.append(whole)
        else:
            out.append(np.zeros(0, U64))
    return out


def _arrival(e: np.ndarray, k: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Gap before, and register of, arrival k (from 1) of elements e."""
    h = mix64(e + np.asarray(k, U64) * _STEP)
    return -np.log(((h >> U64(24)).astype(np.float64) + 0.5) / (1 << 40)) / REGISTERS, ((h & U64(0xFFFFFF)) * U64(REGISTERS) >> U64(24)).astype(np.int64)


def _one(e: np.ndarray, cut: float) -> np.ndarray:
    """Earliest arrivals of a small set before the cut-off, by a table of all its streams."""
    first = np.full(REGISTERS, np.inf)
    mean = REGISTERS * cut
    n, lo, t = int(mean + 7 * mean**0.5 + 12), 0, np.zeros((len(e), 1))
    while True:
        gap, reg = _arrival(e[:, None], np.arange(lo + 1, lo + n + 1)[None, :])
        gap[:, 0] += t[:, -1]
        t = np.cumsum(gap, 1)
        ok = t <= cut
        np.minimum.at(first, reg[ok], t[ok])
        if t[:, -1].min() > cut:
            return first
        lo += n


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (n, REGISTERS) as bytes; an empty set has zeros."""
    out = np.full((len(sets), REGISTERS), np.inf)
    size = np.array([len(s) for s in sets])
    big = np.flatnonzero(size >= SMALL)
    if len(big):
        e = np.concatenate([sets[d] for d in big])
        doc = np.repeat(big, size[big])
        cut = CUTOFF / size[doc]
        t, k, flat = np.zeros(len(e)), 0, out.ravel()
        while len(e):
            k += 1
            gap, reg = _arrival(e, k)
            t = t + gap
            on = t <= cut
            e, doc, cut, t = e[on], doc[on], cut[on], t[on]
            np.minimum.at(flat, doc * REGISTERS + reg[on], t)
    for d in np.flatnonzero((size > 0) & ((size < SMALL) | np.isinf(out).any(1))):
        cut = CUTOFF / size[d]
        out[d] = _one(sets[d], cut)
        while np.isinf(out[d]).any():
            cut *= 2
            out[d] = _one(sets[d], cut)
    grid = np.floor(-np.log(np.where(np.isinf(out), 1.0, out)) / np.log(BASE)) + OFFSET
    return np.where(size[:, None] > 0, np.clip(grid, 1, 255), 0).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard index of pairs from the counts of larger, smaller and equal registers and the set sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(n_a, n_b)[:, None] / np.maximum(n_a, n_b)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    larger, smaller = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    like = up[:, None] * np.log(larger) + down[:, None] * np.log(smaller) + (a.shape[1] - up - down)[:, None] * np.log(np.maximum(1 - larger - smaller, 1e-12))
    return grid[np.arange(len(grid)), like.argmax(1)]


def exact_set(text: str | None, k: int) -> frozenset:
    """The shingle set itself, as words."""
    w = (text or "").encode().translate(bytes(_FOLD)).split()
    # bytes.split() cuts at the same six characters
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, h1, h2, regs``: set size, a 128-bit hash of the set, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = byte_view(batch.column("text"))
            for lo, hi, part, at in byte_slices(raw, offs):
                sets = shingle_sets(part, at, k)
                regs = sketches(sets)
                h1 = [int(mix64(s).sum(dtype=U64).view(np.int64)) for s in sets]
                h2 = [int(mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n", "h1", "h2", "regs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, regs binary")


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (src, dst) whose estimate and sizes leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in ("ra", "rb"))
            got = np.concatenate([estimate(a[i : i + 4096], b[i : i + 4096], *(batch.column(c).to_numpy()[i : i + 4096].astype(float) for c in ("na", "nb"))) for i in range(0, n, 4096)]) if n else np.zeros(0)
            keep = pa.array(got >= least - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column("src").filter(keep), batch.column("dst").filter(keep)], ["src", "dst"])

    a = reps.select(F.col("doc_id").alias("src"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = reps.select(F.col("doc_id").alias("dst"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    fit = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least - 1e-9)
    return pairs.join(a, "src").join(b, "dst").where(fit).mapInArrow(run, "src long, dst long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that are linked, by the full sets of both texts.

    Pairs of one ``dst`` are dealt into cells of about ``HUB``, so the text of a hub is sent once a cell
    and no task holds all its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, the hub's texts first."""
        cell, hubs = None, []
        for batch in batches:
            src, dst = [], []
            for d, salt, member, i, text in zip(*(batch.column(c) for c in ("dst", "salt", "member", "src", "text")), strict=True):
                now = (d.as_py(), salt.as_py())
                if now != cell:
                    cell, hubs = now, []
                own = exact_set(text.as_py(), k)
                if not member.as_py():
                    hubs.append(own)
                elif any(100 * both >= percent * (len(own) + len(hub) - both) for hub in hubs if (both := len(own & hub))):
                    src.append(i.as_py())
                    dst.append(now[0])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    many = pairs.groupBy("dst").agg(F.ceil(F.count("*") / HUB).cast("int").alias("salts"))
    cells = materialize(pairs.join(many, "dst").select("src", "dst", F.pmod(F.xxhash64("src"), F.col("salts")).cast("int").alias("salt")), pieces_of(texts))
    members = cells.join(texts.select(F.col("doc_id").alias("src"), "text"), "src").select("dst", "salt", F.lit(1).alias("member"), "src", "text")
    hubs = cells.select("dst", "salt").distinct().join(texts.select(F.col("doc_id").alias("dst"), "text"), "dst").select("dst", "salt", F.lit(0).alias("member"), F.col("dst").alias("src"), "text")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.unionByName(hubs).repartition(n, "dst", "salt").sortWithinPartitions("dst", "salt", "member")
    return materialize(dealt.mapInArrow(run, "src long, dst long").distinct(), pieces_of(texts))


def linked_pairs(sizes: np.ndarray, comps: np.ndarray, sigs: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of a member ``left`` and a member ``right`` (indexes) in different components that may be linked, enough of them to join what is linked.

    ``sigs`` are the ``SIG`` least 32-bit hashes of each set, which are all of them for most sets. Counts of
    shared hashes come from matrix products over ranges of hashes, so memory is that of the counts and of
    one range. Where both sets are whole the count is the answer but for collisions, for which two hashes
    are allowed either way: a link that they could not have made joins the two components here, so that a
    group of near copies gives a forest, not all its pairs; one that they could have hidden goes on too.
    """
    root = {int(c): int(c) for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    if not len(left) or not len(right):
        return []
    place = np.full((2, len(sizes)), -1, np.int32)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    codes = np.concatenate(sigs)
    doc = np.repeat(np.arange(len(sigs), dtype=np.int32), [len(x) for x in sigs])
    shared = np.zeros((len(left), len(right)), np.float32)
    ranges = max(1, len(codes) >> 18)
    which = (codes.astype(np.uint64) * U64(ranges) >> U64(32)).astype(np.int32)
    for r in range(ranges):
        now = np.flatnonzero(which == r)
        _, of = np.unique(codes[now], return_inverse=True)
        often = np.bincount(of) > 1
        on = often[of]
        d, c = doc[now[on]], (np.cumsum(often) - 1)[of[on]]
        order = np.argsort(c, kind="stable")
        d, c = d[order], c[order]
        for lo in range(0, int(often.sum()), 2048):
            a, b = np.searchsorted(c, (lo, lo + 2048))
            x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            for grid, at in ((x, place[0, d[a:b]]), (y, place[1, d[a:b]])):
                grid[at[at >= 0], c[a:b][at >= 0] - lo] = 1
            shared += x @ y.T
    whole = sizes <= SIG
    out = []
    for lo in range(0, len(left), 64):
        strip = left[lo : lo + 64]
        n, m, both = sizes[strip][:, None], sizes[right][None, :], shared[lo : lo + 64]
        fits = (comps[strip][:, None] != comps[right][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        sure = whole[strip][:, None] & whole[right][None, :]
        may = fits & (~sure | (100 * (both + 2) >= percent * (n + m - both - 2)))
        strong = fits & sure & (100 * (both - 2) >= percent * (n + m - both + 2))
        for i, j in [*zip(*np.nonzero(strong), strict=True), *zip(*np.nonzero(may & ~strong), strict=True)]:
            p, q = int(strip[i]), int(right[j])
            a, b = find(int(comps[p])), find(int(comps[q]))
            if a == b:
                continue
            if strong[i, j]:
                root[a] = b
            elif not sure[i, j]:
                one, two = sigs[p], sigs[q]
                least = np.union1d(one, two)[:SIG]
                alike = np.isin(least, np.intersect1d(one, two, assume_unique=True), assume_unique=True).mean()
                if 100 * (alike + SIG_MARGIN) < percent:
                    continue
            out.append((p, q))
    return out


def _within_buckets(met: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs ``src, dst`` in different components of ``met(band, doc_id, component)``, found by comparing whole sets bucket by bucket.

    The members outside a bucket's largest component are dealt into left blocks and meet all members in
    right blocks, each two blocks in a cell of their own, so no task holds a bucket and a large group that
    is one component already is copied once for each left block only. Two members that are both outside
    meet in one cell, not in two.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = byte_view(batch.column("text"))
            for lo, hi, part, at in byte_slices(raw, offs):
                sets = shingle_sets(part, at, k)
                sigs = [np.unique((s >> U64(32)).astype(np.uint32))[:SIG].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n", "sig"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell."""
        held, last = [], None

        def done() -> pa.RecordBatch:
            ids, comps, sizes, sigs, side = zip(*held, strict=True)
            side = np.array(side)
            found = linked_pairs(np.array(sizes), np.array(comps), list(sigs), np.flatnonzero(side == 0), np.flatnonzero(side == 1), percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([max(ids[i], ids[j]) for i, j in found], pa.int64()), pa.array([min(ids[i], ids[j]) for i, j in found], pa.int64())], ["src", "dst"])

        for batch in batches:
            for cell, doc_id, component, n, sig, side in zip(*(batch.column(c) for c in ("cell", "doc_id", "component", "n", "sig", "side")), strict=True):
                now = cell.as_py()
                if now != last and held:
                    yield done()
                last = now
                held.append((doc_id.as_py(), component.as_py(), n.as_py(), np.frombuffer(sig.as_py(), np.uint32), side.as_py()))
        if held:
            yield done()

    sets = texts.join(met.select("doc_id").distinct(), "doc_id").select("doc_id", "text").mapInArrow(signed, "doc_id long, n long, sig binary")
    counts = met.groupBy("band", "component").agg(F.count("*").alias("c"))
    tops = counts.groupBy("band").agg(F.sum("c").alias("all"), F.max(F.struct(F.col("c"), -F.col("component"))).alias("top"))
    deal = tops.select("band", (-F.col("top.col2")).alias("top"), F.ceil((F.col("all") - F.col("top.c")) / LEFT).cast("int").alias("lefts"), F.ceil(F.col("all") / RIGHT).cast("int").alias("rights"))
    rows = met.join(deal, "band").withColumns({"out": F.col("component") != F.col("top"), "l": F.pmod(F.xxhash64("doc_id"), F.col("lefts")).cast("int"), "r": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("rights")).cast("int")})
    # a left block meets every right block; of two outside members that of the smaller left block is on the left, within a block either
    ones = lambda n: F.sequence(F.lit(0), n - 1)
    as_left = rows.where("out").select("band", F.col("l").alias("a"), F.explode(ones(F.col("rights"))).alias("b"), "doc_id", "component", F.lit(0).alias("side"))
    last = F.when(F.col("out"), F.col("l") + 1).otherwise(F.col("lefts"))
    as_right = rows.select("band", F.explode(ones(last)).alias("a"), F.col("r").alias("b"), "doc_id", "component", F.lit(1).alias("side"))
    cells = as_left.unionByName(as_right).select(F.concat_ws(":", "band", "a", "b").alias("cell"), "doc_id", "component", "side")
    n_parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.join(sets, "doc_id").select("cell", "doc_id", "component", "n", "sig", "side").repartition(n_parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(meet, "src long, dst long").distinct()


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks, _ = stored(sketched(rows, k))
    parts = pieces_of(marks)
    full = marks.where("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    member = materialize(full.select("doc_id", "n", "h1", "h2").distinct().join(classes, ["n", "h1", "h2"]).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.collect_set("rep").alias("reps")), parts)
    # an id with several texts joins their classes
    own = member.where(F.size("reps") > 1).select(F.explode("reps").alias("src"), F.col("rep").alias("dst")).where("src <> dst")
    reps, reps_at = stored(full.join(classes, ["n", "h1", "h2"]).where("doc_id = rep").select("doc_id", "n", "regs").dropDuplicates(["doc_id", "regs"]), parts)
    keys = [F.xxhash64(F.lit(b), F.substring("regs", b * ROWS + 1, ROWS)) for b in range(BANDS)]
    banded = reps.select("doc_id", F.explode(F.array(*keys)).alias("band"))
    low = banded.groupBy("band").agg(F.min("doc_id").alias("dst"), F.max("doc_id").alias("top")).where("dst < top").select("band", "dst")
    shared, shared_at = stored(banded.join(low, "band"), parts)  # buckets with company only
    discard(spark)
    tried = shared.where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst").distinct()
    likely = materialize(_likely(tried, reps, percent / 100).distinct(), parts)
    discard(spark, reps_at)
    # whole texts are shuffled once; only those in company go on
    texts, texts_at = stored(rows.join(shared.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "text"]), 8 * parts)
    discard(spark)
    links = _confirmed(likely, texts, k, percent).unionByName(own)
    comps = components(links)
    at = shared.select("band", "doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = at.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    met, met_at = stored(at.join(mixed, "band").distinct(), parts)
    discard(spark, shared_at)
    fresh = materialize(_within_buckets(met, texts, k, percent), parts)
    discard(spark, met_at)
    if not fresh.isEmpty():
        comps = components(links.unionByName(_confirmed(fresh, texts, k, percent)))
    discard(spark, texts_at)
    reached = member.join(comps, member.rep == comps.node, "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = marks.select("doc_id", F.col("n").alias("n_shingles")).join(reached, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that represent their group, as the module docstring says; its columns stay."""
    parts = pieces_of(docs)
    name = unused("rows", docs)
    kept = groups(docs, k, percent).where("kept").groupBy("doc_id").agg(F.count("*").alias(name))
    kept = materialize(kept, parts)
    once = docs.join(kept.where(F.col(name) == 1).select("doc_id"), "doc_id", "left_semi")
    if not kept.where(F.col(name) > 1).isEmpty():
        more = docs.join(kept.where(F.col(name) > 1).select("doc_id"), "doc_id", "left_semi")
        once = once.unionByName(more.dropDuplicates(["doc_id", "text"]))
    return once.unionByName(docs.where("doc_id is null")).coalesce(4 * parts)
