"""Operator 6: removal of long repeated byte strings by suffix arrays built with induced sorting.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier (in a document of
smaller id, or earlier in the same one) is removed; strings are judged on the input.

1. Each start of a ``LENGTH``-byte string belongs to one anchor: the leftmost least hash of the
   ``GRAM``-byte strings within it. Equal strings have equal anchors at equal offsets, so strings are
   compared only under one anchor hash, and none is missed. Consecutive starts under one anchor are a
   run; a run and the bytes its strings cover are a segment.
2. Anchor hashes are counted with a map-side sum; runs of hashes that occur once are unique and go.
3. Equal segments (same anchor and segment hash, 128 bits) are reduced to their first occurrence by a
   map-side minimum; every later one is removed whole. So a passage that a third of all documents
   share costs one row a task, not a group in one task.
4. Where an anchor has several different segments, their bytes go to shards by anchor hash. All
   strings of a segment hold its anchor, with half of their other bytes on one side of it at least, so
   a segment that shares neither half with another one of its anchor has no repeated string and is left
   out. The rest of a shard is one text, whose suffix array is induced: suffixes are classified,
   leftmost-smaller (LMS) substrings sorted by induction and named, the string of names sorted by the
   same function unless all names differ, and all suffixes induced from it. Over a small alphabet a
   whole bucket is induced at a time with numpy, over a large one suffix by suffix; either is linear.
   Permuted common prefixes, compared eight bytes at a time, group the suffixes that agree in
   ``LENGTH`` bytes; all but the first start go. Anchors with more than ``MANY`` segments are not put
   into a shard, which would hold them all in one task: their strings are grouped by (anchor, string
   hash), 128 bits, with the same map-side minimum.

Defined cases: null texts are empty; strings never cross documents; documents shorter than ``LENGTH``
bytes lose nothing. Rows that are equal in id and text count as one document and each gets its result;
rows of one id with other texts are further documents, ordered by a hash of the text. Null ids come
before all others. An empty table gives an empty result; other columns, whatever their names, are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import INVERSE, U64, byte_slices, byte_view, discard, materialize, mix64, pieces_of, powers, prefix_sums, stored, unused, window_hash

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # anchor hashes in one string
#: Segments of one anchor beyond which they are not sorted in one shard; bytes of a shard.
MANY, SHARD_BYTES = 4096, 1 << 19
LOWEST = -(1 << 63)
_BITS = 8  # a run has at most SPAN starts, fewer than 2**_BITS; so is the place of its anchor
_MASK = (1 << _BITS) - 1
HALF = (LENGTH - GRAM) // 2  # bytes beside an anchor that a string has on one side at least
#: Alphabets up to this size are induced bucket by bucket.
SMALL_ALPHABET = 320


def runs_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start within the row, number of starts with the anchor's place packed above it, anchor hash and segment hash of each run."""
    n = len(raw) - GRAM + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    if n < SPAN:
        return none
    sums = prefix_sums(raw)
    at = np.arange(n)
    # the hash's upper half over the place: a minimum is the least hash, and of equal ones the leftmost
    best = (sums[GRAM:] - sums[:-GRAM]) * powers(INVERSE, n)
    best *= U64(0x9FB21C651E98DF25)
    best &= U64(0xFFFFFFFF00000000)
    best |= at.astype(U64)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    where = (best & U64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(where)]
    ok = np.arange(len(where)) + LENGTH <= offs[1:][row]  # strings within one document
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none
    w = where[starts]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    s0, count = starts[first], np.diff(np.append(first, len(starts)))
    seg = window_hash(sums, s0, s0 + count + LENGTH - 1)
    # an anchor's place in the segment belongs to the identity of the segment
    seg = mix64(seg + (w[first] - s0).astype(U64))
    r = row[s0]
    return r, s0 - offs[:-1][r], count | (w[first] - s0) << _BITS, window_hash(sums, w[first], w[first] + GRAM), seg


def anchors(rows: DataFrame) -> DataFrame:
    """``anchor, seg, doc_id, h, run`` of every run; ``run`` packs the start, the anchor's place from there and the number of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = byte_view(batch.column("text"))
            ids, hs = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            for lo, _, part, at in byte_slices(raw, offs, 1 << 18):
                r, start, count, anchor, seg = runs_of(part, at)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(ids[lo + r]), pa.array(hs[lo + r]), pa.array((start << 2 * _BITS) | count)], ["anchor", "seg", "doc_id", "h", "run"])

    return rows.mapInArrow(run, "anchor long, seg long, doc_id long, h long, run long")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers by induced sorting; a shorter suffix comes before one it begins."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = np.append(s.astype(np.int64) + 1, 0)
    n += 1
    # classify: S if smaller than its right neighbour; equal ones follow the next difference
    diff = np.append(np.sign(s[1:] - s[:-1]), -1)
    nxt = np.where(diff != 0, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = diff[nxt] > 0
    small[-1] = True
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _by_bucket if s.max() <= SMALL_ALPHABET else _by_suffix
    if len(lms) < 2:
        return induce(s, small, lms)[1:]
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = induce(s, small, lms)
    sorted_lms = sa[is_lms[sa]]
    # names: equal LMS substrings (from one LMS suffix through the next) get equal names
    follow = np.empty(n, np.int64)
    follow[lms] = np.append(lms[1:], n - 1)
    length = follow[sorted_lms] - sorted_lms + 1
    same = np.zeros(len(sorted_lms), bool)
    alive = np.flatnonzero(length[1:] == length[:-1]) + 1
    k = 0
    while len(alive):
        alive = alive[s[np.minimum(sorted_lms[alive] + k, n - 1)] == s[np.minimum(sorted_lms[alive - 1] + k, n - 1)]]
        k += 1
        done = length[alive] <= k
        same[alive[done]] = True
        alive = alive[~done]
    name = np.cumsum(~same) - 1
    if name[-1] + 1 < len(lms):
        names = np.empty(n, np.int64)
        names[sorted_lms] = name
        sorted_lms = lms[suffix_array(names[lms])]
    return induce(s, small, sorted_lms)[1:]


def _by_bucket(s: np.ndarray, small: np.ndarray, order: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the LMS suffixes, given in ``order``, induce; steps go over whole buckets."""
    n, counts = len(s), np.bincount(s)
    ends = np.cumsum(counts)
    heads = ends - counts
    chars = np.flatnonzero(counts)
    sa = np.full(n, -1, np.int64)
    # LMS suffixes at their buckets' ends, in the given order
    c = s[order]
    by = np.argsort(c, kind="stable")
    cs = c[by]
    size = np.bincount(cs, minlength=len(counts))
    sa[ends[cs] - size[cs] + np.arange(len(cs)) - (np.cumsum(size) - size)[cs]] = order[by]

    def put(found: np.ndarray, front: np.ndarray, sign: int) -> None:
        ch = s[found]
        by = np.argsort(ch, kind="stable")
        ch, found = ch[by], found[by]
        begin = np.flatnonzero(np.concatenate(([True], ch[1:] != ch[:-1])))
        rank = np.arange(len(ch)) - np.repeat(begin, np.diff(np.append(begin, len(ch))))
        sa[front[ch] + sign * rank] = found
        front[ch[begin]] += sign * np.diff(np.append(begin, len(ch)))

    def before(found: np.ndarray, kind: bool) -> np.ndarray:
        j = found - 1
        j = j[j >= 0]
        return j[small[j] == kind]

    front = heads.copy()
    for ch in chars:  # larger suffixes from left to right, a bucket at a time
        lo = heads[ch]
        while lo < front[ch]:
            hi = front[ch]
            j = before(sa[lo:hi], False)
            lo = hi
            if len(j):
                put(j, front, 1)
        if size[ch]:
            j = before(sa[ends[ch] - size[ch] : ends[ch]], False)
            if len(j):
                put(j, front, 1)
    front_s = ends - 1
    edge = front  # where the larger ones of each bucket end
    for ch in chars[::-1]:  # smaller suffixes from right to left
        hi = ends[ch] - 1
        while hi > front_s[ch]:
            lo = front_s[ch]
            j = before(sa[lo + 1 : hi + 1][::-1], True)
            hi = lo
            if len(j):
                put(j, front_s, -1)
        j = before(sa[heads[ch] : edge[ch]][::-1], True)
        if len(j):
            put(j, front_s, -1)
    return sa


def _by_suffix(s: np.ndarray, small: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The same for an alphabet about as large as the string, where nearly every bucket is one suffix."""
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    head, tail = (ends - counts).tolist(), (ends - 1).tolist()
    text, rising = s.tolist(), small.tolist()
    sa, last = [-1] * len(text), list(tail)
    for i in order[::-1].tolist():
        c = text[i]
        sa[last[c]] = i
        last[c] -= 1
    for i in range(len(sa)):
        j = sa[i] - 1
        if j >= 0 and not rising[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    for i in range(len(sa) - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and rising[j]:
            c = text[j]
            sa[tail[c]] = j
            tail[c] -= 1
    return np.array(sa, np.int64)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, among: np.ndarray | None = None) -> np.ndarray:
    """Permuted: at each position of the text the length, cut at ``most``, of the prefix its suffix shares with the one before it in the array.

    With a mask ``among``, only where it holds for both; else 0.
    """
    n = len(sa)
    plcp = np.zeros(n, np.int64)
    if n < 2:
        return plcp
    eight = np.zeros(n + most + 8, U64)  # the eight bytes from each position
    for k in range(8):
        eight[: max(0, n - k)] |= text[k:].astype(U64) << U64(8 * k)
    i, phi = sa[1:], sa[:-1]
    if among is not None:
        on = among[i] & among[phi]
        i, phi = i[on], phi[on]
    order = np.argsort(i)
    i, phi = i[order], phi[order]
    got = np.zeros(len(i), np.int64)
    a, b, alive, k = i, phi, np.arange(len(i)), 0
    while len(alive) and k < most:
        x = eight[a + k] ^ eight[b + k]
        same = x == 0
        low = (x & (~x + U64(1)))[~same]
        got[alive[~same]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive, a, b = alive[same], a[same], b[same]
        k += 8
        got[alive] = k
    plcp[i] = np.minimum(np.minimum(got, most), n - np.maximum(i, phi))
    return plcp


def paired(segments: list[bytes], places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whether a segment shares the ``HALF`` bytes before, or after, its anchor with another segment of that anchor."""
    sizes = np.array([len(b) for b in segments])
    base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    sums = prefix_sums(np.frombuffer(b"".join(segments), np.uint8))
    out = np.zeros(len(segments), bool)
    for before, after in ((HALF, GRAM), (0, GRAM + HALF)):
        has = np.flatnonzero((places >= before) & (places + after <= sizes))
        at = base[has] + places[has]
        _, of, count = np.unique(window_hash(sums, at - before, at + after) ^ mix64(anchor[has].view(U64)), return_inverse=True, return_counts=True)
        out[has] |= count[of] > 1
    return out


def repeated(segments: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every string of LENGTH bytes in the segments that also starts earlier in one of them."""
    sizes = np.array([len(b) for b in segments])
    joined = np.frombuffer(b"".join(b + b"\xff" for b in segments), np.uint8)  # 0xff is no byte of UTF-8
    base = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    sa = suffix_array(joined)
    seg = np.repeat(np.arange(len(segments)), sizes + 1)
    off = np.arange(len(joined)) - base[seg]
    whole = off + LENGTH <= sizes[seg]
    plcp = common_prefixes(joined, sa, LENGTH, whole)
    group = np.cumsum(~((plcp[sa] >= LENGTH) & whole[sa] & np.concatenate(([False], whole[sa][:-1]))))
    keep = whole[sa]
    pos, group = sa[keep], group[keep]
    order = np.lexsort((starts[seg[pos]] + off[pos], docs[seg[pos]], group))
    g, p = group[order], pos[order]
    later = np.concatenate(([False], g[1:] == g[:-1]))
    # equal documents and starts are the same string, met twice
    s, d = starts[seg[p]] + off[p], docs[seg[p]]
    first = np.maximum.accumulate(np.where(later, 0, np.arange(len(p))))
    later &= (s != s[first]) | (d != d[first])
    return seg[p[later]], off[p[later]]


def _packed(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (document, packed start and length) of single starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    # a run of more than _MASK starts is several
    size = start[np.append(first[1:], len(doc)) - 1] - start[first] + 1 if len(first) else np.zeros(0, np.int64)
    parts = -(-size // _MASK)
    of = np.repeat(np.arange(len(first)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    return doc[first[of]], ((start[first[of]] + k * _MASK) << 2 * _BITS) | np.minimum(size[of] - k * _MASK, _MASK)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``doc_id, h, text`` of the texts that hold a string, and whether ``h`` is a hash of the text; ``(doc_id, h)`` is a document and orders it.

    Else every id is of one text, and ``h`` is 0, which saves shuffling it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    long = F.octet_length("text") >= LENGTH
    kinds = rows.where(F.col("id").isNotNull() | long).groupBy("id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    several = not kinds.where("id is null or lo <> hi").isEmpty()
    return rows.where(long).select(F.coalesce("id", F.lit(LOWEST)).alias("doc_id"), (F.xxhash64("text") if several else F.lit(0).cast("long")).alias("h"), "text"), several


def removals(rows: DataFrame) -> DataFrame:
    """``doc_id, h, runs`` of ``keyed`` rows: the starts of all strings that also start earlier, packed in runs, for each document that has any."""
    spark = rows.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["doc_id", "h"]
    found = anchors(rows)
    # stored, so that the join's two sides are plain shuffles, of which Spark can split a hot anchor
    often, often_at = stored(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), 4 * spark.sparkContext.defaultParallelism)
    met, met_at = stored(found.join(often, "anchor"))
    discard(spark, often_at)
    parts = pieces_of(met)
    firsts = met.groupBy("anchor", "seg").agg(F.min(F.struct(*key, "run")).alias("f"), F.count("*").alias("c"))
    firsts = materialize(firsts.select("anchor", "seg", "f.*", "c"), parts)
    twice = firsts.where("c > 1").select("anchor", "seg", *[F.col(c).alias("_" + c) for c in (*key, "run")])
    later = met.join(twice, ["anchor", "seg"]).where("doc_id <> _doc_id or h <> _h or run <> _run").select(*key, "run")
    kinds = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = firsts.select("anchor", *key, "run").join(kinds, "anchor")
    wanted = several.groupBy(*key).agg(F.collect_list(F.struct("run", "anchor", "kinds")).alias("runs"))  # a document's own runs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, h, text, runs in zip(*(batch.column(c) for c in (*key, "text", "runs")), strict=True):
                data, own = text.as_py().encode(), runs.values
                run = own.field("run").to_numpy()
                ends = (run >> 2 * _BITS) + (run & _MASK) + LENGTH - 1
                pieces = [data[a:b] for a, b in zip((run >> 2 * _BITS).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.field("anchor"), pa.array(np.full(len(run), doc.as_py())), pa.array(np.full(len(run), h.as_py())), own.field("run"), pa.array(pieces, pa.binary()), own.field("kinds")], ["anchor", *key, "run", "bytes", "kinds"])

    pieces, pieces_at = stored(rows.join(wanted, key).mapInArrow(cut, "anchor long, doc_id long, h long, run long, bytes binary, kinds long"))
    discard(spark)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every string of the segments of a frequent anchor, by hash."""
        for batch in batches:
            for anchor, doc, h, run, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", *key, "run", "bytes")), strict=True):
                raw = np.frombuffer(data, np.uint8)
                at = np.arange(len(raw) - LENGTH + 1)
                same = window_hash(prefix_sums(raw), at, at + LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), anchor)), pa.array(same.view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), h)), pa.array((run >> 2 * _BITS) + at)], ["anchor", "same", *key, "start"])

    hot = pieces.where(F.col("kinds") > MANY).select("anchor", *key, "run", "bytes").mapInArrow(strings, "anchor long, same long, doc_id long, h long, start long")
    hot_first = hot.groupBy("anchor", "same").agg(F.min(F.struct(*key, "start")).alias("f"), F.count("*").alias("c")).where("c > 1").select("anchor", "same", *[F.col("f." + c).alias("_" + c) for c in (*key, "start")])
    hot_later = hot.join(hot_first, ["anchor", "same"]).where("doc_id <> _doc_id or h <> _h or start <> _start").select(*key, F.shiftleft(F.col("start"), 2 * _BITS).bitwiseOR(F.lit(1).cast("long")).alias("run"))

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor, so a shard is any run of whole anchors."""
        held: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            anchor, doc, h, run = (np.array([x[k] for x in held], np.int64) for k in range(4))
            some = np.flatnonzero(paired([x[4] for x in held], run >> _BITS & _MASK, anchor))
            ids, of = np.unique(np.stack((doc[some], h[some]), 1), axis=0, return_inverse=True)  # in their order
            of = of.reshape(-1)
            start = run[some] >> 2 * _BITS
            d, r = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(some):
                seg, off = repeated([held[k][4] for k in some], of, start)
                d, r = _packed(of[seg], start[seg] + off)
            return pa.RecordBatch.from_arrays([pa.array(ids[d, 0]), pa.array(ids[d, 1]), pa.array(r)], [*key, "run"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                for x in zip(*(part.column(c).to_pylist() for c in ("anchor", *key, "run", "bytes")), strict=True):
                    if size >= SHARD_BYTES and x[0] != last:
                        yield done()
                        held, size = [], 0
                    held.append(x)
                    size, last = size + len(x[4]), x[0]
        if held:
            yield done()

    shards = pieces.where(F.col("kinds") <= MANY).select("anchor", *key, "run", "bytes").repartition(n_parts, "anchor").sortWithinPartitions("anchor")
    every = later.unionByName(hot_later).unionByName(shards.mapInArrow(sort_shards, "doc_id long, h long, run long"))
    out = materialize(every.groupBy(*key).agg(F.collect_list("run").alias("runs")), parts)
    discard(spark, met_at, pieces_at)
    return out


def _spans(data: bytes, runs: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of ``data``, the bytes removed and the number of maximal removed runs."""
    a = runs >> 2 * _BITS
    delta = np.zeros(len(data) + 1, np.int64)
    b = np.minimum(a + (runs & _MASK) + LENGTH - 1, len(data))
    np.add.at(delta, np.minimum(a, len(data)), 1)
    np.add.at(delta, b, -1)
    gone = np.cumsum(delta[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def with_runs(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with their packed removals, null if none, and the name of that column."""
    rows, several = keyed(docs)
    doc, h, name = (unused("_" + c, docs) for c in ("id", "h", "runs"))
    found = removals(rows).select(F.col("doc_id").alias(doc), F.col("h").alias(h), F.col("runs").alias(name))
    marked = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), h: F.xxhash64("text") if several else F.lit(0).cast("long")})
    return marked.join(found, [doc, h], "left").drop(doc, h), name


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                left, removed, spans = _spans(data, runs.values.to_numpy()) if runs.is_valid else (data, 0, 0)
                out.append((len(data), removed, spans, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    got, runs = with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return got.select("doc_id", "text", runs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut (characters that lose a byte go whole) and ``n_chars`` set anew; a document left without text that had some goes."""
    schema = docs.schema
    got, name = with_runs(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, runs = batch.column("text"), batch.column(name)
            cut = runs.is_valid().to_numpy(zero_copy_only=False) & text.is_valid().to_numpy(zero_copy_only=False)
            left = [_spans(text[k].as_py().encode(), runs[k].values.to_numpy())[0].decode("utf-8", "ignore") for k in np.flatnonzero(cut).tolist()]
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pc.replace_with_mask(text, pa.array(cut), pa.array(left, text.type)))
            if "n_chars" in schema.names:
                sizes = batch.column("n_chars")
                batch = batch.set_column(batch.schema.get_field_index("n_chars"), "n_chars", pc.replace_with_mask(sizes, pa.array(cut), pa.array([len(x) for x in left], pa.int64()).cast(sizes.type)))
            keep = np.ones(batch.num_rows, bool)
            keep[cut] = [x != "" for x in left]
            yield batch.select(schema.names).filter(pa.array(keep))

    return got.mapInArrow(run, schema).coalesce(4 * pieces_of(docs))


def brute(texts: dict) -> dict:
    """The definition, for tests: n_bytes, n_removed, n_spans, kept_sha256 by key; keys order the documents."""
    seen, out = set(), {}
    for doc in sorted(texts):
        data = (texts[doc] or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - LENGTH + 1):
            s = data[i : i + LENGTH]
            if s in seen:
                gone[i : i + LENGTH] = True
            seen.add(s)
        spans = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out
