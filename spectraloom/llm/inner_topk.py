"""Operator 3: exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors are quantised to integers, floor(64 x), rotated by the right singular vectors of a moment
matrix summed over all rows, and dealt into blocks by descending length. Each query first meets the
longest candidates (a block whose size is fixed), which gives it a floor: a real score that ``k``
candidates reach. By Cauchy-Schwarz no candidate shorter than floor / length of the query can reach it.
So queries are dealt into blocks by that least length, a query is sent only to blocks that hold longer
candidates, and a candidate only to blocks of queries that it can serve. Within a block of queries and
one of candidates the first rotated dimensions are multiplied; the bound of the rest prunes pairs;
survivors are scored exactly, in doubles, 64-bit or unbounded integers as the lengths demand. Floors
only ever come from real scores, so the result is exact.

Vectors of one length give least lengths below it, so nothing is pruned before the shuffle then: every
query block meets every candidate block, as an exact search must where no bound tells them apart.

Defined cases: a vector that is null, or holds a null, NaN or infinity, takes no part, nor does a row
without an id; vectors of other lengths than the longest are padded with zeros; an id that occurs twice
is two candidates, and two queries that find each other; ties go to the smaller ``vec_id``; a score
beyond a long is given as the largest or least long; fewer candidates than k give all of them; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import materialize

#: Rows of a query block and of a candidate block; rows of the first, longest block; borders by length that a plan holds.
QUERY_ROWS, CAND_ROWS, HEAD_ROWS, BORDERS = 1024, 8192, 2048, 255
#: Products of lengths below which sums are exact in doubles, and in 64-bit integers.
IN_DOUBLE, IN_LONG = 2.0**52, 2.0**62
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v array<double>, norm`` of the vectors that take part; the components are integers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())
    # beyond 2^52 a double is an integer already
    whole = lambda c: F.when(F.abs(c) < IN_DOUBLE, F.floor(F.when(F.abs(c) < IN_DOUBLE, c)).cast("double")).otherwise(c)
    rows = rows.select("vec_id", F.transform(F.transform("embedding", lambda c: c.cast("double") * scale), whole).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lens = np.diff(np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]) if len(arr) else np.zeros(0, int)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim))
    out[np.arange(dim) < lens[:, None]] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, from the sum of their moment matrices: one dim x dim matrix a task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            m = m[np.abs(m).max(1, initial=0) < 1e100]  # any rotation gives right results
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(total.ravel())], ["i", "j", "s"])

    got = rows.select("v").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    m = np.zeros((dim, dim))
    m[got["i"], got["j"]] = got["s"]
    return np.linalg.eigh(m)[1][:, ::-1] if len(got) else np.eye(dim)


def exact_scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of the rows of a and b, whose absolute values are at most ``largest``, as 64-bit integers."""
    if largest < IN_DOUBLE:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if largest < IN_LONG:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([max(-LONG, min(LONG, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def _split(m: np.ndarray, rotated: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and lengths of what the leading rotated dimensions leave; infinite where doubles do not hold them."""
    size = np.sqrt(np.einsum("ij,ij->i", m, m))
    rest = np.sqrt(np.maximum(size**2 * (1 + 1e-12) - np.einsum("ij,ij->i", rotated[:, :lead], rotated[:, :lead]), 0))
    return size, np.where(np.isfinite(rest), rest, np.inf)


def best_of(queries: np.ndarray, cands: np.ndarray, c_ids: np.ndarray, floor: np.ndarray, rot: np.ndarray, k: int, q_seq: np.ndarray, c_seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row, score) that hold every query's best k of these candidates with scores of at least ``floor``."""
    with np.errstate(over="ignore", invalid="ignore"):
        order = np.argsort(-np.einsum("ij,ij->i", cands, cands), kind="stable")
        c = cands[order]
        lead = max(1, queries.shape[1] // 3)
        qr, cr = queries @ rot, c @ rot
        (q_len, q_rest), (c_len, c_rest) = _split(queries, qr, lead), _split(c, cr, lead)
        most = float(q_len.max(initial=0) * c_len.max(initial=0))
        slack = 1e-6 * (1 + q_len * c_len.max(initial=0))
        floor = floor.astype(np.float64).copy()
        rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(c), 2048):
            hi = min(len(c), lo + 2048)
            alive = np.flatnonzero(~(q_len * c_len[lo] < floor - slack))  # descending lengths: no longer candidate follows
            if not len(alive):
                break
            bound = qr[alive, :lead] @ cr[lo:hi, :lead].T + q_rest[alive, None] * c_rest[None, lo:hi]
            qi, ci = np.nonzero(~(bound < (floor - slack)[alive, None]) & (q_seq[alive, None] != c_seq[order[lo:hi]][None, :]))
            if not len(qi):
                continue
            qi = alive[qi]
            s = np.concatenate([exact_scores(queries[qi[p : p + 65536]], c[lo + ci[p : p + 65536]], most) for p in range(0, len(qi), 65536)])
            keep = ~(s < floor[qi] - slack[qi])
            rows.append(qi[keep])
            cols.append(order[lo + ci[keep]])
            scores.append(s[keep])
            # cut to the best k of each query and raise its floor
            r, cc, ss = np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)
            o = np.lexsort((c_ids[cc], -ss, r))
            r, cc, ss = r[o], cc[o], ss[o]
            rank = np.arange(len(r)) - np.searchsorted(r, np.arange(len(queries)))[r]
            kth = rank == k - 1
            floor[r[kth]] = np.maximum(floor[r[kth]], ss[kth])
            rows, cols, scores = [r[rank < k]], [cc[rank < k]], [ss[rank < k]]
    return rows[0], cols[0], scores[0]


def _borders(rows: DataFrame, column: str, blocks: int) -> list[float]:
    """At most ``BORDERS`` quantiles that cut ``rows`` into about ``blocks`` ranges."""
    n = min(blocks, BORDERS + 1)
    return sorted(set(rows.stat.approxQuantile(column, [b / n for b in range(1, n)], 0.2 / n))) if n > 1 else []


def _place(column: str, cuts: list[float]) -> F.Column:
    """How many of the borders lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(column))) if cuts else F.lit(0)


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id ``every`` divides, against all other rows."""
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, scale).withColumn("seq", F.monotonically_increasing_id()))
    size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    n, dim = size[0], max(1, size[1] or 0)
    empty = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], empty)
    rot = rotation(rows, dim)
    queries = rows.where(F.col("vec_id") % every == 0)
    n_q = queries.count()
    cuts = _borders(rows, "norm", -(-n // CAND_ROWS))
    head = rows.orderBy(F.desc("norm"), "vec_id", "seq").limit(HEAD_ROWS).collect()  # a fixed number of rows

    def padded(vs: list) -> np.ndarray:
        out = np.zeros((len(vs), dim))
        for r, v in enumerate(vs):
            out[r, : len(v)] = v
        return out

    h, h_ids, h_seq = padded([r["v"] for r in head]), np.array([r["vec_id"] for r in head]), np.array([r["seq"] for r in head])
    shared = spark.sparkContext.broadcast((rot, h, h_ids, h_seq))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot, h, h_ids, h_seq = shared.value
        for batch in batches:
            q, ids, seq = _matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy(), batch.column("seq").to_numpy()
            floor = np.full(len(q), -np.inf)
            r, _, s = best_of(q, h, h_ids, floor, rot, k, seq, h_seq)
            last = np.arange(len(r)) - np.searchsorted(r, np.arange(len(q)))[r] == k - 1 if len(r) else np.zeros(0, bool)
            floor[r[last]] = s[last]
            # no shorter candidate reaches the floor; a millionth less, for the rounding of lengths
            size = np.sqrt(np.einsum("ij,ij->i", q, q))
            least = np.where(np.isfinite(floor) & np.isfinite(size) & (size > 0), (floor - 1) / np.maximum(size, 1), -np.inf)
            least -= 1e-6 * np.abs(np.where(np.isfinite(least), least, 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("seq"), pa.array(floor), pa.array(np.maximum(least, -1.0))], ["vec_id", "v", "seq", "floor", "least"])

    seeded = materialize(queries.select("vec_id", "v", "seq").mapInArrow(seed, "vec_id long, v array<double>, seq long, floor double, least double"))
    needs = _borders(seeded, "least", -(-n_q // QUERY_ROWS))
    # ranges are split again by a hash into parts of the intended size: there are few borders, and ties
    c_parts, q_parts = max(1, -(-n // (CAND_ROWS * (len(cuts) + 1)))), max(1, -(-n_q // (QUERY_ROWS * (len(needs) + 1))))
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    left = seeded.select("vec_id", "v", "seq", "floor", (_place("least", needs) * q_parts + F.pmod(F.xxhash64("seq", F.lit(1)), F.lit(q_parts))).alias("q"), every(_place("least", cuts) * c_parts, F.lit((len(cuts) + 1) * c_parts - 1)).alias("c"))
    # a block of queries begins at the border below it: candidates shorter than that are of no use to it
    right = rows.select("vec_id", "v", "seq", (_place("norm", cuts) * c_parts + F.pmod(F.xxhash64("seq"), F.lit(c_parts))).alias("c"), every(F.lit(0), (_place("norm", needs) + 1) * q_parts - 1).alias("q"))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("q_seq", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        rot = shared.value[0]
        qm, cm = _matrix(q.column("v"), dim), _matrix(c.column("v"), dim)
        q_ids, c_ids, q_seq, c_seq = (t.column(x).to_numpy() for t, x in ((q, "vec_id"), (c, "vec_id"), (q, "seq"), (c, "seq")))
        r, j, s = best_of(qm, cm, c_ids, q.column("floor").to_numpy(), rot, k, q_seq, c_seq)
        return pa.table([q_ids[r], q_seq[r], c_ids[j], s], schema=schema)

    # a cogroup does not bring its keys to one type, and an int and a long of one value hash to different partitions
    left, right = (side.withColumns({x: F.col(x).cast("long") for x in ("q", "c")}) for side in (left, right))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(meet, "query_id long, q_seq long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_seq").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute(vectors: pd.DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> pd.DataFrame:
    """The definition, for tests: ``vectors`` has vec_id and embedding, all of them usable."""
    m = np.array([[int(np.floor(float(x) * scale)) for x in v] for v in vectors["embedding"]], object)
    ids, out = vectors["vec_id"].to_numpy(), []
    for q in np.flatnonzero(ids % every == 0):
        s = m @ m[q]
        others = np.delete(np.arange(len(ids)), q)
        o = sorted(others.tolist(), key=lambda j: (-max(-LONG, min(LONG, s[j])), ids[j]))[:k]
        out += [(ids[q], r + 1, ids[j], max(-LONG, min(LONG, s[j]))) for r, j in enumerate(o)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
