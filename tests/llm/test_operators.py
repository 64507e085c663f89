"""Every corpus operator on its odd cases, and against SQL, brute force, a round trip or held-out accuracy."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import edit_print, inner_topk, language_id, near_dedup, pieces, quality_pu, queries, source_mix, suffix_dedup, toxicity, url_filter

WORDS = ["pier", "boat", "grain", "ledger", "harbour", "noon", "rope", "wind", "tide", "gull", "stone", "lamp", "crane", "net", "sail"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, component long, n long, _p double"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, exact and near copies, ties and repeated rows."""
    base = prose(1, 200)
    near = base.replace(" ", " x ", 3)
    rows = [(1, base), (2, near), (3, base), (3, base), (4, ""), (5, None), (None, "a null id"), (6, "one"), (7, "ONE"), (8, prose(8, 30_000)), (9, " \n\t "), (10, "größe 日本語 😀 ▁ end"), (11, prose(11, 60) + " " + base[300:900]), (12, "x" * 400), (13, "12 34 !!")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "web", None if k % 5 == 0 else len(t or ""), 0.5, 7, 1, 0.1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def sf1(spark):
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


def labels_of(spark, column, other):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (99, 0, 0)], f"doc_id long, {column} int, {other} int")


def test_quality(spark, odd, none, sf1):
    marks = labels_of(spark, "quality", "toxic")
    assert quality_pu.classify(odd, marks).count() == 15 and quality_pu.classify(none, marks).count() == 0
    assert {r.score for r in quality_pu.classify(odd, marks.limit(0)).collect()} == {0.5}
    got = queries.QUERIES["op1_quality"](spark, sf1).join(spark.read.parquet(f"{sf1}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all() and auc(got["score"], got["quality"]) > 0.9
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    y = np.asarray(label) == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_prior():
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(2, 1, 2000), np.concatenate((rng.normal(2, 1, 600), rng.normal(-2, 1, 1400)))
    assert 0.25 < quality_pu.estimate_prior(pos, unl) < 0.42


def near_brute(rows, k, percent):
    sets = {i: near_dedup.exact_set(t, k) for i, t in rows if i is not None}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(odd, none, k):
    got = near_dedup.groups(odd, k).collect()
    want = near_brute([(r[0], r[1]) for r in odd_rows()], k, 80)
    assert len(got) == 15 and near_dedup.groups(none, k).count() == 0
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_slices_of_few_words():
    """A slice of one short document, whose words are fewer than a shingle's."""
    for n in range(7):
        raw = np.frombuffer(" ".join(WORDS[:n]).encode(), np.uint8)
        sets = near_dedup.shingle_sets(raw, np.array([0, len(raw)]), 5)
        assert [len(s) for s in sets] == [min(n, 1) if n < 5 else n - 4]
        # the same set as beside a longer document
        both = np.frombuffer((" ".join(WORDS[:n]) + " ".join(WORDS)).encode(), np.uint8)
        assert (near_dedup.shingle_sets(both, np.array([0, len(raw), len(both)]), 5)[0] == sets[0]).all()


def test_near_chains(spark):
    """A hub group whose members are linked along chains, and many that only share a passage."""
    rng = random.Random(3)
    base = prose(5, 60).split()
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join([*base[:40], *prose(100 + k, 20).split()])) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == near_brute(rows, 2, 80)


def test_blocks_find_the_links(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**32, 50, dtype=np.uint32)) for _ in range(6)]
    sets += [np.unique(np.concatenate((sets[0][:48], rng.integers(0, 2**32, 2, dtype=np.uint32)))), sets[1].copy()]
    n = np.array([len(s) for s in sets])
    every, want = np.arange(8), {frozenset((0, 6)), frozenset((1, 7))}
    pairs = lambda left, right, sigs: {frozenset(p) for p in near_dedup.linked_pairs(n, every, sigs, left, right, 80)}
    assert pairs(every, every, sets) == pairs(every[:4], every[4:], sets) == want
    # one hash short of the threshold, as a collision would leave it: goes on to be confirmed
    short = [*sets[:6], np.unique(np.concatenate((sets[0][:44], rng.integers(0, 2**32, 6, dtype=np.uint32)))), sets[1].copy()]
    assert frozenset((0, 6)) in pairs(every, every, short)
    monkeypatch.setattr(near_dedup, "SIG", 30)  # sets larger than their signature
    assert want <= pairs(every, every, [s[:30] for s in sets])


def test_near_buckets_of_many_blocks(spark, monkeypatch):
    """A hot bucket in many blocks, and an id with two texts."""
    monkeypatch.setattr(near_dedup, "LEFT", 3)
    monkeypatch.setattr(near_dedup, "RIGHT", 5)
    monkeypatch.setattr(near_dedup, "HUB", 4)
    rng = random.Random(9)
    base = prose(31, 80).split()
    rows = []
    for k in range(50):
        w = list(base)
        for _ in range(rng.choice((1, 6, 12))):
            w[rng.randrange(len(w))] = f"other{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == near_brute(rows, 2, 80)
    two = [(5, prose(1, 50)), (9, prose(1, 50)), (9, prose(2, 50)), (3, prose(2, 50)), (7, prose(3, 50))]
    got = {(r.doc_id, r.component_id) for r in near_dedup.groups(spark.createDataFrame(two, "doc_id long, text string"), 2).collect()}
    assert got == {(5, 3), (9, 3), (3, 3), (7, 7)}


def test_sketches_merge():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (300, 200))
    ra, rb, both = near_dedup.sketches([a, b, np.union1d(a, b)])
    # the union's registers, but where a cut-off left a register open on one side
    assert (near_dedup.merge(ra, rb) == both).mean() > 0.99


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 0.3, 8).round(2).tolist()) for k in range(150)]
    rows[30] = (30, rows[31][1])
    bad = [(200, None), (220, [None] * 8), (240, [float("nan")] * 8), (None, rows[0][1]), (260, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = inner_topk.search(df).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    f32 = pd.DataFrame([(k, np.float32(v)) for k, v in rows], columns=["vec_id", "embedding"])
    pd.testing.assert_frame_equal(got, inner_topk.brute(f32), check_dtype=False)
    assert inner_topk.search(df.limit(0)).count() == 0
    assert inner_topk.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).count() == 2


def test_topk_of_any_size(spark, monkeypatch):
    """Components of any finite size, exact beyond doubles and beyond longs, in many blocks; ties in length."""
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(0, 1, 4) * 10.0 ** rng.choice((0, 0, 3, 5, 6, 8))).tolist()) for k in range(160)]
    rows[20] = (20, [3e5, 0.0, 0.0, 0.0])
    rows[1] = (1, [4e5, 1.0, 0.0, 0.0])
    rows[40] = (40, [1e30, -1e30, 2.0, 0.0])
    rows[60] = rows[61] = (60, [0.0] * 4)
    monkeypatch.setattr(inner_topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(inner_topk, "CAND_ROWS", 16)
    monkeypatch.setattr(inner_topk, "HEAD_ROWS", 30)
    got = inner_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding"])
    want = inner_topk.brute(frame)
    order = ["query_id", "rank", "score", "vec_id"]
    got, want = (x[["query_id", "rank", "vec_id", "score"]].astype("int64").sort_values(order).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want)


def test_topk_in_many_partitions(spark, monkeypatch):
    """Blocks of queries and of candidates meet where the partitions of a shuffle are not merged into one, as on larger tables."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(0, 1, 4).tolist()) for k in range(120)]
    monkeypatch.setattr(inner_topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(inner_topk, "CAND_ROWS", 16)
    monkeypatch.setattr(inner_topk, "HEAD_ROWS", 30)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = inner_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = inner_topk.brute(pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    order = ["query_id", "rank"]
    got, want = (x[["query_id", "rank", "vec_id", "score"]].astype("int64").sort_values(order).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want)


def test_toxicity(spark, odd, none, sf1):
    marks = labels_of(spark, "toxic", "quality")
    assert toxicity.classify(odd, marks).count() == 15 and toxicity.classify(none, marks).count() == 0
    got = queries.QUERIES["op4_toxicity"](spark, sf1).join(spark.read.parquet(f"{sf1}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all() and auc(got["score"], got["toxic"]) > 0.85


def maximal_brute(xs, lo=0):
    """The recursive definition: the best segment (the shortest of equals), then those left and right of it."""
    best = max(((sum(xs[a:b]), -(b - a), -a) for a in range(len(xs)) for b in range(a + 1, len(xs) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*maximal_brute(xs[:a], lo), (lo + a, lo + b - 1, best[0]), *maximal_brute(xs[b:], lo + b)]


def test_segments_are_maximal():
    rng = random.Random(0)
    for _ in range(300):
        xs = [rng.choice([-2.0, -1.0, -0.5, 1.0, 3.0]) + rng.randrange(100) / 4096 for _ in range(rng.randrange(0, 14))]
        assert [(a, b, round(s, 9)) for a, b, s in toxicity.maximal_segments(np.array(xs))] == [(a, b, round(s, 9)) for a, b, s in maximal_brute(xs)]


def test_toxic_passages(spark):
    """Every planted passage is found, and nothing of clean texts."""
    rng = random.Random(4)
    bad = ["vile", "scorn", "filth", "wretch"]
    rows, marks, where = [], [], {}
    for k in range(300):
        w = [rng.choice(WORDS) for _ in range(80)]
        if k % 3 == 0:
            for at in (20, 60)[: 1 + k % 2]:
                w[at : at + 4] = rng.sample(bad, 4)
                where.setdefault(k, []).append(at)
        rows.append((k, " ".join(w)))
        marks.append((k, int(k % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lex = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {}
    for r in toxicity.passages(docs, lex, 0.01).collect():
        text = rows[r.doc_id][1]
        got.setdefault(r.doc_id, set()).update(range(len(text[: r.start].split()), len(text[: r.end].split())))
    # near passages may be one maximal segment with what is between
    assert set(got) == set(where) and all(set(range(at, at + 4)) <= got[k] for k, ats in where.items() for at in ats)
    assert toxicity.segments("Vile filth", lex)[0][0][:2] == (0, 10) and toxicity.segments(None, lex) == ([], 0)


def test_edit_print(spark, odd, none):
    got = edit_print.compare(odd).collect()
    rows = sorted(((-(1 << 63) if r[0] is None else r[0], r[1] or "") for r in odd_rows()))
    want = sorted((len(t), hashlib.sha256(edit_print.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (_, t) in enumerate(rows))
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == want and edit_print.compare(none).count() == 0
    prints = {}
    for r in got:
        if r.doc_id in (1, 3):
            prints[r.doc_id] = r.fingerprint
    assert prints[1] == prints[3]
    one = edit_print.compare(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_edit_print_of_other_lengths(spark):
    """The first half is kept whatever the next document's length, so half of the samples agree."""
    rng = random.Random(7)
    random_text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for k, n in enumerate((0, 1, 60, 300, 700, 1000, 2000, 5000)):  # of the document after one of 2,000 characters
        rows += [(2 * k, random_text(2000)), (2 * k + 1, random_text(n))]
    got = {r.doc_id: r for r in edit_print.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [got[2 * k].near_edited for k in range(8)]
    assert all(0.42 < x < 0.64 for x in near) and max(near) - min(near) < 0.15, near
    a, b = random_text(5462), random_text(300)
    prints = edit_print.fingerprints([edit_print.codes_of(t) for t in (a, a[:-1], a[:2731], b, "")])
    alike = lambda i, j: edit_print.likeness(prints[i : i + 1], prints[j : j + 1])[0]
    assert alike(0, 1) > 0.97 and 0.42 < alike(0, 2) < 0.6 and alike(0, 3) < 0.15 and alike(0, 4) == 0 and alike(4, 4) == 1


def test_edit_print_of_many_short_texts():
    """However short or empty texts are, few of them are held at once."""
    import tracemalloc

    import pyarrow as pa

    n = 20_000
    texts = ["" if k % 3 == 0 else f"t{k}" for k in range(n)]
    batch = pa.RecordBatch.from_pydict({"part": pa.array([0] * n, pa.int32()), "guest": [False] * (n - 1) + [True], "doc_id": list(range(n)), "text": texts})
    tracemalloc.start()
    sizes = [b.num_rows for b in edit_print._stream(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == n - 1 and peak < 20e6


def test_edit_copies(spark):
    """Equal texts always meet, and so do nearly all of one edit."""
    rows = [(5, None)]
    for k in range(20):
        t = prose(100 + k, 80)
        rows += [(100 + k, t), (200 + k, t), (300 + k, t[:200] + t[201:])]
    got = {r.doc_id: r.component_id for r in edit_print.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5] == 5 and all(got[200 + k] == got[100 + k] == 100 + k for k in range(20))
    near = [got[300 + k] for k in range(20)]
    assert sum(c == 100 + k for k, c in enumerate(near)) >= 19 and all(c in (100 + k, 300 + k) for k, c in enumerate(near))
    assert edit_print.within_edits("kitten", "sitting", 3) == 3 and edit_print.within_edits("kitten", "sitting", 2) is None


def test_edit_copies_recall(spark):
    """Up to the most edits that count as near, at least nine of ten texts of each length meet their original."""
    rng, rows = random.Random(19), []
    letters = "abcdefghijklmnopqrstuvwxyz "
    sorts = [(n, edits) for n in (250, 553, 2000) for edits in (1, 4, 12, 16)]
    for s, (n, edits) in enumerate(sorts):
        for k in range(30):
            t = [rng.choice(letters) for _ in range(n)]
            rows.append((1000 * s + 2 * k, "".join(t)))
            for _ in range(edits):
                at, kind = rng.randrange(len(t)), rng.randrange(3)
                t[at : at + (kind != 1)] = [rng.choice(letters)] if kind < 2 else []
            rows.append((1000 * s + 2 * k + 1, "".join(t)))
    got = {r.doc_id: r.component_id for r in edit_print.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    for s, sort in enumerate(sorts):
        assert sum(got[1000 * s + 2 * k + 1] == 1000 * s + 2 * k for k in range(30)) >= 27, sort


def test_fingerprints_step_by_step():
    """Every sampled digit, by a walk of one character at a time, on two walks; and orders that do not hang on the length."""
    rng = random.Random(3)
    texts = ["", "a", "Äβ\U0001f600 x", *("".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (40, 1023, 1025, 3000))]
    codes = [edit_print.codes_of(t) for t in texts]
    for number in (0, 3):
        move = edit_print.moves(number)
        want = []
        for c in codes:
            trail = []
            for lo in range(0, len(c), edit_print.BLOCK):
                block, at = c[lo : lo + edit_print.BLOCK].tolist(), 0
                for j in range(edit_print.STEPS):
                    trail.append(block[at] if at < len(block) else 0)
                    at += int(move[j][trail[-1]])
            first = []
            for order in edit_print.places_of(3 * len(c)) if len(c) else [[]] * edit_print.SAMPLES:
                first.append(next((int(edit_print._DIGIT[trail[p]]) for p in order if p >= 0 and trail[p]), 0))
            want.append(first)
        assert edit_print.fingerprints(codes, number).tolist() == want
        a, b = want[4], want[5]
        used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        assert edit_print.likeness(np.array([a]), np.array([b]))[0] == sum(x == y for x, y in used) / len(used)
    for n, m in ((5, 9), (100, 3000), (3000, 10**9)):
        for few, many in zip(edit_print.places_of(n).tolist(), edit_print.places_of(m).tolist(), strict=True):
            inside = [p for p in many if 0 <= p < n]
            assert few[: len(inside)] == inside and all(p < n for p in few)


def test_edit_copies_beside_a_smaller_id(spark, monkeypatch):
    """Texts one edit apart meet although the smallest id of their buckets is too far from both, and at lengths on both sides of a power of two."""
    rng = random.Random(11)
    rows = []
    for k in range(8):
        b = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(8000))
        a = list(b)
        for p in rng.sample(range(8000), 20):
            a[p] = "#"
        rows += [(10 * k, "".join(a)), (10 * k + 1, b), (10 * k + 2, b[:4000] + "#" + b[4001:]), (10 * k + 3, b[:5462] + "+"), (10 * k + 4, b[:5462])]
    for members in (512, 2):
        monkeypatch.setattr(edit_print, "MEMBERS", members, raising=False)
        got = {r.doc_id: r.component_id for r in edit_print.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [got[i] for i, _ in rows] == [i // 10 * 10 + (0, 1, 1, 3, 3)[i % 10] for i, _ in rows]
    pairs = edit_print.forest(["abcd", "abxd", "zzzzzz", "abxx"], [0, 1, 2, 3], [0, 0, 0, 0], 1)
    assert {frozenset(p) for p in pairs} == {frozenset((0, 1)), frozenset((1, 3))}


def test_suffix_array(monkeypatch):
    """Random strings over alphabets of all sizes, by buckets and by suffixes, down to the third recursion and further."""
    rng = np.random.default_rng(3)
    for small in (suffix_dedup.SMALL_ALPHABET, 0):
        monkeypatch.setattr(suffix_dedup, "SMALL_ALPHABET", small)
        for n, sigma in ((0, 2), (1, 2), (30, 1), (200, 2), (500, 4), (400, 200), (900, 5000)):
            s = rng.integers(0, sigma, n)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    calls = []
    plain = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda s: calls.append(len(s)) or plain(s))
    text = np.frombuffer((prose(1, 4000) * 3).encode(), np.uint8)
    sa = suffix_dedup.suffix_array(text)
    assert len(calls) > 2 and sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())


def rows_brute(rows):
    """The definition for rows: equal ids with other texts are further documents, ordered by the text's hash."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    return suffix_dedup.brute({(-(1 << 63) if i is None else i, hashes[t], t or ""): t for i, t in rows})


def rows_digest(docs):
    return sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(docs).collect())


def test_suffix_dedup(spark, odd, none):
    for rows in (
        [(r[0], r[1]) for r in odd_rows()],
        # one id with two texts, one of them short; null ids with texts of their own and one in common
        [(1, prose(1, 60)), (2, prose(1, 60)), (2, prose(2, 60)), (2, "short"), (2, None), (3, prose(2, 60)), (None, prose(3, 50)), (None, prose(4, 50)), (None, prose(3, 50)), (4, prose(4, 50) + prose(3, 50))],
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        want = rows_brute(rows)
        hashes = {k[2]: k for k in want}
        expect = sorted((-(1 << 63) if i is None else i, *next(v for k, v in want.items() if k[0] == (-(1 << 63) if i is None else i) and k[2] == (t or ""))) for i, t in rows)
        assert hashes and rows_digest(docs) == expect
    assert suffix_dedup.digest(none).count() == 0 and suffix_dedup.digest(odd).count() == 15


def test_strip_repeats_keeps_columns(spark, none):
    rows = [(k, prose(1, 40) + prose(50 + k, 20), 7, 8, 9, "kept", None) for k in range(6)] + [(9, None, 1, 1, 1, "null", 0), (10, prose(1, 40), 1, 1, 1, "gone", 3), (11, "", 1, 1, 1, "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _runs int, _h int, __id string, n_chars int")
    got = {r.doc_id: r for r in suffix_dedup.strip_repeats(docs).collect()}
    want = suffix_dedup.brute({r[0]: r[1] for r in rows})
    assert suffix_dedup.strip_repeats(docs).columns == docs.columns and set(got) == {*range(6), 9, 11}
    assert all(len(got[k].text.encode()) == want[k][0] - want[k][1] and got[k]["_runs"] == 8 and got[k]["__id"] == "kept" for k in range(6))
    assert got[9].text is None and got[9].n_chars == 0 and got[0].n_chars is None and got[3].n_chars == len(got[3].text) and suffix_dedup.strip_repeats(none).count() == 0


def test_suffix_dedup_hot(spark, monkeypatch):
    """A passage in most texts, with different surroundings, by shards and by strings."""
    hot = prose(20, 40)
    rows = {k: prose(k, 10) + hot[k % 7 :] + prose(k + 50, 10) * (1 + k % 2) for k in range(40)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = suffix_dedup.brute(rows)
    for many in (suffix_dedup.MANY, 1):
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(docs).collect()} == want


def test_language(spark, odd, none, sf1):
    got = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 9, 13)) and language_id.identify(none).count() == 0
    docs = spark.read.parquet(f"{sf1}/documents.parquet")
    rows = queries.QUERIES["op7_language"](spark, sf1).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert rows.where("lang = lang_pred").count() / rows.count() > 0.95


def test_language_learns_short_texts_and_every_language(spark):
    short = [(k, ("the cat and the dog " if k % 2 else "æøå ßü æøå ßü ")[: 12 + k % 7], ("en", "da")[k % 2 == 0]) for k in range(120)]
    docs = spark.createDataFrame(short, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert sum(got[k] == lang for k, _, lang in short) > 110
    many = spark.createDataFrame([(k, f"text of language {k % 70} " * 4, f"l{k % 70:02}") for k in range(700)], "doc_id long, text string, lang string")
    assert len(language_id.fit(many).langs) == 70


def test_gradients():
    rng = np.random.default_rng(0)
    draw = lambda *s: rng.normal(0, 0.3, s)
    h = language_id.HIDDEN
    layer = language_id.Layer(draw(3 * h, 256), draw(2 * h, h), draw(h, h))
    layer.table[: 2 * h] += 0.4
    xs = rng.integers(0, 256, (5, 3))
    pull = rng.normal(size=(5, h, 3)).astype(np.float32)
    grads = layer.grads(xs, layer.run(xs), pull)
    for got, w in zip(grads, (layer.table, layer.gates, layer.cand), strict=True):
        at = np.unravel_index(np.abs(got).argmax(), got.shape)
        old, loss = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = old + step
            loss.append(float((layer.run(xs).astype(np.float64) * pull).sum()))
        w[at] = old
        assert got[at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.05)


def test_urls(spark):
    schema = "page_id long, url string, html string, host int, verdict int"
    rows = [(1, "http://A.example.com/en/x?q", None), (2, "https://www.example.com/en/y", ""), (3, "http://x.net/es/1", '<link rel="canonical" href="/home">'), (4, "http://x.net/home#top", None), (5, None, None), (6, "no scheme", None), (7, "http://other.org/", '<meta http-equiv="refresh" content="0; url=http://x.net/fr/2">'), (7, "http://other.org/", None), (8, "http://quiet.org/", '<link rel=canonical href="http://b.com/">'), (None, "http://b.com", None), (9, "http://notcom/", None)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()]
    want = [(1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/y", "www.example.com/en/", "allow"), (3, "x.net", "/es/1", "net/es/", "block"), (4, "x.net", "/home", None, "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "other.org", "/", None, "block"), (7, "other.org", "/", None, "block"), (8, "quiet.org", "/", None, "allow"), (None, "b.com", "", None, "allow"), (9, "notcom", "/", None, "allow")]
    assert sorted(got, key=str) == sorted(want, key=str) and url_filter.judge(pages.limit(0)).count() == 0
    moved = spark.createDataFrame([("http://quiet.org/", "http://x.net/fr/9"), ("http://notcom/", "http://x.net/fr/9")], "url string, target string")
    now = {r.page_id: r.verdict for r in url_filter.judge(pages, moved).collect()}
    assert now[9] == "allow" and now[8] == "allow"  # an allowed URL is among the aliases
    moved = moved.where("url like '%notcom%'")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, moved).collect()}[9] == "block"


def test_urls_relative(spark):
    """Targets are resolved as the standard library does, and verdicts equal a union-find over the edges."""
    from urllib.parse import urljoin, urlsplit

    targets = ["home", "../b", "./c", "?q=1", "/x/../y", "//other.net/fr/1", "http://B.org/z#f", "a/b/../../d?e=/../f", "..", ".", "../../../up", "#top", "p?x=1&amp;y=2", "https://sub.x.net", "g;h=1/./i"]
    bases = ["http://a.org/one/two/page.html?k=v", "http://a.org", "https://a.org/dir/"]
    rows = spark.createDataFrame([(b, t) for b in bases for t in targets], "url string, target string")
    for r in rows.select("url", "target", url_filter.resolved(F.col("url"), F.col("target")).alias("full")).collect():
        want = None if r.target == "#top" else urljoin(r.url, r.target.replace("&amp;", "&")).split("#")[0]
        path = lambda u: u if u is None or urlsplit(u).path else u + "/"
        assert path(r.full) == path(want), r
    rng = random.Random(2)
    urls = [f"http://h{k}.{('com', 'org', 'net')[k % 3]}/{('es', 'xx', 'fr', 'deep/er')[k % 4]}/{k}" for k in range(60)]
    pages, low = [], {u: u for u in urls}
    for k, u in enumerate(urls):
        v = rng.choice(urls)
        html = (f'<link rel="canonical" href="{v}">', f'<META HTTP-EQUIV=refresh content="3; URL={v}">', "<p>none</p>")[k % 3]
        pages.append((k, u, html))
        if k % 3 < 2:
            a, b = low[u], low[v]
            low = {x: a if y == b else y for x, y in low.items()}
    moved = [(urls[5], "../es/../xx/1"), (urls[8], urls[9])]
    for u, t in moved:
        a, b = low[u], low.get(urljoin(u, t), urljoin(u, t))
        low = {x: a if y == b else y for x, y in low.items()}
    kind = lambda u: "allow" if ".com/" in u else "block" if ".net/es/" in u or ".net/fr/" in u else None
    held = {}
    for u, root in low.items():
        held.setdefault(root, set()).add(kind(u))
    want = {k: kind(u) or ("block" if "block" in held[low[u]] and "allow" not in held[low[u]] else "allow") for k, u in enumerate(urls)}
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(moved, "url string, target string"))
    assert {r.page_id: r.verdict for r in got.collect()} == want and "block" in want.values()


def test_mix(spark, odd, none):
    rows = source_mix.weigh(odd).collect()
    assert len(rows) == 15 and all(0 <= r.p <= 1 for r in rows) and source_mix.weigh(none).count() == 0
    assert all(r.kept for r in rows if r.p == 1)
    cells = spark.createDataFrame([("a", "en", "t", 60.0), ("a", "de", "t", 20.0), ("b", "en", "t", 10.0), ("b", "de", "t", 10.0)], "source string, lang string, topic string, w double")
    share = lambda **x: spark.createDataFrame(list(x.items()), "category string, share double")
    x, gap = source_mix.rake(source_mix.with_targets(cells, {"source": share(a=0.5, b=0.5), "lang": share(en=0.4, de=0.6), "topic": share(t=1.0)}))
    x = x.toPandas()
    assert gap < 1e-9 and x.groupby("source")["x"].sum().round(6).tolist() == [0.5, 0.5] and x.groupby("lang")["x"].sum().round(6).to_dict() == {"de": 0.6, "en": 0.4}


def test_mix_targets(spark):
    """Shares of 0, categories without a target, margins that cannot be met, and columns named like working ones."""
    rows = [(k, "some words of a text" if k % 10 else "", "abc"[k % 3], "en" if k % 2 else "de", 1, 2, "kept") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _tokens int, _p int, __keep string")
    share = lambda **x: spark.createDataFrame(list(x.items()), "category string, share double")
    got = source_mix.weigh(docs, {"source": share(a=1.0, b=0.0, z=3.0), "lang": share(en=0.5, de=0.5)}).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert {r.p > 0 for r in got if r.source != "a"} == {False} and all(r.p > 0 for r in got if r.source == "a") and all(r.met for r in got)
    kept = source_mix.mix(docs, {"source": share(a=1.0)})
    assert kept.columns == docs.columns and {(r.source, r["_p"], r["_tokens"], r["__keep"]) for r in kept.collect()} == {("a", 2, 1, "kept")}
    lone = spark.createDataFrame([(1, "a word", "a", "en"), (2, "a word", "b", "de")], "doc_id long, text string, source string, lang string")
    with pytest.warns(UserWarning, match="margins"):
        source_mix.mix(lone, {"source": share(a=0.5, b=0.5), "lang": share(en=0.9, de=0.1)})


def test_mix_rakes_in_short_plans(spark, monkeypatch):
    """Arrays of one row and joined sums give the fit of plain NumPy; no plan grows with the rounds."""
    rng = np.random.default_rng(3)
    w = np.where(rng.random((5, 3, 4)) < 0.8, rng.integers(1, 1000, (5, 3, 4)), 0).astype(float)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", float(w[i, j, k])) for i, j, k in np.ndindex(w.shape)], "source string, lang string, topic string, w double")
    aims = [(t := w.sum(tuple(a for a in range(3) if a != d)) ** 0.8) / t.sum() for d in range(3)]
    want = w / w.sum()
    for _ in range(40):
        for d in range(3):
            want *= (aims[d] / want.sum(tuple(a for a in range(3) if a != d))).reshape([-1 if a == d else 1 for a in range(3)])
    windows = []

    def cut(df, parts=None, real=source_mix.materialize):
        windows.append(df._jdf.queryExecution().optimizedPlan().toString().count("Window ["))
        return real(df, parts)

    aimed = source_mix.with_targets(cells).localCheckpoint()
    monkeypatch.setattr(source_mix, "materialize", cut)
    for few in (source_mix.FEW, 10):
        monkeypatch.setattr(source_mix, "FEW", few)
        out, gap = source_mix.rake(aimed)
        got = {(r.source, r.lang, r.topic): r.x for r in out.collect()}
        assert gap < 1e-9 and len(got) == (w > 0).sum() and all(abs(x - want[int(s[1]), int(la[1]), int(t[1])]) < 1e-9 for (s, la, t), x in got.items())
    assert 0 < max(windows) <= 4


def test_pieces(spark, odd, none):
    rows = pieces.encode(odd).collect()
    assert len(rows) == 15 and all(r.exact for r in rows) and pieces.encode(none).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(odd)).collect()}
    assert back == {r[0]: r[1] or "" for r in odd_rows()}


def test_pieces_window():
    from pathlib import Path

    p = pieces.load(Path(pieces.MODEL).read_bytes())
    for text in (" " + prose(1, 300), " " + "ab" * 900, " größe 日本語 😀" * 20, " " * 300):
        streamed = [k for run in p.viterbi(text) for k in run]
        assert streamed == p.short(text) and p.decode_bytes(streamed) == text[1:].encode()
        if p.split is not None:
            assert np.frombuffer(p.encode_bytes(text[1:]), np.int32).tolist() == streamed


def test_pieces_are_the_best_path():
    """Against a plain search over all cuttings, with the pieces read anew from the file."""
    from functools import cache
    from math import log
    from pathlib import Path

    from sentencepiece import SentencePieceProcessor

    raw = Path(pieces.MODEL).read_bytes()
    lib, own = SentencePieceProcessor(model_proto=raw), pieces.load(raw)
    vocab = {lib.id_to_piece(k).replace("▁", " "): k for k in range(lib.vocab_size()) if not (lib.is_byte(k) or lib.is_control(k) or lib.is_unknown(k))}
    weight = lambda k: -log(pieces.SHIFT - lib.get_score(k))
    worst = min(map(weight, vocab.values())) - 10

    def best(text):
        @cache
        def tail(i):
            if i == len(text):
                return 0.0, ()
            out = [(worst + tail(i + 1)[0], tuple(lib.piece_to_id(f"<0x{b:02X}>") for b in text[i].encode()) + tail(i + 1)[1])] if text[i] not in vocab else []
            return max(out + [(weight(vocab[text[i:j]]) + tail(j)[0], (vocab[text[i:j]], *tail(j)[1])) for j in range(i + 1, len(text) + 1) if text[i:j] in vocab], key=lambda x: x[0])

        return tail(0)

    score = lambda ids: sum(worst / 4 if lib.is_byte(k) else weight(k) for k in ids)
    for text in (prose(3, 6), "unbelievable größe", "über  die   Straße", "日本語 x 😀 y", "a" * 40, "Ünd, wie-geht's (so)?", "12,345.678 km/h"):
        total, ids = best(" " + text)
        got = own.encode(text)
        assert got == list(ids) or score(got) == pytest.approx(score(ids)), text
        assert own.decode(got) == text and total < 0


def test_components(spark):
    from spectraloom.llm.common import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 51), (51, 50), (52, 52)], "src long, dst long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 50: 50, 51: 50}


def test_pipeline_stages(spark, sf):
    """Each stage against a plain version on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "suffix_dedup", "source_mix", "pieces"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        kept, before = [r.asDict() for r in out.collect()], [r.asDict() for r in now.collect()]
        if name == "near_dedup":
            low = near_brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert {r["doc_id"] for r in kept} == {i for i, (_, root) in low.items() if i == root}
        elif name == "suffix_dedup":
            want = suffix_dedup.brute({r["doc_id"]: r["text"] for r in before})
            size = {r["doc_id"]: len(r["text"].encode()) for r in kept}
            assert all(w[0] - w[1] - 6 <= size.get(i, 0) <= w[0] - w[1] for i, w in want.items())
            assert all(r["n_chars"] == len(r["text"]) for r in kept)
        elif name == "source_mix":
            assert {r["doc_id"] for r in kept} == {r.doc_id for r in source_mix.weigh(now).where("kept").collect()}
        elif name == "pieces":
            assert len(kept) == len(before) and all(r["exact"] for r in kept)
        else:
            assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in before} and len(kept) > len(before) / 2
        if name != "pieces":
            assert out.columns == docs.columns
            now = spark.createDataFrame([tuple(r.values()) for r in kept], docs.schema)
