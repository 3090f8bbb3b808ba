import random
import re

import numpy as np
import pytest

from mailrisk.llm import caps, graph, near_dedup
from mailrisk.llm.common import table
from mailrisk.llm.graph import components

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = W.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def smallest(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    linked = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1:] if x and y
              and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y)]
    return smallest({i for i, _ in sets}, linked)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: rng.choices(vocabulary, k=n)

    def edit(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return w

    rows, base, common = [], say(120), say(20)
    rows += [(i, " ".join(edit(base, rng.randint(0, 5)))) for i in range(90)]  # one group, many pairs near the threshold
    chain = say(100)
    for i in range(100, 112):  # a chain: ends are not similar, links join them
        rows.append((i, " ".join(chain)))
        chain = chain[2:] + say(2)
    rows += [(200 + i, " ".join(common + say(60))) for i in range(60)]  # a shared passage, no duplicates
    rows += [(300 + i, "exact copy of one text") for i in range(30)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "ONE"), (405, "two words"), (406, "Two  Words"), (407, "exact copy of one  TEXT"),
             (408, " ".join(say(40_000))), (None, "exact copy of one text"), (409, "exact copy of one text x"), (403, "one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent,block", [(3, 85, 512), (3, 85, 16), (5, 80, 512)])
def test_components_against_brute_force(spark, texts, k, percent, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, rep int, Text string")
    got = near_dedup.near_duplicates(docs, k, percent).collect()
    assert len(got) == len(texts)
    want = brute(texts, k, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    sizes = {i: len(shingles(t, k)) for i, t in texts}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)


def test_one_of_each_stays(spark, texts):
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, rep int, Text string")
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute(texts, 5, 80)
    assert sorted([r[0] for r in kept.collect()], key=str) == sorted([*{i for i, c in want.items() if i == c}, None], key=str)


def test_test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in near_dedup.op3_near_duplicates(docs).collect()} == want


def test_pigeonhole_finds_every_pair_within_the_distance(spark):
    rng = np.random.default_rng(0)
    m = near_dedup.chunks_for(85)
    k, d = near_dedup.CHUNK * m, 2 * m - 1
    one = rng.integers(0, 1 << 16, (200, k)).astype(np.uint16)
    two = one.copy()
    for i in range(len(two)):
        at = rng.choice(k, d, replace=False)
        two[i, at] = rng.integers(0, 1 << 16, d)
    rows = [(int(i), bytearray(s.tobytes())) for i, s in enumerate(np.concatenate((one, two)))]
    keys = near_dedup.chunk_keys(spark.createDataFrame(rows, "id long, sig binary"), m).collect()
    by = {}
    for r in keys:
        by.setdefault(r.id, set()).add(r.key)
    assert all(by[i] & by[i + 200] for i in range(200))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = smallest({x for a, b in edges if a != b for x in (a, b)}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_take_few_jobs(spark):
    # the driver's memory follows the jobs and tasks of the rounds: a long chain and stars are two rounds' work
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000 + i % 3, 2000 + i) for i in range(300)] + [(None, 5), (5, None)], "a long, b long")
    spark.sparkContext.setJobGroup("few-jobs", "components")
    try:
        got = {r.id: r.component for r in components(edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: 0 for i in range(401)} | {1000 + i: 1000 + i for i in range(3)} | {2000 + i: 1000 + i % 3 for i in range(300)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 24


def test_pieces_keep_what_is_connected(monkeypatch):
    monkeypatch.setattr(graph, "PIECE", 16)
    rng = np.random.default_rng(3)
    for n in (1, 40, 400):
        edges = rng.integers(0, 300, (n, 2))
        out = [(a, b) for batch in graph._contract((p[:, 0], p[:, 1]) for p in np.array_split(edges, 7)) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        assert all(a > b for a, b in out) and len(out) <= n
        ids = {int(x) for x in edges.ravel()}
        assert smallest(ids, out) == smallest(ids, edges.tolist())


def test_repeated_ids_are_one_node(spark):
    rows = [(1, "x y z"), (2, "a b c"), (2, "x y z"), (3, "a b c"), (4, "q r s"), (5, "q r s"), (5, "a b c"), (6, "only one here"), (6, "only two here")]
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows += [(7, f"{a} end of"), (8, f"{a.translate({97: 'b', 98: 'a'})} end of")]  # one shingle each, different in a structured word
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.op3_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 1, False), (6, 6, True), (7, 7, True), (8, 8, True)}


def test_no_documents(spark):
    assert near_dedup.op3_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 24)))]
    for c in range(30):  # groups around a centre, cosines on both sides of the threshold
        centre = rng.standard_normal(24)
        rows += [(1000 + 20 * c + j, (centre + rng.standard_normal(24) * np.linalg.norm(centre) * rng.uniform(0, 0.08)).tolist()) for j in range(12)]
    rows += [(2000 + j, rows[3][1]) for j in range(40)] + [(2100, [2 * x for x in rows[3][1]])]
    rows += [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None, *rows[3][1][1:]]), (3004, []), (3005, [1.0]), (3006, [2.0]),
             (3007, [float("inf")] * 24), (None, rows[3][1]), (5, rows[5][1]), (3008, [1e38] * 24), (3009, [1e-38] * 24)]
    return rows


@pytest.mark.parametrize("block", [1024, 24])
def test_cap_filters_against_brute_force(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", block)
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, label int")
    got = caps.op4_cap_filters(df).collect()
    assert len(got) == len(vectors)
    unit = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            unit[i] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    links = dict.fromkeys([i for i, _ in vectors], 0)
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    assert all(r.n_links <= links[r.vec_id] for r in got)  # none below the threshold
    assert sum(r.n_links for r in got if r.vec_id != 5) >= 0.98 * sum(n for i, n in links.items() if i != 5)
    want = smallest({i for i, _ in vectors if i is not None}, linked)
    wrong = [r for r in got if r.vec_id is not None and r.component_id != want[r.vec_id]]
    assert len(wrong) <= 0.02 * len(got)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_decoding_lists_all_filters():
    code = caps.Code(12, words=6, filters=5)
    rng = np.random.default_rng(1)
    for v in rng.standard_normal((20, 12)):
        v /= np.linalg.norm(v)
        a, b = code._halves(code.turn @ v)
        sums = np.add.outer(a, b).ravel()
        alpha = min(code.alpha, np.sort(sums)[-caps.LEAST])
        assert code.decode(v).tolist() == (np.flatnonzero(sums >= alpha) + (12 << 32)).tolist()


def test_recall_on_the_test_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = df.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in caps.op4_cap_filters(df).collect()}
    assert sum(got.values()) >= 0.98 * links.sum()
    assert all(got[r.vec_id] <= n for r, n in zip(rows, links, strict=True))


def test_one_vector_an_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a), (2, b), (2, a), (2, a), (3, a), (4, b)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in caps.op4_cap_filters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    small = b if np.array(b, "<f4").tobytes() < np.array(a, "<f4").tobytes() else a
    same = [i for i, v in rows if i != 2 and v == small]
    assert got.count((2, 1 if small == b else 2, min(2, *same))) == sum(i == 2 and v == small for i, v in rows)
    assert got.count((2, 0, 2)) >= sum(i == 2 and v != small for i, v in rows)


def test_no_vectors(spark):
    assert caps.op4_cap_filters(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
