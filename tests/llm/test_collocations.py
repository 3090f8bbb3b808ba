import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailrisk.llm import collocations as m

SCHEMA = "lang string, text string, doc_id long, phrase string"


def plain(rows, support, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text, *_ in rows:
        lang, text = lang or "und", (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if a >= support and len(p) > 1}
        hidden = set()
        for q, b in cands.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    p = q[i:i + k]
                    if 100 * b >= 100 * cands[p]:
                        hidden.add(p)
        rows = []
        for p, a in cands.items():
            if p not in hidden:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(seed, docs=200):
    r = random.Random(seed)
    words = ["New", "york", "new", "the", "of", "Ünion", "x\x00y", "a", "b", " ", "z" * 40]
    phrases = ["new york the", "a b a b a", "of the Ünion", "the"]
    rows = []
    for i in range(docs):
        said = "".join(r.choice([r.choice(words), r.choice(phrases)]) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "?"])
                       for _ in range(r.randrange(0, 40)))
        rows.append((r.choice(["en", "en", "en", None, "und", "fr"]), r.choice([said, said, said, None, ""]), i, "p"))
    return rows + rows[:9]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("support", "size", "bits"), [(12, 1 << 20, 1 << 20), (12, 300, 1 << 20), (3, 40, 1 << 10), (1, 2000, 1 << 20), (40, 1000, 64)])
def test_brute_force(spark, support, size, bits):
    """One shard or hundreds (local support 1), a roomy filter or one that holds every phrase."""
    rows = made(support)
    want = plain(rows, support, 15)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(m.op13_collocations(df, support, 15, size=size, count_size=size, bits=bits)) == want
    assert want


def test_empty_and_unfit(spark):
    assert m.op13_collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert m.op13_collocations(spark.createDataFrame([("en", None, 1, "p"), (None, "a b", 2, "p")], SCHEMA)).collect() == []


def test_only_langs_are_broadcast(spark):
    """Spark takes an exploded table for as small as the files under it; phrases must not reach the driver by that, at first or adaptively."""
    rows = made(7)
    df = m.op13_collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), 3, 15, bits=1 << 16)
    assert sorted(tuple(r) for r in df.collect()) == plain(rows, 3, 15)
    ran = df._jdf.queryExecution()
    for plan in (ran.sparkPlan().toString(), ran.executedPlan().toString()):
        assert set(re.findall(r"BroadcastHashJoin \[([^]]*)]", re.sub(r"#\d+L?", "", plan))) == {"lang"}


def test_products_beyond_64_bits(spark):
    big = 10**12
    phrases = spark.createDataFrame([("en", "a b", 2, big + 7), ("en", "a", 1, 3 * big), ("en", "b", 1, 5 * big)], "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", 7 * 10**15)], "lang string, n long")
    r = m.scored(phrases, totals).collect()[0]
    assert (r.a, r.l, r.r, r.score) == (big + 7, 3 * big, 5 * big, 1000 * (big + 7) * 7 * 10**15 // (15 * big * big))


def test_local_supports_cover_the_support():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 30)
    least = [m.local_supports(size.sum(keepdims=True), np.array([s]), 100)[0] for s in size]
    assert sum(x - 1 for x in least) < 100  # a phrase below every local support is below the support


def test_bloom_holds_all(spark):
    d = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 3000)
    words = m.bloom(spark.createDataFrame([(int(x),) for x in d], "digest long"), 1 << 16)
    assert m.may_hold(words, d.view(np.uint64)).all()
    other = np.random.default_rng(3).integers(-2**63, 2**63 - 1, 3000)
    assert m.may_hold(words, other.view(np.uint64)).mean() < 0.05


def mined(word, piece, lang, least, last=3):
    tracemalloc.start()
    filters, rows, got = [np.zeros(0, np.uint64)], [], Counter()
    for digest, count, _ in m.mine(word, piece, lang, least, filters, 1, last):
        rows.append(len(digest))
        if len(word) < 1 << 20:
            got.update(dict(zip(digest.tolist(), count.tolist(), strict=True)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, peak, got


def test_mining_memory():
    """A shard of two million words is handed on in bounded parts, with little memory besides its digests."""
    n = 2_000_000
    word = m.mix(np.random.default_rng(5).integers(0, n // 4, n).astype(np.uint64))
    rows, peak, _ = mined(word, np.arange(n, dtype=np.int32) // 9, np.zeros(n, np.int16), np.array([1]))
    assert max(rows) <= 1 << 16 and sum(rows) > n
    assert peak < 48 * n


def test_mined_counts_over_parts(monkeypatch):
    """Shards taken in several sets of digests count as in one."""
    n = 9000
    word = m.mix(np.random.default_rng(6).integers(0, 60, n).astype(np.uint64))
    args = word, np.arange(n, dtype=np.int32) // 7, np.zeros(n, np.int16), np.array([3])
    whole = mined(*args)[2]
    monkeypatch.setattr(m, "alike", lambda d, f=m.alike: f(d, 100))
    monkeypatch.setattr(m, "BATCH_ROWS", 50)
    rows, _, parts = mined(*args)
    assert parts == whole and max(rows) <= 50 and len(whole) > 100
    words = Counter(word.tolist())
    assert all(whole[w] == c for w, c in words.items() if c >= 3)
