import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mailrisk.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, d string, `conv_id2` long"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    """The nodes by plain Python over dictionaries of whole prefixes."""
    original = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            original[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    original = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in original.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        path = tuple(original.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in children[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                              "ends_sha256").collect())


def made(seed, convs=120, most=9):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.choice([r.randrange(-250, 900), r.randrange(0, 30)])
        for t in range(r.randrange(1, most)):
            rows.append((c, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "é" * 3, "hello"]), "x", 1))
    rows += rows[:7] + [(None, 1, "user", "hi", "x", 1)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rows = made(seed)
    assert got(trie.op12_prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_long_conversations_in_blocks_and_shards(spark):
    """Deep paths cross many blocks, shards and tasks; a common conversation ends in many members."""
    r = random.Random(5)
    rows = [(200, t, "user", f"t{t % 3}", "x", 1) for t in range(300)]
    rows += [(7, t, "user", f"t{t % 3}", "x", 1) for t in range(150)] + [(107, t, "user", f"t{t % 3}", "x", 1) for t in range(310)]
    for c in range(1000, 1120):
        n = r.choice([3, 3, 20, 33])
        rows += [(c, t, "user", "same", "x", 1) for t in range(n)] + [(c, n, "user", r.choice("ab"), "x", 1)]
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6), 8, 40)) == plain(rows)


def test_all_turns_equal(spark):
    rows = [(1, None, "user", "x", "x", 1)] * 60 + [(2, None, "user", "x", "x", 1)] * 61
    assert got(trie.op12_prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_turnless_and_empty(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    assert got(trie.op12_prefix_trie(spark.createDataFrame([(lone, 0, "user", "x", "x", 1)], SCHEMA))) == plain([(lone, 0, "user", "x")])
    assert plain([(lone, 0, "user", "x")])[0][:4] == (lone, 0, None, 1)
    assert trie.op12_prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_arithmetic_and_slots():
    r = random.Random(3)
    values = [0, 1, trie.P - 1, trie.P - 2, 1 << 31, (1 << 31) - 1, 1 << 60, *[r.randrange(trie.P) for _ in range(400)]]
    a, b = np.array(values, dtype=np.uint64), np.array(values[::-1], dtype=np.uint64)
    assert trie.times(a, b).tolist() == [x * y % trie.P for x, y in zip(values, values[::-1], strict=True)]
    assert trie.plus(a, b).tolist() == [(x + y) % trie.P for x, y in zip(values, values[::-1], strict=True)]
    assert trie.minus(a, b).tolist() == [(x - y) % trie.P for x, y in zip(values, values[::-1], strict=True)]
    k = np.random.default_rng(1).integers(-2**60, 2**60, (2, 5000))
    slots = trie.Slots(k[0], k[1])
    at = slots.of(k[0], k[1])
    assert sorted(at.tolist()) == list(range(5000))
    assert (slots.of(k[0], k[1] + 1) == -1).all()
