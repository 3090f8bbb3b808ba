import zlib

import numpy as np
import public_tokenizers
import pytest

from mailrisk.llm import packing
from mailrisk.llm.tokens import Encoder


def used(patterns, size):
    counts = np.zeros(size, dtype=np.int64)
    for items, times in patterns:
        assert sum(items) <= size - 1
        for x in items:
            counts[x] += times
    return counts


def optimum(items, capacity):
    """Fewest bins by trying everything (small cases)."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in sorted(set(range(len(bins))), key=lambda j: bins[j]):
            if bins[j] >= items[i]:
                go(i + 1, [*bins[:j], bins[j] - items[i], *bins[j + 1:]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_solver_is_exact_on_small_cases(seed):
    rng = np.random.default_rng(seed)
    items = sorted(rng.integers(1, 31, rng.integers(1, 11)).tolist(), reverse=True)
    counts = np.bincount(items, minlength=31)
    patterns = packing.solve(counts, 30)
    assert (used(patterns, 31) == counts).all()
    assert sum(m for _, m in patterns) == optimum(items, 30)


def test_solver_is_exact_on_4000_cases_of_up_to_14_items():
    for seed in range(4000):
        rng = np.random.default_rng(seed)
        items = sorted(rng.integers(8, 32, rng.integers(8, 15)).tolist(), reverse=True)
        counts = np.bincount(items, minlength=61)
        packing_ = packing.pack(counts, 60)
        assert packing_.proven and (used(packing_.patterns, 61) == counts).all()
        if packing_.bins > packing_.bound:  # at the bound there is nothing to show
            assert packing_.bins == optimum(items, 60), seed


def test_a_case_that_few_fillings_a_bin_miss():
    counts = np.bincount([31, 29, 28, 27, 26, 24, 22, 21, 20, 19, 17, 16, 11], minlength=61)
    assert packing.pack(counts, 60)[1:] == (5, 5, True)


def test_without_a_proof_the_gap_is_told():
    counts = np.bincount(np.random.default_rng(3).integers(200, 1201, 400), minlength=2049)
    got = packing.pack(counts, 2048, node_limit=10, steps=10)
    assert got.bins >= got.bound and got.proven == (got.bins == got.bound)
    assert (used(got.patterns, 2049) == counts).all()


@pytest.mark.parametrize("lengths", [np.full(5000, 700), np.arange(1, 2048), np.random.default_rng(0).integers(1, 60, 5000),
                                     np.random.default_rng(1).lognormal(6.3, 1, 20_000).clip(1, 2048).astype(int), np.array([2048] * 9), np.array([], dtype=int)])
def test_solver_uses_every_item_and_comes_near_the_bound(lengths):
    counts = np.bincount(lengths, minlength=2049)
    patterns = packing.solve(counts, 2048)
    assert (used(patterns, 2049) == counts).all()
    bins = sum(m for _, m in patterns)
    assert bins <= sum(m for _, m in packing.best_fit_decreasing(counts, 2048))
    if len(lengths) and lengths.max() < 60:
        assert bins == packing.lower_bound(counts, 2048)


def test_operator_against_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, "word " * (i * 37 % 900)) for i in range(60)] + [(70, None), (71, ""), (72, "long text " * 5000), (5, "again"), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Doc_ID int")
    got = packing.op8_packing(docs, path).collect()
    tok = Encoder(path).tok
    want = []
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p:p + 2048]
            want.append((doc, p // 2048, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(w[3] for w in want)
    assert len(sequences) <= -(-total // 2048) + 1


def test_assembled_sequences_hold_the_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, "one two three " * (i + 1)) for i in range(30)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, path, 64)
    whole = packing.assemble(packing.place(pieces, 64)).collect()
    ids = [np.frombuffer(r.ids, "<u4") for r in whole]
    assert all(len(x) <= 64 for x in ids)
    assert sum(map(len, ids)) == sum(r.length for r in pieces.collect())


def test_no_documents(spark):
    assert packing.op8_packing(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect() == []
