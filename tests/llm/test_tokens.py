import random

import numpy as np
import public_tokenizers
import pytest

from mailrisk.llm import mphf, token_files, tokens
from mailrisk.llm.kernels import splitmix

ODD = ["a  b", "\ta b\n\nc", " x", "x ", "it's don't  'll", "é é ́x", "a b c", "<|endoftext|> a <|startoftext|>", "a\x00b c", "",
       "1234 5678 a1b2", "中文 中", "a\nb", "\na", "a\n", " ́", "Straße ΣΣ İ", "x y z", "a “q” b", "\n", " ", "\x1c a", "　", "a\u0085b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 50)
    enc = tokens.Encoder(public_tokenizers.path(name))
    rng = random.Random(1)
    alphabet = ["a", "b", " ", " ", "\n", "é", "'", "s", "1", ".", "́", "  ", "中", "\t"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(300)] + [" ".join(["word"] * 400_000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    assert enc.encode(texts[::-1]) == want[::-1]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    keys = splitmix(n, 5)
    function, slots = mphf.build(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert (mphf.lookup(function, keys) == slots).all()
    other = splitmix(1000, 6)
    at = mphf.lookup(function, other)
    prints = np.zeros(max(n, 1), np.uint32)
    prints[slots] = mphf.fingerprint(keys)
    assert not ((at >= 0) & (at < n) & (prints[np.clip(at, 0, max(n - 1, 0))] == mphf.fingerprint(other))).any()


def brute(rows, name):
    import zlib
    tok = tokens.Encoder(public_tokenizers.path(name)).tok
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [2, 4])
def test_files_and_index_round_trip(spark, tmp_path, width, monkeypatch):
    monkeypatch.setattr(token_files, "BUCKET_KEYS", 16)
    rows = [(i * 3, f"text number {i} !!! {'é ' * (i % 7)}") for i in range(100)] + [(5, None), (7, ""), (9, "same"), (9, "same"), (None, "no id"), (400, "! " * 50_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Text string")
    got = token_files.op5_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, "byte_bpe_50k.json")
    path = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / f"w{width}"), width)
    found = token_files.read_token_files(spark, path)
    assert found.count() == len(rows)
    index = token_files.build_index(found, 4)
    keys = spark.createDataFrame([(9, 1), (9, 3), (12345, 0)], "doc_id long, occurrence long")
    assert [r.doc_id for r in token_files.lookup(keys, index, 4).collect()] == [9]  # keys never put in are refused


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.op5_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "out")).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("plain", [False, True])
def test_marks_as_the_library_takes_them(name, plain):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|ENDOFTEXT|>y z", "plain words here", "<|startoftext|> go", "<|endoftext", "|> b"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder(path, plain_marks=plain).encode(texts) == want


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [1024, 2048])
def test_structured_pieces_are_told_apart(n):
    """Polynomial hashes modulo 2**64 of these two are equal whatever the base."""
    from mailrisk.llm import kernels
    a, b = thue_morse(n)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = tokens.Encoder(public_tokenizers.path(name))
        for texts in ([a, b], [f"x {a} y", f"x {b} y"]):
            assert enc.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    buf = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    h = kernels.words(buf, np.array([0, len(buf)]), kernels.SPACED)[0]
    assert h[0] != h[1]
