import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from mailrisk.llm import compression as c

SCHEMA = "doc_id long, text string, lang string, _text string"


def plain(text):
    """The base counts by plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), dup, len(covered)


def made(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "Ünï", "the", "x#y", "$$", " q", "\x00", "\U0001f600", "A"]
    glue = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c"]
    parts = ["".join(r.choice(vocabulary) + r.choice(glue) for _ in range(r.randrange(0, 14))) for _ in range(3)]
    return "".join(r.choice(parts) for _ in range(r.randrange(0, 9)))


TEXTS = [None, "", " \n\t ", "one", "same line\nsame line\nsame line\r\nsame line", "w " * 19, "w " * 20, " ".join(map(str, range(40))) * 2,
         "word" * 30_000, "a b c d e f g h a b c d e f g h", *[made(i) for i in range(300)]]


def test_base_counts():
    column = pa.array(TEXTS, pa.string())
    got = []
    for _, _, buf, off in c.text_slices(column, 4000):
        counts = c.base_counts(buf, off)
        got += list(zip(*[counts[x].tolist() for x in c.COUNTS], strict=True))
    assert got == [plain(t) for t in TEXTS]


def test_colliding_words_stay_apart():
    """Thue-Morse words have equal polynomial hashes modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate({97: "b", 98: "a"})
    texts = [" ".join([a, *"1234567", b, *"1234567"])]
    for _, _, buf, off in c.text_slices(pa.array(texts, pa.string())):
        assert c.base_counts(buf, off)["n_repeat_words"].tolist() == [plain(texts[0])[4]] == [0]


def test_bands():
    press = zstandard.ZstdCompressor(level=c.LEVEL)
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    prose = " ".join(rng.choice([f"w{i}o{i % 7}n" for i in range(3000)], 3000)).encode()
    assert c.judge(noise, press)[4] == "incompressible"
    assert c.judge(b"all work and no play " * 500, press)[4] == "repetitive"
    assert c.judge(prose, press)[4] is None
    # a repeated half shows in the chunks even where a long clean half hides it in the whole
    ratio, chunks, over, _, reason = c.judge(prose + b"spam spam " * (len(prose) // 10), press)
    assert reason == "repetitive" and 0.25 * chunks < over < chunks
    assert c.judge(b"", press) == (None, 0, 0, 0, None) and c.judge(b"aaaa", press)[4] is None
    assert c.band(1 << 30, c.LIMITS) == c.LIMITS[17] and c.band(127, c.LIMITS) is None


def test_query(spark):
    rows = [(i if i % 50 else None, t, None, "x") for i, t in enumerate(TEXTS)]
    got = sorted(c.op11_compression_bands(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    assert len(got) == len(rows)
    press, want = zstandard.ZstdCompressor(level=c.LEVEL), Counter()
    for i, t, _, _ in rows:
        p = plain(t)
        failed = p[0] < 20 or 100 * p[4] > 30 * p[0]
        want[(i, *p, failed, not failed and c.judge((t or "").encode(), press)[4] is None)] += 1
    assert Counter((r.doc_id, *[r[x] for x in c.COUNTS], r.base_failed, r.kept) for r in got) == want
    assert any(r.kept for r in got) and any(r.reason for r in got)
    assert c.op11_compression_bands(spark.createDataFrame([], SCHEMA)).collect() == []
