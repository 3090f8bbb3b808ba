import hashlib
import random
import re

import pytest

from mailrisk.llm import decontaminate

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, Text string, items int"


def split(text):
    return W.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = split(text)
        k = min(10, len(w))
        windows += [(item, tuple(w[i:i + k])) for i in range(len(w) - k + 1) if k]
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    if item is not None:
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "été", "x1", "delta"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(1, say(30)), (2, "short item"), (10, say(12)), (11, ""), (12, None), (None, "nameless item here"), (2, "short item"), (13, say(10)), (14, say(9))]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)]
    docs += [(100, "pre-" + items[0][1].upper().replace("É", "é").replace(" ", ", ") + "! post"), (101, "Short, item; short item"), (102, None), (103, "..."),
             (104, items[2][1] + " " + items[2][1]), (105, "a nameless  item\nhere"), (100, "twice"), (100, "twice"), (None, "short item"),
             (106, "filler " * 300_000 + "short item " + "end " * 10), (107, items[7][1]), (108, " ".join(items[7][1].split()[:9]))]
    return docs, items


@pytest.mark.parametrize("max_windows", [200_000, 7])
def test_against_brute_force(spark, data, max_windows, monkeypatch):
    docs, items = data
    monkeypatch.setattr(decontaminate.mark, "__defaults__", ("text", max_windows))
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, TEXT string")
    assert sorted(map(tuple, decontaminate.op6_decontamination(df, bench).collect()), key=str) == brute(docs, items)


def test_spans_and_documents(spark, data):
    docs, items = data
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    cut = decontaminate.without_spans(df, bench)
    assert cut.columns == df.columns
    texts = {r[0]: r[1] for r in cut.collect()}
    assert texts[100] is not None and texts[101].strip(" ,;") == "" and texts[102] is None
    assert texts[106].endswith("filler  " + "end " * 10)
    assert len(split(texts[106])) == 300_010
    left = decontaminate.without_documents(df, bench)
    assert left.columns == df.columns
    assert sorted([r[0] for r in left.collect()], key=str) == sorted([w[0] for w in want if not w[5]], key=str)


def test_empty_tables(spark, data):
    docs, items = data
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.op6_decontamination(none, bench).collect() == []
    no_bench = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    assert not decontaminate.op6_decontamination(df, no_bench).filter("contaminated").count()
