"""Plain CSV cut at any byte equals the reading of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from mailrisk.operators import corpus as C
from mailrisk.sources import corpus_io as CIO
from mailrisk.sources import csv_split as S


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "37b", "spark.sql.files.openCostInBytes": "1b"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def whole(spark, path):
    """(position, cells) by the multi-line reader, files in path order."""
    raw = spark.read.options(header=True, **CIO.CSV_OPTIONS).csv(path)
    ordered = CIO._with_file_order(raw.select(*[C.column(c) for c in raw.columns], "_metadata"), F.monotonically_increasing_id())
    return sorted((r["_row_order"], *[r[c] for c in raw.columns]) for r in ordered.collect())


def cut(spark, path):
    columns = spark.read.options(header=True, **CIO.CSV_OPTIONS).csv(path).columns
    df = S.read(spark, path, columns, CIO.CSV_OPTIONS)
    return None if df is None else sorted((r["_row_order"], *[r[c] for c in columns]) for r in df.collect())


def table(rng, rows, end="\n"):
    pool = ["a", "", " x ", "1,2", 'say ""hi""', "line\nline", "\n\n", "é z", "w" * 90, ",", '""', "a\r\nb", "\n,spam\n", "NA"]
    lines = ["subject,body,label"]
    for _ in range(rows):
        cells = []
        for _ in range(rng.choice([3, 3, 3, 2, 4])):
            v = rng.choice(pool)
            cells.append('"' + v + '"' if rng.random() < .3 or any(x in v for x in ',"\n\r') else v)
        lines.append(",".join(cells))
        if rng.random() < .1:
            lines.append("")
    return end.join(lines) + (end if end == "\r\n" or rng.random() < .5 else "")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_whole_files_on_random_tables(spark, tiny_splits, tmp_path, end):
    rng = random.Random(5)
    for i in range(3):
        folder = tmp_path / f"t{i}"
        folder.mkdir()
        for j in range(rng.choice([1, 3])):
            (folder / f"{j}.csv").write_bytes(table(rng, rng.choice([0, 3, 25]), end).encode())
        assert cut(spark, str(folder)) == whole(spark, str(folder)), i


def test_one_record_over_many_ranges_and_many_tasks(spark, tiny_splits, tmp_path):
    p = tmp_path / "c.csv"
    body = "\n".join(f"line {i}, \"\"quoted\"\"" for i in range(60))
    p.write_text("subject,body,label\n" + f'first,"{body}",spam\n' + "".join(f"s{i},b{i},ham\n" for i in range(50)))
    got = cut(spark, str(p))
    assert got == whole(spark, str(p)) and len(got) == 51 and got[0][2].count("\n") == 59
    assert CIO.read_csv(spark, str(p)).filter("subject like 's%'").rdd.getNumPartitions() > 8


@pytest.mark.parametrize("text", [
    'subject,body,label\nsize 5" disk,b,spam\nx,"two\nlines",ham\n',       # a stray quote
    'subject,body,label\n"a" ,b,spam\n',                                     # something after a closing quote
    'subject,body,label\na,"never closed,spam\n',
    'subject,body,label\r\na,b,spam\nc,d,ham\r\n',                           # mixed line ends
    'subject,body,label\ra,b,spam\rc,d,ham\r',
])
def test_other_quoting_is_read_whole(spark, tiny_splits, tmp_path, text):
    p = tmp_path / "c.csv"
    p.write_bytes(text.encode())
    assert cut(spark, str(p)) is None
    assert CIO.read_csv(spark, str(p)).count() == len(whole(spark, str(p)))


def test_byte_order_mark(spark, tiny_splits, tmp_path):
    p = tmp_path / "c.csv"
    p.write_bytes('\ufeff"subject",body,label\na,"b\nc",spam\n'.encode())
    assert cut(spark, str(p)) == whole(spark, str(p)) == [(0, "a", "b\nc", "spam")]


def test_header_only_and_compressed(spark, tmp_path):
    import gzip
    p = tmp_path / "c.csv"
    p.write_text("subject,body,label\n")
    assert cut(spark, str(p)) == []
    z = tmp_path / "c.csv.gz"
    z.write_bytes(gzip.compress(b"subject,body,label\na,b,spam\n"))
    assert cut(spark, str(z)) is None and CIO.read_csv(spark, str(z)).count() == 1
