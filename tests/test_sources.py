import os
import tempfile

from pyspark.sql import functions as F

from mailrisk.operators import corpus as C
from mailrisk.operators import history as H
from mailrisk.plans import catalog as CAT
from mailrisk.sources import corpus_io as CIO
from mailrisk.sources import model_store as MS
from mailrisk import fixtures as FX
from conftest import SF_SMALL


CSV = ('subject,body,label\n'
       '"Hi","line one\nline two",spam\n'
       'NA,"second, with comma",0\n'
       '"Hi","line one\nline two",ham\n'
       'x,,NA\n')


def write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_csv_multiline_na_tokens_and_order(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "corpus.csv")
    write(p, CSV)
    canon = CIO.load_corpus(spark, p).orderBy("row_idx").collect()
    assert [r.row_idx for r in canon] == [0, 1, 2, 3]
    assert canon[0].body == "line one\nline two" and canon[0].label == 1
    assert canon[1].subject == "" and canon[1].label == 0          # 'NA' read as missing
    assert canon[3].label is None and canon[3].body == ""
    table = C.corpus_table(CIO.load_corpus(spark, p)).orderBy("row_idx").collect()
    assert [(r.row_idx, r.subject, r.label) for r in table] == [(0, "Hi", 1), (1, "", 0), (2, "x", None)]


def test_parquet_named_csv_falls_back(spark):
    # a '.gzip' name is tried as Parquet first; the footer check fails and the
    # file is read as (gzip) CSV
    import gzip
    d = tempfile.mkdtemp()
    p = os.path.join(d, "data.parquet.gzip")
    with gzip.open(p, "wt") as f:
        f.write(CSV)
    assert CIO.load_corpus(spark, p).count() == 4


def test_missing_path_fails_before_work(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        CIO.read_corpus(spark, "/nonexistent/corpus.csv")


def test_model_roundtrip(spark):
    d = tempfile.mkdtemp()
    MS.save_model(FX.model_terms(spark), FX.MODEL_INTERCEPT, 7, d)
    terms, intercept = MS.load_model(spark, d)
    assert intercept == FX.MODEL_INTERCEPT and terms.count() == len(FX.MODEL_TERMS)


def test_breakdown_partition_independent(spark):
    h = CAT.history(spark, SF_SMALL)
    base = sorted(H.domain_breakdown(h).collect())
    assert sorted(H.domain_breakdown(h.repartition(1)).collect()) == base
    assert sorted(H.domain_breakdown(h.repartition(7)).collect()) == base


def test_headers_with_dots_and_uri_paths(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("Email No.,text,label\n1,hello there,spam\n2,NA,ham\n")
    rows = CIO.load_corpus(spark, f"file:{p}").orderBy("row_idx").collect()
    assert [(r.body, r.label) for r in rows] == [("hello there", 1), ("", 0)]
    CIO.write_corpus(C.corpus_table(CIO.load_corpus(spark, str(p))), str(tmp_path / "out"))
    import pytest
    with pytest.raises(FileNotFoundError):
        CIO.read_corpus(spark, f"file:{tmp_path}/missing.csv")


def test_damaged_parquet_is_an_error(spark, tmp_path):
    import pytest
    p = tmp_path / "d.parquet"
    p.write_bytes(b"PAR1" + b"damaged" * 20)
    with pytest.raises(Exception):
        CIO.read_corpus(spark, str(p)).count()


def test_replace_swaps_versions(spark, tmp_path):
    src, dest = tmp_path / "a.csv", str(tmp_path / "corpus")
    src.write_text("subject,body,label\ns,b,spam\nt,c,ham\n")
    assert CIO.replace_corpus(spark, str(src), dest) == 2
    src.write_text("subject,body,label\ns,b,spam\n")
    assert CIO.replace_corpus(spark, str(src), dest) == 1
    assert sorted(os.listdir(tmp_path)) == ["a.csv", "corpus"]
