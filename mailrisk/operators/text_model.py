"""TF-IDF terms, vocabulary, weights, scoring and explanations (M2-M4, M7-M9).

The model is a table ``MODEL_TERMS(term, idf, coef)`` plus an intercept, so
scoring is a join and an aggregation, never a dense 250,000-wide vector.

Plan shape for scoring a table of emails (see ``score``): a projection.  The
model's terms are numbered by a ``CountVectorizerModel``, whose broadcast hash
table counts them inside the row; their weights stand in one array literal of
the plan, so a term number costs one array access.
Nothing is exploded, exchanged, grouped or sorted beyond a row, and no caller's
id is used as a key.  A model beyond the broadcast bound is joined by shuffle
(``score_by_join``).
"""

from __future__ import annotations

import json

from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX

# A term table may be broadcast up to the vocabulary cap and this many bytes of terms.
MODEL_BROADCAST_MAX_ROWS = K.MAX_FEATURES
MODEL_BROADCAST_MAX_BYTES = 64 << 20


def _measured(df: DataFrame, max_rows: int) -> tuple[int, int]:
    """Rows (counted up to ``max_rows + 1``) of a term table and the bytes of their terms."""
    return tuple(df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first())


def bounded_broadcast(df: DataFrame, max_rows: int = MODEL_BROADCAST_MAX_ROWS,
                      max_bytes: int = MODEL_BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast the term table ``df`` after checking its rows and the bytes of
    its terms; a larger one is joined by shuffle, where AQE splits the
    partitions of frequent terms."""
    n, size = _measured(df, max_rows)
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def counted_terms(df: DataFrame, text_col: str, out: str = "_t") -> DataFrame:
    """M2 inside the row: the other columns and ``out``, an array of (term, tf).

    The sorted 1-2-grams are cut into runs: the run starts are the distinct
    terms, the distance to the next start the count.  Staged projections keep
    each array computed once and the accent fold outside the lambdas."""
    rest = [c for c in df.columns if c != text_col]
    starts = F.filter(F.transform("_s", lambda x, i: F.struct(x.alias("term"), i.alias("at"))),
                      lambda y: (y["at"] == 0) | (y["term"] != F.get("_s", y["at"] - 1)))
    runs = F.transform("_d", lambda y, j: F.struct(
        y["term"].alias("term"), (F.coalesce(F.get("_d", j + 1)["at"], F.size("_s")) - y["at"]).cast("long").alias("tf")))
    return (df.select(*rest, TX.fold_case_accents(F.col(text_col)).alias("_f"))
            .select(*rest, TX.word_tokens("_f").alias("_w"))
            .select(*rest, F.sort_array(TX.ngrams_1_2("_w")).alias("_s"))
            .select(*rest, "_s", starts.alias("_d"))
            .select(*rest, runs.alias(out)))


def spread(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """One row per struct of ``array``.  The outer form keeps the optimizer from adding a
    ``size(array) > 0`` filter, which it would push below the staged projections and so
    evaluate the whole text pipeline once per array element."""
    return df.select(*keep, F.inline_outer(array))


def doc_terms(df: DataFrame, text_col: str = "text", id_col: str = "row_idx",
              vocab: DataFrame | None = None) -> DataFrame:
    """M2: (id, term, tf [, vocab columns]), one row per distinct term of each
    text; with ``vocab`` only its terms are kept.  No exchange."""
    terms = spread(counted_terms(df.select(id_col, text_col), text_col), F.col("_t"), id_col).filter("term IS NOT NULL")
    return terms if vocab is None else terms.join(vocab, "term")


def term_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, cf): documents containing the term and its corpus count.

    A text's sorted 1-2-grams meet the one before them, so a term's first place in a text is
    known without counting inside the row.  Partial aggregation keeps one row per term per task
    before the shuffle."""
    grams = (df.select(TX.fold_case_accents(F.col(text_col)).alias("_f")).select(TX.word_tokens("_f").alias("_w"))
             .select(F.sort_array(TX.ngrams_1_2("_w")).alias("term")))
    before = F.concat(F.array(F.lit("")), F.slice("term", 1, F.greatest(F.size("term") - 1, F.lit(0))))  # no term is empty
    rows = spread(grams.select("term", before.alias("before")), F.arrays_zip("term", "before")).filter("term IS NOT NULL")
    return rows.groupBy("term").agg(F.count_if(F.col("term") != F.col("before")).alias("df"), F.count(F.lit(1)).alias("cf"))


def vocabulary(stats: DataFrame, n_docs: Column | int, min_df: int = K.MIN_DF, max_df: float = K.MAX_DF,
               max_features: int = K.MAX_FEATURES) -> DataFrame:
    """M3: from ``term_statistics``, document frequency in [min_df, max_df * n_docs],
    then the ``max_features`` terms with the highest corpus count (ties by term).

    Terms per count give the count at which the cut falls; only the terms from
    there on are sorted and numbered (``global_position``)."""
    from pyspark.sql import Window

    from ..session import ensure_checkpoint_dir
    from .positions import global_position
    ensure_checkpoint_dir(stats.sparkSession)
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.lit(n_docs))).checkpoint()
    # one row per distinct count, far fewer than terms
    above = Window.orderBy(F.col("cf").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_count = kept.groupBy("cf").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(above))
    cut = by_count.filter(F.col("upto") >= max_features).agg(F.max("cf")).first()[0]
    if cut is not None:
        kept = kept.filter(F.col("cf") >= cut)
    ranked = global_position(kept, [F.col("cf").desc(), F.col("term").asc()], out="idx")
    return ranked.filter(F.col("idx") < max_features)


def idf_weights(vocab: DataFrame, n_docs: int) -> DataFrame:
    """Smoothed idf: ln((1 + n) / (1 + df)) + 1."""
    return vocab.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)


def _weight() -> Column:
    return (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")


def doc_weights(df: DataFrame, weights: DataFrame, text_col: str = "text", id_col: str = "row_idx") -> DataFrame:
    """(id, _norm, _list): a text's vocabulary terms with tf and unnormalised weight
    (and ``idx`` if the weights carry it), gathered by one aggregation per text."""
    extra = [c for c in ("idx",) if c in weights.columns]
    w = (doc_terms(df, text_col, id_col, vocab=bounded_broadcast(weights.select("term", "idf", *extra)))
         .withColumn("w", _weight()))
    return w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
                                 F.collect_list(F.struct(*extra, "term", "tf", "w")).alias("_list"))


def tfidf(df: DataFrame, weights: DataFrame, text_col: str = "text", id_col: str = "row_idx") -> DataFrame:
    """M4: (id, term, tf, w) with w = (1 + ln tf) * idf, L2-normalised per text
    over the vocabulary terms."""
    return (doc_weights(df, weights, text_col, id_col).select(id_col, "_norm", F.inline("_list"))
            .select(id_col, "term", "tf", (F.col("w") / F.col("_norm")).alias("w")))


def sigmoid_percent(margin: Column) -> Column:
    return F.lit(100.0) / (F.lit(1.0) + F.exp(-margin))


def term_weights(model: DataFrame) -> tuple[CountVectorizerModel, Column]:
    """The numbering of the model's terms and the array of (term, idf, coef) in that order.

    Both have at most ``MODEL_BROADCAST_MAX_ROWS`` entries.  The array is one literal: the
    optimizer folds the parsing of its JSON text away."""
    grams = F.array("term").alias("_g")
    numbering = CountVectorizer(inputCol="_g", outputCol="_v", minDF=1.0, vocabSize=MODEL_BROADCAST_MAX_ROWS).fit(model.select(grams))
    rows = (numbering.transform(model.select(grams, "term", "idf", "coef"))
            .select(F.unwrap_udt("_v")["indices"][0].alias("at"), "term", "idf", "coef").collect())
    packed = json.dumps([{"t": r["term"], "i": r["idf"], "c": r["coef"]} for r in sorted(rows, key=lambda r: r["at"])])
    return numbering, F.from_json(F.lit(packed), "array<struct<t: string, i: double, c: double>>")


def _candidates(contribs, sign: int, k: int) -> Column:
    """The ``k`` strongest terms of one direction: by |contribution|, then term."""
    fit = F.filter(contribs, lambda x: (F.length(x["term"]) >= K.EXPLAIN_MIN_TERM_LEN) & (x["contrib"] * sign > 0))
    ordered = F.array_sort(F.transform(fit, lambda x: F.struct((-F.abs(x["contrib"])).alias("k"), x["term"].alias("term"))))
    return F.transform(F.slice(ordered, 1, k), lambda x: x["term"])


def score(df: DataFrame, model: DataFrame, intercept: float, text_col: str = "text",
          k: int = K.EXPLAIN_TOP_K) -> DataFrame:
    """M7 + M9 inputs: ``df`` without its text, plus ``margin``, ``spam_risk``
    (percent) and the ordered candidates ``spam_terms`` and ``ham_terms``.

    Rows are scored each for itself, so rows that share an id, or have none, do
    not mix.  A text without any model term (a null text too) scores by the intercept alone.
    Candidates are terms of length >= 3 with a non-zero contribution, by
    |contribution| then term."""
    model = model.select("term", "idf", "coef")
    n, size = _measured(model, MODEL_BROADCAST_MAX_ROWS)
    if not 0 < n <= MODEL_BROADCAST_MAX_ROWS or size > MODEL_BROADCAST_MAX_BYTES:
        return score_by_join(df, model, intercept, text_col, k)
    numbering, weights = term_weights(model)
    rest = [c for c in df.columns if c != text_col]
    folded = df.select(*rest, F.coalesce(TX.fold_case_accents(F.col(text_col)), F.lit("")).alias("_f"))
    grams = folded.select(*rest, TX.word_tokens("_f").alias("_w")).select(*rest, TX.ngrams_1_2("_w").alias("_g"))

    def weigh(m, tf):
        w = (F.lit(1.0) + F.log(tf)) * m["i"]
        return F.struct(m["t"].alias("term"), w.alias("w"), (w * m["c"]).alias("contrib"))

    total = lambda f: F.aggregate("_h", F.lit(0.0), lambda a, x: a + f(x))
    out = (numbering.transform(grams).select(*rest, F.unwrap_udt("_v").alias("_x"))
           .select(*rest, "_x", F.transform("_x.indices", lambda at: F.get(weights, at)).alias("_m"))
           .select(*rest, F.zip_with("_m", "_x.values", weigh).alias("_h"))
           .select(*rest, total(lambda x: x["w"] * x["w"]).alias("_ss"), total(lambda x: x["contrib"]).alias("_dot"),
                   _candidates("_h", 1, k).alias("spam_terms"), _candidates("_h", -1, k).alias("ham_terms")))
    margin = F.coalesce(F.when(F.col("_ss") > 0, F.col("_dot") / F.sqrt("_ss")), F.lit(0.0)) + F.lit(intercept)
    return (out.select(*rest, margin.alias("margin"), "spam_terms", "ham_terms")
            .withColumn("spam_risk", sigmoid_percent(F.col("margin"))))


def score_by_join(df: DataFrame, model: DataFrame, intercept: float, text_col: str = "text",
                  k: int = K.EXPLAIN_TOP_K) -> DataFrame:
    """:func:`score` for a model of any size (or of no term): one inline, one join with the
    model by term, one aggregation by an engine-assigned key.

    The rows of an email leave the same task, so map-side partial aggregation hands the
    only exchange about one row an email; the text is not shuffled."""
    model = bounded_broadcast(model.select("term", "idf", "coef"))
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(F.monotonically_increasing_id().alias("_eid"), F.struct(*rest).alias("_row"),
                     F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    kind = rows.schema["_row"].dataType
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"), F.col("_row").alias("row")))
    parts = F.transform("_t", lambda x: F.struct(x["term"].alias("term"), x["tf"].alias("tf"), F.lit(None).cast(kind).alias("row")))
    terms = spread(counted_terms(rows, text_col), F.concat(whole, parts), "_eid")
    known = (terms.join(model, "term", "left").filter((F.col("tf") == 0) | F.col("idf").isNotNull())
             .withColumn("w", F.when(F.col("tf") > 0, _weight()))
             .withColumn("contrib", F.col("w") * F.col("coef")))
    eligible = (F.length("term") >= K.EXPLAIN_MIN_TERM_LEN) & (F.col("contrib") != 0)
    key = F.struct((-F.abs("contrib")).alias("k"), F.col("term").alias("term"))
    top = lambda c: F.transform(F.slice(F.array_sort(c), 1, k), lambda x: x["term"])
    per_email = known.groupBy("_eid").agg(
        F.first("row", ignorenulls=True).alias("_row"),
        F.sum(F.col("w") * F.col("w")).alias("_ss"), F.sum("contrib").alias("_dot"),
        F.collect_list(F.when(eligible & (F.col("contrib") > 0), key)).alias("_p"),
        F.collect_list(F.when(eligible & (F.col("contrib") < 0), key)).alias("_n"))
    margin = F.coalesce(F.when(F.col("_ss") > 0, F.col("_dot") / F.sqrt("_ss")), F.lit(0.0)) + F.lit(intercept)
    return (per_email.select(*[F.col("_row")[c].alias(c) for c in rest], margin.alias("margin"),
                             top("_p").alias("spam_terms"), top("_n").alias("ham_terms"))
            .withColumn("spam_risk", sigmoid_percent(F.col("margin"))))


def predict(df: DataFrame, risk_col: str = "spam_risk") -> DataFrame:
    """M8: prediction (unrounded risk >= 50) and confidence; both rounded to 1 for output."""
    from ..functions import risk as RK
    return (df.withColumn("prediction", RK.prediction(risk_col))
            .withColumn("confidence", RK.confidence(risk_col)))


def explain_terms(scored: DataFrame) -> DataFrame:
    """M9: per email the candidates in the predicted direction (empty if none)."""
    return (scored
            .withColumn("model_terms", F.when(F.col("prediction") == K.SPAM, F.col("spam_terms")).otherwise(F.col("ham_terms")))
            .drop("spam_terms", "ham_terms"))
