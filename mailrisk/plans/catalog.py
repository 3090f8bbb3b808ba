"""Registered queries: name -> (Spark job over the driver tables, DuckDB oracle SQL).

Every job reads the whole driver tables of ``sf_dir`` (through the EMAILS
view, see ``fixtures``) and runs the library's operators on them.  The oracle
SQL recomputes the same result independently in DuckDB; ``None`` marks jobs
without a SQL form (model fitting, streaming), which the driver checks by
row count and pytest checks against a batch or brute-force equivalent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as FX
from ..operators import corpus as C
from ..operators import history as H
from ..session import stored
from . import oracle as O

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonicalize(FX.emails(spark, sf_dir), order_col="row_idx")


def _bigint(df: DataFrame, *cols) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# ---------------------------------------------------------------------------
# Corpus (S2, C1-C14)
# ---------------------------------------------------------------------------

@register("canonical_corpus", O.with_ctes(O.CANON) + """
SELECT row_idx, source, subject, body, sender, recipient, urls, label_raw, CAST(label AS BIGINT) AS label FROM canon""")
def q_canonical(spark, sf_dir):
    """S2 + C1 + C2: column resolution, cleaning and label normalisation."""
    return _bigint(canon(spark, sf_dir).drop("src_ord"), "label")


@register("corpus_table", O.with_ctes(O.CANON, O.CORPUS) + """
SELECT row_idx, source, subject, body, sender, recipient, urls, CAST(label AS BIGINT) AS label FROM corpus""")
def q_corpus_table(spark, sf_dir):
    """Load path with keep-first dedup and dense 0-based positions."""
    return _bigint(C.corpus_table(canon(spark, sf_dir)), "label")


@register("training_table", O.with_ctes(O.CANON, O.TRAINING) + """
SELECT row_idx, subject, body, sender, CAST(label AS BIGINT) AS label FROM training""")
def q_training_table(spark, sf_dir):
    """Train path (label filters before dedup)."""
    return _bigint(C.training_table(canon(spark, sf_dir)).select("row_idx", "subject", "body", "sender", "label"),
                   "label")


@register("dedup_keep_first", O.with_ctes(O.CANON) + """
SELECT subject, body, row_idx, label_raw FROM (
  SELECT *, row_number() OVER (PARTITION BY subject, body ORDER BY row_idx) AS rn FROM canon) t WHERE rn = 1""")
def q_dedup(spark, sf_dir):
    """C6 alone on the cleaned frame (empty rows included)."""
    return C.dedup_keep_first(canon(spark, sf_dir)).select("subject", "body", "row_idx", "label_raw")


@register("emails_at", O.with_ctes(O.CANON, O.CORPUS) + """
SELECT c.row_idx, c.subject, c.sender FROM corpus c WHERE c.row_idx IN (SELECT doc_id FROM labels)""")
def q_emails_at(spark, sf_dir):
    """Positional lookup; positions come from the labels table, some out of range."""
    corpus = C.corpus_table(canon(spark, sf_dir))
    positions = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("pos"))
    return C.emails_at(corpus, positions).select("row_idx", "subject", "sender")


@register("combined_text", O.with_ctes(O.CANON) + f"""
SELECT row_idx, trim('Subject: ' || subject || chr(10) || chr(10) || body, {O.WS_SQL}) AS text FROM canon""")
def q_combined(spark, sf_dir):
    """C10."""
    return C.combine_text(canon(spark, sf_dir)).select("row_idx", "text")


@register("cleaning_funnel", O.with_ctes(O.CANON) + """
SELECT count(*) AS merged_raw_rows, count(label) AS rows_after_label_filter,
  count(*) FILTER (WHERE label IN (0, 1) AND length(subject) + length(body) > 0) AS rows_after_nonempty_filter,
  (SELECT count(*) FROM (SELECT DISTINCT subject, body FROM canon
     WHERE label IN (0, 1) AND length(subject) + length(body) > 0) t) AS training_rows_after_dedup
FROM canon""")
def q_funnel(spark, sf_dir):
    """C11."""
    return C.cleaning_funnel(canon(spark, sf_dir))


_CONV = f"""conv AS (
 SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx, 1 AS src_ord, 'conversations' AS source,
  '' AS subject, {O.clean('text')} AS body, '' AS sender, '' AS recipient, '' AS urls,
  CAST(NULL AS VARCHAR) AS label_raw, CAST(NULL AS INTEGER) AS label FROM conversations)"""


def merged(spark, sf_dir):
    """S3: the email corpus first, then the conversations table as an extra
    source in a different layout (text column only, no labels)."""
    return C.merge_corpora([canon(spark, sf_dir), conversations_corpus(spark, sf_dir)])


def conversations_corpus(spark, sf_dir):
    """The conversations table as a corpus in its own layout, in (conv_id, turn) order."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return C.canonicalize(C.dense_index(conv, order=["conv_id", "turn"], out="_row_order"), source="conversations")


@register("raw_counts", O.with_ctes(O.CANON, _CONV) + """
SELECT src_ord, source, count(*) AS n FROM (SELECT src_ord, source FROM canon UNION ALL SELECT src_ord, source FROM conv) t
GROUP BY src_ord, source""")
def q_raw_counts(spark, sf_dir):
    """S3 + C12: rows per source of a merged corpus (counting needs no positions)."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("_row_order", F.lit(0))
    return C.raw_counts(C.merge_corpora([canon(spark, sf_dir), C.canonicalize(conv, source="conversations")]))


@register("merged_training_table", O.with_ctes(O.CANON, _CONV, """allc AS (SELECT * FROM canon UNION ALL SELECT * FROM conv)""",
                                               O.TRAINING.replace("FROM canon", "FROM allc")) + """
SELECT src_ord, row_idx, subject, body, CAST(label AS BIGINT) AS label FROM training""")
def q_merged_training(spark, sf_dir):
    """S3 + C8: keep-first across sources orders by (source ordinal, position)."""
    return _bigint(C.training_table(merged(spark, sf_dir)).select("src_ord", "row_idx", "subject", "body", "label"),
                   "label")


@register("quality_profile", O.with_ctes(O.CANON) + f"""
SELECT 'raw_rows' AS metric, count(*) AS value FROM emails
UNION ALL SELECT 'missing_label_rows', count(*) FILTER (WHERE label_raw IS NULL) FROM emails
UNION ALL SELECT 'exact_duplicate_rows', (SELECT count(*) FROM emails) - count(*) FROM (SELECT DISTINCT sender, recipient, subject, body, label_raw FROM emails) t
UNION ALL SELECT 'duplicate_subject_body_rows', (SELECT count(*) FROM emails) - count(*) FROM (SELECT DISTINCT subject, body FROM canon) t
UNION ALL SELECT 'training_rows_after_cleaning_and_deduplication', count(*) FROM (SELECT DISTINCT subject, body FROM canon
  WHERE label IN (0, 1) AND length(subject) + length(body) > 0) t""")
def q_quality(spark, sf_dir):
    """C13 on the raw EMAILS table without its per-row time, so exact copies can occur."""
    return C.quality_profile(FX.emails(spark, sf_dir).drop("created_at"), order_col="row_idx")


@register("label_distribution", O.with_ctes(O.CANON, O.CORPUS) + """
SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM corpus WHERE label IS NOT NULL GROUP BY label""")
def q_labels(spark, sf_dir):
    """C14 on the cleaned corpus (counting needs no positions)."""
    return _bigint(C.label_distribution(C.dedup_keep_first(C.drop_empty(canon(spark, sf_dir)))), "label")


# ---------------------------------------------------------------------------
# Minimum slice: domain breakdown (H7) on dataset labels as classification
# ---------------------------------------------------------------------------

@register("domain_breakdown_labels", O.with_ctes(O.CANON) + f"""
SELECT {O.history_domain('sender')} AS domain,
  count(*) FILTER (WHERE label = 1) AS spam, count(*) FILTER (WHERE label IS DISTINCT FROM 1) AS ham
FROM (SELECT c.sender, c.label, e.created_at FROM canon c JOIN emails e USING (row_idx)) t GROUP BY 1""")
def q_domain_labels(spark, sf_dir):
    """H7 keyed on the cleaned sender, with the dataset label as the class."""
    e = FX.emails(spark, sf_dir)
    rows = e.select("row_idx", "sender", "created_at",
                    F.when(C.TX.normalize_label("label_raw") == 1, F.lit("SPAM")).otherwise(F.lit("HAM"))
                    .alias("classification"))
    return H.domain_breakdown(rows)


# ---------------------------------------------------------------------------
# Rules: URLs (U1-U7), language (L1-L14), sender
# ---------------------------------------------------------------------------

from ..operators import rules as R  # noqa: E402

_RULES = f"""rules AS (SELECT row_idx, subject, body, sender, {O.urls_expr('subject', 'body')} AS url_list FROM canon)"""
_SIG = f"""sig AS (SELECT *, {O.signals('subject', 'body', 'url_list')} AS signals FROM rules)"""


def rules_frame(spark, sf_dir):
    return R.with_signals(canon(spark, sf_dir))


@register("extract_urls", O.with_ctes(O.CANON, _RULES) + """
SELECT row_idx, array_to_string(url_list, ' | ') AS urls, len(url_list) AS n_urls FROM rules""")
def q_extract_urls(spark, sf_dir):
    """Distinct urls per email in first-seen order."""
    df = R.with_urls(canon(spark, sf_dir))
    return df.select("row_idx", F.array_join("url_list", " | ").alias("urls"),
                     F.size("url_list").cast("long").alias("n_urls"))


@register("url_items", O.with_ctes(O.CANON, _RULES) + f"""
SELECT row_idx, CAST(pos - 1 AS BIGINT) AS pos, url, coalesce({O.host('url')}, '') AS domain,
  {O.is_https('url')} AS https, {O.invalid('url')} AS invalid
FROM (SELECT row_idx, unnest(url_list) AS url, generate_subscripts(url_list, 1) AS pos FROM rules) t""")
def q_url_items(spark, sf_dir):
    """One row per email x url."""
    return _bigint(R.url_items(R.with_urls(canon(spark, sf_dir))), "pos")


@register("url_report", O.with_ctes(O.CANON, _RULES) + f"""
SELECT row_idx,
  CASE WHEN len(url_list) > 0 THEN CAST(len(url_list) AS VARCHAR) || {O.sql_str(O.K.REASON_URL_COUNT_SUFFIX)} END AS url_count_reason,
  {O.first_finding('url_list')} AS first_finding,
  len(url_list) AS urls_detected, {O.suspicious_count('url_list')} AS suspicious_urls,
  round(CASE WHEN {O.suspicious_count('url_list')} > 0
        THEN least(100.0, {O.suspicious_count('url_list')} / len(url_list) * 100.0) ELSE 0.0 END, 6) AS suspicious_share,
  CAST(least(100, 25 * len(url_list)) AS BIGINT) AS url_risk
FROM rules""")
def q_url_report(spark, sf_dir):
    """Count reason, first finding, suspicious count and share, url risk."""
    return _bigint(R.url_report(R.with_urls(canon(spark, sf_dir))), "urls_detected", "suspicious_urls", "url_risk")


_FLAGS = O.flags("subject", "body")


@register("language_flags", O.with_ctes(O.CANON) + "SELECT row_idx, " + ", ".join(
    f"{_FLAGS[f'L{i + 1}']} AS {name}" for i, name in enumerate(R.LANGUAGE_FLAG_NAMES)) + " FROM canon")
def q_language_flags(spark, sf_dir):
    """One boolean per rule."""
    return R.with_language_flags(canon(spark, sf_dir)).select("row_idx", *R.LANGUAGE_FLAG_NAMES)


@register("signal_reasons", O.with_ctes(O.CANON, _RULES, _SIG) + """
SELECT row_idx, array_to_string(signals, ' | ') AS signals, len(signals) AS n_signals FROM sig""")
def q_signal_reasons(spark, sf_dir):
    """Ordered labels of the fired rules (including U3/U4)."""
    df = rules_frame(spark, sf_dir)
    return df.select("row_idx", F.array_join("signals", " | ").alias("signals"),
                     F.col("n_signals").cast("long").alias("n_signals"))


@register("safe_reasons", O.with_ctes(O.CANON, _RULES, _SIG) + f"""
SELECT row_idx, array_to_string({O.safe('signals', 'url_list', 'sender')}, ' | ') AS safe_reasons FROM sig""")
def q_safe_reasons(spark, sf_dir):
    """L12."""
    return rules_frame(spark, sf_dir).select("row_idx", F.array_join("safe_reasons", " | ").alias("safe_reasons"))


@register("topic_category", O.with_ctes(O.CANON) + f"""
SELECT row_idx, {O.topic('subject', 'body')} AS topic FROM canon""")
def q_topic(spark, sf_dir):
    """First matching topic, else General."""
    return R.with_topic(canon(spark, sf_dir)).select("row_idx", "topic")


@register("signal_summary", O.with_ctes(O.CANON, _RULES, _SIG) + """
SELECT signal, count(*) AS n FROM (SELECT unnest(signals) AS signal FROM sig) t GROUP BY signal""")
def q_signal_summary(spark, sf_dir):
    """Emails per signal label."""
    return R.signal_summary(rules_frame(spark, sf_dir))


@register("sender_report", O.with_ctes(O.CANON) + f"""
SELECT row_idx, sender, {O.sender_domain('sender')} AS sender_domain,
  CAST(CASE WHEN sender = '' THEN 0 ELSE {O.sender_base_score('sender')} END AS BIGINT) AS base_score,
  array_to_string({O.sender_indicators('sender')}, ' | ') AS indicators
FROM canon""")
def q_sender_report(spark, sf_dir):
    """Sender domain, rule score, ordered indicators (NULL for an empty sender)."""
    df = R.sender_report(canon(spark, sf_dir))
    return _bigint(df.withColumn("indicators", F.array_join("indicators", " | ")), "base_score")


# Conversation texts with characters that only look like, or normalise to, ASCII ones, so that case folding and URL
# validity are exercised; one SQL text for both engines.
_LOOKALIKE = """SELECT conv_id * 1000 + turn AS row_idx, '' AS subject, '' AS sender, coalesce(text, '') || CASE (conv_id + turn) % 9
 WHEN 0 THEN ' claim your pr\u0131ze ' WHEN 1 THEN ' pa\u017f\u017fword reset '
 WHEN 2 THEN ' see https://example.com\uff1fx now' WHEN 3 THEN ' see https://example.com\uff1a8080/x now'
 WHEN 4 THEN ' http\u017f://b.example.com/x' WHEN 5 THEN ' https://a.com\uff0fb ' WHEN 6 THEN ' UN\u017fUB\u017fCRIBE '
 WHEN 7 THEN ' https://ok.example.com/\uff1f fam\u0131ly d\u0131nner ' ELSE ' VER\u0130FY ' END AS body
FROM conversations"""
_LOOKALIKE_FLAGS = ", ".join(f"{_FLAGS[f'L{i + 1}']} AS {name}" for i, name in enumerate(R.LANGUAGE_FLAG_NAMES))


@register("lookalike_rules", f"""WITH canon AS ({_LOOKALIKE}), {_RULES}
SELECT row_idx, {_LOOKALIKE_FLAGS}, {O.topic('subject', 'body')} AS topic, array_to_string(url_list, ' | ') AS urls,
 {O.first_finding('url_list')} AS first_finding, CAST({O.suspicious_count('url_list')} AS BIGINT) AS suspicious_urls,
 list_filter(list_transform(url_list, lambda u: {O.url_error('u')}), lambda x: x IS NOT NULL)[1] AS url_error,
 array_to_string(list_transform(url_list, lambda u: {O.host('u')}), ' | ') AS hosts FROM rules""")
def q_lookalike(spark, sf_dir):
    """U1, U2, U4, U5, L1-L10 and L13 on conversation texts with look-alike characters."""
    FX.register_tables(spark, sf_dir, ["conversations"])
    df = R.with_topic(R.with_language_flags(R.with_urls(spark.sql(_LOOKALIKE))))
    return df.select("row_idx", *R.LANGUAGE_FLAG_NAMES, "topic", F.array_join("url_list", " | ").alias("urls"),
                     R.U.first_finding("url_list").alias("first_finding"), R.U.suspicious_count("url_list").cast("long").alias("suspicious_urls"),
                     R.U.first_error("url_list").alias("url_error"),
                     F.array_join(F.transform("url_list", R.U.host), " | ").alias("hosts"))


# ---------------------------------------------------------------------------
# Model as tables (M2-M4, M7-M9) and the full analysis
# ---------------------------------------------------------------------------

from ..operators import analyze as A  # noqa: E402
from ..operators import text_model as M  # noqa: E402

_ANALYSIS = O.analysis_ctes(FX.model_terms_sql(), FX.MODEL_INTERCEPT)
_ANALYSIS_SQL = O.with_ctes(O.CANON, *_ANALYSIS)


def analysis(spark, sf_dir) -> DataFrame:
    """R6 over the whole EMAILS table with the fixed model parameter."""
    return A.analyze_emails(FX.emails(spark, sf_dir), FX.model_terms(spark), FX.MODEL_INTERCEPT)


@register("term_frequencies", _ANALYSIS_SQL + "SELECT row_idx, term, tf FROM tf")
def q_term_frequencies(spark, sf_dir):
    """M2: (email, term, tf) for unigrams and bigrams of the combined text."""
    ruled = A.rule_table(FX.emails(spark, sf_dir))
    return M.doc_terms(ruled.select("row_idx", "text"))


@register("tfidf_weights", _ANALYSIS_SQL + """
SELECT wt.row_idx, wt.term, round(wt.w / sqrt(s.ss), 9) AS w FROM wt JOIN sums s USING (row_idx)""")
def q_tfidf(spark, sf_dir):
    """M4: sublinear tf x idf, L2-normalised over the model terms."""
    ruled = A.rule_table(FX.emails(spark, sf_dir))
    return (M.tfidf(ruled.select("row_idx", "text"), FX.model_terms(spark))
            .select("row_idx", "term", F.round("w", 9).alias("w")))


@register("model_scores", _ANALYSIS_SQL + """
SELECT row_idx, round(spam_risk, 4) AS spam_risk, prediction, round(confidence, 4) AS confidence FROM pr""")
def q_model_scores(spark, sf_dir):
    """M7 + M8: probability x 100 for every email, prediction and confidence."""
    ruled = A.rule_table(FX.emails(spark, sf_dir)).select("row_idx", "text")
    scored = M.predict(M.score(ruled, FX.model_terms(spark), FX.MODEL_INTERCEPT))
    return scored.select("row_idx", F.round("spam_risk", 4).alias("spam_risk"), "prediction",
                         F.round("confidence", 4).alias("confidence"))


@register("explain_terms", _ANALYSIS_SQL + """
SELECT row_idx, prediction, array_to_string(model_terms, ', ') AS model_terms FROM pr""")
def q_explain(spark, sf_dir):
    """M9: top-5 model terms in the predicted direction."""
    ruled = A.rule_table(FX.emails(spark, sf_dir)).select("row_idx", "text")
    out = M.explain_terms(M.predict(M.score(ruled, FX.model_terms(spark), FX.MODEL_INTERCEPT)))
    return out.select("row_idx", "prediction", F.array_join("model_terms", ", ").alias("model_terms"))


@register("analyze_emails", _ANALYSIS_SQL + "SELECT " + O.analysis_select() + " FROM fin")
def q_analyze(spark, sf_dir):
    """R6 (flagship): full RESULT per email, flattened; bad-url rows on the error path."""
    return A.flatten(analysis(spark, sf_dir))


@register("risk_level_summary", _ANALYSIS_SQL + f"""
SELECT CASE WHEN NOT url_error THEN prediction END AS prediction,
  CASE WHEN NOT url_error THEN {O.risk_level('overall')} END AS risk_level, count(*) AS n
FROM fin GROUP BY 1, 2""")
def q_risk_summary(spark, sf_dir):
    """Emails per prediction x risk level."""
    return A.risk_level_summary(analysis(spark, sf_dir))


# ---------------------------------------------------------------------------
# Training (M1, M3, M5, M6, M10-M12)
# ---------------------------------------------------------------------------

from ..operators import training as T  # noqa: E402
from . import retrain as RT  # noqa: E402

_SPLIT = f"""split AS (SELECT label, count(*) AS n_c, CAST(round({O.K.TEST_SHARE} * count(*)) AS BIGINT) AS t_c
 FROM training GROUP BY label)"""


def training_docs(spark, sf_dir):
    return RT.prepare_training(canon(spark, sf_dir))


@register("stratified_split_counts", O.with_ctes(O.CANON, O.TRAINING, _SPLIT) + """
SELECT CAST(label AS BIGINT) AS label, true AS is_test, t_c AS n FROM split
UNION ALL SELECT CAST(label AS BIGINT), false, n_c - t_c FROM split""")
def q_split(spark, sf_dir):
    """M1: exact per-class test share."""
    split = T.stratified_split(training_docs(spark, sf_dir))
    return _bigint(T.split_counts(split), "label")


_SIDES = f"""sides AS (SELECT t.*, row_number() OVER (PARTITION BY t.label
  ORDER BY md5('{O.K.SPLIT_SEED}' || chr(31) || subject || chr(31) || body), src_ord, row_idx) <= s.t_c AS is_test
 FROM training t JOIN split s USING (label))"""


@register("stratified_split", O.with_ctes(O.CANON, O.TRAINING, _SPLIT, _SIDES) + """
SELECT row_idx, CAST(label AS BIGINT) AS label, is_test FROM sides""")
def q_split_rows(spark, sf_dir):
    """M1: which row goes to which side."""
    return _bigint(T.stratified_split(training_docs(spark, sf_dir)).select("row_idx", "label", "is_test"), "label")


@register("class_weights", O.with_ctes(O.CANON, O.TRAINING, _SPLIT) + """
SELECT CAST(label AS BIGINT) AS label, n_c - t_c AS n,
  round(sum(n_c - t_c) OVER () / (2.0 * (n_c - t_c)), 9) AS weight FROM split""")
def q_class_weights(spark, sf_dir):
    """M5: balanced weights on the training side of the split."""
    split = T.stratified_split(training_docs(spark, sf_dir))
    w = T.class_weights(split.filter(~F.col("is_test")))
    return _bigint(w.withColumn("weight", F.round("weight", 9)), "label")


_VOCAB_SQL = O.with_ctes(
    O.CANON, O.TRAINING,
    f"tdocs AS (SELECT row_idx, trim('Subject: ' || subject || chr(10) || chr(10) || body, {O.WS_SQL}) AS text FROM training)",
    f"toks AS (SELECT row_idx, regexp_extract_all(strip_accents(lower(text)), '{O.TOKEN_RE2}') AS t FROM tdocs)",
    "terms AS (SELECT row_idx, unnest(t) AS term FROM toks UNION ALL "
    "SELECT row_idx, unnest(list_transform(t[2:], lambda x, i: t[i] || ' ' || x)) AS term FROM toks)",
    "tf AS (SELECT row_idx, term, count(*) AS tf FROM terms GROUP BY row_idx, term)",
    f"st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= {O.K.MIN_DF} "
    f"AND count(*) <= {O.K.MAX_DF} * (SELECT count(*) FROM training))") + f"""
SELECT term, df, CAST(cf AS BIGINT) AS cf, idx FROM (
  SELECT *, row_number() OVER (ORDER BY cf DESC, term) - 1 AS idx FROM st) t WHERE idx < {O.K.MAX_FEATURES}"""


@register("vocabulary", _VOCAB_SQL)
def q_vocabulary(spark, sf_dir):
    """M3: min_df / max_df filter, then the top terms by corpus count."""
    docs = training_docs(spark, sf_dir)
    return M.vocabulary(M.term_statistics(docs, "text"), docs.count()).select("term", "df", "cf", "idx")


@register("classification_metrics", _ANALYSIS_SQL.replace("WITH emails AS", "WITH emails AS", 1).rstrip()
          + ",\n" + O.TRAINING + """,
cm AS (SELECT count(*) FILTER (WHERE t.label = 1 AND p.prediction = 'SPAM') AS tp,
  count(*) FILTER (WHERE t.label = 0 AND p.prediction = 'SPAM') AS fp,
  count(*) FILTER (WHERE t.label = 1 AND p.prediction = 'HAM') AS fn,
  count(*) FILTER (WHERE t.label = 0 AND p.prediction = 'HAM') AS tn
  FROM training t JOIN pr p USING (row_idx))
SELECT round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END, 4) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM cm""")
def q_metrics(spark, sf_dir):
    """Metrics of the fixed model's predictions against the cleaned labels."""
    docs = C.training_table(canon(spark, sf_dir))
    ruled = A.rule_table(docs.select("row_idx", "subject", "body", "sender", "recipient", "label"))
    scored = M.score(ruled.select("row_idx", "label", "text"), FX.model_terms(spark), FX.MODEL_INTERCEPT)
    pred = scored.withColumn("pred", (F.col("spam_risk") >= 50).cast("int"))
    return T.classification_metrics(pred, "label", "pred")


def _retrain_dir(spark):
    from ..session import shared_dir
    return shared_dir(spark, "retrain")


GRADIENT_TOLERANCE = 1e-3
_FIT_SQL = (_VOCAB_SQL.replace(f"tdocs AS (SELECT row_idx,", f"{_SPLIT},\n{_SIDES},\ntdocs AS (SELECT row_idx,")
            .replace("AS text FROM training)", "AS text FROM sides WHERE NOT is_test)")
            .replace("(SELECT count(*) FROM training)", "(SELECT count(*) FROM tdocs)"))


@register("fit_spam_model", f"""WITH v AS ({_FIT_SQL.strip().replace('SELECT term, df, CAST(cf', 'SELECT (SELECT count(*) FROM tdocs) AS n_docs, term, df, CAST(cf')})
SELECT term, idx, n_docs, round(ln((1.0 + n_docs) / (1.0 + df)) + 1.0, 9) AS idf, true AS converged FROM v""")
def q_fit(spark, sf_dir):
    """M6 (+M3-M5): fit on the training side; the model's terms, and whether the
    objective's gradient at the solution has a norm of at most 0.001."""
    split = T.stratified_split(training_docs(spark, sf_dir))
    terms, _, n_docs, gradient = T.fit_spam_model(split.filter(~F.col("is_test")), id_col="doc", with_gradient=True)
    return terms.select("term", "idx", F.lit(n_docs).cast("long").alias("n_docs"), F.round("idf", 9).alias("idf"),
                        (F.lit(gradient) <= GRADIENT_TOLERANCE).alias("converged"))


@register("training_report", _ANALYSIS_SQL.rstrip() + ",\n" + O.TRAINING + f""",
{_SPLIT}, {_SIDES},
cm AS (SELECT CAST(count(*) FILTER (WHERE t.label = 1 AND p.prediction = 'SPAM') AS DOUBLE) AS tp,
  count(*) FILTER (WHERE t.label = 0 AND p.prediction = 'SPAM') AS fp, count(*) FILTER (WHERE t.label = 1 AND p.prediction = 'HAM') AS fn,
  count(*) FILTER (WHERE t.label = 0 AND p.prediction = 'HAM') AS tn FROM sides t JOIN pr p USING (row_idx) WHERE t.is_test)
SELECT 'merged_raw_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM canon
UNION ALL SELECT 'rows_after_label_filter', count(label) FROM canon
UNION ALL SELECT 'rows_after_nonempty_filter', count(*) FROM canon WHERE label IN (0, 1) AND length(subject) + length(body) > 0
UNION ALL SELECT 'training_rows_after_dedup', count(*) FROM training
UNION ALL SELECT 'raw_counts.' || source, count(*) FROM canon GROUP BY source
UNION ALL SELECT 'label_counts.' || label, count(*) FROM training GROUP BY label
UNION ALL SELECT 'metrics.accuracy', round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END, 4) FROM cm
UNION ALL SELECT 'metrics.precision', round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) FROM cm
UNION ALL SELECT 'metrics.recall', round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) FROM cm
UNION ALL SELECT 'metrics.f1', round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) FROM cm""")
def q_training_report(spark, sf_dir):
    """Funnel, counts and held-out metrics, with the fixed model in the fitted one's place."""
    source = stored(canon(spark, sf_dir), "training-source")  # read by the funnel, the counts and the split
    docs = stored(RT.prepare_training(source), "training-table")
    test = T.stratified_split(docs).filter("is_test")
    return RT.training_report(C.cleaning_funnel(source), C.raw_counts(source), C.label_distribution(docs),
                              RT.evaluate(test, FX.model_terms(spark), FX.MODEL_INTERCEPT))


@register("retrain_report", None)
def q_retrain(spark, sf_dir):
    """M12 + M11: the whole retraining job over the email corpus merged with
    the conversations table; returns the run report."""
    frames = [canon(spark, sf_dir), conversations_corpus(spark, sf_dir)]
    report, _, _ = RT.retrain(frames, _retrain_dir(spark))
    return report


# ---------------------------------------------------------------------------
# History and dashboard
# ---------------------------------------------------------------------------

from ..sources import history_io as HIO  # noqa: E402

RAW = ("sender", "recipient", "subject", "body")
_HIST = f"""hist AS (SELECT md5(CAST(f.row_idx AS VARCHAR)) AS id, e.sender, e.recipient, e.subject, e.body,
  f.prediction AS classification, round(f.spam_risk, 1) AS spam_risk, round(f.confidence, 1) AS confidence,
  f.overall AS overall_risk, f.reasons, e.created_at, {O.risk_level('f.overall')} AS risk_level,
  f.row_idx AS src_row
 FROM fin f JOIN emails e USING (row_idx) WHERE NOT f.url_error)"""
_HIST_SQL = O.with_ctes(O.CANON, *_ANALYSIS, _HIST)


def history(spark, sf_dir) -> DataFrame:
    """HISTORY rows for every analysed email: raw request fields, results,
    ``id = md5(row_idx)`` and ``created_at`` from the fixture."""
    e = FX.emails(spark, sf_dir)
    e = e.select("row_idx", "created_at", *RAW, *[F.col(c).alias(f"raw_{c}") for c in RAW])
    res = A.analyze_emails(e, FX.model_terms(spark), FX.MODEL_INTERCEPT,
                           keep=("created_at", *[f"raw_{c}" for c in RAW]))
    return HIO.history_records(res, id_col=F.md5(F.col("row_idx").cast("string")), created_at=F.col("created_at"))


def stored_history(spark, sf_dir) -> DataFrame:
    """S6 -> S7: the detections appended to a history table and read from it."""
    from ..session import shared_dir
    path = shared_dir(spark, "history")
    HIO.append_history(history(spark, sf_dir), path)
    return HIO.read_history(spark, path)


@register("history_roundtrip", _HIST_SQL + """
SELECT id, classification, spam_risk, overall_risk, array_to_string(reasons, ' | ') AS reasons, risk_level FROM hist""")
def q_history_roundtrip(spark, sf_dir):
    """S6 + S7: write the history in its JSON exchange form, read it back, parse."""
    from ..session import shared_dir
    path = shared_dir(spark, "history-wire")
    HIO.to_wire(history(spark, sf_dir)).write.mode("overwrite").parquet(path)
    back = HIO.from_wire(spark.read.parquet(path))
    return back.select("id", "classification", "spam_risk", "overall_risk",
                       F.array_join("reasons", " | ").alias("reasons"), F.col("features.risk_level").alias("risk_level"))


@register("history_list", _HIST_SQL + """
SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS number, classification FROM hist""")
def q_history_list(spark, sf_dir):
    """S6 -> S7 -> H1: append the detections to a history table, then list it
    newest first with a 1-based number over the whole table."""
    return H.history_list(stored_history(spark, sf_dir)).select("id", F.col("number").cast("long"), "classification")


@register("history_page", _HIST_SQL + """
SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS number, subject FROM hist
ORDER BY created_at DESC, id LIMIT 25""")
def q_history_page(spark, sf_dir):
    """H1 for one page: the 25 newest detections (the top-k is the feature)."""
    return H.history_page(stored_history(spark, sf_dir), 25).select("id", F.col("number").cast("long"), "subject")


def indexed_history(spark, sf_dir) -> str:
    """A history table in files of its own order with its indexes; the folder."""
    from ..session import shared_dir
    path = shared_dir(spark, "history")
    HIO.append_history(history(spark, sf_dir), path)
    HIO.arrange_history(spark, path)
    HIO.index_history(spark, path)
    return path


@register("history_page_deep", _HIST_SQL + """
SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS number, subject FROM hist
ORDER BY created_at DESC, id LIMIT 25 OFFSET 100""")
def q_history_page_deep(spark, sf_dir):
    """H1 for the fifth page of the stored history (the page is the feature)."""
    return HIO.stored_page(spark, indexed_history(spark, sf_dir), 100, 25).select("id", F.col("number").cast("long"), "subject")


@register("history_search_indexed", _HIST_SQL + """
SELECT id FROM hist WHERE contains(lower(coalesce(sender, '') || ' ' || coalesce(subject, '') || ' ' || coalesce(body, '')), 'account')""")
def q_history_search_indexed(spark, sf_dir):
    """H3 through the substring index."""
    return HIO.stored_search(spark, indexed_history(spark, sf_dir), "Account").select("id")


@register("history_by_class", _HIST_SQL + "SELECT id, spam_risk FROM hist WHERE classification = 'SPAM'")
def q_history_by_class(spark, sf_dir):
    """H2."""
    return H.history_by_class(stored_history(spark, sf_dir), "SPAM").select("id", "spam_risk")


@register("history_search", _HIST_SQL + """
SELECT id FROM hist WHERE contains(lower(coalesce(sender, '') || ' ' || coalesce(subject, '') || ' ' || coalesce(body, '')), 'account')""")
def q_history_search(spark, sf_dir):
    """H3: case-insensitive substring search for 'Account'."""
    return H.history_search(stored_history(spark, sf_dir), "Account").select("id")


@register("history_detail", _HIST_SQL + "SELECT id, sender, subject, overall_risk FROM hist WHERE id = md5('2')")
def q_history_detail(spark, sf_dir):
    """H4: one record by id."""
    import hashlib
    rid = hashlib.md5(b"2").hexdigest()
    return H.history_detail(stored_history(spark, sf_dir), rid).select("id", "sender", "subject", "overall_risk")


@register("history_delete", _HIST_SQL + """
SELECT id FROM hist WHERE id NOT IN (SELECT md5(CAST(doc_id AS VARCHAR)) FROM labels)""")
def q_history_delete(spark, sf_dir):
    """H5: delete the records of every labelled document from the stored history (unknown ids are no-ops)."""
    from ..session import shared_dir
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.md5(F.col("doc_id").cast("string")).alias("id"))
    path = shared_dir(spark, "history")
    HIO.append_history(history(spark, sf_dir), path)
    HIO.delete_history(spark, path, ids)
    return HIO.read_history(spark, path).select("id")


@register("dashboard_totals", _HIST_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE classification = 'SPAM') AS spam,
  count(*) FILTER (WHERE classification IS DISTINCT FROM 'SPAM') AS not_spam FROM hist""")
def q_totals(spark, sf_dir):
    """H6."""
    return H.dashboard_totals(stored_history(spark, sf_dir))


_BREAKDOWN = f"""bd AS (SELECT {O.history_domain('sender')} AS domain,
  count(*) FILTER (WHERE classification = 'SPAM') AS spam,
  count(*) FILTER (WHERE classification IS DISTINCT FROM 'SPAM') AS ham FROM hist GROUP BY 1)"""


@register("domain_breakdown", _HIST_SQL + "," + _BREAKDOWN + " SELECT domain, spam, ham FROM bd")
def q_breakdown(spark, sf_dir):
    """H7: spam/ham per sender domain key."""
    return H.domain_breakdown(stored_history(spark, sf_dir))


@register("domain_percentages", _HIST_SQL + "," + _BREAKDOWN + """
SELECT domain, spam, ham,
  CASE WHEN spam + ham > 0 THEN round(spam / (spam + ham) * 100.0, 2) ELSE 0.0 END AS spam_pct,
  CASE WHEN spam + ham > 0 THEN round(ham / (spam + ham) * 100.0, 2) ELSE 0.0 END AS ham_pct FROM bd""")
def q_percentages(spark, sf_dir):
    """H8."""
    return H.domain_percentages(H.domain_breakdown(stored_history(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------

from ..streaming import dashboard_stream as DS  # noqa: E402
from ..streaming import score_stream as SS  # noqa: E402


def stream_history(spark, sf_dir, n_files: int = 4) -> str:
    """Run T1 over the EMAILS rows landed as Parquet files, in ``n_files`` micro-batches
    of one file a core at least; returns the history folder."""
    from ..session import shared_dir
    inbox, hist, ckpt = shared_dir(spark, "inbox"), shared_dir(spark, "history"), shared_dir(spark, "ckpt-score")
    e = FX.emails(spark, sf_dir).select(*[f.name for f in SS.EMAIL_STREAM_SCHEMA.fields])
    cores = spark.sparkContext.defaultParallelism  # a small file is one task, so a micro-batch of one file would run on one core
    e.repartition(n_files * cores).write.mode("overwrite").parquet(inbox)
    q = SS.start_score_stream(spark, inbox, hist, ckpt, FX.model_terms(spark), FX.MODEL_INTERCEPT,
                              id_col=F.md5(F.col("row_idx").cast("string")), created_at=F.col("created_at"),
                              max_files_per_trigger=cores)
    q.awaitTermination()
    return hist


@register("stream_score", _HIST_SQL + """
SELECT id, classification, spam_risk, overall_risk, array_to_string(reasons, ' | ') AS reasons FROM hist""")
def q_stream_score(spark, sf_dir):
    """File stream -> analysis per micro-batch -> history (equals batch R6 + S6)."""
    h = HIO.read_history(spark, stream_history(spark, sf_dir))
    return h.select("id", "classification", "spam_risk", "overall_risk",
                    F.array_join("reasons", " | ").alias("reasons"))


@register("stream_dashboard", _HIST_SQL + "," + _BREAKDOWN + " SELECT domain, spam, ham FROM bd")
def q_stream_dashboard(spark, sf_dir):
    """Running per-domain counts over the history stream written by T1."""
    return DS.read_dashboard(spark, run_dashboard(spark, stream_history(spark, sf_dir)))


@register("stream_dashboard_ranked", _HIST_SQL + f""",
bd AS (SELECT {O.history_domain('sender')} AS domain, count(*) FILTER (WHERE classification = 'SPAM') AS spam,
  count(*) FILTER (WHERE classification IS DISTINCT FROM 'SPAM') AS ham, max(created_at) AS last FROM hist GROUP BY 1)
SELECT row_number() OVER (ORDER BY spam + ham DESC, last DESC NULLS LAST, domain) AS place, domain, spam, ham FROM bd""")
def q_stream_ranked(spark, sf_dir):
    """T2 in H7's order, after a replayed batch, a deletion with its records appended again, and a compaction."""
    path = stream_history(spark, sf_dir)
    gone = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.md5(F.col("doc_id").cast("string")).alias("id"))
    again = HIO.read_history(spark, path).join(gone, "id", "left_semi")
    out, ckpt = run_dashboard(spark, path, both=True)
    HIO.delete_history(spark, path, gone)
    DS.start_dashboard_stream(spark, path, out, ckpt).awaitTermination()
    HIO.append_history(again, path, "again")
    HIO.compact_history(spark, path)
    DS.start_dashboard_stream(spark, path, out, ckpt).awaitTermination()
    return DS.read_ranked(spark, out)


def run_dashboard(spark, hist: str, both: bool = False):
    """Run T2 over what the history holds now; returns the folder of result versions (and the stream's checkpoint)."""
    from ..session import shared_dir
    out, ckpt = shared_dir(spark, "dashboard"), shared_dir(spark, "ckpt-dash")
    DS.start_dashboard_stream(spark, hist, out, ckpt).awaitTermination()
    return (out, ckpt) if both else out


@register("stream_totals", _HIST_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE classification = 'SPAM') AS spam,
  count(*) FILTER (WHERE classification IS DISTINCT FROM 'SPAM') AS not_spam FROM hist""")
def q_stream_totals(spark, sf_dir):
    """T2 + H6: running totals over the history stream written by T1."""
    return DS.dashboard_totals(DS.read_dashboard(spark, run_dashboard(spark, stream_history(spark, sf_dir))))


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------

from ..sources import corpus_io as CIO  # noqa: E402
from ..sources import model_store as MS  # noqa: E402

_RAW_LAYOUT = ["sender", "recipient", "subject", "body", "label_raw", "created_at"]


def _landed(spark, sf_dir, kind: str) -> str:
    """Write the raw EMAILS layout (no position column) in input order."""
    from ..session import shared_dir
    e = FX.emails(spark, sf_dir).orderBy("row_idx").select(*_RAW_LAYOUT)
    if kind == "csv":
        path = shared_dir(spark, "emails") + ".csv.gz"
        CIO.write_csv(e, path)
    elif kind == "plain csv":
        path = shared_dir(spark, "emails") + ".csv"
        CIO.write_csv(e, path, compression="none")
    else:
        path = shared_dir(spark, "emails") + ".parquet.gzip"
        e.write.mode("overwrite").option("compression", "gzip").parquet(path)
    return path


_CORPUS_SQL = O.with_ctes(O.CANON, O.CORPUS) + """
SELECT row_idx, subject, body, sender, recipient, CAST(label AS BIGINT) AS label FROM corpus"""


@register("corpus_csv_roundtrip", _CORPUS_SQL)
def q_csv_roundtrip(spark, sf_dir):
    """S4 + S1: gzip CSV written and read back (multi-line bodies, file order), then C7."""
    table = C.corpus_table(CIO.load_corpus(spark, _landed(spark, sf_dir, "csv")))
    return _bigint(table.select("row_idx", "subject", "body", "sender", "recipient", "label"), "label")


@register("corpus_csv_split", _CORPUS_SQL)
def q_csv_split(spark, sf_dir):
    """Plain CSV with newlines in bodies, cut at any byte, then C7."""
    table = C.corpus_table(CIO.load_corpus(spark, _landed(spark, sf_dir, "plain csv")))
    return _bigint(table.select("row_idx", "subject", "body", "sender", "recipient", "label"), "label")


@register("corpus_parquet_roundtrip", _CORPUS_SQL)
def q_parquet_roundtrip(spark, sf_dir):
    """A '.parquet.gzip' name is tried as Parquet (row order from the file), then C7."""
    table = C.corpus_table(CIO.load_corpus(spark, _landed(spark, sf_dir, "parquet")))
    return _bigint(table.select("row_idx", "subject", "body", "sender", "recipient", "label"), "label")


@register("replace_corpus", _CORPUS_SQL)
def q_replace(spark, sf_dir):
    """Load a corpus file, then another one in its place; the rows of the table then."""
    from ..session import shared_dir
    dest = shared_dir(spark, "corpus")
    CIO.replace_corpus(spark, _landed(spark, sf_dir, "parquet"), dest)
    CIO.replace_corpus(spark, _landed(spark, sf_dir, "csv"), dest)
    return _bigint(CIO.read_corpus_table(spark, dest).select("row_idx", "subject", "body", "sender", "recipient", "label"), "label")


@register("stored_emails_at", O.with_ctes(O.CANON, O.CORPUS) + """
SELECT c.row_idx, c.subject, c.sender FROM corpus c WHERE c.row_idx IN (SELECT doc_id FROM labels)""")
def q_stored_emails_at(spark, sf_dir):
    """C9 on a stored corpus through its position index."""
    from ..session import shared_dir
    dest = shared_dir(spark, "corpus")
    CIO.replace_corpus(spark, _landed(spark, sf_dir, "parquet"), dest)
    positions = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("pos"))
    return CIO.stored_emails_at(spark, dest, positions).select("row_idx", "subject", "sender")


@register("model_roundtrip", _ANALYSIS_SQL + """
SELECT row_idx, round(spam_risk, 4) AS spam_risk, prediction FROM pr""")
def q_model_roundtrip(spark, sf_dir):
    """Save the term table + intercept, load them, score every email."""
    from ..session import shared_dir
    path = shared_dir(spark, "model")
    MS.save_model(FX.model_terms(spark), FX.MODEL_INTERCEPT, 0, path)
    terms, intercept = MS.load_model(spark, path)
    ruled = A.rule_table(FX.emails(spark, sf_dir)).select("row_idx", "text")
    scored = M.predict(M.score(ruled, terms, intercept))
    return scored.select("row_idx", F.round("spam_risk", 4).alias("spam_risk"), "prediction")
