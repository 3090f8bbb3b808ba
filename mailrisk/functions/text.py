"""Text column expressions: cleaning, label normalisation, combined text, tokens.

All of these are plain ``Column`` expressions evaluated inside whole-stage
codegen.  The single exception is the accent fold, a vectorised pandas UDF
that only ever receives the rows that actually contain non-ASCII text (the
argument is NULL for ASCII rows, so Arrow ships almost nothing for them).
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .regex import PY_WHITESPACE, TOKEN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean(col) -> Column:
    """NULL -> '' and strip Python whitespace (not only U+0020) at both ends."""
    return F.coalesce(F.trim(_c(col).cast("string"), F.lit(PY_WHITESPACE)), F.lit(""))


# A decimal literal as Python's float() reads it (ASCII digits, '_' between
# digits); Spark's cast alone would also take "1d", "1f" or "0x1p0".
_DIGITS = r"[0-9](?:_?[0-9])*"
PY_FLOAT = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?$"


def normalize_label(col) -> Column:
    """Alias spellings, else a number equal to 0 or 1, else NULL (INT)."""
    s = F.lower(F.trim(_c(col).cast("string"), F.lit(PY_WHITESPACE)))
    as_double = F.when(s.rlike(PY_FLOAT), F.regexp_replace(s, "_", "").try_cast("double"))
    return (F.when(_c(col).isNull(), F.lit(None).cast("int"))
            .when(s.isin(K.SPAM_SPELLINGS), F.lit(1))
            .when(s.isin(K.HAM_SPELLINGS), F.lit(0))
            .when(as_double == 1.0, F.lit(1))
            .when(as_double == 0.0, F.lit(0))
            .otherwise(F.lit(None).cast("int")))


def combine_text(subject, body) -> Column:
    """``"Subject: {subject}\\n\\n{body}"`` stripped (inputs already cleaned)."""
    return F.trim(F.concat(F.lit(K.SUBJECT_PREFIX), _c(subject), F.lit("\n\n"), _c(body)),
                  F.lit(PY_WHITESPACE))


def joined(subject, body, sep: str) -> Column:
    return F.concat(_c(subject), F.lit(sep), _c(body))


# ---------------------------------------------------------------------------
# Tokens (M2): lower-case, NFKD accent strip, words of >= 2 word characters,
# unigrams followed by adjacent bigrams.
# ---------------------------------------------------------------------------

# Ship this module's UDF code by value: executors' Python workers then need
# nothing but pyspark/pandas, whatever the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _fold_one(t):
    if t is None:
        return None
    t = t.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _fold_non_ascii(s: pd.Series) -> pd.Series:
    return s.map(_fold_one, na_action="ignore")


# Accent fold table for U+0080..U+024F, derived by rule: characters whose
# NFKD form without combining marks is a single other character.  Characters
# of that range that fold to several characters, and every character beyond
# it, send their row to the Python fold instead.
_TABLE_END = 0x24F


def _latin_fold_table():
    src, dst, multi = [], [], []
    for cp in range(0x80, _TABLE_END + 1):
        c = chr(cp)
        f = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if f != c:
            if len(f) == 1:
                src.append(c)
                dst.append(f)
            else:
                multi.append(c)
    return "".join(src), "".join(dst), multi


FOLD_SRC, FOLD_DST, _FOLD_MULTI = _latin_fold_table()
# One class whose first part rules ASCII out, so the ranges behind it are tried for other characters only.
NEEDS_PYTHON_FOLD = (f"[[^\\x{{0}}-\\x{{7f}}]&&[[^\\x{{0}}-\\x{{{_TABLE_END:x}}}]"
                     + "".join(f"\\x{{{ord(c):x}}}" for c in _FOLD_MULTI) + "]]")


def fold_case_accents(col) -> Column:
    """Lower-case and strip accents (Python ``lower`` then NFKD without
    combining marks).  ASCII rows only lower-case; rows whose lower-cased
    text stays within U+0000..U+024F fold through a ``translate`` table in
    the JVM; only the remaining rows go through the Python fold."""
    c = _c(col)
    low = F.lower(c)
    non_ascii = F.octet_length(c) != F.length(c)
    needs_python = non_ascii & low.rlike(NEEDS_PYTHON_FOLD)
    # translate looks every character up in a map, so it only gets the words that are not ASCII
    fold = lambda w: F.when(F.octet_length(w) != F.length(w), F.translate(w, FOLD_SRC, FOLD_DST)).otherwise(w)
    jvm = F.when(non_ascii, F.array_join(F.transform(F.split(low, " "), fold), " ")).otherwise(low)
    return F.coalesce(_fold_non_ascii(F.when(needs_python, c)), jvm)


def word_tokens(folded) -> Column:
    return F.regexp_extract_all(_c(folded), F.lit(TOKEN), 0)


def ngrams_1_2(tokens) -> Column:
    """Unigrams then bigrams ``"a b"`` of adjacent tokens, in document order."""
    t = _c(tokens)
    n = F.size(t)
    k = F.greatest(n - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(t, 1, k), F.slice(t, 2, k), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(t, bigrams)
