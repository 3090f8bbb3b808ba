"""Regular expressions in the two dialects used by the engine.

Spark evaluates ``rlike``/``regexp_*`` with ``java.util.regex``; the DuckDB
oracle uses RE2.  Python's ``re`` (whose behaviour the rules reproduce)
differs from both on word boundaries, ``\\s``, ``\\d`` and ``.``, so every
pattern is generated here for each dialect from the keyword lists in
``constants`` instead of being written twice by hand:

* word characters are ``[\\p{L}\\p{N}_]`` (Python's ``str.isalnum`` or ``_``);
  Java gets look-arounds, RE2 (no look-arounds) a consumed neighbour, which is
  equivalent for "does it match" tests;
* ``\\d`` becomes ``\\p{Nd}``;
* ``.`` must not cross ``\\n`` only: Java runs in UNIX_LINES mode ``(?d)``;
* whitespace is Python's ``str.isspace`` set, spelled as ``\\x{..}`` escapes
  understood by both engines.
"""

from __future__ import annotations

import re

from .. import constants as K

WORD = r"\p{L}\p{N}_"

# Python's str.isspace() set, derived by rule (all such code points are < U+3001).
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WS_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE)


def _digits(fragment: str) -> str:
    return fragment.replace(r"\d", r"\p{Nd}")


def _alt(words) -> str:
    return "(?:" + "|".join(_digits(w) for w in words) + ")"


def _starts(words) -> str:
    """Lookahead for the first letters of the words, so that the look-behind and the words are tried
    only where one can begin; empty unless every word begins with a letter that must be there."""
    if not all(re.match(r"[a-z](?![?*{|])", w) for w in words):
        return ""
    return "(?=[" + "".join(sorted({w[0] for w in words})) + "])"


def java_words(words, ignore_case: bool = True) -> str:
    flags = "(?diu)" if ignore_case else "(?d)"
    return f"{flags}{_starts(words)}(?<![{WORD}]){_alt(words)}(?![{WORD}])"


def re2_words(words, ignore_case: bool = True) -> str:
    flags = "(?i)" if ignore_case else ""
    return f"{flags}(?:^|[^{WORD}]){_alt(words)}(?:$|[^{WORD}])"


def java_verification() -> str:
    lead, obj, signin = _alt(K.VERIFY_LEAD_WORDS), _alt(K.VERIFY_OBJECT_WORDS), _alt(K.SIGN_IN_WORDS)
    return (f"(?diu){_starts(K.VERIFY_LEAD_WORDS)}(?<![{WORD}]){lead}.{{0,{K.VERIFY_GAP_MAX}}}(?<![{WORD}]){obj}(?![{WORD}])"
            f"|{_starts(K.SIGN_IN_WORDS)}(?<![{WORD}]){signin}(?![{WORD}])")


def re2_verification() -> str:
    # ".{0,60}\b" before a word character: the gap is non-empty and ends with
    # a non-word, non-newline character.
    lead, obj, signin = _alt(K.VERIFY_LEAD_WORDS), _alt(K.VERIFY_OBJECT_WORDS), _alt(K.SIGN_IN_WORDS)
    return (f"(?i)(?:^|[^{WORD}]){lead}.{{0,{K.VERIFY_GAP_MAX - 1}}}[^{WORD}\\n]{obj}(?:$|[^{WORD}])"
            f"|(?:^|[^{WORD}]){signin}(?:$|[^{WORD}])")


# URL extraction: https?:// followed by characters that are not whitespace or <>"'
URL_PATTERN = "(?iu)https?://[^" + WS_CLASS + "<>\"']+"
PUNCT_RUNS = r"!{2,}|\?{2,}"
IPV4_HOST = r"^\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}$"
SENDER_SHAPE = "^[^" + WS_CLASS + "@]+@[^" + WS_CLASS + "@]+\\.[^" + WS_CLASS + "@]+$"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def required_literal(fragment: str) -> str:
    """A substring every match of a keyword fragment contains: drop optional
    characters (``x?``), then keep the longest run free of regex syntax."""
    plain = re.sub(r".[?*]", "", fragment)
    pieces = re.split(r"\[[^\]]*\]|\\[a-zA-Z](?:\{[^}]*\})?[+*?]?|[().|+^$]", plain)
    return max(pieces, key=len)


def required_literals(words) -> list[str]:
    return sorted({required_literal(w) for w in words})


def sql_str(s: str) -> str:
    """Quote a string as a SQL literal (standard SQL: no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"
