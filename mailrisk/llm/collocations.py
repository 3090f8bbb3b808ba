"""Phrase collocation mining (operator 13): SON partitioning with exact counts.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``; everything is counted per lang.  A phrase is 1 to ``LONGEST`` words of a piece.

1. Mine.  A shard is a run of about ``SHARD_BYTES`` of texts inside a task.  With a share w of a
   lang's bytes, a shard reports each phrase that it holds at least ``ceil(support * w)`` times.
   The shares of a lang add up to 1, so a phrase below its local support in every shard is below
   the support everywhere.  Phrases are mined level by level (a phrase is tried only where the two
   phrases one word shorter are frequent) and in the rounds ``ROUNDS``: words, pairs, longer ones; a
   round starts from the phrases that the union of the round before left.
2. Union.  Reports (a 64-bit digest and a count) are added up.  A shard that did not report a
   phrase holds it at most ``ceil(support * w) - 1`` times, so a phrase stays a candidate only if
   its reported counts and that slack reach the support.  Digests that collide only add candidates.
3. Count.  A round's candidates go into a Bloom filter of ``BLOOM_BITS`` bits, whose size does not
   depend on the input; filters and a row a lang are the only broadcasts.  Every text is then read
   again and the phrases that the filters hold are counted by their words: exact counts, from
   which phrases below the support go.  False positives of a filter cost time, never rows.
4. Score.  Cuts of a phrase meet the counts of their two parts in a join that is salted, since a
   third of all phrases may start with one word.  Scores are exact decimal integers.  Joins with
   exploded tables are sort-merge joins by hint: Spark sizes such a table by what lies under the
   explode, takes ``SALT`` times the phrases for small and would collect them on the driver.

No text is shuffled.  While mining, a task holds 8-byte digests of a shard's words, not its texts;
while counting, the exact codes of a smaller run of texts and the counts of up to
``COMBINED_ROWS + ADDED_ROWS`` phrases.

With support fixed and the input growing, shares shrink and local supports fall towards 1; then
a round reports every phrase of a shard that its filter lets through once, and the slack is 0.

Edge cases: null text is empty, null lang is ``und`` (with the rows whose lang is that string);
repeated rows count each; a lang without candidates has no rows, an empty table none at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, map_arrow, pick, stored
from .exact import paired, span_codes, spans
from .kernels import U, mix, text_slices, words

SUPPORT = 100
LONGEST = 5
TOP = 2000
ROUNDS = ((1, 1), (2, 2), (3, LONGEST))
SHARD_BYTES = 16 << 20
LEAST_SHARDS = 64  # a small corpus is cut finer, so that it spreads over a cluster too
COUNT_BYTES = 2 << 20
COUNT_TASK_BYTES = 256 << 20  # texts that a task counts at most where the cores alone would give it more
COMBINED_ROWS = 1 << 19  # counts that a task holds at most before it hands them on
ADDED_ROWS = 1 << 18  # counts of further runs that wait until they are added to those
BATCH_ROWS = 1 << 16  # rows of a record batch that a task hands on
BLOCK = 1 << 17  # words whose temporaries are held at a time
BLOOM_BITS = 1 << 26
PROBES = 4
SALT = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, dtype=bool)
_CUT[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_WORD = ~_CUT
_WORD[[0x20, 0x09]] = False
_HASHED = np.where(_WORD, _LOWER, 0).astype(np.uint8)  # for the hash of words; a NUL is a word byte and stands as 1
_HASHED[0] = 1


def slices(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(lang of each text, bytes, offsets)`` of runs of a few texts."""
    number = {x: i for i, x in enumerate(langs)}
    for b in batches:
        coded = b.column(0).dictionary_encode()
        codes = np.array([number[x] for x in coded.dictionary.to_pylist()], dtype=np.int64)
        rows = codes[coded.indices.to_numpy()] if len(codes) else np.zeros(0, np.int64)
        for lo, hi, buf, off in text_slices(b.column(1)):
            yield rows[lo:hi], buf, off


def pieces(buf: np.ndarray, off: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and text of every word; both numbers only grow."""
    doc = np.searchsorted(off, starts, "right") - 1
    return np.searchsorted(np.flatnonzero(_CUT[buf]), starts) + doc, doc


def seeds(langs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in langs), dtype=U, count=len(langs))


def word_digests(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digest and start of every word."""
    h, starts, _ = words(buf, off, _HASHED)
    return h, starts


def blocks(n: int, size: int = BLOCK) -> Iterator[slice]:
    """The range ``0..n`` in parts of ``size``."""
    return (slice(lo, min(n, lo + size)) for lo in range(0, n, size))


def longer(digest: np.ndarray, word: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Digest of phrases with one word more, the word at ``last``."""
    out = np.empty(len(digest), dtype=U)
    for s in blocks(len(digest)):
        out[s] = mix(digest[s] * U(0x9E3779B97F4A7C15) + word[last[s]])
    return out


def extended(at: np.ndarray, k: int, piece: np.ndarray) -> np.ndarray:
    """Which of the kept places ``at`` of phrases of k - 1 words can start one of k: the next place is kept too, in the same piece."""
    kept = np.zeros(len(piece) + 1, dtype=bool)
    kept[at] = True
    out = np.empty(len(at), dtype=bool)
    for s in blocks(len(at)):
        first, last = at[s], at[s] + (k - 1)
        ok = kept[first + 1] & (last < len(piece))
        ok[ok] = piece[first[ok]] == piece[last[ok]]
        out[s] = ok
    return out


def alike(digest: np.ndarray, size: int = 4 * BLOCK) -> Iterator[np.ndarray]:
    """Places of ``digest`` in sets of about ``size``, all equal digests in one of them."""
    bits = max(0, -(-len(digest) // size) - 1).bit_length()
    for i in range(1 << bits):
        yield np.concatenate([np.flatnonzero(digest[s] >> U(64 - bits) == U(i)) + s.start for s in blocks(len(digest))]) if bits else np.arange(len(digest))


def mine(word: np.ndarray, piece: np.ndarray, lang: np.ndarray, least: np.ndarray, filters: list[np.ndarray], first: int,
         last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(digest, count, lang)`` of a shard's phrases of ``first`` to ``last`` words that reach their lang's ``least`` count.

    They come in parts of at most ``BATCH_ROWS``; besides a number and a digest a word, temporaries are those of a block.
    """
    at, digest = np.arange(len(word), dtype=np.int32), word
    for k in range(1, last + 1):
        if k > 1:
            ok = extended(at, k, piece)
            at, digest = at[ok], digest[ok]
            digest = longer(digest, word, at + (k - 1))
        if not len(at):
            return
        if k < first:
            held = may_hold(filters[k], digest)
        else:
            held = np.zeros(len(at), dtype=bool)
            for part in alike(digest):
                order = part[np.argsort(digest[part])]
                d = digest[order]
                new = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else np.zeros(0, np.int64)
                count = np.diff(np.append(new, len(d)))
                of = lang[at[order[new]]]
                enough = count >= least[of]
                held[order] = np.repeat(enough, count)
                found = d[new[enough]], count[enough], of[enough]
                for s in blocks(len(found[0]), BATCH_ROWS):
                    yield tuple(x[s] for x in found)
        at, digest = at[held], digest[held]


class Run:
    """Exact word codes of a run of texts, in order; a phrase of k words is named by a code and its first place."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: np.ndarray):
        langs, bufs, offs = zip(*parts, strict=True)
        buf, off = np.concatenate(bufs), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(o) for o in offs]))))
        inside = _WORD[buf]
        starts, ends = spans(inside, off)
        self.piece, doc = pieces(buf, off, starts)
        self.word, self.words = span_codes(_LOWER[buf], inside, starts, ends)
        self.lang = np.concatenate(langs)[doc]
        hashed = np.concatenate([word_digests(b, o)[0] for _, b, o in parts])
        self.digest = mix(hashed ^ seed[self.lang]) if len(hashed) else hashed

    def phrases(self, filters: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(k, first places, counts)`` of the distinct phrases of k words that the filters hold, k = 1, 2, ..."""
        at, code, digest = np.arange(len(self.word)), paired(self.word, self.lang), self.digest
        for k in range(1, len(filters)):
            if k > 1:
                ok = extended(at, k, self.piece)
                at, digest, code = at[ok], digest[ok], code[ok]
                digest = longer(digest, self.digest, at + (k - 1))
            held = may_hold(filters[k], digest)
            at, code, digest = at[held], code[held], digest[held]
            if not len(at):
                return
            code = paired(code, self.word[at + k - 1]) if k > 1 else pd.factorize(code)[0].astype(np.int64)
            first = np.empty(int(code.max()) + 1, dtype=np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            yield k, at[first], np.bincount(code)

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words at the places ``at``, joined by spaces."""
        words = [self.words.take(pa.array(self.word[at + j])).cast(pa.large_binary()) for j in range(k)]
        joined = words[0] if k == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.large_string()).cast(pa.string())


def local_supports(lang_bytes: np.ndarray, own: np.ndarray, support: int) -> np.ndarray:
    """Least count that a shard reports, by lang: the support times the shard's share of the lang's bytes, rounded up."""
    return np.array([max(1, -(-support * int(b) // max(1, int(t)))) for b, t in zip(own, lang_bytes, strict=True)], dtype=np.int64)


def reports(texts: DataFrame, langs: dict[str, int], support: int, size: int, filters, first: int, last: int) -> DataFrame:
    """What the shards report of phrases of ``first`` to ``last`` words: ``(lang, digest, over, slack, words)``.

    ``lang`` is a number; ``over`` is how far a phrase's local count lies above the largest count
    that a shard keeps to itself.  One row a shard and lang has no digest and carries that count
    (``slack``) and the shard's words.  Every text counts one byte more than it has.
    """
    names, total = list(langs), np.array(list(langs.values()))

    def look(batches):
        seed, held = seeds(names), filters.value if filters is not None else []

        def out(cols):
            return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, int) else pa.nulls(c, t) for c, t in zip(
                cols, [pa.int32(), *[pa.int64()] * 4], strict=True)], ["lang", "digest", "over", "slack", "words"])

        def cut(parts, own):
            joined = []
            for column in parts:
                joined.append(np.concatenate(column))
                column.clear()
            word, piece, lang = joined
            least, there = local_supports(total, own, support), np.flatnonzero(own)
            yield out([there, len(there), len(there), least[there] - 1, np.bincount(lang, minlength=len(names))[there]])
            for digest, count, of in mine(word, piece, lang, least, held, first, last):
                yield out([of, digest.view(np.int64), count - (least[of] - 1), len(of), len(of)])

        parts, filled, own, base = ([], [], []), 0, np.zeros(len(names), np.int64), 0
        for rows, buf, off in slices(batches, names):
            if filled and filled + len(buf) > size:
                yield from cut(parts, own)
                parts, filled, own, base = ([], [], []), 0, np.zeros(len(names), np.int64), 0
            h, starts = word_digests(buf, off)
            piece, doc = pieces(buf, off, starts)
            for column, x in zip(parts, (mix(h ^ seed[rows[doc]]) if len(h) else h, (piece + base).astype(np.int32), rows[doc].astype(np.int16)), strict=True):
                column.append(x)
            base = int(parts[1][-1][-1]) + 1 if len(h) else base
            own += np.bincount(rows, weights=np.diff(off) + 1, minlength=len(names)).astype(np.int64)
            filled += len(buf)
        if parts[0]:
            yield from cut(parts, own)

    return map_arrow(texts, look, "lang int, digest long, over long, slack long, words long")


def bloom(digests: DataFrame, bits: int, probes: int = PROBES) -> np.ndarray:
    """Bit array of the digests; its 64-bit words are made by Spark, so the driver sees at most ``bits / 64`` of them."""

    def places(batches):
        for b in batches:
            at = _places(b.column(0).to_numpy().view(U), bits, probes).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(U(1), (at & 63).astype(U)).view(np.int64))], ["word", "mask"])

    words = map_arrow(digests.select("digest"), places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, dtype=U)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(U)
    return out


def _places(digest: np.ndarray, bits: int, probes: int) -> np.ndarray:
    step = mix(digest ^ U(0xD6E8FEB86659FD93)) | U(1)
    return np.stack([((digest + U(j) * step) % U(bits)).astype(np.int64) for j in range(probes)])


def may_hold(words: np.ndarray, digest: np.ndarray, probes: int = PROBES) -> np.ndarray:
    found = np.ones(len(digest), dtype=bool)
    for s in blocks(len(digest)):
        for at in _places(digest[s], len(words) << 6, probes):
            found[s] &= (words[at >> 6] >> (at & 63).astype(U)) & U(1) == U(1)
    return found


def summed(tables: list[pa.Table]) -> pa.Table:
    """Counts of the same phrase added up."""
    whole = pa.concat_tables(tables).group_by(["lang", "phrase", "k"]).aggregate([("f", "sum")])
    return whole.rename_columns({"f_sum": "f"}).select(["lang", "phrase", "k", "f"])


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, size: int = SHARD_BYTES, count_size: int = COUNT_BYTES,
                     bits: int = BLOOM_BITS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, k, f)`` of all phrases found at least ``support`` times, and ``(lang, n)``, the words of each lang."""
    spark = docs.sparkSession
    texts = pick(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    # langs are few by nature: one row each on the driver, as a share needs the whole
    langs = {r[0]: r[1] for r in texts.groupBy("lang").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")).sort("lang").collect()}
    names = list(langs)
    size = min(size, max(1, sum(langs.values()) // LEAST_SHARDS))
    whole = texts.coalesce(max(1, -(-sum(langs.values()) // size)))  # a task takes neighbouring input splits until it has a whole shard
    filters, totals = [np.zeros(0, U)], None
    for first, last in ROUNDS:
        shared = spark.sparkContext.broadcast(filters) if first > 1 else None
        told = stored(reports(whole, langs, support, size, shared, first, last), "phrase-reports")
        by_lang = told.filter("digest IS NULL").groupBy("lang").agg(F.sum("slack").alias("slack"), F.sum("words").alias("n")).collect()  # one row a lang
        totals = totals or [(names[r["lang"]], r["n"]) for r in by_lang]
        slack = F.element_at(F.create_map(*[F.lit(x) for r in by_lang for x in (r["lang"], r["slack"])]), F.col("lang")) if by_lang else F.lit(0)
        candidates = told.filter("digest IS NOT NULL").groupBy("digest", "lang").agg(F.sum("over").alias("over")).filter(F.col("over") + slack >= support)
        filters += [bloom(candidates, bits)] * (last - first + 1)
        drop_stored(told)
    shared = spark.sparkContext.broadcast(filters)

    def count(batches):
        seed, held, labels = seeds(names), shared.value, pa.array(names, pa.string())

        def tables():
            parts, filled = [], 0
            for part in slices(batches, names):
                if filled and filled + len(part[1]) > count_size:
                    yield Run(parts, seed)
                    parts, filled = [], 0
                parts.append(part)
                filled += len(part[1])
            if parts:
                yield Run(parts, seed)

        waiting, rows, added = [], 0, 0
        for run in tables():
            for k, at, n in run.phrases(held):
                waiting.append(pa.table({"lang": labels.take(pa.array(run.lang[at])), "phrase": run.texts(at, k),
                                         "k": pa.array(np.full(len(at), k, np.int32)), "f": pa.array(n.astype(np.int64))}))
                rows += len(at)
            if rows > added + ADDED_ROWS:  # add the runs of a task up before they are handed on
                waiting = [summed(waiting)]
                rows = added = waiting[0].num_rows
                if rows > COMBINED_ROWS:
                    yield from waiting[0].to_batches(BATCH_ROWS)
                    waiting, rows, added = [], 0, 0
        if waiting:
            yield from summed(waiting).to_batches(BATCH_ROWS)

    # a phrase leaves a task once, so a task counts many splits, as long as every core has two tasks
    wide = texts.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-sum(langs.values()) // COUNT_TASK_BYTES)))
    counted = map_arrow(wide, count, "lang string, phrase string, k int, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return (stored(counted.filter(F.col("f") >= support), "phrases"), spark.createDataFrame(totals, "lang string, n long"))


def scored(phrases: DataFrame, totals: DataFrame, salt: int = SALT) -> DataFrame:
    """Phrases of two words and more with the least score of their cuts: ``(lang, phrase, k, a, l, r, n, score)``."""
    words = F.split("phrase", " ")
    cuts = (phrases.filter("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", "k", F.col("f").alias("a"), "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("head"),
                    F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"),
                    F.pmod(F.xxhash64("phrase"), F.lit(salt)).cast("int").alias("salt")))
    parts = phrases.filter("k < %d" % LONGEST).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    heads = parts.select("lang", F.col("phrase").alias("head"), "salt", F.col("f").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), "salt", F.col("f").alias("r"))
    wide = "decimal(38,0)"
    exact = F.expr(f"CAST(1000 AS {wide}) * a * n div (CAST(l AS {wide}) * r)")
    rated = (cuts.join(heads.hint("merge"), ["lang", "head", "salt"]).join(tails.hint("merge"), ["lang", "tail", "salt"])
             .join(F.broadcast(totals), "lang").withColumn("score", exact.cast("long")))
    best = rated.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")


def without_contained(candidates: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Candidates that lie in no longer candidate found as often.

    Counts never rise with a phrase's length, so a longer candidate as frequent as the phrase
    implies one that is only a word longer, and those are enough to look at.
    """
    words = F.split("phrase", " ")
    shorter = candidates.filter("k > 2").select("lang", F.col("a").alias("most"), F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    inner = shorter.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return (candidates.join(inner.hint("merge"), ["lang", "phrase"], "left")
            .filter(F.col("most").isNull() | (100 * F.col("most") < 100 * F.col("a"))).drop("most"))


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each lang: first in each of its hash buckets, then among those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(bucket)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    return few.withColumn("rank", F.row_number().over(whole).cast("long")).filter(F.col("rank") <= top)


def op13_collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, **sizes) -> DataFrame:
    """Each lang's best phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, support, **sizes)
    kept = without_contained(scored(phrases, totals))
    return ranked(kept, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH words AS (
  SELECT lang, d, p, list_filter(regexp_split_to_array(piece, '[ \\t]'), lambda w: w <> '') AS w
  FROM (SELECT lang, d, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p
        FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
                     regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents))
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), counts AS (
  SELECT lang, phrase, any_value(k) AS k, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k)))
  GROUP BY lang, phrase HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, cut, h.f AS l, t.f AS r, n,
         ((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counts WHERE k > 1) c
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[cut + 1:], ' ')
  JOIN totals ON totals.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
  SELECT DISTINCT b.lang, array_to_string(w[i:j], ' ') AS phrase, a
  FROM (SELECT lang, a, k, string_split(phrase, ' ') AS w FROM best WHERE k > 2) b,
       (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j)
  WHERE j <= b.k AND j - i >= 1 AND j - i + 1 < b.k
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM inner_phrases i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
