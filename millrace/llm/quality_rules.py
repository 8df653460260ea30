"""Quality rules: shape statistics of a text and a log-likelihood ratio against the raw corpus.

Two multinomials over hashed word n-grams are counted: one over every document, one over the trusted ones.
A document's score is the mean log ratio of its n-grams (target over raw), so long and short texts compare.
Everything is DataFrame functions: counting explodes n-grams and pre-aggregates by bucket, scoring is an
array fold inside the row. Texts are not shuffled. While the ids of trusted documents can be broadcast, they tell these
exactly; of more ids a bitmap of fixed size does nearly, and the n-grams of documents that it takes for trusted ones
by mistake, which a join of ids alone tells, are taken back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.line_dedup import SPACE
from millrace.llm.staging import Stage, is_small, mark_maybe, maybe_in

#: Words are runs of anything but these; these characters count as symbols.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
NOT_SYMBOL = "[^#*$%&|<>]+"
#: Tokens of the multinomials: runs of letters, marks, digits and _, and runs of other printing characters.
TOKEN = "[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]+"
#: Weights are log ratios in units of 2**-16, held as integers so that sums do not depend on their order.
UNIT = 65536
#: The number of buckets that n-grams are hashed to. It bounds the table of weights at any corpus size.
BUCKETS = 16384


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def _covered(hashes: Column) -> Column:
    """Positions that lie in a 3-word window found twice or more. Windows are compared by 64-bit hash."""

    def fold(s):  # s: windows as (hash, position), sorted
        again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)))
        return _let(
            F.sort_array(F.transform(again, lambda x: x["i"])),
            lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b),
        )

    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), fold)


#: What ``shape`` tells of a text.
SHAPE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _beside(docs: DataFrame, rows: DataFrame, new: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs``, held in ``_row`` of ``rows``, and the ``new`` ones, which replace like-named ones.

    The new ones are one generated row, so that a filter on one of them does not pull all of their making into
    its condition again.
    """
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in new], F.inline(F.array(F.struct(*new))))


def shape(docs: DataFrame, *, text: str = "text", min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """The columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or empty text has no words, so all counts are 0 and ``base_failed`` is true.
    """
    return _beside(docs, _shaped(docs, text, min_words, repeat_percent), SHAPE)


def _shaped(docs: DataFrame, text: str, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """``_row`` (all columns of ``docs``, so that their names stay apart), ``_body`` and what ``shape`` adds."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), body.alias("_body"), words(body).alias("_words"))
    windows = F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2)))
    held = held.withColumns({"_windows": windows, "_full": F.filter(F.split("_body", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")})
    held = held.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.regexp_replace("_body", WORD_BREAK, "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace("_body", NOT_SYMBOL, "")).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": F.when(F.size("_windows") == F.size(F.array_distinct("_windows")), F.lit(0)).otherwise(_covered(F.col("_windows"))).cast("long"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return held.withColumn("base_failed", failed).drop("_words", "_windows", "_full")


def _grams(held: DataFrame, *carried: str) -> DataFrame:
    """``_g``, the hash of each word and of each word pair of ``_w``, and the ``carried`` columns."""
    pairs = held.select(*carried, F.inline(F.arrays_zip(F.col("_w").alias("a"), F.expr("slice(_w, 2, size(_w))").alias("b"))))
    return pairs.select(*carried, F.explode(F.array(F.xxhash64("a"), F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")))).alias("_g")).where("_g is not null")


def ngram_weights(docs: DataFrame, trusted: DataFrame, *, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, smoothing: float = 1.0) -> DataFrame:
    """One row, ``weights``: for each bucket the log ratio of trusted to raw frequency, in units of 2**-16.

    Counts cover all of ``docs``; ``trusted`` has the keys of the trusted documents (repeated and null keys
    count once and never). The table has ``buckets`` entries whatever the size of the corpus.

    Edge cases: null and empty texts have no n-grams; of repeated rows each counts, and all rows of a trusted key
    do; without any n-gram, or without a trusted one, the frequencies are those of the smoothing alone.
    """
    tokens = lambda df: df.select("_k", "_own", F.regexp_extract_all("_t", F.lit(TOKEN), F.lit(0)).alias("_w")).where(F.size("_w") > 0)
    held = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"))
    good = trusted.select(F.col(f"`{key}`").alias("_k")).where("_k is not null").distinct()
    own = F.lit(1).alias("_own")
    if is_small(good):
        grams = _grams(tokens(held.join(F.broadcast(good.select("_k", own)), "_k", "left")), "_own").withColumn("_raw", F.lit(1))
    else:
        # one pass over all texts in which a bitmap tells the trusted ones, and few others, whose n-grams are taken back
        marked = mark_maybe(held, good, "_k", "_maybe").select("_k", "_t", F.when(F.col("_maybe") & F.col("_k").isNotNull(), 1).alias("_own"))
        every = _grams(tokens(marked), "_own").withColumn("_raw", F.lit(1))
        wrong = Stage(docs.sparkSession, "quality_rules").write(maybe_in(held.select("_k").where("_k is not null"), good, "_k").distinct().join(good, "_k", "left_anti"), "wrong")
        few = held.join(F.broadcast(wrong), "_k", "left_semi") if is_small(wrong) else maybe_in(held, wrong, "_k").join(wrong, "_k", "left_semi")
        grams = every.unionByName(_grams(tokens(few.withColumn("_own", F.lit(-1))), "_own").withColumn("_raw", F.lit(None).cast("int")))
    counts = grams.groupBy(F.pmod("_g", F.lit(buckets)).alias("_b")).agg(F.count("_raw").alias("raw"), F.coalesce(F.sum("_own"), F.lit(0)).alias("own"))
    # at most `buckets` rows from here on, folded as one array
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("_b")).join(counts, "_b", "left").fillna(0, ["raw", "own"])
    one = every.agg(F.sort_array(F.collect_list(F.struct("_b", "raw", "own"))).alias("_e"), F.sum("raw").alias("_raw"), F.sum("own").alias("_own"))
    share = lambda n, total: (n + smoothing) / (total + smoothing * buckets)
    ratio = lambda e: F.log(share(e["own"], F.col("_own")) / share(e["raw"], F.col("_raw")))
    return one.select(F.transform("_e", lambda e: F.round(ratio(e) * UNIT).cast("long")).alias("weights"))


def judge(docs: DataFrame, weights: list[int], *, text: str = "text", buckets: int = BUCKETS, threshold: float = -0.5, **limits) -> DataFrame:
    """The columns of ``shape`` and n_grams, score (mean log ratio, null without n-grams) and kept.

    ``weights`` has one number per bucket and enters as one constant array. A document is kept unless its base
    rules failed or its score is below ``threshold``; a score equal to it is kept.

    Edge cases: a null or empty text has the score null and fails the base rules; repeated rows are judged each;
    an empty table gives an empty table; columns named like the new ones are replaced, others carried along.
    """
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded once, when planned
    at = lambda *t: F.coalesce(F.get(table, F.pmod(F.xxhash64(*t), F.lit(buckets)).cast("int")), F.lit(0))

    def total(w):
        each = F.transform(w, lambda t, i: at(t) + F.when(i + 1 < F.size(w), at(t, F.get(w, i + 1))).otherwise(0))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    held = _shaped(docs, text, **limits).withColumn("_w", F.regexp_extract_all("_body", F.lit(TOKEN), F.lit(0)))
    held = held.withColumns({"n_grams": F.greatest(2 * F.size("_w") - 1, F.lit(0)).cast("long"), "_sum": total(F.col("_w"))})
    held = held.withColumn("score", F.when(F.col("n_grams") > 0, F.col("_sum") / UNIT / F.col("n_grams")))
    passed = F.coalesce(F.col("_sum") >= F.lit(threshold * UNIT) * F.col("n_grams"), F.lit(False))
    held = held.withColumn("kept", ~F.col("base_failed") & passed)
    return _beside(docs, held, (*SHAPE, "n_grams", "score", "kept"))


def apply_quality_rules(docs: DataFrame, trusted: DataFrame, *, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, **settings) -> DataFrame:
    """Count, fetch the weights (``buckets`` numbers), judge every row of ``docs``. Columns as ``judge``; like-named ones are replaced.

    Edge cases: null or empty texts fail the base rules; with no trusted document the smoothed target is
    uniform, so scores say only how common the n-grams are; repeated rows count each; an empty table gives an
    empty table; other columns are carried along unread.
    """
    weights = ngram_weights(docs, trusted, text=text, key=key, buckets=buckets).first()["weights"]
    return judge(docs, weights, text=text, buckets=buckets, **settings)
