"""Line de-duplication over the whole corpus, with DataFrame functions only.

Lines are normalised and hashed inside each row; what is shuffled to count them is hashes and document ids, each
pair once, so a line that stands in a third of all documents is spread over all tasks. Then the positions of the
lines to drop come to their document by id, and the rest is reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import Stage, small_side

#: Fixed value: the white space that is stripped from both ends of a line (code points 20 and 09 to 0D).
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The normalised line: stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _keys(body: Column, min_chars: int) -> Column:
    """The 128-bit hash (a, b) of each line's key, null for a key that is too short to count. A key is made once."""
    both = lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))
    return F.transform(F.transform(F.split(body, "\n"), line_key), lambda k: F.when(F.char_length(k) >= min_chars, both(k)))


def dedup_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop every line whose key has ``min_chars`` code points or more and stands in ``min_docs`` documents or more.

    All copies of such a line go, in every document. Returns the columns of ``docs`` with ``text`` replaced,
    and ``n_lines`` (before dropping) and ``n_dropped`` added (these two replace columns of the same name).

    Edge cases: a null or empty text is one empty line and stays ``""``; a text whose lines all go becomes
    ``""``; all rows of one id are one document when lines are counted, and of rows with a null id those of one
    text are; every row loses the counted lines; ``min_docs`` ties (exactly that many) are dropped; an empty
    table gives an empty table. Other columns are carried along and never read.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "line_dedup")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(F.col(f"`{key}`").alias("_k"), F.xxhash64(body).alias("_t"), _keys(body, min_chars).alias("_h"))
    found = slim.select("_k", F.when(F.col("_k").isNull(), F.col("_t")).alias("_u"), F.explode("_h").alias("_l")).where("_l is not null")
    counted = found.select("_k", "_u", "_l.*").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"))
    frequent = small_side(stage.write(counted.where(F.col("_n") >= min_docs).select("a", "b"), "frequent"))
    hits = slim.select("_k", "_t", F.posexplode("_h").alias("_p", "_l")).where("_l is not null").select("_k", "_t", "_p", "_l.*").join(frequent, ["a", "b"], "left_semi")
    drops = hits.groupBy("_k", "_t").agg(F.sort_array(F.collect_set("_p")).alias("_drop"))
    # one row at most for each (_k, _t), so the join keeps every row of docs once; _row keeps the columns' names apart
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_k"), F.xxhash64(body).alias("_t"))
    both = own.alias("d").join(drops.alias("x"), F.col("d._k").eqNullSafe(F.col("x._k")) & (F.col("d._t") == F.col("x._t")), "left")
    rows = both.select("_row", F.coalesce(F.col(f"_row.`{text}`"), F.lit("")).alias("_body"), F.coalesce("_drop", F.array().cast("array<int>")).alias("_drop"))
    rows = rows.withColumn("_lines", F.split("_body", "\n"))
    # what stays: the runs of lines between one dropped position and the next
    kept = F.flatten(
        F.transform(
            F.concat(F.array(F.lit(-1)), F.col("_drop")),
            lambda p, i: F.slice(F.col("_lines"), p + 2, F.coalesce(F.get(F.col("_drop"), i), F.size("_lines")) - p - 1),
        )
    )
    rows = rows.withColumn("_kept", F.when(F.size("_drop") == 0, F.col("_body")).otherwise(F.array_join(kept, "\n")))
    out = {text: F.col("_kept"), "n_lines": F.size("_lines").cast("long"), "n_dropped": F.size("_drop").cast("long")}
    return rows.select(
        *[(out[c] if c in out else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns], *[v.alias(c) for c, v in out.items() if c not in docs.columns]
    )
