"""Window columns over the rows of a key in order, without one task for each key.

All rows are range-partitioned by (key, order), so a key with many rows lies in many parts, in order. Columns that look
back a few rows are computed inside a part, once the last rows of the key from the parts before it have been put
in front. Running sums are computed inside a part, and what the parts before it come to is added: one row for each
part and key that goes on over parts, of which there are no more than two a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.shared import Stage

#: Parts for each shuffle partition: the more, the more evenly tasks are filled.
PARTS = 8


def ordered_columns(
    rows: DataFrame,
    *,
    by: tuple[str, ...],
    order: tuple[str, ...],
    look_back: dict[str, Callable[[WindowSpec], Column]] | None = None,
    reach: int = 0,
    running: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """The columns of ``rows``, and new ones over the rows of each key ``by`` in ``order`` (ascending, nulls first).

    ``look_back`` makes columns from a window of which only the current row and ``reach`` rows before it may be read
    (``lag``, frames of rows). ``running`` makes running sums, the current row included, of columns of ``rows`` and
    ``look_back``: whole numbers or decimals; ``F.lit(1)`` counts rows. A rank is the running sum of a mark where the
    value differs from the row's before. Nulls add nothing; a null key is a key.

    ``order`` must tell the rows of a key apart, else their places are taken in any order. All rows of equal key and order
    lie in one part. ``by`` may be empty: then all rows are one key. New names must differ from those of ``rows``. An
    empty table gives an empty one.
    """
    look_back, running = look_back or {}, running or {}
    spark = rows.sparkSession
    stage = Stage(spark, "ordered")
    keys, places = [F.col(f"`{c}`") for c in by], [F.col(f"`{c}`") for c in order]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage.write(rows.repartitionByRange(parts or PARTS * tasks, *keys, *places).withColumn("_part", F.spark_partition_id()), "dealt")
    inside = Window.partitionBy("_part", *keys).orderBy(*places)
    of_key = Window.partitionBy(*keys)
    # the parts of the keys that lie in several
    segments = dealt.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    spans = stage.write(segments.withColumn("_of", F.count(F.lit(1)).over(of_key)).where("_of > 1").select("_part", *keys), "spans")

    def beside(df: DataFrame, few: DataFrame, how: str) -> DataFrame:
        """Join on part and key, nulls equal; ``few`` has at most some rows for each part."""
        few = few.select(*[F.col(f"`{c}`").alias(f"_key_{k}") for k, c in enumerate(("_part", *by))], *[c for c in few.columns if c not in ("_part", *by)])
        same = F.lit(True)
        for k, c in enumerate(("_part", *by)):
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_key_{k}"))
        return df.join(F.broadcast(few), same, how).drop(*[f"_key_{k}" for k in range(len(by) + 1)])

    # windows over a part and a key of it need no other exchange than this even one of whole parts
    together = lambda df: df.repartitionByRange(tasks, "_part")
    seen = dealt
    if look_back:
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
        back = Window.partitionBy("_part", *keys).orderBy(*[c.desc() for c in places])
        tails = beside(dealt, spans, "left_semi").withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= reach).select("_part", *keys, "_back", row)
        in_order = Window.partitionBy(*keys).orderBy("_part", F.desc("_back"))
        before = tails.withColumn("_rows", F.collect_list("_row").over(in_order.rowsBetween(1 - reach, 0))).where("_back = 1")
        moved = before.withColumn("_to", F.lead("_part").over(Window.partitionBy(*keys).orderBy("_part"))).where("_to is not null")
        ghosts = moved.select(F.col("_to").alias("_part"), F.explode("_rows").alias("_row")).select("_row.*", "_part", F.lit(True).alias("_ghost"))
        both = together(dealt.withColumn("_ghost", F.lit(False)).unionByName(ghosts))
        seen = both.select(*both.columns, *[make(inside).alias(name) for name, make in look_back.items()]).where("not _ghost").drop("_ghost")
    if running:
        seen = seen if look_back else together(seen)
        so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # a running sum of nulls is 0, so that what came before can be added
        sums = {name: F.coalesce(F.sum(column).over(so_far), F.lit(0)) for name, column in running.items()}
        seen = stage.write(seen.select(*seen.columns, *[c.alias(name) for name, c in sums.items()]), "seen")
        held = beside(seen, spans, "left_semi").groupBy("_part", *keys).agg(*[F.sum(column).alias(f"_at_{k}") for k, column in enumerate(running.values())])
        earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = held.select("_part", *keys, *[F.sum(f"_at_{k}").over(earlier).alias(f"_add_{k}") for k in range(len(running))])
        joined = beside(seen, carried, "left")
        seen = joined.select(*[c for c in seen.columns if c not in running], *[(F.col(f"`{name}`") + F.coalesce(F.col(f"_add_{k}"), F.lit(0))).alias(name) for k, name in enumerate(running)])
    return seen.drop("_part")
