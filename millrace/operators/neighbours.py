"""Nearest neighbours of vectors by an inverted file: vectors are dealt to cells, and a query is held against some cells.

The centres of the cells are fitted on a bounded sample, every vector is dealt to the cell of its nearest centre,
and queries meet the vectors of a cell in blocks of bounded size, by products of matrices. An exact answer needs a second round:
by the triangle inequality a cell whose centre is farther than its radius and the distance of the k-th neighbour
so far cannot hold a nearer one, and all other cells are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.shared import Stage

#: Vectors that the centres are fitted on, centres, and rounds of fitting, at most.
SAMPLE, CELLS, ROUNDS = 16_384, 1_024, 12
#: Vectors and queries that meet in one block at most, about.
BLOCK, ASKED = 4_096, 1_024


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by k-means, begun with evenly spaced rows of the sample; a cell that loses all its vectors keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest_centre(sample, centres)[0]
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0)


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centre and the distance to it."""
    d = distances(rows, centres)
    own = d.argmin(axis=1)
    return own, np.sqrt(d[np.arange(len(rows)), own])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def nearest_neighbours(
    queries: DataFrame, vectors: DataFrame, *, key: str, vector: str, k: int, probes: int = 8, cells: int | None = None, exact: bool = False
) -> DataFrame:
    """``query``, ``place`` (1 to ``k``) and ``neighbour``: for each query the ``k`` nearest other vectors by distance.

    Both sides have ``key`` and ``vector`` (arrays of one length, without nulls inside). A query's own key is not its neighbour; ties
    are broken by key. With ``exact`` all cells that could hold a neighbour are read, else the ``probes`` nearest.

    Edge cases: null keys, null vectors and vectors of another length than the most common one take no part; with
    fewer than ``k`` others there are fewer places; keys should be unique, copies under other keys are neighbours
    at distance 0; a cell of any number of vectors is many blocks; an empty side gives an empty table.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "neighbours")
    of = lambda df, name: df.select(F.col(f"`{key}`").alias(name), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(f"{name} is not null and v is not null and not exists(v, x -> x is null)")
    held, asked = of(vectors, "id"), of(queries, "query")
    sizes = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    kind = held.schema["id"].dataType.simpleString()
    if not sizes or not sizes[0].n:
        return spark.createDataFrame([], f"query {kind}, place int, neighbour {kind}")
    size, many = sizes[0].n, sizes[0]["count"]
    held, asked = held.where(F.size("v") == size), asked.where(F.size("v") == size)
    sample = held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()  # the fit's bounded sample
    centres = fit_centres(np.array([r.v for r in sample]), cells or min(CELLS, max(1, int(many**0.5))))
    shared = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = nearest_centre(_matrix(batch.column(1), size), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], ["id", "v", "cell", "far"])

    dealt = stage.write(held.mapInArrow(deal, f"id {kind}, v array<double>, cell int, far double"), "dealt")
    # one row a cell
    told = {r.cell: (r.n, r.radius) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    salts, radius = np.array([-(-told.get(c, (0, 0))[0] // BLOCK) for c in range(len(centres))]), np.array([told.get(c, (0, -np.inf))[1] for c in range(len(centres))])
    split = spark.sparkContext.broadcast((salts, radius))
    salt_of = spark.createDataFrame([(c, int(n)) for c, n in enumerate(salts)], "cell int, salts int")
    parts = dealt.drop("far").join(F.broadcast(salt_of), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    asked = stage.write(asked.withColumn("bound", F.lit(None).cast("double")), "asked")

    def ask(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        """The (cell, salt) blocks that each query is held against: those of its nearest cells, or the rest within its bound."""
        salts, radius = split.value
        for batch in batches:
            if not batch.num_rows:
                continue
            d = np.sqrt(distances(_matrix(batch.column(1), size), shared.value))
            order = np.argsort(d, axis=1, kind="stable")
            near = np.zeros(d.shape, bool)
            np.put_along_axis(near, order[:, :probes], True, axis=1)
            if rest:
                bound = np.asarray(batch.column(2).fill_null(np.inf), np.float64)
                near = ~near & (d - radius[None] <= bound[:, None] * (1 + 1e-9) + 1e-9)
            row, cell = np.nonzero(near & (salts > 0)[None])
            again = salts[cell]
            row, cell = np.repeat(row, again), np.repeat(cell, again)
            salt = np.arange(len(cell)) - np.repeat(np.cumsum(again) - again, again)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32))], ["query", "v", "cell", "salt"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ``k`` nearest of a block, and one more for the query itself, for each query that is held against it."""
        empty = pa.table({"query": left.column("query").slice(0, 0), "id": right.column("id").slice(0, 0), "d": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        ids, rows = right.column("id"), _matrix(right.column("v").combine_chunks(), size)
        order = np.empty(len(rows), np.int64)
        order[np.argsort(ids.to_numpy(), kind="stable")] = np.arange(len(rows))
        found = []
        for begin in range(0, left.num_rows, ASKED):
            own = left.slice(begin, ASKED)
            asking = _matrix(own.column("v").combine_chunks(), size)
            d = distances(asking, rows)
            some = min(k + 1, d.shape[1])
            # products of matrices round: whatever may be as near as the last one is measured again, term by term
            slack = 1e-9 * ((rows * rows).sum(axis=1).max() + (asking * asking).sum(axis=1).max())
            for q, least in enumerate(np.partition(d, some - 1, axis=1)[:, some - 1]):
                at = np.flatnonzero(d[q] <= least + slack)
                true = np.cumsum((asking[q] - rows[at]) ** 2, axis=1)[:, -1]
                best = np.lexsort((order[at], true))[:some]
                found.append((begin + q, at[best], true[best]))
        asked_by = pa.array(np.repeat([q for q, _, _ in found], [len(at) for _, at, _ in found]))
        return pa.table({"query": left.column("query").take(asked_by), "id": ids.take(pa.array(np.concatenate([at for _, at, _ in found]))), "d": pa.array(np.concatenate([d for _, _, d in found]))})

    def search(rest: bool, queries: DataFrame) -> DataFrame:
        probing = queries.mapInArrow(lambda batches: ask(batches, rest), f"query {kind}, v array<double>, cell int, salt int")
        # a block that very many queries ask for is read by many tasks
        turns = stage.write(probing.withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(TURNS)).cast("int")), f"turns{int(rest)}")
        used = turns.select(F.col("cell").alias("of_cell"), F.col("salt").alias("of_salt"), F.col("turn").alias("of_turn")).distinct()
        blocks = parts.join(used, (F.col("cell") == F.col("of_cell")) & (F.col("salt") == F.col("of_salt"))).select("id", "v", "of_cell", "of_salt", "of_turn")
        met = turns.groupBy("cell", "salt", "turn").cogroup(blocks.groupBy("of_cell", "of_salt", "of_turn")).applyInArrow(meet, f"query {kind}, id {kind}, d double")
        return met.where("not (query <=> id)")

    best = Window.partitionBy("query").orderBy("d", "id")
    top = lambda df: df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    first = top(search(False, asked))
    if exact:
        first = stage.write(first, "first")
        reach = first.where(F.col("place") == k).select(F.col("query").alias("q"), F.sqrt("d").alias("reach"))
        bounded = asked.join(reach, F.col("query") == F.col("q"), "left").select("query", "v", F.col("reach").alias("bound"))
        first = top(first.drop("place").unionByName(search(True, bounded)))
    return first.select("query", "place", F.col("id").alias("neighbour"))


#: Groups that the queries of one block are dealt into.
TURNS = 4
