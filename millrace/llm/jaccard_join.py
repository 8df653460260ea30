"""N-gram Jaccard self-join by parity sketches, exact at its threshold.

Documents with equal shingle sets are one node. Sets of similar size fall into one size band. In each band
the shingles are dealt by hash over so many blocks that two sets above the threshold, which differ in a
bounded number of shingles, must agree in some block (pigeonhole); a block's key is the XOR of its shingles'
hashes, so agreeing blocks have equal keys and a join on the keys finds every pair. Empty blocks have no key:
sets that have many also give their least shingles one by one, as many as two such sets above the threshold need
to have one in common. Each node also has a
1024-bit parity sketch (every shingle flips one bit), which folds to 256 bits by XOR of its quarters; the Hamming
distance of two sketches is a lower bound of the symmetric difference, so it discards pairs without error. What
is left is verified on the texts.

Pairs are not listed inside large groups. First each node of a key meets only the key's most central node (the
one that shares its keys with most others: of edited copies, the least edited one); the verified links are
contracted to components. Then only nodes of one key in different components meet, held against the wide sketch.
A key of many nodes (say, of a passage that many texts share) is not compared through: its nodes meet by their
rarest shingles instead, as many as two linked sets need to have one in common, and what is still large is dealt
over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.staging import Stage, is_small, maybe_in, small_side
from millrace.llm.shingles import mix, shingle_set

#: Members that one task compares with a copy of a pair's first text, or with a copy of their key's other members; more
#: nodes than MEMBERS make a key large. Among nodes of large keys, shingles of more than COMMON nodes are common ones.
SALT, MEMBERS, COMMON = 512, 4096, 64
#: 64-bit words of a parity sketch, and of its fold, which the keys carry.
WIDE, FOLDED = 16, 4
#: Sets that a task remembers, so as not to give the keys of a copy again. More only cost repeated keys.
MET = 100_000


class Bands:
    """Size bands for a threshold of ``percent``: their limits, blocks and differences, all in whole numbers."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent, self.starts = percent, [1]

    def band(self, n: int) -> int:
        """Sizes n and m (n <= m) can link only if 100 n >= percent m, so only in one band or two neighbours."""
        while self.starts[-1] <= n:
            s = self.starts[-1]
            self.starts.append(max(s + 1, -(-100 * s // self.percent)))
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    @lru_cache(maxsize=4096)
    def blocks(self, group: int) -> tuple[int, int]:
        """Of pairs with the smaller set in band ``group``: the number of blocks, and how many may be spare.

        |A & B| * 100 >= percent * |A | B| means a symmetric difference of (100 - p) / (100 + p) of |A| + |B| at
        most. With d differences, d + 1 + e blocks leave e + 1 that agree; so of two sets, one with at most e empty
        blocks, a block that is not empty agrees.
        """
        self.band(self.starts[-1] + 1) if len(self.starts) < group + 2 else None
        low, high = self.starts[group], self.starts[group + 1] - 1
        p = self.percent
        d = (high + 100 * high // p) * (100 - p) // (100 + p)
        e = 0 if d == 0 else 1 + math.ceil(2 * (d + 1) * math.exp(-low / (d + 1)))
        return d + 1 + e, e


def block_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys of a set of sorted 64-bit hashes, in the groups of its own band and of the one below.

    They are the XORs of its blocks, without empty ones. A set with too many empty blocks also gives its least
    shingles: two sets with at least k in common have one of them among their n - k + 1 least, and above the
    threshold k is at least percent of either set.
    """
    n, out = len(shingles), []
    if n == 0:
        return np.empty(0, np.int64)
    own, place, value = bands.band(n), mix(shingles, 11) >> np.uint64(32), mix(shingles, 7)
    for group in (own, own - 1):
        if group < 0:
            continue
        blocks, spare = bands.blocks(group)
        if blocks == 1:  # no difference is allowed, and equal sets are one node already
            continue
        at = ((place * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
        xor = np.zeros(blocks, np.uint64)
        np.bitwise_xor.at(xor, at, value)
        used = np.flatnonzero(np.bincount(at, minlength=blocks))
        mark = np.array([group * 0x100000001], np.uint64)
        out.append(mix(xor[used] ^ mix(used.astype(np.uint64) + mark, 13), 17))
        if blocks - len(used) > spare:
            out.append(mix(shingles[: n + bands.percent * -n // 100 + 1] ^ mix(mark, 29), 19))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """1024 bits as sixteen 64-bit words; each shingle flips one bit."""
    bits = np.bincount((mix(shingles, 3) >> np.uint64(54)).astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _nodes(words: int):
    """Rows (id, the text's hash, text) to (id, that hash, n, the set's two fingerprints, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f, g, s = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = shingle_set(text or "", words)
                n.append(len(h))
                f.append(int(np.add.reduce(mix(h, 21)).astype(np.uint64).view(np.int64)))
                g.append(int(np.bitwise_xor.reduce(mix(h, 23)).astype(np.uint64).view(np.int64)))
                s.append(parity_sketch(h))
            s = np.array(s, np.int64).reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), *(pa.array(s[:, k].copy()) for k in range(WIDE))], ["id", "t", "n", "f", "g", *(f"s{k}" for k in range(WIDE))])

    return run


def _keys(words: int, percent: int):
    """Rows (text) to (key, fingerprint of the set). Equal sets that one task meets give their keys once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, met = Bands(percent), set()
        for batch in batches:
            keys, f, held = [], [], 0
            for text in batch.column(0).to_pylist():
                h = shingle_set(text or "", words)
                if not len(h):
                    continue
                mark = np.add.reduce(mix(h, 21)).astype(np.uint64).view(np.int64)
                if mark in met:
                    continue
                if len(met) >= MET:
                    met.clear()
                met.add(mark)
                own = block_keys(h, bands)
                keys.append(own)
                f.append(np.full(len(own), mark, np.int64))
                held += len(own)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(f))], ["key", "f"])
                    keys, f, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(f))], ["key", "f"])

    return run


def _key_ends(words: int, percent: int):
    """As ``_keys``, but of the sets that share a key in a part of a task's rows only those of least and greatest fingerprint."""
    every = _keys(words, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in every(batches):
            parts.append(part)
            held += part.num_rows
            if held > 500_000:
                yield _ends(parts)
                parts, held = [], 0
        if held:
            yield _ends(parts)

    return run


def _ends(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    key, f = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (0, 1))
    order = np.lexsort((f, key))
    new = np.flatnonzero(np.diff(key[order], prepend=~key[order[0]]))
    both = order[np.unique(np.concatenate([new, np.append(new[1:], len(key)) - 1]))]
    return pa.RecordBatch.from_arrays([pa.array(key[both]), pa.array(f[both])], ["key", "f"])


def _shingles(words: int):
    """Rows (node, text) to (node, shingle), each distinct shingle once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h = shingle_set(batch.column(1)[k].as_py() or "", words).view(np.int64)
                for at in range(0, len(h), 200_000):
                    part = pa.array(h[at : at + 200_000])
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(part)), part], ["node", "shingle"])

    return run


def _compare(words: int, percent: int):
    """Rows (group, salt, side, other, text) sorted so that a group's own text comes first: the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for group, salt, side, other, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = shingle_set(text or "", words)
                if side == 0:
                    now, own = (group, salt), h
                elif now == (group, salt):
                    common = len(np.intersect1d(own, h, assume_unique=True))
                    union = len(own) + len(h) - common
                    if 100 * common >= percent * union:
                        for column, value in zip(out, (group, other, common, union)):
                            column.append(value)
                else:
                    raise RuntimeError("a text to compare with is missing")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["x", "y", "n_common", "n_union"])

    return run


def _texts(some: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node`` and ``text`` for the nodes in ``some``.

    A node's text is looked up by id and hash, so rows that share an id are told apart, and of repeated rows one
    is taken.
    """
    asked = small_side(some.select("node").distinct().join(nodes.select("node", "id", "t"), "node"))
    same = F.col("d.id").eqNullSafe(F.col("a.id")) & (F.col("d.t") == F.col("a.t"))
    return docs.alias("d").join(asked.alias("a"), same).select("node", "text").dropDuplicates(["node"])


def _rare_keys(some: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``key`` and ``node``: for the nodes in ``some`` their rarest shingles among these nodes.

    The order is that of how many nodes have a common shingle, others first, then of the hash: one order for all
    sets, so of two sets that have percent of either in common, one common shingle is among these of both.
    """
    own = _texts(some, nodes, docs).select("node", "text").mapInArrow(_shingles(words), "node long, shingle long")
    common = small_side(own.groupBy("shingle").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > COMMON))
    ranked = own.join(common, "shingle", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "shingle"))).alias("s"))
    n = F.size("s")
    return ranked.select(F.explode(F.slice("s", F.lit(1), n - F.ceil(F.lit(percent) * n / 100).cast("int") + 1)).alias("s"), "node").select(F.col("s.shingle").alias("key"), "node")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among ``pairs`` (x, y: nodes). The first text is copied once for each SALT members."""
    large = small_side(pairs.groupBy("x").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > SALT))
    salted = pairs.join(large, "x", "left").withColumn("salt", F.pmod(F.xxhash64("y"), F.ceil(F.coalesce("many", F.lit(1)) / SALT)))
    members = salted.select(F.col("y").alias("node"), F.col("x").alias("group"), "salt", F.lit(1).alias("side"))
    owners = salted.select(F.col("x").alias("node"), F.col("x").alias("group"), "salt", F.lit(0).alias("side")).distinct()
    routes = members.unionByName(owners)
    texts = _texts(routes, nodes, docs)
    rows = texts.join(routes, "node").select("group", "salt", "side", F.col("node").alias("other"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "group", "salt").sortWithinPartitions("group", "salt", "side", "other")
    return dealt.mapInArrow(_compare(words, percent), "x long, y long, n_common long, n_union long")


def _classes(docs: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """For every row of ``docs``: id, t (hash of the text), n (size of the set), class (a number for all rows that
    can be reached by links, null for an empty set) and least (the least id of the class)."""
    stage = Stage(docs.sparkSession, "jaccard")
    body = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(body).alias("t"), body.alias("text"))
    wide = [f"s{k}" for k in range(WIDE)]
    sketches = "id long, t long, n long, f long, g long, " + ", ".join(f"{s} long" for s in wide)
    sets = stage.write(slim.mapInArrow(_nodes(words), sketches), "sets")
    # one node for each set; id and t are those of one of its rows
    own = F.coalesce(F.min_by("t", "id"), F.min("t")).alias("t")
    nodes = sets.where("n > 0").groupBy("f", "g", "n").agg(F.min("id").alias("id"), own, *[F.min(s).alias(s) for s in wide])
    nodes = stage.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    fold = [f"o{k}" for k in range(FOLDED)]
    folded = [reduce(lambda a, b: a.bitwiseXOR(b), [F.col(s) for s in wide[k::FOLDED]]).alias(fold[k]) for k in range(FOLDED)]

    # keys that two different sets share, found by the ends of what tasks hold of a key, so a key of many sets is a few
    # rows a task; then the rows of those keys, made again, since they are far fewer than all
    texts, kind = slim.select("text"), "key long, f long"
    ends = texts.mapInArrow(_key_ends(words, percent), kind).repartition("key")
    twice = stage.write(ends.groupBy("key").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo < hi").select("key"), "twice")
    keys = texts.mapInArrow(_keys(words, percent), kind)
    keys = keys.join(F.broadcast(twice), "key") if is_small(twice) else maybe_in(keys, twice, "key").join(twice, "key")
    shared = stage.write(keys.distinct().join(nodes.select("f", "node", "n", *folded), "f").drop("f"), "shared")
    stage.drop("twice")

    def near(sketch: list[str]) -> Column:
        """No pair at the threshold fails this: sizes of p and q, and the least difference that a sketch allows."""
        far = sum((F.bit_count(F.col(f"p.{s}").bitwiseXOR(F.col(f"q.{s}"))) for s in sketch), F.lit(0))
        return (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")) & (far * (100 + percent) <= (100 - percent) * (F.col("p.n") + F.col("q.n")))

    # first round: a key's members meet its most central member
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    ranks = shared.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("rank"))
    star = shared.join(ranks, "node").groupBy("key").agg(F.max(F.struct("rank", "node", "n", *fold)).alias("m")).select("key", "m.*")
    pairs = shared.alias("p").join(star.alias("q"), F.col("p.key") == F.col("q.key")).where(F.col("p.node") != F.col("q.node")).where(near(fold))
    pairs = stage.write(pairs.select(F.col("q.node").alias("x"), F.col("p.node").alias("y")).distinct(), "pairs_1")
    links = stage.write(_verify(pairs, nodes, slim, words, percent), "links_1")
    found = connected_components(links.select("x", "y"), stage, "cc_1")

    # second round: members of one key in different components meet; those of large keys by their rarest shingles
    where = nodes.join(found.withColumnRenamed("component", "c"), "node", "left").select("node", "n", F.coalesce("c", "node").alias("c"))

    def several(members: DataFrame) -> DataFrame:
        """Keys (key, node, c) of different components, and the number of members."""
        ends = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"))
        return ends.where("lo < hi").select("key", "size")

    def meet(members: DataFrame, keys: DataFrame, name: str) -> DataFrame:
        """Pairs of one of the ``keys``; of a key with many, MEMBERS of one side in a task."""
        mixed = members.join(small_side(keys), "key").withColumn("parts", F.ceil(F.col("size") / MEMBERS))
        mixed = stage.write(mixed.join(nodes.select("node", *wide), "node"), name)
        left = mixed.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
        right = mixed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        same = (F.col("p.key") == F.col("q.key")) & (F.col("p.part") == F.col("q.part"))
        across = left.alias("p").join(right.alias("q"), same & (F.col("p.node") < F.col("q.node")) & (F.col("p.c") != F.col("q.c")) & near(wide))
        return across.select(F.col("p.node").alias("x"), F.col("q.node").alias("y"))

    named = shared.select("key", "node").join(where, "node")
    keys = stage.write(several(named), "several")
    across = meet(named, keys.where(F.col("size") <= MEMBERS), "mixed")
    large = keys.where(F.col("size") > MEMBERS).select("key")
    if not large.isEmpty():
        rare = stage.write(_rare_keys(named.join(small_side(large), "key"), nodes, slim, words, percent).join(where, "node"), "rare")
        across = across.unionByName(meet(rare, stage.write(several(rare), "rare_several"), "rare_mixed"))
    met = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    more = stage.write(across.distinct().join(met, ["x", "y"], "left_anti"), "pairs_2")
    every = links.select("x", "y").unionByName(_verify(more, nodes, slim, words, percent).select("x", "y"))
    parts = connected_components(every, stage, "cc_2")

    # least ids of components with a link, then of all nodes, then of all rows
    linked = parts.join(nodes.select("node", "id"), "node")
    least = linked.join(linked.groupBy("component").agg(F.min("id").alias("least")), "component").select("node", "component", "least")
    whole = nodes.join(least, "node", "left").select("f", "g", "n", F.coalesce("component", "node").alias("class"), F.coalesce("least", "id").alias("least"))
    rows = stage.write(sets.select("id", "t", "n", "f", "g").join(whole, ["f", "g", "n"], "left").select("id", "t", "n", "class", "least"), "rows")
    stage.drop("sets", "nodes", "shared", "several", "mixed", "rare", "rare_several", "rare_mixed", "pairs_1", "pairs_2", "links_1", "cc_1", "cc_2")
    return rows


def jaccard_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id``, ``n_shingles`` (size of the set) and ``component_id`` for every row of ``docs``.

    A text's shingles are its runs of ``words`` words, A-Z lower-cased; a shorter text with a word is one
    shingle. Rows link when 100 * |A & B| >= percent * |A | B|; a component's id is the least id in it.

    Edge cases: null, empty and blank texts have no shingles and are their own component; rows with a null id
    take part, and a component without any id has null; repeated rows come out each; rows are told apart by id
    and text, so of different texts under one id each is in its own component; pairs exactly at the threshold
    link; an empty table gives an empty table; other columns are not read.
    """
    rows = _classes(docs, text, key, words, percent)
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component (as ``jaccard_components`` has them) with all its columns: that of the least id.

    Edge cases: rows without shingles all stay; a null id comes after all others; of different texts under one
    id that of the least hash stays, of repeated rows the least by all columns; an empty table gives an empty
    table. Columns must have an order (no maps); their names may be any.
    """
    rows = _classes(docs, text, key, words, percent).where("n > 0")
    stays = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("k"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stage = Stage(docs.sparkSession, "near_copies")
    chosen = F.col("id").eqNullSafe(F.col("k.id")) & (F.col("t") == F.col("k.t"))
    met = stage.write(rows.join(stays, "class").groupBy("id", "t", chosen.alias("stays")).agg(F.count(F.lit(1)).alias("size")).where("not stays or size > 1"), "met")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("t"))

    def beside(some: DataFrame, how: str) -> DataFrame:
        return held.alias("d").join(small_side(some.select("id", "t")).alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.t") == F.col("m.t")), how)

    out = beside(met, "left_anti").select("row")
    repeated = met.where("stays")
    if not repeated.isEmpty():
        out = out.unionByName(beside(repeated, "left_semi").groupBy("id", "t").agg(F.min("row").alias("row")).select("row"))
    return out.select("row.*")
