"""Benchmark decontamination by spaced seeds.

A mask picks some word positions of a window and ignores the others, so a seed still matches when an ignored
word was replaced. Seeds of the test items and of the documents are joined by hash, and each hit's diagonal is
verified word by word. The masks for items of a length have a seed for every placement of the substitutions that
the length allows (for 13 words and more: in every window of 13 words with up to two), so within its definition
the search is exact.

Both sides are tables. The test items' seeds set the bits of a bitmap of fixed size; one scan of the documents gives
their seeds that have both bits set, which are few; those are joined with the test seeds by hash, and each text
is verified against the items that it shares a seed with. Nothing grows with the test side but tables on Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shingles import window_hashes
from millrace.llm.staging import Stage, is_small, maybe_in, small_side

#: Masks as offsets of the words that count, with the lengths of the items that they serve.
MASKS = (
    ((0, 1, 3), 4, 5),
    ((0, 1, 2, 4), 5, 13),
    ((0, 1, 4, 5), 8, 13),
    ((0, 1, 2, 4, 6, 7), 13, None),
    ((0, 1, 3, 6, 7, 8), 13, None),
)
#: Pairs of equal seeds, diagonals, and words beside words that are held at once.
PAIRS, DIAGONALS, CELLS = 1_000_000, 2_000_000, 1_000_000
#: Words of a window, the share of them that must agree, and the fewest words of an item that may differ.
WINDOW, SHARE, LEAST = 13, 0.8, 8
#: Bits of the bitmap for each seed of the test items, and bits at most (32 MB); items that a row is verified against, about.
SPARE, MAP_BITS, ITEMS = 1024, 28, 4_096
#: Fixed value: ASCII punctuation, which does not count.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_words(text: str) -> np.ndarray:
    """Hashes of the words of a text, lower-cased, without ASCII punctuation."""
    words = text.lower().encode().translate(None, PUNCTUATION).split()
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


def window_of(n: int) -> tuple[int, int]:
    """For an item of ``n`` words: words of the window that decides, and how many must agree."""
    if n >= LEAST:
        length = min(WINDOW, n)
        return length, math.ceil(SHARE * length)
    return n, n


@dataclass
class Seeds:
    """Some test items: their words, and for each mask the sorted seeds with item and position."""

    ids: list
    words: list[np.ndarray]
    tables: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]]

    @classmethod
    def of(cls, ids: list, words: list[np.ndarray]) -> "Seeds":
        tables = []
        for mask, low, high in MASKS:
            own = [k for k, w in enumerate(words) if low <= len(w) and (high is None or len(w) < high)]
            if own:
                seeds = [window_hashes(words[k], mask) for k in own]
                h = np.concatenate(seeds)
                item = np.repeat(np.array(own), [len(s) for s in seeds])
                place = np.concatenate([np.arange(len(s)) for s in seeds])
                order = np.argsort(h, kind="stable")
                shift = np.uint64(64 - min(22, len(h).bit_length() + 6))
                marks = np.zeros(1 << int(64 - shift), bool)
                marks[(h >> shift).astype(np.int64)] = True
                tables.append((mask, h[order], item[order], place[order], marks, shift))
        return cls(ids, words, tables)

    def _diagonals(self, doc: np.ndarray) -> Iterator[np.ndarray]:
        """Distinct diagonals with an equal seed, as item * 2**40 + diagonal + 2**39, in parts of bounded size."""
        held, many = [], 0
        for mask, seeds, item, place, marks, shift in self.tables:
            h = window_hashes(doc, mask)
            at = np.flatnonzero(marks[(h >> shift).astype(np.int64)])
            low, high = np.searchsorted(seeds, h[at], "left"), np.searchsorted(seeds, h[at], "right")
            at, low, size = at[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(size)
            begin = 0
            while begin < len(at):
                done = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                own, first, n = size[begin:stop], low[begin:stop], ends[begin:stop] - done
                rows = np.repeat(first - (n - own), own) + np.arange(n[-1])
                held.append(np.unique((item[rows] << 40) + (np.repeat(at[begin:stop], own) - place[rows]) + (1 << 39)))
                many += len(held[-1])
                begin = stop
                if many > DIAGONALS:
                    held = [np.unique(np.concatenate(held))]
                    many = len(held[0])
                    if many > DIAGONALS:
                        yield held[0]
                        held, many = [], 0
        if held:
            yield np.unique(np.concatenate(held))

    def overlaps(self, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """For each item found: item, first word in the document and in the item, words, and how many agree."""
        best: dict[int, tuple] = {}
        for codes in self._diagonals(doc):
            items, starts = np.unique(codes >> 40, return_index=True)
            for k, own in zip(items.tolist(), np.split(codes, starts[1:])):
                found = self._verified(k, doc, (own & ((1 << 40) - 1)) - (1 << 39))
                # of most equal words, then the first
                if found and (k not in best or (-found[4], found[1] - found[2]) < (-best[k][4], best[k][1] - best[k][2])):
                    best[k] = found
        return [best[k] for k in sorted(best)]

    def _verified(self, k: int, doc: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int, int, int] | None:
        """The best overlap of an item on some sorted diagonals (word of the document less word of the item)."""
        own, found = self.words[k], None
        length, needed = window_of(len(own))
        step = max(1, CELLS // len(own))
        for at in range(0, len(diagonals), step):
            d = diagonals[at : at + step, None]
            low, high = max(0, int(-d[-1, 0])), min(len(own), int(len(doc) - d[0, 0]))
            if high - low < length:
                continue
            i = np.arange(low, high)
            equal = (own[low:high] == doc[np.clip(i + d, 0, len(doc) - 1)]) & (i + d >= 0) & (i + d < len(doc))
            total = np.zeros((len(d), high - low + 1), np.int32)
            np.cumsum(equal, axis=1, out=total[:, 1:])
            # windows of the item that lie inside the document and agree well enough
            good = (total[:, length:] - total[:, :-length] >= needed) & (i[: high - low - length + 1] >= -d) & (i[length - 1 :] < len(doc) - d)
            rows = np.flatnonzero(good.any(axis=1))
            if not len(rows):
                continue
            first = good[rows].argmax(axis=1)
            stop = good.shape[1] - 1 - good[rows, ::-1].argmax(axis=1) + length
            agree = total[rows, stop] - total[rows, first]
            q = int(agree.argmax())
            if found is None or agree[q] > found[4]:
                start = low + int(first[q])
                found = (k, start + int(d[rows[q], 0]), start, int(stop[q] - first[q]), int(agree[q]))
        return found


def seeds_of(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The distinct seeds of a test item, by number of the mask."""
    return [(k, np.unique(window_hashes(words, mask))) for k, (mask, low, high) in enumerate(MASKS) if low <= len(words) and (high is None or len(words) < high)]


@dataclass
class ItemTables:
    """The distinct test texts as tables: ``texts`` (item, t), ``items`` (item, words), ``seeds`` (h, item); and the bitmap of seeds."""

    texts: DataFrame
    items: DataFrame
    seeds: DataFrame
    masks: list[int]
    bitmap: np.ndarray
    bits: int
    many: int

    @classmethod
    def of(cls, benchmark: DataFrame, text: str, stage: Stage) -> "ItemTables":
        slim = benchmark.select(F.col(f"`{text}`").alias("t")).where("t is not null").distinct()
        texts = stage.write(slim.select(F.monotonically_increasing_id().alias("item"), "t"), "texts")

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain_words(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["item", "words"])

        def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(item, mask, h) for item, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for mask, h in seeds_of(np.frombuffer(own, np.uint64))]
                if found:
                    sizes = [len(h) for _, _, h in found]
                    columns = np.concatenate([h for _, _, h in found]).view(np.int64), np.repeat([i for i, _, _ in found], sizes), np.repeat(np.array([m for _, m, _ in found], np.int32), sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "item", "mask"])

        items = stage.write(texts.mapInArrow(words, "item long, words binary"), "items")
        held = stage.write(items.mapInArrow(seeds, "h long, item long, mask int"), "seeds")
        found = held.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a mask
        bits = min(MAP_BITS, max(16, (SPARE * sum(r.n for r in found)).bit_length()))
        places = F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1)))).alias("x")
        pages = held.select(places).groupBy((F.col("x") / 32768).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("x") % 32768).alias("bits"))
        bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for r in pages.toLocalIterator():  # 4 KB each, of a bitmap of bounded size
            bitmap[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
        return cls(texts, items, held.select("h", "item").distinct(), sorted(r.mask for r in found), bitmap, bits, texts.count())

    def ids(self, benchmark: DataFrame, text: str, item: str) -> DataFrame:
        """Every id of each distinct text: ``item``, ``item_id``."""
        own = benchmark.select(F.col(f"`{text}`").alias("t"), F.col(f"`{item}`").alias("item_id"))
        return own.join(small_side(self.texts), "t").select("item", "item_id")


def passing(h: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The seeds with both of their bits set."""
    for place in (lambda x: x >> np.uint64(64 - bits), lambda x: x & np.uint64((1 << bits) - 1)):
        at = place(h).astype(np.int64)
        h = h[(bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return h


def _verified(docs: DataFrame, test: ItemTables, text: str, kept: list[str], stage: Stage) -> DataFrame:
    """The columns ``kept`` of the rows that overlap with an item, and ``item``, ``doc_word``, ``item_word``, ``n_words``, ``n_matches``.

    Texts are known by two hashes, so copies are joined once; every row is verified.
    """
    spark = docs.sparkSession
    body = F.col(f"`{text}`")
    named = docs.select(*[F.col(f"`{c}`").alias(f"_own_{k}") for k, c in enumerate(kept)], body.alias("_text"), *text_hashes(body)).where(F.length("_text") > 0)
    shared = spark.sparkContext.broadcast((test.bitmap, test.bits, [MASKS[k][0] for k in test.masks]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits, masks = shared.value
        for batch in batches:
            rows, found = [], []
            for k, t in enumerate(batch.column(2).to_pylist()):
                own = plain_words(t)
                h = np.unique(np.concatenate([passing(window_hashes(own, m), bitmap, bits) for m in masks])) if masks else own[:0]
                rows.append(np.full(len(h), k))
                found.append(h)
            at = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))], ["_t1", "_t2", "h"])

    hits = stage.write(named.select("_t1", "_t2", "_text").mapInArrow(scan, "_t1 long, _t2 long, h long"), "hits")
    pairs = stage.write(hits.join(small_side(test.seeds), "h").select("_t1", "_t2", "item").distinct(), "pairs")
    told = pairs.join(small_side(test.items), "item")
    chunks = F.pmod(F.xxhash64("item"), F.lit(1 + test.many // ITEMS))
    grouped = told.groupBy("_t1", "_t2", chunks.alias("_chunk")).agg(F.collect_list(F.struct("item", "words")).alias("_items"))
    if is_small(told):
        rows = named.join(F.broadcast(grouped), ["_t1", "_t2"])
    else:
        rows = maybe_in(named, pairs.select("_t1"), "_t1").join(grouped, ["_t1", "_t2"])
    own = [f"_own_{k}" for k in range(len(kept))]
    rows = rows.select(*own, "_text", "_items")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k in range(batch.num_rows):
                items = batch.column(len(own) + 1)[k].as_py()
                seeds = Seeds.of([x["item"] for x in items], [np.frombuffer(x["words"], np.uint64) for x in items])
                for hit in seeds.overlaps(plain_words(batch.column(len(own))[k].as_py())):
                    rows.append(k)
                    found.append((seeds.ids[hit[0]], *hit[1:]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(own))), *(pa.array([x[c] for x in found], pa.int64()) for c in range(5))], [*own, *FOUND])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*own).schema] + [f"{c} long" for c in FOUND])
    return rows.mapInArrow(verify, schema)


FOUND = ["item", "doc_word", "item_word", "n_words", "n_matches"]


def text_hashes(body: Column) -> list[Column]:
    return [F.xxhash64(body).alias("_t1"), F.xxhash64(F.lit(1), body).alias("_t2")]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each document and test item that overlap: ``doc_id``, ``item_id``, ``doc_word``,
    ``item_word`` (where the overlap starts), ``n_words`` and ``n_matches``.

    They overlap if some 13 words of the item stand in the document, in place, with at most 20 % of them
    replaced. An item of 8 to 12 words counts as a whole, one of 4 to 7 only if unchanged; shorter ones never
    do. Of several places the one with most equal words is given, the first of equals.

    Edge cases: null and empty texts overlap with nothing; null ids are given as they are; repeated documents
    and repeated items come out each; long texts are read whole; empty tables give an empty table; other
    columns are not read.
    """
    stage = Stage(docs.sparkSession, "decontaminate")
    test = ItemTables.of(benchmark, text, stage)
    found = _verified(docs, test, text, [key], stage).withColumnRenamed("_own_0", "doc_id")
    # the ids of a text, however many, are joined to what was found of it
    return found.join(small_side(test.ids(benchmark, text, item)), "item").select("doc_id", "item_id", "doc_word", "item_word", "n_words", "n_matches")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no test item, as ``find_overlaps`` defines it, with all columns.

    Edge cases: rows with null or empty texts stay, whatever their id; repeated rows are judged alike, by their
    whole texts; without items all rows stay; an empty table gives an empty table; all columns are carried along.
    """
    stage = Stage(docs.sparkSession, "decontaminate")
    test = ItemTables.of(benchmark, text, stage)
    hashed = docs.select(*text_hashes(F.col(f"`{text}`")), F.col(f"`{text}`").alias("_body"))
    bad = _verified(hashed, test, "_body", ["_t1", "_t2"], stage).select(F.col("_own_0").alias("_t1"), F.col("_own_1").alias("_t2")).distinct()
    bad = stage.write(bad, "bad")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *text_hashes(F.col(f"`{text}`")))
    if is_small(bad):
        left = own.join(F.broadcast(bad), ["_t1", "_t2"], "left_anti")
    else:
        # most rows are certainly not among them and need not travel
        left = maybe_in(own, bad, "_t1", inside=False).unionByName(maybe_in(own, bad, "_t1").join(bad, ["_t1", "_t2"], "left_anti"))
    return left.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
