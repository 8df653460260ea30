"""Spelling variants: frequent words one edit apart, and the frequent form that each rare variant leads to.

Pairs come from an errata trie. The words are the terminals of a trie; at each node the child with the most words
continues the heavy path, and the words of the lighter children are merged into it with one character skipped
or replaced, so a word moves once for each light edge above it, which is about log2 of the number of words at most.
Where a moved terminal coincides with another, the two words are one edit apart, and each pair coincides at
one node only: the last that both pass.

The sorted words are dealt into buckets by split words, each bucket is one bounded task, and the few nodes above a
split have their heavy child stated for all buckets. Moved terminals meet by a join on Spark.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import Stage, small_side

#: Runs of letters, once A-Z are lower-cased: a to z and code points C0 to FF.
RUN = re.compile("[a-zÀ-ÿ]+")
#: What stands for any one character in a key; no word holds it.
ANY = "\x00"
#: Distinct words that a task counts before it gives its counts out.
HELD = 200_000
#: Words of a bucket, buckets at most, sampled words for each split, and code points of a split.
BUCKET, BUCKETS, SAMPLED, SPLIT = 2_000, 2_048, 32, 64


def damage(word: str, crc: int) -> str:
    """The word without its code point number ``crc`` modulo its length."""
    at = crc % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = 6, min_count: int = 5, damage_every: int = 199) -> DataFrame:
    """``word`` and ``n``: the words of all texts with ``min_chars`` code points and ``min_count`` occurrences or more.

    With ``damage_every`` the CRC-32 of ``<id>:<word>`` decides which words lose a code point before they are
    counted (0: none do). Each task counts its own rows first, so a word that stands everywhere is one row a task.

    Edge cases: null and empty texts have no words; rows with a null id are counted undamaged; repeated rows count
    each; an empty table gives an empty one; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for k, body in zip(*(c.to_pylist() for c in batch.columns)):
                if not body:
                    continue
                found = Counter(RUN.findall(body.encode().lower().decode()))
                start = zlib.crc32(f"{k}:".encode())
                for word, n in found.items():
                    if len(word) < min_chars:
                        continue
                    if damage_every and k is not None and (crc := zlib.crc32(word.encode(), start)) % damage_every == 0:
                        word = damage(word, crc)
                        if len(word) < min_chars:
                            continue
                    seen[word] += n
                if len(seen) > HELD:
                    yield _columns([list(seen), list(seen.values())], ["word", "n"])
                    seen.clear()
        yield _columns([list(seen), list(seen.values())], ["word", "n"])

    counted = docs.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _columns(values: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for v, c in zip(values, names)], names)


def split_words(sample: list[str], every: int) -> tuple[list[str], dict[str, str]]:
    """Split words from a sorted sample, and for each node above a split the character of its heavy child.

    The nodes are the proper prefixes of the splits; the heavy child is the one with the most sampled words, so that
    every bucket takes the same one.
    """
    splits = sorted({w[:SPLIT] for w in sample[every::every]})
    heavy: dict[str, str] = {}
    for split in splits:
        lo, hi = 0, len(sample)
        for p in range(len(split)):
            node = split[:p]
            lo, hi = bisect.bisect_left(sample, node, lo, hi), bisect.bisect_left(sample, node + "\U0010ffff", lo, hi)
            if node not in heavy:
                below = Counter(w[p] for w in sample[lo:hi] if len(w) > p)
                heavy[node] = min(below, key=lambda c: (-below[c], c), default=split[p])
    return splits, heavy


def _shared(a: str, b: str, start: int) -> int:
    """The length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def light_edges(words: list[str], stated: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """(word's number, depth, heavy character) for every node of the trie at which a word leaves the heavy path or ends.

    ``words`` are sorted and distinct; ``stated`` has nodes that other buckets share. A node's heavy child is the
    stated one, else the one with the most words here, the first of several.
    """
    todo = [(0, len(words), 0)] if words else []
    while todo:
        lo, hi, p = todo.pop()
        first, last = words[lo], words[hi - 1]
        branch = _shared(first, last, p)
        # nodes that branch in other buckets only; a node is stated only if the one above it is
        while p < branch and (heavy := stated.get(first[:p])) is not None:
            if heavy != first[p]:
                yield from ((k, p, heavy) for k in range(lo, hi))
            p += 1
        if hi - lo == 1 and branch == len(first) and (branch >= SPLIT or first not in stated):
            continue
        p, node = branch, first[:branch]
        ends = lo if len(first) == p else None
        starts = [lo + (ends is not None)]
        while starts[-1] < hi:
            starts.append(bisect.bisect_left(words, node + words[starts[-1]][p] + "\U0010ffff", starts[-1], hi))
        children = list(zip(starts, starts[1:]))
        heavy = stated.get(node) or words[max(children, key=lambda c: (c[1] - c[0], -c[0]))[0]][p]
        if ends is not None:
            yield ends, p, heavy
        for a, b in children:
            if words[a][p] != heavy:
                yield from ((k, p, heavy) for k in range(a, b))
            todo.append((a, b, p + 1))


def moved(word: str, p: int, heavy: str) -> Iterator[str]:
    """The word's places in the merged trie of the node at depth ``p``: one character more, replaced, or skipped."""
    node, rest = word[:p], word[p + 1 :]
    yield node + heavy + word[p:]
    if p < len(word):
        yield node + heavy + rest
        yield node + ANY + rest
        # else the two words part further down
        if rest[:1] != word[p]:
            yield node + rest


def _terminals(words: DataFrame) -> DataFrame:
    """``key``, ``word``, ``n``: every place of every moved terminal."""
    many = words.count()
    buckets = min(BUCKETS, many // BUCKET + 1)
    rate = max(1, many // (SAMPLED * buckets))
    sample = sorted(r.word for r in words.select("word").where(F.pmod(F.xxhash64("word"), F.lit(rate)) == 0).collect()) if buckets > 1 else []
    splits, stated = split_words(sample, SAMPLED)
    shared = words.sparkSession.sparkContext.broadcast((splits, stated))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(shared.value[0], w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], ["word", "n", "bucket"])

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("word")
        own, n = group.column("word").to_pylist(), group.column("n").to_pylist()
        rows = [(key, own[k], n[k]) for k, p, heavy in light_edges(own, shared.value[1]) for key in moved(own[k], p, heavy)]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["key", "word", "n"])

    kinds = (pa.string(), pa.string(), pa.int64())
    dealt = words.select("word", "n").mapInArrow(deal, "word string, n long, bucket int")
    return dealt.groupBy("bucket").applyInArrow(merge, "key string, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """For each of the distinct ``words`` (``word``, ``n``) with a word one edit away: ``n_near``, and ``best`` of these.

    ``best`` is a struct of ``less`` (minus its n) and ``word``: the near word of largest n, the first in code-point
    order of several. No pairs are listed for terminals that coincide under a replaced character: of such a
    group (one character long, so of bounded size) the best two are enough for all. An edit is one code point
    inserted, deleted or replaced; a word is not near itself. An empty table gives an empty one.
    """
    stage = Stage(words.sparkSession, "spelling")
    words = stage.write(words, "near_of")
    places = stage.write(_terminals(words), "places")
    as_best = lambda n, word: F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))
    met = places.where(~F.contains("key", F.lit(ANY))).join(words.select(F.col("word").alias("key"), F.col("n").alias("m")), "key")
    sides = F.explode(F.array(F.struct(F.col("word").alias("w"), as_best("m", "key").alias("best")), F.struct(F.col("key").alias("w"), as_best("n", "word").alias("best"))))
    one = met.select(sides.alias("s")).select(F.col("s.w").alias("word"), F.lit(1).cast("long").alias("c"), "s.best")
    groups = places.where(F.contains("key", F.lit(ANY))).groupBy("key").agg(F.sort_array(F.collect_list(as_best("n", "word"))).alias("g")).where(F.size("g") > 1)
    each = F.transform("g", lambda x: F.struct(x["word"].alias("word"), F.when(x == F.col("g")[0], F.col("g")[1]).otherwise(F.col("g")[0]).alias("best")))
    same = groups.select((F.size("g") - 1).cast("long").alias("c"), F.explode(each).alias("s")).select("s.word", "c", "s.best")
    return one.unionByName(same).groupBy("word").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def group_spellings(words: DataFrame, *, ratio: int = 5) -> DataFrame:
    """For each of the distinct ``words`` (``word``, ``n``): ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    A word's form is its near word of largest n (ties: the first in code-point order) if that n is ``ratio`` times its
    own or more, else null. Its root is the last word that is reached over forms, or the word itself. An n grows by
    ``ratio`` along forms, so they have no circles and no chain is longer than a few words; roots are found by doubling.

    Edge cases: words without a near word have n_near 0; an empty table gives an empty one; ``n`` must be 1 or more, ``ratio`` 2.
    """
    if ratio < 2:
        raise ValueError("forms could go in a circle")
    stage = Stage(words.sparkSession, "spelling")
    words = stage.write(words.select("word", F.col("n").cast("long").alias("n")), "words")
    has_form = -F.col("best.less") >= ratio * F.col("n")
    judged = words.join(near_words(words), "word", "left").select(
        "word", "n", F.when(has_form, F.col("best.word")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, -F.col("best.less")).cast("long").alias("form_n")
    )
    judged = stage.write(judged, "judged")
    roots = stage.write(judged.where("form is not null").select("word", F.col("form").alias("root")), "roots1")
    reach = 1
    most = judged.agg(F.max("n")).first()[0] or 1
    while ratio**reach <= most:
        nexts = small_side(roots.select(F.col("word").alias("root"), F.col("root").alias("further")))
        reach *= 2
        roots = stage.write(roots.join(nexts, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots{reach}")
    found = judged.join(small_side(roots), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
