"""Token counts of whole texts by a piece vocabulary, without moving pre-tokens between machines.

The vocabulary's pieces hold the space mark only at their start, so merges never cross from a character to a
following space and a text's count is the sum over its pre-tokens (a run of spaces with the characters after
it). Most pre-tokens are looked up: first in a broadcast table of lengths of frequent pre-tokens, then in a
bounded cache of the worker; the rest is encoded, each distinct one of a batch once.

The table only saves work: any table gives the same counts. It is filled from every task's own frequent
pre-tokens, a bounded number from each, packed into one row; such rows are merged as they are, so no pre-token
is ever shuffled by itself. The vocabulary is read on the driver and broadcast, so workers need no path to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table (its proven bound), rows that a task may offer for it, and the share of a
#: task's pre-tokens that a row must reach.
TABLE, OFFERED, SHARE = 32_768, 2_048, 1e-5
#: Tasks that merge the packed rows before the last one does.
MERGERS = 64
#: Pre-tokens that a worker's cache and a task's counter hold at most, and the longest that are held.
CACHED, COUNTED, LONGEST = 150_000, 150_000, 64

#: A run of space marks with what follows it. U+2581 in a text is the space mark itself.
PRETOKEN = re.compile(" +[^ ]*")
_models: dict[int, object] = {}


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, which starts with the mark that the model puts before every text."""
    return PRETOKEN.findall(" " + text.replace("▁", " ")) if text else []


def model_of(data: bytes):
    """The model of a vocabulary file's bytes, once per worker."""
    mark = xxhash.xxh3_64_intdigest(data)
    if mark not in _models:
        import sentencepiece

        _models[mark] = sentencepiece.SentencePieceProcessor(model_proto=data)
    return _models[mark]


def read_vocabulary(path: str) -> bytes:
    """The file's bytes. Raises unless counting by pre-token is exact: unchanged characters, spaces kept, marks only in front."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        data = f.read()
    model.ParseFromString(data)
    rules = model.normalizer_spec
    crossing = [p.piece for p in model.pieces if p.type in (1, 4) and re.search("[^▁]▁", p.piece)]
    if crossing or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError(f"{path} needs whole texts: its pieces or its normaliser cross spaces")
    return data


def encode_lengths(held: list[str], data: bytes) -> list[int]:
    """Numbers of tokens of pre-tokens by the model, which puts one space in front of any text but an empty one.

    So a pre-token's own first space goes; of a lone space, which ends a text, the length is the difference
    that it makes there.
    """
    model = model_of(data)
    lone = len(model.encode("a ")) - len(model.encode("a"))
    return [len(ids) if p != " " else lone for p, ids in zip(held, model.encode([p[1:] for p in held], num_threads=1))]


class Lengths:
    """Numbers of tokens of pre-tokens: broadcast table, then a cache, then the model."""

    def __init__(self, table: dict[str, int], data: bytes):
        self.table, self.data, self.cache = table, data, {}

    def of(self, texts: list[str]) -> list[int]:
        table, cache = self.table, self.cache
        totals, missing, again = [], {}, []
        for text in texts:
            total, left = 0, None
            for p in pretokens(text):
                n = table.get(p)
                if n is None:
                    n = cache.get(p)
                    if n is None:
                        missing[p] = 0
                        if left is None:
                            left = []
                        left.append(p)
                        continue
                total += n
            totals.append(total)
            again.append(left)
        if missing:
            held = list(missing)
            missing = dict(zip(held, encode_lengths(held, self.data)))
            for k, left in enumerate(again):
                if left:
                    totals[k] += sum(map(missing.__getitem__, left))
            if len(cache) + len(missing) > CACHED:
                cache.clear()
            cache.update((p, n) for p, n in list(missing.items())[:CACHED] if len(p) <= LONGEST)
        return totals


def _offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's frequent pre-tokens as one row. Rare ones are let go whenever the counter is full."""
    seen: Counter = Counter()
    total = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                found = pretokens(text)
                total += len(found)
                seen.update(found)
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 4)))
    rows = [(p, n) for p, n in seen.most_common(OFFERED) if n >= SHARE * total and n > 1 and len(p) <= LONGEST]
    if rows:
        yield _packed(rows)


def _packed(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    p, n = [p for p, _ in rows], [n for _, n in rows]
    return pa.RecordBatch.from_arrays([pa.array([p], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64()))], ["p", "n"])


def _merge(entries: int):
    """Packed rows to one, of the ``entries`` pre-tokens counted most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, many in zip(p, n):
                    seen[word] += many
                if len(seen) > COUNTED + entries:
                    seen = Counter(dict(seen.most_common(COUNTED // 4 + entries)))
        if seen:
            yield _packed(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries])

    return run


def frequent_lengths(docs: DataFrame, data: bytes, *, text: str = "text", entries: int = TABLE) -> dict[str, int]:
    """Lengths of the ``entries`` pre-tokens that tasks count most, over all rows of ``docs``."""
    kind = "p array<string>, n array<long>"
    offered = docs.select(F.col(f"`{text}`")).mapInArrow(_offer, kind).repartition(MERGERS)
    found = offered.mapInArrow(_merge(entries), kind).repartition(1).mapInArrow(_merge(entries), kind).collect()
    held = [p for row in found for p in row["p"]]
    return dict(zip(held, encode_lengths(held, data))) if held else {}


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", entries: int = TABLE, batch: int = 256) -> DataFrame:
    """The columns of ``docs`` and ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    ``path`` is a sentencepiece BPE model. No begin, end or other special token is counted, and their strings
    in a text are ordinary text. Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are
    counted each; long texts are split like others; an empty table gives an empty table; other columns are
    carried along; columns named like the new ones are replaced.
    """
    vocabulary = read_vocabulary(path)
    context = docs.sparkSession.sparkContext
    data, table = context.broadcast(vocabulary), context.broadcast(frequent_lengths(docs, vocabulary, text=text, entries=entries))
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    place = kept.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(table.value, data.value)
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                texts = [t or "" for t in part.column(place).to_pylist()]
                n = [0 if not t else k for t, k in zip(texts, lengths.of(texts))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], [*part.schema.names, "n_bytes", "n_tokens"])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(count, schema)
