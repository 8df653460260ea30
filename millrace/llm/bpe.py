"""Byte-level BPE encoding in linear time by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds the tokens that start at each byte. The encoder takes the
longest one, goes back to shorter ones where two neighbours are not what the merges would leave, and never
tries an end twice that has failed, so its steps are linear in the length. Whether two tokens may stand side
by side is looked up in a pair-compatibility table that fills as pairs are met. The result is exactly that of
applying the merges in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in each of the two halves of a worker's cache, the longest that is held, and pairs that the table holds.
CACHED, LONGEST, PAIRS = 250_000, 48, 1_000_000
#: Fixed value: the published pattern of byte-level pre-tokenisation.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The vocabulary file's printable character for each byte: itself where it prints, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A vocabulary file's tokens, merges and added tokens, as tables. ``data``: the file's bytes."""

    def __init__(self, data: bytes):
        import ahocorasick
        import regex

        spec = json.loads(data)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = all(not model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = spec.get("added_tokens") or []
        own = any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
        if model.get("type") != "BPE" or not plain or own or spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        size = max([*model["vocab"].values(), *(a["id"] for a in added)]) + 1
        tokens = [b""] * size
        for word, i in model["vocab"].items():
            tokens[i] = bytes(alphabet[c] for c in word)
        ids = {t: i for i, t in enumerate(tokens) if t}
        self.special = {a["content"]: a["id"] for a in added}
        for content, i in self.special.items():
            tokens[i] = content.encode()
        # a merge's rank, and of the token that it makes its halves and rank; a token no merge makes is one byte
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            c = ids[tokens[a] + tokens[b]]
            if c in self.halves:
                raise ValueError(f"two merges make token {c}")
            self.rank[a, b] = self.made[c] = k
            self.halves[c] = (a, b)
        self.length = [len(t) for t in tokens]
        self.offset = np.zeros(size + 1, np.int64)
        np.cumsum(self.length, out=self.offset[1:])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # tokens that the merges leave whole; of each, the longest other such token that it starts with
        self.pairs: dict[tuple[int, int], bool] = {}
        whole = {t: i for t, i in sorted(ids.items(), key=lambda x: self.made.get(x[1], -1)) if i not in self.special.values()}
        bad: set[int] = set()
        for i, (a, b) in sorted(self.halves.items(), key=lambda x: self.made[x[0]]):
            if a in bad or b in bad or not self._apart(a, b, self.made[i]):
                bad.add(i)
        whole = {t: i for t, i in whole.items() if i not in bad and (len(t) == 1 or i in self.halves)}
        self.shorter = {i: next((whole[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in whole), -1) for t, i in whole.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in whole.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        # ids of pre-tokens met since the cache was last full, and of those met before
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank under ``before`` joins ``a`` and ``b`` or the parts of them that touch.

        The merges within both are undone, the latest first. A part lives until its own merge: at equal ranks
        the left one of two overlapping pairs goes first, so a joining merge must rank under the left part's
        own merge, and may rank equal to the right part's.
        """
        until_a = until_b = before
        while True:
            k = self.rank.get((a, b))
            if k is not None and k < until_a and k <= until_b and k < before:
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until_a, a = made_a, self.halves[a][1]
            else:
                until_b, b = made_b, self.halves[b][0]

    def compatible(self, left: int, right: int) -> bool:
        """The pair-compatibility table: whether two whole tokens stay two when they stand side by side."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._apart(left, right, len(self.rank))
        return found

    def encode_bytes(self, data: bytes) -> list[int]:
        """Tokens of one pre-token. Every byte is a token, so each prefix has exactly one encoding."""
        n, length, shorter, compatible = len(data), self.length, self.shorter, self.compatible
        longest = [0] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):
            longest[end - length[i] + 1] = i  # ends rise, so the last one is the longest
        ends, out, at = bytearray(b"\1") * (n + 1), [], 0
        token = longest[0] if n else -1
        while at < n:
            while token >= 0 and not (ends[at + length[token]] and (not out or compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:  # no encoding goes on from here: shorten the token before
                ends[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def _met(self, word: str) -> bytes:
        """Ids of a pre-token that the newer half of the cache lacked. When it is full, it becomes the older half."""
        ids = self.cache.get(word)
        if ids is not None:  # met a little earlier in the same text
            return ids
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.encode_bytes(word.encode()), np.uint32).tobytes()
        if len(word) <= LONGEST:
            if len(self.cache) >= CACHED:
                self.older = dict(self.cache)
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; strings of added tokens in it become their ids, as the file's library does."""
        parts, cache, at = [], self.cache, 0
        found = [(m.start(), m.end(), self.special[m[0]]) for m in self.split.finditer(text)] if self.split and any(s in text for s in self.special) else []
        for start, end, special in [*found, (len(text), len(text), None)]:
            words = self.pattern.findall(text[at:start] if found else text)
            ids = list(map(cache.get, words))
            if None in ids:
                ids = [self._met(w) if i is None else i for i, w in zip(ids, words)]
            parts += ids
            if special is not None:
                parts.append(np.uint32(special).tobytes())
            at = end
        return np.frombuffer(b"".join(parts), np.uint32)

    def decode(self, ids: np.ndarray, step: int = 1 << 20) -> str:
        """Text of ids: the tokens' bytes are gathered by offset; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            starts, sizes = self.offset[part], self.offset[part + 1] - self.offset[part]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_open: dict[int, Bpe] = {}


def vocabulary(data: bytes) -> Bpe:
    """The vocabulary of a file's bytes, once per worker."""
    mark = xxhash.xxh3_64_intdigest(data)
    if mark not in _open:
        _open[mark] = Bpe(data)
    return _open[mark]


def _shared(docs: DataFrame, path: str):
    """The file's bytes, read on the driver and broadcast, so workers need no path to it."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.uint32)]).astype(np.int32)))


def _mapped(docs: DataFrame, new: dict[str, str], need: str, work, batch: int) -> DataFrame:
    """``docs`` with new columns (name: type) that ``work`` makes of lists of the values of ``need``."""
    kept = [c for c in docs.columns if c not in new]
    place = kept.index(need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part.column(place))], [*part.schema.names, *new])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    return slim.mapInArrow(run, slim.select("*", *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema)


def encode_texts(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None, batch: int = 128) -> DataFrame:
    """The columns of ``docs`` and ``ids``, the tokens of the whole text (array of int).

    ``path`` is a byte-level BPE vocabulary in the tokenizers library's JSON. With ``decoded``, also a column
    of that name: the ids decoded again in the same pass. Edge cases: null and empty texts have no ids and
    decode to ``""``; nothing is truncated or padded; repeated rows are encoded each; an empty table gives an
    empty table; other columns are carried along; columns named like the new ones are replaced.
    """

    data = _shared(docs, path)

    def work(column: pa.Array) -> list[pa.Array]:
        bpe = vocabulary(data.value)
        rows = [bpe.encode(t or "") for t in column.to_pylist()]
        return [_lists(rows)] + ([pa.array([bpe.decode(r) for r in rows], pa.string())] if decoded else [])

    return _mapped(docs, {ids: "array<int>"} | ({decoded: "string"} if decoded else {}), text, work, batch)


def decode_ids(rows: DataFrame, path: str, *, ids: str = "ids", text: str = "text", batch: int = 128) -> DataFrame:
    """The columns of ``rows`` and ``text``, decoded from the array ``ids``.

    Edge cases: null or empty ids give ``""``; ids that together are no UTF-8 give U+FFFD for the bad bytes; null
    ids inside an array and ids that the vocabulary lacks raise; repeated rows are decoded each; an empty table
    gives an empty table; other columns are carried along; a column named like the new one is replaced.
    """
    data = _shared(rows, path)

    def work(column: pa.Array) -> list[pa.Array]:
        bpe = vocabulary(data.value)
        return [pa.array([bpe.decode(np.array(r or [], np.uint32)) for r in column.to_pylist()], pa.string())]

    return _mapped(rows, {text: "string"}, ids, work, batch)
