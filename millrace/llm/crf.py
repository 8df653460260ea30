"""A linear-chain conditional random field in numpy: trained by likelihood, decoded by Viterbi in batches.

A position has some feature ids (0: none); its emission scores are the sum of their rows of
``weights``. Sequences of a batch are padded to one length, and every step is an array operation over them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class FeatureIds:
    """Ids of feature names. New names get ids while training; afterwards unknown ones are 0."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.open = True

    def __call__(self, name: str) -> int:
        found = self.ids.get(name)
        if found is None:
            if not self.open:
                return 0
            found = self.ids[name] = len(self.ids) + 1
        return found


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays (length, slots) of feature ids to (rows, longest, most slots), and their lengths."""
    sizes = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), int(sizes.max(initial=0)), max(r.shape[1] for r in rows)), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r), : r.shape[1]] = r
    return out, sizes


class LinearChainCrf:
    """``weights`` (features, labels), ``moves`` (from, to), ``starts`` and ``ends`` (labels).

    ``barred``: moves that no sequence makes; row -1 has the labels that none starts with.
    """

    def __init__(self, features: int, labels: int, barred: np.ndarray | None = None):
        self.weights = np.zeros((features, labels))
        self.moves, self.starts, self.ends = np.zeros((labels, labels)), np.zeros(labels), np.zeros(labels)
        self.barred = np.zeros((labels + 1, labels), bool) if barred is None else barred
        self._bar()

    def _bar(self) -> None:
        self.moves[self.barred[:-1]] = self.starts[self.barred[-1]] = -1e4

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Sums of the rows of ``weights``, slot by slot, which needs no array of all of them."""
        out = np.zeros((*ids.shape[:-1], self.weights.shape[1]))
        for k in range(ids.shape[-1]):
            out += np.take(self.weights, ids[..., k], axis=0)
        return out

    def fit(self, rows: list[np.ndarray], tags: list[np.ndarray], *, rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> "LinearChainCrf":
        """Full-batch gradient steps (AdaGrad) on the penalised log likelihood; nothing is drawn at random."""
        labels, order = len(self.starts), sorted(range(len(rows)), key=lambda k: len(rows[k]))
        # sequences of like length are padded together
        parts = [self._counts([rows[k] for k in own], [tags[k] for k in own]) for own in (order[q * len(rows) // 6 : (q + 1) * len(rows) // 6] for q in range(6)) if own]
        params = (self.weights, self.moves, self.starts, self.ends)
        squares = [np.full_like(p, 1e-8) for p in params]
        for _ in range(rounds):
            grads = [np.zeros_like(p) for p in params]
            for part in parts:
                self._gradient(*part, grads)
            grads[0][0] = 0
            for p, g, q in zip(params, grads, squares):
                g = g / len(rows) - decay * p
                q += g * g
                p += rate * g / np.sqrt(q)
            self._bar()
        return self

    def _counts(self, rows: list[np.ndarray], tags: list[np.ndarray]) -> tuple:
        """Padded ids, lengths, which positions are real, the true labels as 0 and 1, and the counts of true moves."""
        ids, sizes = pad(rows)
        real = np.arange(ids.shape[1])[None, :] < sizes[:, None]
        gold = np.zeros(real.shape, np.int64)
        for k, t in enumerate(tags):
            gold[k, : len(t)] = t
        hot = np.eye(len(self.starts))[gold] * real[..., None]
        return ids, sizes, real, hot, np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])

    def _gradient(self, ids: np.ndarray, sizes: np.ndarray, real: np.ndarray, hot: np.ndarray, moved: np.ndarray, grads: list[np.ndarray]) -> None:
        """Add what the sequences say: true minus expected counts, by the forward-backward algorithm, scaled at each step."""
        n, longest, labels = hot.shape
        moves, ends = np.exp(self.moves), np.exp(self.ends)
        e = self.emissions(ids)
        e = np.exp(e - e.max(axis=2, keepdims=True))
        share = lambda x: x / x.sum(axis=-1, keepdims=True)
        step = lambda x, moves: np.einsum("na,ab->nb", x, moves)  # noqa: E731  the arrays are too small for threads
        forward, backward = np.empty((n, longest, labels)), np.empty((n, longest, labels))
        forward[:, 0] = share(np.exp(self.starts) * e[:, 0])
        for t in range(1, longest):
            forward[:, t] = np.where(real[:, t, None], share(step(forward[:, t - 1], moves) * e[:, t]), forward[:, t - 1])
        backward[:, longest - 1] = share(ends)
        for t in range(longest - 2, -1, -1):
            backward[:, t] = np.where(real[:, t + 1, None], share(step(e[:, t + 1] * backward[:, t + 1], moves.T)), share(ends))
        missing = hot - share(forward * backward) * real[..., None]
        before, after = forward[:, :-1].reshape(-1, labels), (e[:, 1:] * backward[:, 1:]).reshape(-1, labels)
        weight = real[:, 1:].ravel() / (step(before, moves) * after).sum(axis=1)
        pairs = moves * np.einsum("na,nb->ab", before * weight[:, None], after)
        flat, slots = ids.ravel(), ids.shape[2]
        for label in range(labels):
            grads[0][:, label] += np.bincount(flat, np.repeat(missing[..., label].ravel(), slots), len(self.weights))
        grads[1] += moved - pairs
        grads[2] += missing[:, 0].sum(axis=0)
        grads[3] += missing[np.arange(n), sizes - 1].sum(axis=0)

    def decode(self, rows: list[np.ndarray], batch: int = 512, cells: int = 65_536) -> list[np.ndarray]:
        """The likeliest labels of each sequence of feature ids. Sequences of like length share a batch.

        A batch has at most ``batch`` sequences and ``cells`` positions, or one sequence, which is read by parts.
        """
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
        order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
        at = 0
        while at < len(order):
            longest = 2 * len(rows[order[at]]) + 8
            some = [k for k in order[at : at + max(1, min(batch, cells // longest))] if len(rows[k]) <= longest]
            at += len(some)
            if len(some) == 1:
                own = rows[some[0]]
                out[some[0]] = self.best_path(self.emissions(own[t : t + cells]) for t in range(0, len(own), cells))
                continue
            ids, sizes = pad([rows[k] for k in some])
            for k, tags in zip(some, self._viterbi(self.emissions(ids), sizes)):
                out[k] = tags
        return out

    def _viterbi(self, e: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        n, longest, labels = e.shape
        real = np.arange(longest)[None, :] < sizes[:, None]
        score, back = self.starts + e[:, 0], np.zeros((n, longest, labels), np.int8)
        for t in range(1, longest):
            ways = score[:, :, None] + self.moves[None]
            best = ways.argmax(axis=1)
            back[:, t] = np.where(real[:, t, None], best, np.arange(labels))
            score = np.where(real[:, t, None], ways.max(axis=1) + e[:, t], score)
        tags = np.zeros((n, longest), np.int64)
        tags[:, -1] = (score + self.ends).argmax(axis=1)
        for t in range(longest - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return [tags[k, : sizes[k]] for k in range(n)]

    def best_path(self, parts: Iterable[np.ndarray], block: int = 256) -> np.ndarray:
        """The likeliest labels of one sequence, whose emissions come in parts (positions, labels).

        A part is cut into blocks that are read side by side: first each from every label that may stand before it, which
        tells how scores go over from block to block, then once more from its true scores. Of the whole sequence only
        one byte for each position and label is held.
        """
        score, back = None, []
        for e in parts:
            if score is None and len(e):
                score, e = self.starts + e[0], e[1:]
                back.append(np.zeros((1, len(self.starts)), np.int8))
            if len(e):
                score, own = self._forward(np.ascontiguousarray(e.T), score, block)
                back.append(own)
        if score is None:
            return np.empty(0, np.int64)
        label = int((score + self.ends).argmax())
        tags = []
        for own in reversed(back):
            for row in reversed(own.tolist()):
                tags.append(label)
                label = row[label]
        return np.array(tags[::-1], np.int64)

    def _forward(self, e: np.ndarray, score: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores after the last position, up to a constant, and the best label before each label of each position.

        ``e`` is (labels, positions). Steps are elementwise over blocks, by the moves that are not barred.
        """
        labels, n = e.shape
        blocks = -(-n // block)
        padded = np.zeros((labels, blocks * block))
        padded[:, :n] = e
        padded = np.ascontiguousarray(padded.reshape(labels, blocks, block).transpose(2, 0, 1))
        sizes = np.append(np.full(blocks - 1, block), n - (blocks - 1) * block)
        before = [np.flatnonzero(~self.barred[:-1, y]).tolist() for y in range(labels)]

        def step(held: np.ndarray, t: int, back: np.ndarray | None) -> np.ndarray:
            """``held`` is (labels, ..., blocks); the last block may be over."""
            out = np.empty_like(held)
            for y in range(labels):
                best = held[before[y][0]] + self.moves[before[y][0], y]
                way = np.full(blocks, before[y][0], np.int8)
                for k in before[y][1:]:
                    other = held[k] + self.moves[k, y]
                    if back is not None:
                        way[other > best] = k
                    best = np.maximum(best, other)
                out[y] = best + padded[t, y]
                if back is not None:
                    back[t, :, y] = way
            if t >= sizes[-1]:
                out[..., -1] = held[..., -1]
            return out

        entry = np.empty((labels, blocks))
        entry[:, 0] = score
        if blocks > 1:
            ways = np.where(np.eye(labels, dtype=bool), 0.0, -1e9)[:, :, None].repeat(blocks, axis=2)  # (label, first label, block)
            for t in range(block):
                ways = step(ways, t, None)
            for b in range(1, blocks):
                entry[:, b] = (entry[:, b - 1][None] + ways[:, :, b - 1]).max(axis=1)
                entry[:, b] -= entry[:, b].max()
        back = np.zeros((block, blocks, labels), np.int8)
        held = entry
        for t in range(block):
            held = step(held, t, back)
        return held[:, -1] - held[:, -1].max(), back.transpose(1, 0, 2).reshape(-1, labels)[:n]
