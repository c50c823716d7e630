"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Features are places of a vector of 2**BITS weights: words, pairs of words, the forms of words, repeats and length.
BITS = 18
#: At most so many labelled documents are learned from: those whose ids hash lowest. They are trained on in one task.
SAMPLE = 12_000
EPOCHS, ALPHA, BETA, L1, L2, SHORT = 4, 0.5, 1.0, 0.02, 1.0, 2.0
SCORED = "doc_id long, held_out boolean, score double, predicted int"


class _Hashes(dict):
    """word -> 64-bit hash; forgets all when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class _Forms(dict):
    """word -> 64-bit hash of its form: kinds of characters, runs as one, and whether it is long."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        kinds = "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in word.decode("utf-8", "replace"))
        runs = "".join(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)
        value = self[word] = xxhash.xxh64_intdigest(f"{runs}:{len(kinds) > 12}")
        return value


class Features:
    """text -> the places of its features and their values (square root of the count, then a length under one: short texts lean on the bias)."""

    def __init__(self, bits: int = BITS):
        self.shift, self.words, self.forms = np.uint64(64 - bits), _Hashes(), _Forms()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = (text or "").encode("utf-8", "replace").split()
        n = len(tokens)
        w = np.fromiter(map(self.words.__getitem__, tokens), np.uint64, n)
        f = np.fromiter(map(self.forms.__getitem__, tokens), np.uint64, n)
        two = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]
        shape = f[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + f[1:] * np.uint64(3)
        same = np.full(int((w[:-1] == w[1:]).sum()), 0x5851F42D4C957F2D, np.uint64)  # a word said twice
        size = np.full(1 + n // 8, 0x2545F4914F6CDD1D + 977 * n.bit_length(), np.uint64)  # how long the text is
        found = np.concatenate([w, two, f, shape, same, size]) * np.uint64(0xD6E8FEB86659FD93)
        place, count = np.unique(found >> self.shift, return_counts=True)
        value = np.sqrt(count.astype(np.float64))
        return place.astype(np.int64), value / math.sqrt(float((value**2).sum()) + SHORT)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. FTRL-proximal: z and n per coordinate, weights made from them when they are needed."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = np.int64(1 << bits)

    def weights(at):
        s = z[at]
        return np.where(np.abs(s) <= L1, 0.0, -(s - np.sign(s) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for place, value, y in rows:
            at, x = np.append(place, bias), np.append(value, 1.0)
            w = weights(at)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange((1 << bits) + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learns from documents that labels marks and whose crc32 of the id modulo 3 is not 1.

    Null labels and ids are left out; of several labels of one document the largest counts;
    without labels all weights are 0 and every score is one half.
    """
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
              .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "text", "quality")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, found = Features(bits), []
        for batch in batches:
            for doc_id, text, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                place, value = of(text.as_py())
                found.append((doc_id, int(y > 0), place.astype(np.int32), value.astype(np.float32)))
        found.sort(key=lambda r: (r[0], r[1], len(r[2])))
        order = np.random.default_rng(7).permutation(len(found))
        w, b = train([(found[i][2], found[i][3], found[i][1]) for i in order], bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], ["weights", "bias"])

    # one task has the sample, whose size is bounded; the driver gets the weights
    made = rows.repartition(1).mapInArrow(trained, "weights binary, bias double").first()
    return (np.frombuffer(made["weights"], np.float32), made["bias"]) if made else (np.zeros(1 << bits, np.float32), 0.0)


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; null texts are scored as empty. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 2**bits floats

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, b), of = shared.value, Features(bits)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(2)):
                place, value = of(text.as_py())
                out[i] = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[place] @ value) + b))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(scores, SCORED)


def keep_good(docs: DataFrame, weights: np.ndarray, bias: float, bits: int = BITS) -> DataFrame:
    """docs without those that score under one half; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, b), of = shared.value, Features(bits)
        for batch in batches:
            found = (of(t.as_py()) for t in batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([float(w[place] @ value) + b >= 0 for place, value in found], pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
