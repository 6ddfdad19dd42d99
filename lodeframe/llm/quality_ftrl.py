"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix
from .labelled import FIT_ROWS, fold, training_sample

BITS = 20
#: FTRL-proximal: learning rate, its smoothing, L1 and L2; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.2, 1.0, 0.02, 0.5, 3
#: The two families, words and word shapes, count alike: each is scaled to this length.
SCALE = 4.0
SAME = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xF90BDC6BE5BE97B7))
STEP = np.uint64(0x9E3779B97F4A7C15)


class CharClasses(dict):
    """A for capitals, a for other letters, 9 for digits; other characters stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        value = self[code] = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        return value


class Shapes(WordHashes):
    """Hashes of word shapes: character classes without repeats, and a coarse length."""

    classes = CharClasses()
    repeats = re.compile(r"(.)\1+")

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        shape = self.repeats.sub(r"\1", text.translate(self.classes))
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(f"{shape}\0{min(len(text) // 4, 6)}", 7)
        return value


class Grams:
    """Hashed unigrams and bigrams of words and of their shapes."""

    def __init__(self, bits: int = BITS):
        self.words, self.shapes, self.shift = WordHashes(seed=1), Shapes(), np.uint64(64 - bits)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices, with repeats, and a value for each: SCALE over the root of the family's size."""
        found = (text or "").encode("utf-8", "replace").split()
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        w, s = self.words.of([x.lower() for x in found]), self.shapes.of(found)
        pairs = [np.where(a[1:] == a[:-1], SAME[k], mix(a[:-1] * STEP + a[1:])) for k, a in ((0, w), (1, s))]
        index = np.concatenate([w, pairs[0], mix(s + STEP), pairs[1]]) >> self.shift
        value = np.full(len(index), SCALE / len(found), np.float32)
        return index.astype(np.int64), value


def train(texts: list[str], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. An empty sample gives none and a bias of 0."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    grams = Grams(bits)
    rows = []
    for text in texts:
        index, value = grams.of(text)
        unique, where = np.unique(index, return_inverse=True)
        rows.append((unique.astype(np.int32), np.bincount(where, value, len(unique)).astype(np.float32) if len(unique) else value))
    order = np.random.default_rng(0)

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, value = rows[k]
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            b = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w @ value + b, -30, 30)))
            g = (p - labels[k]) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
            gb = p - labels[k]
            bias_z += gb - (np.sqrt(bias_n + gb * gb) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += gb * gb
    return weights(z, n).astype(np.float32), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, held_out: int = 2, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1) and predicted (1 from threshold on).

    Fitted on up to fit_rows labelled rows outside the held-out fold (crc32 of the id as text, modulo `modulus`; labelled.training_sample). Null and empty
    texts get the bias alone; texts of any length are read whole; without labels every score is 0.5. Repeated rows get equal scores, null ids stay; an empty table gives no rows. Further columns of either table
    are ignored. The weights, 4 MB, are broadcast.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(*training_sample(docs, labels, "quality", modulus, held_out, fit_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = weights.value
        grams = Grams()
        for batch in batches:
            scores = []
            for text in batch["text"].to_pylist():
                index, value = grams.of(text)
                scores.append(float(w[index] @ value) + bias if len(index) else bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold() % modulus == held_out).alias("held_out"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
