"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams of lengths 1 to 3 present in both,
over the geometric mean of the numbers present in each. A bounded sample of labelled texts gives
landmarks (Nystroem) and a one-versus-rest kernel ridge regression; texts are scored in batches
by matrix products with the landmarks, over the n-grams that some landmark has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Fixed odd multipliers of the n-gram hash.
MIX = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


@dataclass(frozen=True)
class Settings:
    """``per_label`` bounds the labelled sample and ``landmarks`` the landmarks; both are bounds of the fit alone, never of what is scored.

    An n-gram is told by ``bits`` bits of its hash; long texts of large alphabets have some 60,000 of them.
    """

    bits: int = 18
    lengths: int = 3
    per_label: int = 300
    landmarks: int = 128
    ridge: float = 1e-3


def presence(text: str, settings: Settings) -> np.ndarray:
    """True at the hash of every n-gram of the whole lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(1 << settings.bits, bool)
    shift = np.uint32(32 - settings.bits)
    mixed = np.zeros(0, np.uint32)
    for n in range(1, settings.lengths + 1):
        if len(codes) < n:
            break
        mixed = codes * MIX[0] if n == 1 else (mixed[:-1] * MIX[1] + codes[n - 1 :]) * MIX[0]
        out[(mixed ^ (mixed >> np.uint32(15))) * MIX[2] >> shift] = True
    return out


class Landmarks:
    """Texts as sorted n-gram hashes, and the kernel of others with them."""

    def __init__(self, grams: list[np.ndarray]):
        self.known = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int64)
        self.rows = np.zeros((len(grams), len(self.known)), np.float32)
        for row, found in zip(self.rows, grams):
            row[np.searchsorted(self.known, found)] = 1
        self.sizes = np.array([max(1, len(g)) for g in grams], np.float32)

    def kernel(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``rows``: which of the known n-grams texts have; ``sizes``: how many n-grams they have in all. One matrix product."""
        return rows.astype(np.float32) @ self.rows.T / np.sqrt(np.maximum(sizes, 1).astype(np.float32)[:, None] * self.sizes[None, :])

    def of_grams(self, grams: list[np.ndarray]) -> np.ndarray:
        """The kernel of texts given by their n-gram hashes."""
        rows = np.stack([np.isin(self.known, g, assume_unique=True) for g in grams])
        return self.kernel(rows, np.array([len(g) for g in grams]))


class Model:
    def __init__(self, grams: list[np.ndarray], labels: list[str], settings: Settings):
        """``grams``: sorted n-gram hashes of each text of the sample, in a fixed order."""
        self.settings = settings
        self.labels = sorted(set(labels))
        if not self.labels:
            return
        first: dict[bytes, int] = {}
        for i, g in enumerate(grams):
            first.setdefault(g.tobytes(), i)
        # Landmarks by turns from each label, so that a rare one has its share.
        kept = set(first.values())
        turns = [[i for i in range(len(labels)) if labels[i] == l and i in kept] for l in self.labels]
        chosen = [t[r] for r in range(max(map(len, turns))) for t in turns if r < len(t)][: settings.landmarks]
        self.landmarks = Landmarks([grams[i] for i in chosen])
        values, vectors = np.linalg.eigh(self.landmarks.of_grams([grams[i] for i in chosen]).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = self.landmarks.of_grams(grams).astype(np.float64) @ root
        y = np.array([[1.0 if l == m else -1.0 for m in self.labels] for l in labels])
        # Each label weighs the same, however many sample texts it has.
        weight = np.array([len(labels) / (len(self.labels) * labels.count(l)) for l in labels])[:, None]
        self.bias = (y * weight).sum(0) / weight.sum()
        inner = z.T @ (z * weight) + settings.ridge * len(labels) * np.eye(z.shape[1])
        self.weights = (root @ np.linalg.solve(inner, z.T @ ((y - self.bias) * weight))).astype(np.float32)

    def margins(self, texts: list[str]) -> np.ndarray:
        rows, sizes = np.zeros((len(texts), len(self.landmarks.known)), bool), np.zeros(len(texts))
        for i, text in enumerate(texts):
            found = presence(text, self.settings)
            rows[i], sizes[i] = found[self.landmarks.known], np.count_nonzero(found)
        return self.landmarks.kernel(rows, sizes) @ self.weights + self.bias.astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        real = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not self.labels or not real:
            return labels, scores
        margins = self.margins([texts[i] for i in real])
        odds = np.exp(4 * (margins - margins.max(1, keepdims=True)))
        odds /= odds.sum(1, keepdims=True)
        for i, best, p in zip(real, margins.argmax(1), odds.max(1)):
            labels[i], scores[i] = self.labels[best], float(min(1.0, p))
        return labels, scores


def fit(labelled: DataFrame, key: str, text: str, label: str, settings: Settings = Settings()) -> Model:
    """Fit on at most ``per_label`` rows of each label, those with the smallest hash of the key.

    Keys and labels alone are read to choose the rows: of a label with many rows only hashes below a share are looked
    at, which holds twice as many rows as are wanted, so no label is sorted whole. The texts become n-gram hashes on the
    executors, so the driver gets these alone.
    """
    order = Window.partitionBy("_label").orderBy("_hash", "_key")
    keys = labelled.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.xxhash64(F.col(key)).alias("_hash"))
    counts = keys.groupBy("_label").agg(F.count("*").alias("_count"))
    share = F.least(F.lit(1.0), (2 * settings.per_label + 100) / F.col("_count"))
    near = keys.join(counts, "_label").where(F.col("_hash").cast("double") <= share * 2.0**64 - 2.0**63).select("_key", "_label", "_hash")
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= settings.per_label).select("_key").distinct()
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(label).alias("_label")
    ).join(F.broadcast(chosen), "_key", "left_semi")

    def grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                made = np.flatnonzero(presence(batch.column(1)[at].as_py(), settings)).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(2).slice(at, 1), pa.array([made], pa.binary())], names=["_key", "_label", "_grams"])

    key_type = labelled.schema[key].dataType.simpleString()
    sample = sorted(rows.mapInArrow(grams, f"_key {key_type}, _label string, _grams binary").collect(), key=lambda r: (r["_label"], r["_key"], bytes(r["_grams"])))
    return Model([np.frombuffer(r["_grams"], "<u4").astype(np.int64) for r in sample], [r["_label"] for r in sample], settings)


def identify(docs: DataFrame, labelled: Column, key: str = "doc_id", text: str = "text", label: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Key, ``lang_pred`` and ``score`` of every document, by a model of the rows where ``labelled`` is true.

    The score is the share of the best label after an exponential of the margins. A null text or
    one without a letter is ``und`` with score 0, and so is every text if there is nothing to
    learn from. Null labels and keys are not learnt from. Whole texts are read; an empty table
    gives no rows; only key, text and label are read, the last for the fit alone.
    """
    model = fit(docs.where(labelled & F.col(key).isNotNull()), key, text, label, settings)
    held = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[key].dataType
    rows = 128

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                labels, scores = held.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(to_arrow_type(key_type)), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text").mapInArrow(score, f"`{key}` {key_type.simpleString()}, lang_pred string, score double")
