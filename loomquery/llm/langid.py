"""Language identification with blended-spectrum string kernels, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import pieces, table
from ._text import code_points

BITS = 15
SIZE = 1 << BITS
ORDERS = (1, 2, 3, 4)
#: Labelled documents that the model is fitted on for each language, at most, and landmarks among them in all.
FIT_ROWS, LANDMARKS = 400, 256
RIDGE = 1e-2
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def _is_letter(points: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        out[i] = chr(points[i]).isalpha()
    return out


def presence(text: str | None, flags: np.ndarray) -> bool:
    """Sets the buckets of the n-grams that occur in a whole text; False if it has no letter."""
    points = code_points((text or "").lower())
    letter = _is_letter(points)
    if not letter.any():
        return False
    c = np.where(letter, points, 32).astype(np.uint32)
    for at in range(0, len(c), 1 << 20):  # bounded memory for very long texts
        part = c[max(0, at - max(ORDERS) + 1) : at + (1 << 20)]
        h = np.full(len(part), 0x811C9DC5, dtype=np.uint32)
        for n in ORDERS:
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] * np.uint32(0x01000193)) ^ (part[n - 1 :] * np.uint32(0x9E3779B1))
            code = h ^ (h >> np.uint32(15))
            flags[(code * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.intp)] = 1
    return True


@dataclass
class Model:
    """Languages and, for each, the weight of every n-gram bucket and an offset.

    usual: share of each language's fitted texts that hold a bucket; chance and low: mean of it over all buckets, and over
    those of the fitted texts, each against the others, at the lowest hundredth.
    """

    langs: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, 0), np.float32))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0))
    usual: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, 0), np.float32))
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, x: np.ndarray) -> np.ndarray:
        """One-versus-rest outputs of a batch of presence rows: k(x, landmarks) times the coefficients.

        (X Z') A is taken as X (Z' A): the landmark matrix is folded into the weights once.
        """
        norm = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float64), 1))
        return (x.astype(np.float32) @ self.weights) / norm[:, None] + self.offset

    def nearness(self, x: np.ndarray) -> np.ndarray:
        """How usual the n-grams of presence rows are in the language nearest by this: 0 as by chance, 1 as in its least usual texts.

        Unlike the outputs, which sum to a constant, this is low for texts unlike all that was learned.
        """
        mean = (x.astype(np.float32) @ self.usual) / np.maximum(x.sum(axis=1, dtype=np.float64), 1)[:, None]
        return ((mean - self.chance) / np.maximum(self.low - self.chance, 1e-6)).max(axis=1)


def fit(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression, one language against the rest, on Nystroem features.

    ``packed``: presence bits of the texts, eight to a byte; rows are unpacked in blocks, so the memory is
    that of the landmarks. k(x, z) = shared n-grams / sqrt(n-grams of x times those of z). Landmarks are
    taken from the languages in turn.
    """
    names = sorted(set(langs))
    if not names:
        return Model([])

    def rows(at) -> np.ndarray:
        x = np.unpackbits(packed[at], axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    own = np.array([names.index(a) for a in langs])
    turn = np.concatenate([np.arange((own == k).sum()) for k in range(len(names))])
    z = rows(np.concatenate([np.flatnonzero(own == k) for k in range(len(names))])[np.argsort(turn, kind="stable")][:landmarks])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm ** -1/2, up to a rotation
    phi = np.concatenate([rows(slice(i, i + 256)) @ z.T for i in range(0, len(own), 256)]).astype(np.float64) @ root
    y = np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = np.array([1 / (own == k).sum() for k in own])[:, None]  # each language weighs the same
    mean, center = (share * phi).sum(0) / share.sum(), (share * y).sum(0) / share.sum()
    a, b = phi - mean, y - center
    beta = np.linalg.solve(a.T @ (share * a) + ridge * np.eye(a.shape[1]), a.T @ (share * b))
    usual, low = np.zeros((SIZE, len(names)), np.float32), np.zeros(len(names))
    for k in range(len(names)):
        at = np.flatnonzero(own == k)
        held = sum(np.unpackbits(packed[at[i : i + 256]], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(at), 256))
        usual[:, k] = held / len(at)
        rest = (held - 1) / max(len(at) - 1, 1)  # without the text itself
        low[k] = np.quantile([rest[np.unpackbits(packed[i]) > 0].mean() for i in at], 0.01)
    return Model(names, (z.T @ (root @ beta).astype(np.float32)).astype(np.float32), center - mean @ beta, usual, usual.mean(axis=0, dtype=np.float64), low)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _packed(batches):
    for batch in batches:
        langs, bits = [], []
        for part in pieces(batch, 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                flags = np.zeros(SIZE, np.uint8)
                if presence(text, flags):
                    langs.append(lang)
                    bits.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bits, pa.binary())], ["lang", "bits"])


def train(docs: DataFrame, id_col: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Fits on ``rows`` documents of each language at most, whole texts, none of them held out.

    The driver gets SIZE / 8 bytes for each of them. Candidates are ranked by a hash of the id; a language's
    hashes are first cut at eight times the share wanted, so that its ranking does not grow with the corpus.
    """
    known = docs.where(~held_out(F.col(id_col)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = known.select(F.col(id_col).alias("__id"), F.col("lang").cast("string").alias("__lang"))
    share = ids.groupBy("__lang").agg((F.lit(8.0 * rows) / F.count("*")).alias("__share"))  # a row for each language
    place = F.shiftrightunsigned(F.xxhash64("__id"), 11) / F.lit(float(1 << 53))
    ids = ids.join(F.broadcast(share), "__lang").withColumn("__u", place).where("__u <= __share")
    w = Window.partitionBy("__lang").orderBy("__u", "__id")
    ids = ids.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= rows)
    texts = known.join(F.broadcast(ids.select("__id").distinct()), F.col(id_col) == F.col("__id"), "left_semi")
    sample = texts.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_packed, "lang string, bits binary").collect()
    sample = sorted(sample, key=lambda r: (r["lang"], bytes(r["bits"])))
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in sample), np.uint8).reshape(len(sample), SIZE // 8)
    return fit(packed, [r["lang"] for r in sample])


def _predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    langs, score, near = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        x = np.zeros((len(part), SIZE), np.uint8)
        has = np.array([presence(t, x[i]) for i, t in enumerate(part)])
        if not model.langs:
            continue
        s = model.score(x)
        best = s.argmax(axis=1)
        for i in np.flatnonzero(has):
            langs[at + i] = model.langs[best[i]]
        score[at : at + len(part)] = np.where(has, np.clip((s.max(axis=1) + 1) / 2, 0, 1), 0)
        near[at : at + len(part)] = np.where(has, model.nearness(x), 0)
    return langs, score, near


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with __lang_pred, __score and __near (``Model.nearness``), from the text alone.

    A null text or one without a letter is ``und`` with score and nearness 0, and so is every text if nothing was
    learned. Repeated rows get equal results; an empty table gives no rows. Columns named like a result are
    replaced, all others pass through.
    """
    docs = docs.select(*(c for c in docs.columns if c not in ("__lang_pred", "__score", "__near")))
    at = docs.columns.index(text_col)
    names = [*docs.columns, "__lang_pred", "__score", "__near"]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, at):
                langs, score, near = _predict(model, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(near)], names)

    schema = T.StructType([*docs.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__near", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op10_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from those not held out; cases as in ``predict``."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
