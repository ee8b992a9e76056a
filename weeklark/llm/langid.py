r"""Language identification by the nearest of several centroids per language.

Features are hashed byte n-grams (1 to 3 bytes) of the lower-cased text with
everything but letters turned into single spaces; their counts are damped,
weighted by inverse document frequency and normalised. The frequencies are
taken over all learning documents. The centroids come from spherical k-means
over a bounded sample: about ``PER_LANGUAGE`` documents of each language,
chosen by a hash of doc_id (all of a rarer language). A prediction is the
language of the centroid with the largest cosine; a text further from it
than the radius of that language is rejected. The radius leaves room beyond
the sample: it lies where the cosine is ``KEEP`` times the least one of the
sample's members with their own centroids.

Edge cases: texts that are null or without letters are ``und`` with score
0.0 and rejected; documents of null language are not learnt from; with
nothing to learn from everything is ``und``, and an empty table gives no
rows; repeated rows and long texts need no special care, since every text
is read whole, one at a time; of equal cosines the first centroid counts,
by order of language; columns called lang_pred, score or rejected are
replaced, others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from .common import kept_by, small_batches, with_fields

UND = "und"
DIMENSIONS = 4096
PER_LANGUAGE = 500
CENTROIDS = 3
KEEP = 0.5
ROUNDS = 12
BATCH = 256

_ASCII = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _bytes_of(text: str | None) -> bytes | None:
    """Letters and single spaces in UTF-8; None without letters."""
    if not text:
        return None
    low = text.lower()
    raw = low.encode()
    if not raw.isascii():
        wide = {c for c in set(low) if c > "\x7f" and not c.isalpha()}
        if wide:
            raw = low.translate({ord(c): " " for c in wide}).encode()
    words = raw.translate(_ASCII).split()
    return b" " + b" ".join(words) + b" " if words else None


def counts_of(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    raw = _bytes_of(text)
    if raw is None:
        return None
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(40503 * 65537 % (1 << 32))
    three = two[:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)
    grams = np.concatenate((b * np.uint32(2654435769), two ^ (two >> np.uint32(15)), three ^ (three >> np.uint32(13))))
    return np.bincount((grams * np.uint32(668265263) >> np.uint32(8)) % np.uint32(dimensions), minlength=dimensions)


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents; those of null doc_id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Centroids (rows), the language of each, their radii (as distances), and the inverse document frequencies."""

    languages: list[str]
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [UND] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for at in range(0, len(texts), BATCH):
            found = [(at + i, c) for i, t in enumerate(texts[at:at + BATCH]) if (c := counts_of(t, len(self.idf))) is not None]
            if not found or not self.languages:
                continue
            cosines = self.vectors(np.array([c for _, c in found])) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for (i, _), k, row in zip(found, best.tolist(), cosines, strict=True):
                cosine = float(min(max(row[k], 0.0), 1.0))
                langs[i], scores[i], rejected[i] = self.languages[k], cosine, bool(1.0 - cosine > self.radii[k])
        return langs, scores, rejected


def _frequencies(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("langid")
        seen = np.zeros(dimensions + 1, np.int64)  # the last counts documents
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = counts_of(text, dimensions)
                if counts is not None:
                    seen[:-1] += counts > 0
                    seen[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1)), pa.array(seen)], ["feature", "n"])

    return run


def _features(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = counts_of(text, dimensions)
                if counts is not None:
                    langs.append(lang)
                    rows.append(zlib.compress(np.minimum(counts, 65_535).astype("<u2").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "counts"])

    return run


def _clusters(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from starts spread by their closeness to the mean; centroids and the largest distance of a member to its own."""
    k = min(k, len(x))
    ranks = np.argsort(x @ x.mean(axis=0), kind="stable")
    c = np.array([x[part].mean(axis=0) for part in np.array_split(ranks, k)])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    cosines = x @ c.T
    own = cosines.argmax(axis=1)
    return c, np.array([1.0 - cosines[own == j, j].min() if (own == j).any() else 0.0 for j in range(len(c))])


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, keep: float = KEEP) -> Model:
    """Learn from text and lang of ``docs`` (doc_id only chooses the sample). What reaches the driver: one row per feature, and the sample."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull())
    df = known.select("text").mapInArrow(_frequencies(dimensions), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(dimensions + 1)
    for row in df:
        seen[row["feature"]] = row["n"]
    idf = np.log((seen[-1] + 1) / (seen[:-1] + 1)) + 0.05
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    spark = docs.sparkSession
    if not sizes:
        return Model([], np.zeros((0, dimensions), np.float32), np.zeros(0), idf.astype(np.float32))
    share = spark.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in sizes.items()], "lang string, share double")
    drawn = known.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    rows = drawn.select("lang", "text").mapInArrow(_features(dimensions), "lang string, counts binary").orderBy("lang", "counts").collect()
    model = Model([], np.zeros((0, dimensions), np.float32), np.zeros(0), idf.astype(np.float32))
    langs, centres, radii = [], [], []
    for lang in sorted({r["lang"] for r in rows}):
        x = model.vectors(np.array([np.frombuffer(zlib.decompress(r["counts"]), "<u2") for r in rows if r["lang"] == lang]))
        c, far = _clusters(x, centroids)
        langs += [lang] * len(c)
        centres.append(c)
        radii.append(np.full(len(c), 1.0 - keep * (1.0 - float(far.max()))))
    return Model(langs, np.concatenate(centres).astype(np.float32), np.concatenate(radii), idf.astype(np.float32)) if langs else model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score and rejected to every row (columns so named are replaced); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size: centroids x dimensions, both parameters
    kept = docs.drop("lang_pred", "score", "rejected")
    at = kept.columns.index("text")
    names = [*kept.columns, "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names)

    return kept.mapInArrow(run, with_fields(kept.schema, lang_pred=StringType(), score=DoubleType(), rejected=BooleanType()))
