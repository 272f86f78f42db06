"""Nearest-centroid language identification (operator 10).

A text becomes a hashed vector of character-trigram frequencies (square roots, weighted by
inverse document frequency, unit length). Each language has several centroids from spherical
k-means; a text takes the language of the centroid of largest cosine, and is rejected if that
cosine lies below a floor learned for texts of its length.

Document frequencies cover all labelled rows; k-means is fitted on a sample of at most
``sample`` different texts per language (chosen by hash, so that copies of a text count once), the one bound here. The set of label values
is taken as small. Defined cases: a null text, or one without a letter, is ``und`` with score
0 and rejected; rows without a label are not learned from; without any label every text is
``und``; repeated rows are predicted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import settle
from .words import LOWER, buffers, release, slices, tidy

WIDTH = 1 << 13
UNKNOWN = "und"
_FOLD = LOWER.copy()
_FOLD[:128][~np.array([chr(b).isalpha() for b in range(128)])] = 32
_SLICE = 1 << 19
_TEXTS = 256  # a text takes WIDTH counters, however short


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts (texts x WIDTH) and the number of trigrams of each text."""
    texts = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((texts, WIDTH), np.float32), np.zeros(texts, np.int64)
    letters = _FOLD[data].astype(np.uint32)
    gram = (letters[:-2] << np.uint32(16)) | (letters[1:-1] << np.uint32(8)) | letters[2:]
    owner = np.repeat(np.arange(texts), np.diff(offsets))[:-2]
    inside = (np.arange(len(gram)) + 3 <= offsets[1:][owner]) & (gram != 0x202020)
    cell = owner[inside] * WIDTH + ((gram[inside] * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64)
    counts = np.bincount(cell, minlength=texts * WIDTH).reshape(texts, WIDTH)
    return counts, counts.sum(axis=1)


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text size and of few texts."""
    for part in slices(batch, text, _SLICE):
        for at in range(0, part.num_rows, _TEXTS):
            yield part.slice(at, _TEXTS)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.sqrt(counts, dtype=np.float32) * idf)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: np.ndarray  # by the number of trigrams as a power of two

    def predict(self, texts: pa.Array) -> pa.StructArray:
        """Language, cosine and rejection of lower-cased texts."""
        best, score, grams = [], [], []
        batch = pa.RecordBatch.from_arrays([texts.cast(pa.large_string())], names=["text"])
        for part in _parts(batch, 0):
            counts, n = _counts(*buffers(part.column(0)))
            cosine = _vectors(counts, self.idf) @ self.centroids.T
            top = cosine.argmax(axis=1)
            best.append(top)
            score.append(cosine[np.arange(len(top)), top])
            grams.append(n)
        best, score, grams = (np.concatenate(x) if x else np.zeros(0, int) for x in (best, score, grams))
        score = np.clip(score.astype(np.float64), 0.0, 1.0)
        low = score < self.floors[_power(grams)]
        return pa.StructArray.from_arrays(
            [pa.array(np.asarray(self.langs, dtype=object)[best], pa.string()), pa.array(score), pa.array(low)],
            names=["lang", "score", "rejected"])


def _power(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), 31)


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first starts."""
    chosen = [int((v @ v.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    centres = v[chosen]
    for _ in range(rounds):
        near = (v @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([v[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 3, sample: int = 400) -> Model | None:
    """Learn from rows whose text and label are given; null if there are none."""
    rows = (labelled.select(F.lower(F.col(text)).alias("text"), F.col(lang).cast("string").alias("lang"))
            .where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for part in _parts(batch, 0):
                total += (_counts(*buffers(part.column(0)))[0] > 0).sum(axis=0)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WIDTH)), pa.array(np.append(n, total))], names=["feature", "n"])

    found = (rows.select("text").mapInArrow(tidy(frequencies), "feature long, n long")
             .groupBy("feature").agg(F.sum("n").alias("n")).toPandas())  # WIDTH + 1 rows
    if found.empty or not found["n"].sum():
        return None
    seen = np.zeros(WIDTH + 1, np.int64)
    seen[found["feature"].to_numpy() + 1] = found["n"].to_numpy()
    idf = (np.log((1 + seen[0]) / (1 + seen[1:])) + 1).astype(np.float32)

    key = F.xxhash64("text")
    draw = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    different = settle(rows.select(key.alias("key"), "lang").distinct(), "different")  # copies of a text share one draw
    sizes = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 2.0 * sample / n)])
    picked = (different.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key")))
              .where(F.col("rank") <= sample).select("key", "lang"))
    picked = F.broadcast(settle(picked, "picked"))  # at most sample rows a language
    chosen = rows.withColumn("key", key).join(picked, ["key", "lang"]).select("text", "lang", "key")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # a task gives each text once
        for batch in batches:
            fresh = []
            for i, pair in enumerate(zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())):
                if pair not in seen:
                    seen.add(pair)
                    fresh.append(i)
            for part in _parts(batch.take(pa.array(fresh, pa.int64())), 0):
                counts, _ = _counts(*buffers(part.column(0)))
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(1), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                     pa.array([c[a].astype(np.int32) for c, a in zip(counts, at)], pa.list_(pa.int32()))], names=["key", "lang", "at", "n"])

    drawn = (chosen.mapInArrow(tidy(sparse), "key long, lang string, at array<int>, n array<int>")
             .groupBy("key", "lang").agg(F.first(F.struct("at", "n")).alias("v")).select("lang", "v.*").collect())  # at most sample rows a language
    langs, centroids, nearest = [], [], []
    for name in sorted({r["lang"] for r in drawn}):
        own = sorted((tuple(r["at"]), tuple(r["n"])) for r in drawn if r["lang"] == name)
        counts = np.zeros((len(own), WIDTH), np.int64)
        for row, (at, n) in zip(counts, own):
            row[list(at)] = n
        v = _vectors(counts, idf)
        centres = _cluster(v, per_lang)
        centroids.append(centres)
        langs += [name] * len(centres)
        nearest += list(zip(_power(counts.sum(axis=1)).tolist(), (v @ centres.T).max(axis=1).tolist()))
    floors, floor = np.zeros(32), 0.0
    for p in range(32):
        at = [c for q, c in nearest if q == p]
        floor = 0.5 * min(at) if len(at) >= 5 else floor
        floors[p] = floor
    floors = np.minimum.accumulate(floors[::-1])[::-1]  # a longer text is never judged more mildly
    return Model(idf, np.concatenate(centroids), langs, floors)


def identify(model: Model | None, text: Column) -> Column:
    """A struct ``lang``, ``score``, ``rejected`` for a text column."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if model is None:
        return unknown

    @F.arrow_udf("lang string, score double, rejected boolean")
    def nearest(texts: pa.Array) -> pa.Array:
        out = model.predict(texts)
        release()
        return out

    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), nearest(F.lower(text))).otherwise(unknown)


def held_out(id: Column) -> Column:
    """Rows kept out of learning: a quarter by the CRC of the id as text (a null id counts as empty)."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
