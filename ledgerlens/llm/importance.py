"""Importance resampling towards a target distribution (operator 12).

Texts are lowered in ASCII and split into words by an untrained pre-tokeniser, which gives each word
with its offsets. Windows over the offset pairs are the features: runs of 1 to ``most`` consecutive
words, each from the first word's start to the last word's end, spelled with one space between words.
A feature falls into the bucket of its CRC. The buckets' counts over the corpus and over the target
give every bucket a gain, the logarithm of the ratio of both smoothed shares; a document weighs the sum
of the gains of its features, and Gumbel noise from a hash of its id makes the largest scores a draw
without replacement.

A text is split once: each document's bucket counts are written to the folder of
``spark.checkpoint.dir`` and read again for the corpus counts and for the weights. A task returns one row a
bucket; the driver holds one gain a bucket. Ranks come from a range partitioning of the scores, numbered
inside each part and moved by the counts of the parts before (a row a part), so nothing is sorted in one task.

Defined cases: a null text has no words; a text of any length is split in pieces of about a million bytes,
cut outside words, and runs go on across them; a null id is hashed as empty text and comes last among ties;
repeated rows are drawn each, with ranks of their own; without target texts the gains still follow from the
smoothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .store import settle
from .words import buffers, slices, tidy

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OUTSIDE = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_PIECE = 1 << 20


def words_with_offsets(text: bytes, splitter: pre_tokenizers.Split | None = None, piece: int = _PIECE) -> Iterator[list[tuple[str, tuple[int, int]]]]:
    """The lowered words of UTF-8 bytes with their character offsets in the whole text, piece by piece."""
    splitter = splitter or pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
    text, at, base = text.lower(), 0, 0  # bytes are lowered in ASCII only
    while at < len(text):
        cut = _OUTSIDE.search(text, at + piece) if at + piece < len(text) else None
        end = cut.end() if cut else len(text)
        part = text[at:end].decode("utf-8", "replace")
        found = splitter.pre_tokenize_str(part)
        yield [(w, (a + base, z + base)) for w, (a, z) in found] if base else found
        at, base = end, base + len(part)


def features(text: bytes, most: int = 1, splitter: pre_tokenizers.Split | None = None, piece: int = _PIECE) -> Iterator[tuple[str, tuple[int, int]]]:
    """Runs of 1 to ``most`` words with the offset pair of each."""
    before: list = []
    for words in words_with_offsets(text, splitter, piece):
        if most == 1:
            yield from words
            continue
        words = before + words
        for n in range(1, most + 1):  # a run that ends in an earlier piece was given there
            for i in range(max(0, len(before) - n + 1), len(words) - n + 1):
                run = words[i:i + n]
                yield " ".join(w for w, _ in run), (run[0][1][0], run[-1][1][1])
        before = words[len(words) - most + 1:]


def bucket_counts(text: bytes, most: int, buckets: int, splitter: pre_tokenizers.Split) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets that occur, the features in each, and the number of words."""
    total, words = np.zeros(buckets, dtype=np.int64), 0
    if most == 1:
        runs = ((w for w, _ in part) for part in words_with_offsets(text, splitter))
    else:
        found = features(text, most, splitter)
        runs = iter(lambda: [w for w, _ in itertools.islice(found, 1 << 16)], [])
    for part in runs:
        for feature, n in Counter(part).items():
            total[zlib.crc32(feature.encode("utf-8")) % buckets] += n
            words += n if most == 1 or " " not in feature else 0
    at = np.flatnonzero(total)
    return at, total[at], words


def histograms(df: DataFrame, columns: Sequence[str], text: str, most: int, buckets: int) -> DataFrame:
    """``columns``, ``n_words``, ``n_features`` and each document's ``buckets`` with their ``counts``."""
    kept = df.select(*columns, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns),
                        "n_words long, n_features long, buckets array<int>, counts array<long>"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                data, offsets = buffers(part.column(part.num_columns - 1))
                found = [bucket_counts(data[a:z].tobytes(), most, buckets, splitter) for a, z in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([w for _, _, w in found], pa.int64()), pa.array([int(n.sum()) for _, n, _ in found], pa.int64()),
                     pa.array([a.astype(np.int32) for a, _, _ in found], pa.list_(pa.int32())), pa.array([n for _, n, _ in found], pa.list_(pa.int64()))],
                    names=[*columns, "n_words", "n_features", "buckets", "counts"])

    return kept.mapInArrow(tidy(split), schema)


def bucket_totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows; a task returns each bucket once."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            at = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            np.add.at(total, at, batch.column(1).flatten().to_numpy(zero_copy_only=False))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    found = counted.select("buckets", "counts").mapInArrow(tidy(task), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in found.collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B))))`` for each of the ``B`` buckets."""
    size, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_s + size) / (float(s + 1) * float(all_t + size))))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def weights(gains: np.ndarray, buckets: Column, counts: Column) -> Column:
    """The sum of the gains of a document's features."""
    @F.arrow_udf("long")
    def weigh(at: pa.Array, n: pa.Array) -> pa.Array:
        each = gains[at.flatten().to_numpy(zero_copy_only=False)] * n.flatten().to_numpy(zero_copy_only=False)
        lengths = pa.compute.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        total = np.append(0, np.cumsum(each))
        return pa.array(total[ends] - total[ends - lengths], pa.int64())

    return weigh(buckets, counts)


def noise(id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, score: str, id: str) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... by falling score and rising id (null last), over all rows."""
    order = [F.col(score).desc(), F.col(id).asc_nulls_last(), F.col("_draw").asc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*rows.columns, "_part", "_place"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(done, done + batch.num_rows)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(place), part, np.int32)), pa.array(place)], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_part int, _place long"])
    placed = (rows.withColumn("_draw", F.rand(11)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .drop("_draw").mapInArrow(tidy(number), schema))
    placed = settle(placed, "ranks")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part
    before = dict(zip(sorted(sizes), itertools.accumulate([0, *(sizes[p] for p in sorted(sizes))])))
    base = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)])[F.col("_part")] if before else F.lit(0)
    return placed.withColumn("rank", (base + F.col("_place") + 1).cast("long")).drop("_part", "_place")


def resample(documents: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", most: int = 1, buckets: int = 10_000,
             seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Every document's ``id``, ``n_features``, ``weight``, ``score`` and, if it is drawn, its ``rank``.

    ``floor(percent * N / 100)`` of the ``N`` documents with at least ``least_words`` words are drawn.
    """
    counted = settle(histograms(documents, [id], text, most, buckets), "histograms")
    gains = bucket_gains(bucket_totals(counted, buckets), bucket_totals(histograms(target, [], text, most, buckets), buckets))
    weighed = counted.select(F.col(id).alias("doc_id"), "n_words", "n_features", weights(gains, F.col("buckets"), F.col("counts")).alias("weight"))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    eligible = F.col("n_words") >= least_words
    drawn = percent * counted.where(eligible).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    first = ranked(scored.where(eligible).select(columns), "score", "doc_id")
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return first.union(scored.where(~eligible).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample_sql(buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> str:
    """The same draw in SQL for runs of one word; the checksum is computed byte by byte with the usual table (polynomial 0xEDB88320)."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH step AS (
  SELECT list(c ORDER BY n) AS p FROM (
    SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(n))),
docs AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {words} AS w FROM documents),
doc_words AS MATERIALIZED (SELECT n, w, count(*) AS m FROM (SELECT n, unnest(w) AS w FROM docs) GROUP BY n, w),
item_words AS MATERIALIZED (SELECT w, count(*) AS m FROM (SELECT unnest({words}) AS w FROM benchmark) GROUP BY w),
spelled AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM doc_words UNION ALL SELECT w FROM item_words)),
placed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, p[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS b FROM spelled, step),
corpus AS (SELECT b, sum(m) AS s FROM doc_words JOIN placed USING (w) GROUP BY b),
target AS (SELECT b, sum(m) AS t FROM item_words JOIN placed USING (w) GROUP BY b),
totals AS (SELECT (SELECT coalesce(sum(m), 0) FROM doc_words) AS all_s, (SELECT coalesce(sum(m), 0) FROM item_words) AS all_t),
gains AS (SELECT b, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + {buckets} AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST(all_t + {buckets} AS DOUBLE)))) AS gain FROM corpus LEFT JOIN target USING (b), totals),
sums AS (SELECT n, sum(m * gain) AS weight FROM doc_words JOIN placed USING (w) JOIN gains USING (b) GROUP BY n),
scored AS (
  SELECT n, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5)
      / 4294967296.0))) AS BIGINT) AS score
  FROM docs LEFT JOIN sums USING (n)),
places AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS eligible FROM scored WHERE n_features >= {least_words})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= {percent} * eligible // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (n)"""
