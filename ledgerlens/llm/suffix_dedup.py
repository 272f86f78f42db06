"""Repeated passages by sparse suffixes, grouped by hash in place of a suffix array (operator 5).

A passage repeats if ``passage`` consecutive words stand at two places of the corpus. Of all
suffixes only those at minimisers are kept: every run of ``passage`` words has the leftmost
least gram hash among its first ``reach`` grams, so equal runs keep the same suffix. Suffixes
are keyed and brought together by the hash of their first ``passage - reach + 1`` words, which
any repeated run around them shares. Where all neighbours of a key agree over the whole stretch
that the suffix answers for (extended left and right), the stretch repeats as one; otherwise equal
stretches count as one, the runs of each different stretch are compared by hash of their own, and
adjacent repeated runs are one interval. Extended runs that overlap become spans.

The result is exact up to 64-bit hashes: the union of all runs with an equal one elsewhere. The
first place of a run (smallest id, then text hash and position) is kept, later ones are marked
removed. Keys are counted before rows meet, so a passage of very many places is never
gathered. Defined cases: null and empty texts have no passage; rows with equal id and text
are one document for the order of places; an empty table gives no span; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, settle, whole_text
from .words import buffers, find_words, mix, release, sequence_hash, slices, tidy

PASSAGE, GRAM, REACH = 50, 8, 36
_BASE = 0x9FB21C651E98DF25
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            powers = np.full(n, base, dtype=np.uint64)
            powers[0] = 1
            _tables[k] = np.multiply.accumulate(powers)
    return _tables


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each window, by doubling."""
    value, at = h, np.arange(len(h))
    have = 1
    while have < width:
        step = min(have, width - have)
        left = value[:-step] <= value[step:]
        at = np.where(left, at[:-step], at[step:])
        value = np.where(left, value[:-step], value[step:])
        have += step
    return at


def suffixes(texts: pa.Array, passage: int = PASSAGE, gram: int = GRAM, reach: int = REACH):
    """Kept suffixes: text number, first and last run (in words) each answers for, key and stretch hash."""
    w = find_words(*buffers(texts))
    empty = np.zeros(0, np.int64)
    if len(w.hash) < passage:
        return empty, empty, empty, empty, empty
    grams = sequence_hash(w.hash, gram)
    at = _leftmost_least(grams, reach)[: len(w.hash) - passage + 1]
    run = np.arange(len(at))
    owner = np.searchsorted(w.first, run, side="right") - 1
    whole = run + passage <= w.first[owner + 1]
    run, at, owner = run[whole], at[whole], owner[whole]
    if not len(run):
        return empty, empty, empty, empty, empty
    new = np.ones(len(run), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(run)) - 1
    first_run, last_run, at, owner = run[begin], run[last], at[begin], owner[begin]
    key = sequence_hash(w.hash, passage - reach + 1)[at]
    power, inverse = _power_tables(len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, dtype=np.uint64)
    np.cumsum(w.hash * power[: len(w.hash)], out=total[1:])
    stop = last_run + passage
    stretch = mix((total[stop] - total[first_run]) * inverse[first_run]
                  + (stop - first_run).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at - first_run).astype(np.uint64))
    base = w.first[owner]
    return owner, first_run - base, last_run - base, key.view(np.int64), stretch.view(np.int64)


def run_hashes(texts: pa.Array, stretches: list[list[dict]], passage: int = PASSAGE):
    """The given stretches one after the other: text number, the stretch itself, and the hashes of its runs."""
    w = find_words(*buffers(texts))
    h = sequence_hash(w.hash, passage).view(np.int64)
    owner, spans, runs = [], [], []
    for i, own in enumerate(stretches):
        for s in own:
            owner.append(i)
            spans.append(s)
            runs.append(h[w.first[i] + s["a"]: w.first[i] + s["z"] + 1])
    return owner, spans, runs


def _documents(df: DataFrame, id: str, text: str) -> DataFrame:
    body = whole_text(F.col(text))
    return df.select(F.col(id).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))


def _place(*position: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", *position)


def repeated_runs(df: DataFrame, id: str, text: str) -> DataFrame:
    """Stretches of repeated runs: id, text hash, first and last run, and whether an equal one comes before."""
    documents = _documents(df, id, text)
    kind = df.schema[id].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                owner, a, z, key, stretch = suffixes(part.column(2))
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner), pa.array(a.astype(np.int32)),
                     pa.array(z.astype(np.int32)), pa.array(key, pa.int64()), pa.array(stretch, pa.int64())],
                    names=["doc_id", "text_hash", "a", "z", "key", "stretch"])

    kept = settle(documents.mapInArrow(tidy(keep), f"doc_id {kind}, text_hash long, a int, z int, key long, stretch long"), "suffixes")
    often = settle(kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("least"), F.max("stretch").alias("most"))
                   .where("n > 1").select("key", (F.col("least") == F.col("most")).alias("even")), "keys")
    shared = settle(kept.join(often, "key").drop("key"), "shared")
    discard(kept, often)
    classes = settle(shared.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"), F.min(_place("a")).alias("first"),
                                                   F.first(F.col("z") - F.col("a")).alias("width"), F.first("even").alias("even")), "classes")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("width").alias("hi")))
    even = classes.where("even").select("stretch", whole.alias("each"), whole.alias("fresh"), F.filter(whole, lambda s: F.lit(False)).alias("old"))
    inside = _repeated_inside(documents, classes.where("not even"), kind)
    marks = settle(even.unionByName(inside).join(classes.select("stretch", "first"), "stretch"), "marks")
    discard(classes, inside)
    later = F.transform("each", lambda s: s.withField("later", F.lit(True)))
    own = F.concat(F.transform("fresh", lambda s: s.withField("later", F.lit(False))), F.transform("old", lambda s: s.withField("later", F.lit(True))))
    spans = shared.join(marks, "stretch").select(
        "doc_id", "text_hash", "a", F.explode(F.when(_place("a") == F.col("first"), own).otherwise(later)).alias("s"))
    return spans.select("doc_id", "text_hash", (F.col("a") + F.col("s.lo")).alias("a"), (F.col("a") + F.col("s.hi")).alias("z"), F.col("s.later").alias("later"))


def _repeated_inside(documents: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """Per different stretch, its repeated runs as intervals: all, those first there, and those with an earlier place.

    Only the first place of a stretch is read again, whatever the number of its places.
    """
    reps = (classes.groupBy(F.col("first.doc_id").alias("own_id"), F.col("first.text_hash").alias("own_hash"))
            .agg(F.collect_list(F.struct(F.col("first.a").alias("a"), (F.col("first.a") + F.col("width")).alias("z"), "stretch", "n")).alias("stretches")))
    reps = settle(reps, "uneven")
    # merged whatever the sizes: texts are exchanged alike for few and for many stretches
    held = documents.join(reps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                owner, spans, runs = run_hashes(part.column(2), part.column(3).to_pylist())
                take = pa.array(owner, pa.int64())
                ends = np.cumsum([0, *(len(r) for r in runs)])
                flat = pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array([s["a"] for s in spans], pa.int32()),
                     pa.array([s["stretch"] for s in spans], pa.int64()), pa.array([s["n"] for s in spans], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    names=["doc_id", "text_hash", "from", "stretch", "n", "runs"])

    stretches = settle(held.select("doc_id", "text_hash", "text", "stretches").mapInArrow(
        tidy(hashes), f"doc_id {kind}, text_hash long, from int, stretch long, n long, runs array<long>"), "stretches")
    runs = stretches.select("doc_id", "text_hash", "from", "stretch", "n", F.posexplode("runs").alias("i", "run")).withColumn("a", F.col("from") + F.col("i"))
    twice = settle(runs.groupBy("run").agg(F.sum("n").alias("n"), F.min(_place("a")).alias("least")).where("n > 1").select("run", "least"), "twice")
    found = runs.select("doc_id", "text_hash", "a", "stretch", "i", "run").join(twice, "run")
    fresh = F.when(_place("a") == F.col("least"), F.col("i"))
    sets = found.groupBy("stretch").agg(F.collect_set("i").alias("all_runs"), F.collect_set(fresh).alias("new_runs"))  # a stretch has at most REACH runs
    out = settle(sets.withColumn("old_runs", F.array_except("all_runs", "new_runs")).select(
        "stretch", _intervals(F.col("all_runs")).alias("each"), _intervals(F.col("new_runs")).alias("fresh"), _intervals(F.col("old_runs")).alias("old")), "inside")
    discard(reps, stretches, twice)
    return out


def _intervals(numbers: Column) -> Column:
    """Sorted intervals of adjacent numbers."""
    lows = F.sort_array(F.filter(numbers, lambda x: ~F.array_contains(numbers, x - 1)))
    highs = F.sort_array(F.filter(numbers, lambda x: ~F.array_contains(numbers, x + 1)))
    return F.transform(F.arrays_zip(lows.alias("lo"), highs.alias("hi")), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))


def _joined(df: DataFrame, id: str, text: str, gap: int) -> DataFrame:
    """Stretches of repeated runs, joined where the next run begins up to ``gap`` words after the last word of those before."""
    runs = repeated_runs(df, id, text).select("doc_id", "text_hash", "a", (F.col("z") + PASSAGE).alias("stop"), "later").distinct()
    key = ["doc_id", "text_hash", "later"]
    before = Window.partitionBy(*key).orderBy("a", "stop")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.withColumn("new", F.coalesce((F.col("a") > reach + gap).cast("int"), F.lit(1)))
    islands = starts.withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*key, "island").agg(F.min("a").alias("first_word"), F.max("stop").alias("stop"))
    return spans.select("doc_id", "text_hash", F.col("first_word").cast("long"),
                        (F.col("stop") - F.col("first_word")).cast("long").alias("n_words"), F.col("later").alias("removed"))


def repeated_spans(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of repeated words per document: ``first_word``, ``n_words``, and ``removed`` if earlier elsewhere.

    Kept spans join runs that occur first there, removed spans the later ones; both may overlap.
    """
    return _joined(df, id, text, 0)


def cut_bounds(stretches: list[dict]) -> list[tuple[int, int]]:
    """Word bounds to cut, in order, so that no later run stays whole.

    ``stretches`` are of adjacent runs: every run inside a removed one has an earlier place. A later run
    loses the words that no kept run covers; one without such words is cut whole. So first
    places stay whole unless they overlap a later run which they cover, and each word still stands at
    an earlier place.
    """
    kept: list[list[int]] = []
    for a, z in sorted((s["first_word"], s["first_word"] + s["n_words"]) for s in stretches if not s["removed"]):
        if kept and a <= kept[-1][1]:
            kept[-1][1] = max(kept[-1][1], z)
        else:
            kept.append([a, z])
    ends, cuts = [z for _, z in kept], []
    for at, stop in ((s["first_word"], s["first_word"] + s["n_words"]) for s in stretches if s["removed"]):
        for a, z in kept[bisect_right(ends, at):]:
            if a >= stop:
                break
            if a > at:
                cuts.append((at, a))
            if min(z, stop) - max(a, at) >= PASSAGE:
                cuts.append((max(a, at), min(z, stop)))
            at = z
        if at < stop:
            cuts.append((at, stop))
    out: list[tuple[int, int]] = []
    for a, z in sorted(cuts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def cut_words(texts: pa.Array, spans: list[list[dict] | None]) -> list[str]:
    """Texts without the words to cut and the white space after each of them."""
    data, offsets = buffers(texts)
    w = find_words(data, offsets)
    raw, out = data.tobytes(), []
    for i, cuts in enumerate(spans):
        at, keep, first, last = int(offsets[i]), [], int(w.first[i]), int(w.first[i + 1])
        for a, z in cut_bounds(cuts or []):
            keep.append(raw[at: int(w.start[first + a])])
            at = int(w.start[first + z]) if first + z < last else int(offsets[i + 1])
        keep.append(raw[at: int(offsets[i + 1])])
        out.append(b"".join(keep).decode())
    return out


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """``df`` with later occurrences of repeated passages cut from ``text`` (see ``cut_bounds``).

    ``length`` names a column of text lengths, which is set anew where the text was cut.
    Texts of which no word is left are dropped; texts without removed spans stay as they are.
    """
    spans = _joined(df, id, text, 1 - PASSAGE)  # of adjacent runs
    cuts = settle(spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first_word", "n_words", "removed")).alias("_llm_cuts"))
                  .where(F.exists("_llm_cuts", lambda c: c["removed"])).select(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash"), "_llm_cuts"), "cuts")

    discard(spans)

    @F.arrow_udf("string")
    def without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out: list[str] = []
        for part in slices(pa.RecordBatch.from_arrays([texts, cuts], names=["text", "cuts"]), 0):
            out += cut_words(part.column(0), part.column(1).to_pylist())
        release()
        return pa.array(out, pa.string())

    own = F.xxhash64(whole_text(df[text]))
    joined = df.join(cuts, df[id].eqNullSafe(F.col("_llm_id")) & (own == F.col("_llm_hash")), "left")
    uncut = F.when(F.col("_llm_cuts").isNotNull(), F.col(text))  # other texts stay in the JVM
    kept = joined.withColumn(text, F.when(F.col("_llm_cuts").isNotNull(), without(uncut, "_llm_cuts")).otherwise(F.col(text)))
    if length:
        now = F.length(text).cast(df.schema[length].dataType)
        kept = kept.withColumn(length, F.when(F.col("_llm_cuts").isNotNull(), now).otherwise(F.col(length)))
    kept = kept.where(F.col("_llm_cuts").isNull() | F.col(text).rlike(r"[^ \t\n\x0B\f\r]"))
    return kept.select(*df.columns)


def repeated_spans_sql() -> str:
    """The same spans in SQL, by a digest of every run of words."""
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
runs AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - {PASSAGE - 2}), lambda i: md5(array_to_string(ws[i:i + {PASSAGE - 1}], ' ')))) AS run,
    unnest(range(0, len(ws) - {PASSAGE - 1})) AS a FROM words WHERE len(ws) >= {PASSAGE}),
placed AS (SELECT doc_id, a, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) > 1 AS removed FROM runs),
steps AS (
  SELECT doc_id, a, removed, coalesce(CAST(a > lag(a) OVER (PARTITION BY doc_id, removed ORDER BY a) + {PASSAGE} AS INTEGER), 1) AS new
  FROM placed WHERE n > 1),
islands AS (SELECT doc_id, a, removed, sum(new) OVER (PARTITION BY doc_id, removed ORDER BY a) AS island FROM steps)
SELECT doc_id, CAST(min(a) AS BIGINT) AS first_word, CAST(max(a) + {PASSAGE} - min(a) AS BIGINT) AS n_words, removed
FROM islands GROUP BY doc_id, removed, island"""
