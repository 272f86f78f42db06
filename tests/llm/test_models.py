"""Toxicity, importance resampling and centroid clustering against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from ledgerlens.llm import centroids, importance, toxicity
from tests.conftest import SF

from .data import documents, hard_rows, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- centroid clustering ------------------------------------------------------------

def plain_clusters(rows, width, k, rounds, seed=3, scale=1024):
    kept = []
    for d, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((d, [math.floor(scale * x) for x in v]))
    start = sorted((hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest(), v) for d, v in kept)
    cs = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(cs))

    for _ in range(rounds):
        own = [[v for _, v in kept if nearest(v)[1] == i] for i in range(len(cs))]
        cs = [[sum(x) // len(o) for x in zip(*o)] if o else c for c, o in zip(cs, own)]
    last = [(d, *nearest(v)[::-1]) for d, v in kept]
    each = Counter()
    for _, i, dist in last:
        each[i] += dist
    return sorted(((d, i, dist, each[i], sum(each.values()), hashlib.sha256(",".join(map(str, cs[i])).encode()).hexdigest())
                   for d, i, dist in last), key=str)


def embeddings(spark, rows):
    return spark.createDataFrame([(d, v, "x", 1) for d, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")


def vectors(kind):
    rng = np.random.default_rng(4)
    if kind == "ties":
        rows = [(i, rng.integers(0, 2, 4).astype(float).tolist()) for i in range(300)]
    elif kind == "groups":
        middle = rng.normal(size=(6, 4)) * 20
        rows = [(i, (middle[i % 6] + rng.normal(size=4)).tolist()) for i in range(900)]
    elif kind == "large":
        rows = [(i, (rng.normal(size=4) * 10.0 ** (i % 6)).tolist()) for i in range(120)]
    else:
        rows = [(i, rng.normal(size=4).tolist()) for i in range(400)] + [(i, [0.5, -0.25, 0.0, 1.0]) for i in range(400, 700)]
    return rows + [(1000, None), (1001, [1.0]), (1002, [1.0, None, 0.0, 2.0]), (1003, [float("nan"), 0.0, 0.0, 1.0]), (1004, [float("inf"), 0.0, 0.0, 1.0]),
                   (1005, []), (None, [0.25, 0.5, 0.5, 0.0]), (7, rows[7][1]), (7, rows[7][1]), (1006, [0.0] * 4), (1007, [1e300, 0.0, 0.0, 0.0])][:-1]


@pytest.mark.parametrize("kind", ["ties", "groups", "large", "hot"])
def test_clusters_are_those_of_plain_rounds(spark, kind):
    rows = vectors(kind)
    got = centroids.cluster_embeddings(embeddings(spark, rows).repartition(3), width=4, k=5, rounds=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows, 4, 5, 4)


def test_boxes_leave_out_only_centroids_that_are_never_nearest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        c = rng.integers(-50, 50, size=(6, 3))
        points = rng.integers(-40, 40, size=3) + rng.integers(0, 12, size=(40, 3))
        may = centroids.candidates(points.min(axis=0)[None].astype(float), points.max(axis=0)[None].astype(float), c)[0]
        d = ((points[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert may[d.argmin(axis=1)].all()


def test_boxes_spare_comparisons_of_grouped_vectors(spark):
    _, found = centroids.cluster_vectors(embeddings(spark, vectors("groups")), "vec_id", "embedding", 4, k=6, rounds=4, block_rows=16)
    assert found.compared < 0.5 and sum(found.sizes) == 900 + 4


def test_few_and_no_vectors(spark):
    few = [(1, [0.5, 0.5]), (2, [-1.0, 3.0]), (3, [0.1, 0.2])]
    got = centroids.cluster_embeddings(embeddings(spark, few), width=2, k=8, rounds=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(few, 2, 8, 2) and all(r["distance"] == 0 for r in got)
    for rows in ([], [(1, None)], [(1, [1.0])]):
        out = centroids.cluster_embeddings(embeddings(spark, rows), width=2)
        assert out.collect() == [] and out.columns[:3] == ["vec_id", "cluster", "distance"]


def test_components_beyond_64_bits_take_no_part(spark):
    got = centroids.cluster_embeddings(embeddings(spark, [(1, [1e300, 0.0]), (2, [1e15, 0.0]), (3, [0.0, 0.0])]), width=2, k=1, rounds=1).collect()
    assert sorted(r["vec_id"] for r in got) == [2, 3] and all(r["distance"] is None for r in got)


# ---- importance resampling ----------------------------------------------------------

def plain_draw(rows, target, most, buckets, percent, least, seed=2024):
    def runs(text):
        w = WORD.findall(lowered(text))
        return [" ".join(w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)], len(w)

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(bucket(f) for x in texts for f in runs(x)[0]) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out, eligible = [], []
    for d, x in rows:
        found, n = runs(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            eligible.append(out[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(eligible[:percent * len(eligible) // 100]):
        r[4] = i + 1
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_draw_is_that_of_a_plain_version(spark, most):
    rows = [(d, t) for d, t, _ in hard_rows()] + [(100 + i, sentence(random.Random(i), 10 + i)) for i in range(40)]
    items = ["River stone, cloud paper!", "green light window", None, ""]
    docs = documents(spark, [(d, t, None) for d, t in rows]).withColumn("rank", F.lit("x")).withColumn("weight", F.lit("x"))
    got = importance.resample(docs.repartition(3), spark.createDataFrame([(t,) for t in items], "text string"), most=most, buckets=500, percent=40, least_words=15)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_draw(rows, items, most, 500, 40, 15)


def test_offsets_and_pieces_of_long_texts():
    splitter = pre_tokenizers.Split(Regex(importance.WORD), "removed", invert=True)
    text = "Ünï, Cödé  x1\n" * 50 + "z" * 400 + " " + sentence(random.Random(2), 200)
    whole = list(importance.features(text.encode(), 3, splitter))
    pieces = list(importance.features(text.encode(), 3, splitter, piece=64))
    assert Counter(pieces) == Counter(whole)
    for feature, (a, z) in whole:
        assert " ".join(WORD.findall(lowered(text[a:z]))) == feature
    assert list(importance.features(b"", 2)) == [] and list(importance.features(b" .,- ", 2)) == []


def test_a_hot_row_and_empty_tables(spark):
    hot = [(5, sentence(random.Random(3), 30), None)] * 200 + [(i, sentence(random.Random(i), 30), None) for i in range(10, 60)]
    none = spark.createDataFrame([], "text string")
    got = importance.resample(documents(spark, hot), none, percent=90).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 226))
    assert importance.resample(documents(spark, []), none).collect() == []


# ---- toxicity -----------------------------------------------------------------------

def weigh(text, weights=None):
    seeds = toxicity._seed_keys()
    lexicon = toxicity.Lexicon.of({toxicity._key(w.encode()): x for w, x in (weights or {"idiot": 4.0}).items()}, seeds)
    return float(lexicon.evidence(pa.array([text], pa.string()))[0])


def test_clauses_are_weighed_in_context():
    plain = weigh("what an idiot that was")
    assert plain == 4.0
    assert weigh("you are an idiot there") == 4.0 * 1.25
    assert weigh("that was not an idiot there") == 4.0 * 0.25
    assert weigh("not many people here would call it idiot") == plain  # out of the scope of the negation
    assert weigh("it was said an idiot came") == 4.0 * 0.5
    assert weigh("it was not. Idiot") == plain  # the scope ends with the clause
    assert weigh("going to kill") == 2.0 * 1.5 and weigh("kill") == 2.0 * 0.5
    assert weigh("IDIOTS everywhere") == plain and weigh("didiot") == 0
    assert weigh(None) == weigh("") == weigh("a fine day") == 0


def test_composition_is_the_product_of_the_parts():
    rng = np.random.default_rng(3)
    a = toxicity.Transducer(rng.integers(0, 3, (3, 7)), rng.random((3, 7)))
    b = toxicity.Transducer(rng.integers(0, 2, (2, 7)), rng.random((2, 7)))
    symbols, weights = rng.integers(0, 7, 60), rng.random(60)
    first, length = np.array([0, 10, 13, 40]), np.array([10, 3, 27, 20])
    got = a.compose(b).run(symbols, weights, first, length)
    for f, n, g in zip(first, length, got):
        i = j = 0
        total = 0.0
        for s, w in zip(symbols[f:f + n], weights[f:f + n]):
            total += w * a.factor[i, s] * b.factor[j, s]
            i, j = a.follow[i, s], b.follow[j, s]
        assert abs(total - g) < 1e-12


def toxic_corpus(n=600):
    rng, rows, labels = random.Random(9), [], []
    for i in range(n):
        toxic = i % 6 == 0
        parts = [sentence(rng, 12) + "." for _ in range(6)]
        if toxic:
            parts.insert(rng.randint(0, 5), "They are " + rng.choice(["grublor", "grubbing", "zankish"]) + " " + sentence(rng, 5) + ".")
        rows.append((i, " ".join(parts), None))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_words_are_found_in_other_texts_beside_a_hot_one(spark):
    rows, labels = toxic_corpus()
    learn, rest = rows[:400], rows[400:]
    hot = [(1000 + i, learn[0][1], None) for i in range(400)]  # a toxic text, a third of all rows and more
    marks = spark.createDataFrame([*labels, *[(1000 + i, 1) for i in range(400)], (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, learn + hot + [(None, "grublor", None), (2000, None, None)]), marks)
    out = documents(spark, rest).select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()
    truth = dict(labels)
    assert all((r["s"] >= 0.3) == bool(truth[r["doc_id"]]) for r in out)
    found = toxicity.matched_clauses(documents(spark, rest), "doc_id", "text", model).where("score > 2").collect()
    texts = {d: [w for w in WORD.findall(t.lower())] for d, t, _ in rest}
    assert {r["id"] for r in found} == {d for d in texts if truth[d]}
    for r in found:
        assert WORD.findall(r["clause"]) == texts[r["id"]][r["start"]: r["start"] + r["length"]]


def test_hard_texts_and_missing_labels(spark):
    rows, labels = toxic_corpus(300)
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    none = toxicity.fit(documents(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    one = toxicity.fit(documents(spark, rows), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    toxicity.fit(documents(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    for m in (model, none, one):
        got = documents(spark, hard_rows()).select("doc_id", toxicity.score(m, F.col("text")).alias("s")).collect()
        assert len(got) == len(hard_rows()) and all(0 <= r["s"] < 0.3 for r in got)
    assert documents(spark, []).select(toxicity.score(model, F.col("text"))).collect() == []


def test_a_long_text_is_scored_whole(monkeypatch):
    text = ("fine words here. " * 400 + "such an idiot came\n" + "x" * 5000 + " ") * 3
    whole = weigh(text)
    monkeypatch.setattr(toxicity, "_pieces", lambda d, o, size=1000, f=toxicity._pieces: f(d, o, size))
    assert abs(weigh(text) - whole) < 1e-9 and whole > 4.0
    run = " ".join(["word"] * 300 + ["idiot"])
    assert weigh(run) == 4.0


def test_held_out_documents_of_the_tables(spark):
    from ledgerlens.llm import language_id

    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/documents.parquet")
    labels = spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/labels.parquet")
    out = language_id.held_out(F.col("doc_id"))
    model = toxicity.fit(docs.where(~out), labels)
    got = docs.where(out).select("doc_id", toxicity.score(model, F.col("text")).alias("s")).join(labels, "doc_id").toPandas()
    hit = (got["s"] >= 0.3) & (got["toxic"] == 1)
    assert hit.sum() >= 0.85 * (got["toxic"] == 1).sum() and hit.sum() >= 0.85 * (got["s"] >= 0.3).sum()
