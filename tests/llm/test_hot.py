"""Ties, hot texts, text ids and very long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language_id, license_scan, near_dedup, neighbours, packing, sharding, suffix_dedup, token_counts, warc
from tests.conftest import SF

from .data import documents, sentence


@pytest.mark.parametrize("blocks", [1, 16])
def test_neighbours_on_equal_scores_take_smaller_ids(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, 2, 12).astype(float).tolist()) for i in range(300)]
    rows[0] = (0, [1.0] * 12)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20, least_blocks=blocks, window=1.0).collect()
    v = dict((i, np.array(x)) for i, x in rows)
    for q in range(0, 300, 20):
        if not v[q].any():
            continue
        want = sorted((-float(v[q] @ v[i]), i) for i in v if i != q and v[i].any())[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(-s, i) for _, i, s in mine] == want


def test_best_pairs_among_many_ties():
    q, x = np.ones((3, 4)), np.ones((5000, 4))
    x[7] = 2.0
    order = np.random.default_rng(1).permutation(5000)
    own, other, score = neighbours.best_pairs(q, x, order, 21)
    for i in range(3):
        mine = other[own == i]
        assert mine[0] == 7 and order[mine[1:]].tolist() == sorted(set(range(5000)) - {order[7]})[:20]
        assert score[own == i].tolist() == [8.0] + [4.0] * 20


def test_copies_of_one_line_do_not_take_over_a_language(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    learn, rest = docs.where(~out & F.col("text").isNotNull()), docs.where(out & F.col("text").isNotNull() & (F.length("text") > 40))
    lines = [r["text"][:200] for r in learn.where("lang = 'en' and length(text) > 300").orderBy(F.xxhash64("text")).limit(2).collect()]

    def shares(model):
        f = rest.select("lang", language_id.identify(model, F.col("text")).alias("f")).select("lang", F.col("f.lang").alias("found"), "f.rejected")
        r = f.where("lang is not null").agg(F.avg((F.col("lang") == F.col("found")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
        return r[0], r[1]

    right, rejected = shares(language_id.fit(learn))
    for line in lines:
        hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(line).alias("text"), F.lit("en").alias("lang"))
        hot_right, hot_rejected = shares(language_id.fit(learn.union(hot)))
        assert hot_right >= right - 0.01 and hot_rejected <= rejected + 0.02


def test_junk_and_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    rng = random.Random(3)
    junk = ["".join(rng.choice("qxzjkvwpf") for _ in range(400)) for _ in range(10)]
    foreign = ["это простой текст на другом языке который модель никогда не видела прежде " * 4, "これは学習していない言語で書かれた文章です。" * 8]
    rows = spark.createDataFrame([(t,) for t in junk + foreign], "text string").select(language_id.identify(model, F.col("text")).alias("f"))
    assert all(r["f"]["rejected"] for r in rows.collect())


def test_many_short_texts_take_little_memory():
    import tracemalloc

    model = language_id.Model(np.ones(language_id.WIDTH, np.float32), np.eye(4, language_id.WIDTH, dtype=np.float32), list("abcd"), np.zeros(32))
    texts = pa.array(["abcd"] * 10_000)
    tracemalloc.start()
    assert len(model.predict(texts)) == 10_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


IDS = ["a\r\nb", "a", "", "ü/ü <x>", "%41", "None", None, "a b", "twice", "twice "]


def test_archives_keep_text_ids(spark):
    rows = [(d, "http://x/ y", f"<p>{i % 4}</p>") for i, d in enumerate(IDS)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)).collect()
    assert sorted((r["page_id"] for r in got), key=str) == sorted(IDS, key=str)
    firsts = {}
    for d, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        firsts.setdefault(h, d)
    for r in got:
        if r["record_type"] == "revisit":
            assert r["refers_to"] in firsts.values() and r["refers_to"] != r["page_id"]


def test_each_archive_is_read_by_a_task_of_its_own(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("text "), "id").alias("html")).repartition(8)
    body = rows.select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    paths = warc.write_archives(warc.mark_revisits(body, "page_id", "payload"), str(tmp_path / "w"), "page_id", "url", "payload")
    read = warc.read_archives(paths).withColumn("task", F.spark_partition_id())
    per = read.groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert len(per) == paths.count() > 4 and sum(r["n"] for r in per) == 400
    assert sorted(r["n"] for r in per) == sorted(r["records"] for r in paths.collect())


@pytest.fixture(scope="module")
def long_documents(spark):
    """A text of some 200 kB, one of a single word, and two short ones that share a passage with it."""
    rng = random.Random(4)
    long = sentence(rng, 30_000)
    words = long.split()
    return documents(spark, [(1, long, "en"), (2, "x" * 2_000, "en"), (3, "before it " + " ".join(words[15_000:15_060]) + " and after", "en"), (4, long, "en")])


def test_very_long_texts_are_handled_whole(spark, long_documents):
    docs = long_documents
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, limit=2048).collect()}
    assert tokens[1] == tokens[4] > 30_000
    packed = packing.pack_documents(docs, capacity=2048, end_id=1).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {d: n + 1 for d, n in tokens.items()}
    scanned = {r["doc_id"]: r["n_words"] for r in license_scan.scan(docs).collect()}
    assert scanned[1] == 30_000 and scanned[2] == 1
    assert {r["doc_id"] for r in sharding.shard_documents(docs).collect()} == {1, 2, 3, 4}
    near = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, size=5, percent=80).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 1}
    spans = suffix_dedup.repeated_spans(docs.where("doc_id < 4")).collect()
    assert {r["doc_id"] for r in spans} == {1, 3}
