"""Operators that bring rows together: near-dedup, repeats, neighbours, WARC, and the pipeline."""

import base64
import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import near_dedup, neighbours, packing, queries, suffix_dedup, warc
from ledgerlens.llm.components import connected_components

from . import brute
from .data import documents, hard_rows, sentence

SF = "/root/testdata/sf0.001"


def near_copies(n=260, words=90, seed=2):
    """A large group of near copies, chains of drifting copies, and unrelated rows."""
    rng = random.Random(seed)
    base = sentence(rng, words).split()
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(words)] = f"w{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(copy), None))
    drift = sentence(rng, words).split()
    for i in range(n, n + 40):
        drift[rng.randrange(words)] = f"d{i}"
        rows.append((i, " ".join(drift), None))
    return rows + [(1000 + i, sentence(rng, 40), None) for i in range(40)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, size, percent):
    for rows in (near_copies(), [r for r in hard_rows() if r[0] is not None]):
        found = near_dedup.near_duplicates(documents(spark, rows).repartition(5), size=size, percent=percent)
        got = sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()), key=str)
        assert got == brute.components([(d, t) for d, t, _ in rows], size, percent)


def test_near_dedup_of_null_ids_and_empty_tables(spark):
    rows = hard_rows()
    found = near_dedup.near_duplicates(documents(spark, rows)).select("doc_id", "component_id").collect()
    assert len(found) == len(rows) and all(r["component_id"] == 0 for r in found if r["doc_id"] in (0, 1, 2, 20))
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    kept = near_dedup.keep_first(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids.count(0) == 1 and not {1, 2, 20} & set(ids) and {3, 4, 5, 6} <= set(ids)


def test_signatures_reach_the_threshold():
    m = near_dedup.signatures_needed(0.85, 1e-5)
    assert 1 - (1 - (1 - 0.85 ** 3) ** m) ** 2 <= 1.01e-5


@pytest.mark.parametrize("task_edges", [1000, 20])
def test_connected_components(spark, task_edges):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), "t", task_edges).collect()}
    label = {n: n for e in edges for n in e if task_edges == 1000 or e[0] != e[1]}
    for _ in range(100):
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label


def repeat_rows(seed=8):
    rng = random.Random(seed)
    shared = [sentence(rng, n) for n in (49, 50, 51, 80, 200)]
    rows = [(i, sentence(rng, rng.randint(0, 60)) + " " + " ".join(rng.sample(shared, rng.randint(0, 2))) + "\n" + sentence(rng, 10), None)
            for i in range(60)]
    long = sentence(rng, 3000)
    rows += [(100, long, None), (101, long, None), (102, long[:5000] + " cut " + long[5000:], None), (103, "same " * 300, None),
             (104, "a b " * 100, None), (105, None, None), (106, "", None), (107, sentence(rng, 30), None)]
    return rows


def test_spans_equal_brute_force(spark):
    rows = repeat_rows()
    got = suffix_dedup.repeated_spans(documents(spark, rows).repartition(4)).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == brute.repeats([(d, t) for d, t, _ in rows], 50)
    assert suffix_dedup.repeated_spans(documents(spark, [])).count() == 0


def test_cut_passages_stay_in_one_place(spark):
    rows = repeat_rows()
    cut = suffix_dedup.remove_repeats(documents(spark, rows), length="n_chars")
    assert cut.where("n_chars <> length(coalesce(text, ''))").count() == 0
    assert cut.columns == documents(spark, rows).columns
    texts = {r["doc_id"]: r["text"] for r in cut.select("doc_id", "text").collect()}
    removed = {d for d, _, _, gone in brute.repeats([(d, t) for d, t, _ in rows], 50) if gone}
    assert all(texts[d] == t for d, t, _ in rows if d not in removed) and 101 not in texts and texts[105] is None
    places = Counter(tuple(w[i:i + 50]) for _, t, _ in rows for w in [(t or "").split()] for i in range(len(w) - 49))
    runs = {r for r, n in places.items() if n > 1}
    left = {tuple(w[i:i + 50]) for t in texts.values() for w in [(t or "").split()] for i in range(len(w) - 49)}
    assert runs <= left
    null_ids = documents(spark, [(None, rows[2][1], None), (None, rows[2][1], None), *hard_rows()])
    assert suffix_dedup.remove_repeats(null_ids).count() > 0


def test_no_passage_is_left_at_two_places(spark):
    rng = random.Random(11)
    p, q = ([f"{name}{i}" for i in range(n)] for name, n in (("p", 60), ("q", 97)))
    around = {k: [f"{k}{i}" for i in range(20)] for k in "xyzuvw"}
    fill = iter(sentence(rng, 40).replace(" ", f" r{i} ").split() for i in range(9))
    texts = [next(fill) + p, next(fill) + around["x"] + p + around["y"] + next(fill), around["x"] + p + around["y"] + next(fill), next(fill) + q,
             around["z"] + q + around["u"], next(fill) + around["z"] + q + around["u"], around["v"] + p[:30] + q + around["w"] + p, next(fill) + p[30:] + q]
    cut = {r[0]: r[1].split() for r in suffix_dedup.remove_repeats(documents(spark, [(i, " ".join(t), None) for i, t in enumerate(texts)])).select("doc_id", "text").collect()}
    runs = {tuple(t[i:i + 50]) for t in texts for i in range(len(t) - 49)}
    left = Counter(tuple(t[i:i + 50]) for t in cut.values() for i in range(len(t) - 49))
    assert not [r for r, n in left.items() if n > 1 and r in runs]
    assert {w for t in texts for w in t} == {w for t in cut.values() for w in t} and cut[0] == texts[0] and cut[3] == texts[3]


def brute_neighbours(rows, wanted, k):
    keep = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    x, ids = np.stack([v for _, v in keep]), np.array([i for i, _ in keep])
    out = {}
    for i, v in keep:
        if wanted(i):
            s = x @ v
            s[ids == i] = -np.inf
            out[i] = [int(ids[j]) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(1500, 12)))]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]
    bad = [(3000, None), (3001, [0.0] * 12), (3002, [float("nan")] + [1.0] * 11), (3003, [None] + [1.0] * 11), (3004, []), (None, rows[3][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as key", "2 as block", "3 as score")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20).toPandas()
    want = brute_neighbours(vectors, lambda i: i % 20 == 0, 20)
    assert set(got["query_id"]) == set(want)
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and q not in set(part["vec_id"])
        order = list(zip(-part["score"], part["vec_id"]))
        assert order == sorted(order)
        hits += len(set(part["vec_id"]) & set(want[q]))
    assert hits / (20 * len(want)) >= 0.9
    few = df.where("vec_id < 9")
    assert neighbours.search(few, few, "vec_id", "embedding", k=20).count() == 72
    assert neighbours.search(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0


def window_recall(vectors, wanted, blocks, k=20, window=0.1875, curves=10, dims=6):
    """Recall of the windows that a search with production parameters looks through."""
    largest = np.linalg.norm(vectors, axis=1).max()
    entries, queries = neighbours.lifted(vectors, largest), neighbours.levelled(vectors[wanted], largest)
    fitted = neighbours.Curves.fit(entries[:8192], blocks, curves, dims, 7)
    scores = vectors[wanted] @ vectors.T
    scores[np.arange(len(wanted)), wanted] = -np.inf
    best = np.argpartition(-scores, k, axis=1)[:, :k]
    found = np.zeros(best.shape, bool)
    for c in range(curves):
        first, last = neighbours.windows(fitted.block(c, queries), window, blocks)
        at = fitted.block(c, entries)[best]
        found |= (at >= first[:, None]) & (at <= last[:, None])
    return found.mean()


def varied_norms(n, width, sigma=0.7, seed=12):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(sigma * rng.normal(size=(n, 1)))


def test_neighbours_recall_of_varied_norms(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(varied_norms(6000, 64))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20).groupBy("query_id").agg({"vec_id": "collect_list"}).collect()
    want = brute_neighbours(rows, lambda i: i % 20 == 0, 20)
    recall = sum(len(set(r[1]) & set(want[r[0]])) for r in got) / (20 * len(want))
    assert len(got) == len(want) and recall >= 0.9, recall


@pytest.mark.parametrize("blocks", [16, 21, 22, 42, 61])
def test_windows_hold_their_share(spark, blocks):
    first, last = neighbours.windows(np.arange(blocks), 0.1875, blocks)
    assert ((last - first + 1) / blocks >= 0.1875).all() and (first >= 0).all() and (last < blocks).all()
    vectors = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], float)
    for v in (vectors, varied_norms(4000, 64)):
        assert window_recall(v, np.arange(0, len(v), 20), blocks) >= 0.93


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))] + [(500 + i, None) for i in range(3)]
    rows[200:] = [(i, rows[5][1]) for i, _ in rows[200:]]
    more = rows + [rows[5]] * 30 + [rows[8]] * 30
    once, often = (spark.createDataFrame(r, "vec_id long, embedding array<double>").repartition(3) for r in (rows, more))
    want, got = (sorted(tuple(r) for r in neighbours.search(df, df.where("vec_id < 20"), "vec_id", "embedding", k=20).collect()) for df in (once, often))
    assert got == want and len(want) == 400


def test_tasks_of_neighbours_are_bounded(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1800, 16))
    v[:600] = v[0] + 1e-4 * rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = df.selectExpr("cast(vec_id as string) as key", "embedding as vector", "xxhash64(vec_id) as number")
    largest = float(np.linalg.norm(v, axis=1).max())
    fitted = neighbours.Curves.fit(neighbours.lifted(v, largest), 10, 3, 6, 7)
    pairs = []
    for most in (10**6, 60):
        sought, dealt = neighbours.deal(rows.where("vec_id % 2 = 0"), rows, fitted, largest, 0.3, most, most)
        group = ["curve", "block", "part"]
        largest_group = [side.groupBy(*group).count().toPandas()["count"].max() for side in (sought, dealt)]
        met = sought.join(dealt.withColumnRenamed("key", "other"), group).groupBy("curve", "block", "key", "other").count().toPandas()
        assert met["count"].max() == 1
        pairs.append((len(met), set(zip(met["key"], met["other"]))))
        assert max(largest_group) <= 2 * most and (most == 60 or min(largest_group) > 300)
    assert pairs[0] == pairs[1]
    one, many = (sorted(tuple(r) for r in neighbours.search(df, df.where("vec_id % 9 = 0"), "vec_id", "embedding", k=5, query_rows=n).collect()) for n in (8192, 10))
    assert one == many


def test_hilbert_keys_walk_the_grid():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = neighbours.hilbert_keys(grid, bits=3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def page_rows():
    return [(5, "u/5", "<p>same</p>"), (3, "u 3", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "u", None), (2, "u", ""), (7, "é", "é" * 5000),
            (8, "u", "<p>x</p>\r\n\r\nWARC/1.1"), (8, "u", "<p>x</p>\r\n\r\nWARC/1.1"), (None, "u", "<p>same</p>")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").selectExpr("*", "'x' as payload", "'y' as path")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, h in page_rows():
        body = (h or "").encode()
        first = min(j for j, _, g in page_rows() if j is not None and (g or "").encode() == body)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i in (first, None) else "revisit",
                     None if i in (first, None) else first))
    assert got == sorted(want, key=str) and warc.round_trip(pages.limit(0)).count() == 0
    small = warc.mark_revisits(pages.selectExpr("page_id", "url", "cast(coalesce(html, '') as binary) as payload"), "page_id", "payload", 100)
    assert small.where("refers_to is not null").count() == 0
    archives = warc.write_archives(small, f"file://{tmp_path}", "page_id", "url", "payload", most_bytes=400)
    assert archives.count() > 1
    back = {(r["id"], bytes(r["payload"])) for r in warc.read_archives(archives).collect()}
    assert back == {(str(i), (h or "").encode()) for i, _, h in page_rows()}


def test_warc_reader_refuses_damage():
    whole = warc.record(1, "u", b"body", base64.b32encode(hashlib.sha1(b"body").digest()).decode())
    two = whole + whole
    assert len(list(warc.members(two[i:i + 7] for i in range(0, len(two), 7)))) == 2
    with pytest.raises(ValueError):
        list(warc.members([whole[:-9]]))
    wrong = warc.record(1, "u", b"body", "A" * 32)
    with pytest.raises(ValueError):
        [warc.parse(*m) for m in warc.members([wrong])]


def test_every_stage_on_hard_rows(spark):
    bench = spark.createDataFrame([(1, hard_rows()[7 + 4][1][:150])], "item_id long, text string")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/stage-bench"
    bench.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    for rows in (hard_rows(), []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = corpus_pipeline.settle(out, "stage")
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0) == bool(rows)


def test_pipeline_over_the_tables(spark):
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert set(pieces["doc_id"]) <= set(whole)
    per_sequence = pieces.groupby("sequence_id")["length"].sum()
    assert per_sequence.max() <= 2048 and pieces.groupby("doc_id")["length"].sum().eq(pieces.groupby("doc_id")["doc_tokens"].first()).all()
    components = brute.components(list(whole.items()), 5, 80)
    assert not set(pieces["doc_id"]) - {d for d, _, c in components if d == c}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_sequences_keep_their_names_when_partitions_are_coalesced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(6, "doc_id").sortWithinPartitions("doc_id")
    pieces = packing.pack_documents(docs)
    apart, together = (sorted(tuple(r) for r in p.select("doc_id", "start", "sequence_id", "offset").collect()) for p in (pieces, pieces.coalesce(1)))
    assert apart == together and len({r[2] >> 40 for r in apart}) == 6


def test_packing_padding_is_small(spark):
    pieces = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1))
    sizes = pieces.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding / sizes.sum() < 0.02


def test_copies_of_a_stretch_count_as_one(spark):
    rng = random.Random(21)
    passage, ahead, behind = (sentence(rng, n) for n in (70, 40, 40))
    rows = [(i, f"{ahead if i % 3 else sentence(rng, 20)} {passage} {behind if i % 2 else sentence(rng, 20)}", None) for i in range(90)]
    rows += [(200 + i, f"{passage} {passage if i % 2 else ''} x{i}", None) for i in range(20)]
    got = suffix_dedup.repeated_spans(documents(spark, rows).repartition(7)).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == brute.repeats([(d, t) for d, t, _ in rows], 50)


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    rows = near_copies(60)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)  # five sets or so
    found = near_dedup.near_duplicates(documents(spark, rows).repartition(3), size=3, percent=85)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute.components([(d, t) for d, t, _ in rows], 3, 85)


def test_tables_in_between_are_deleted(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "ledgerlens"
    docs = documents(spark, hard_rows())
    for stage, left in ((near_dedup.keep_first, "kept"), (suffix_dedup.remove_repeats, "cuts")):
        before = set(folder.iterdir()) if folder.exists() else set()
        stage(docs).collect()
        assert [p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before] == [left]
