"""Row-by-row operators: token counts, packing, license scan, sharding, decontamination, language."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import decontaminate, language_id, license_scan, packing, sharding, token_counts, tokens, words

from .data import documents, hard_rows, sentence


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, hard_rows()).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def library(text):
    return tokens.encoder(None).library.encode(text or "", add_special_tokens=False).ids


def test_word_hashes_and_sequences():
    texts = ["a b  c a b c", "", None, "C a b c é" + "x" * 70000 + " y", "Zz zz"]
    data, offsets = words.buffers(pa.array(texts))
    w = words.find_words(data, offsets, lower=True)
    spelled = [data[a:z].tobytes().lower() for a, z in zip(w.start, w.end)]
    assert spelled == [x for t in texts for x in (t or "").encode().lower().split()]
    assert len(set(w.hash.tolist())) == len(set(spelled))
    for n in (1, 2, 3, 5):
        runs = words.sequence_hash(w.hash, n).tolist()
        assert len(set(runs)) == len({tuple(spelled[i:i + n]) for i in range(len(spelled) - n + 1)})


def test_token_counts_are_the_library_s(docs):
    rows = token_counts.count_tokens(docs, limit=50).collect()
    texts = sorted(((d, t) for d, t, _ in hard_rows()), key=str)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows if r["doc_id"] is not None) == sorted(
        (d, len((t or "").encode()), len(library(t)), len(library(t)) > 50) for d, t in texts if d is not None)
    by_id = {d: t or "" for d, t, _ in hard_rows()}
    for r in rows:
        if r["doc_id"] is not None:
            t, n = by_id[r["doc_id"]], r["fit_chars"]
            assert len(library(t[:n])) <= 50 and (n == len(t) or len(library(t[:n + 1])) > 50)


def test_every_prefix_without_encoding_again():
    owner, rng = tokens.encoder(None), random.Random(3)
    for t in ["it's I'LL don't we've", "É é Σας ΟΔΟΣ", "“quote” — dash… 'RE", "日本 テスト", "", "½²³ 12,5", sentence(rng, 40)]:
        prefixes = token_counts.TextPrefixes(t, owner)
        assert [prefixes.at(n) for n in range(len(t) + 1)] == [len(library(t[:n])) for n in range(len(t) + 1)]
        for budget in range(0, len(library(t)) + 2, 3):
            n = prefixes.fitting(budget)
            assert len(library(t[:n])) <= budget and (n == len(t) or len(library(t[:n + 1])) > budget)


def test_prefix_table_ends_at_the_whole_count(docs, none):
    for r in token_counts.prefix_table(docs.where("doc_id is not null")).collect():
        assert len(r["ends"]) == len(r["counts"])
    assert token_counts.prefix_table(none).count() == 0 and token_counts.count_tokens(none).count() == 0


def test_other_vocabulary(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    owner = tokens.encoder(path)
    for r in token_counts.count_tokens(docs.where("doc_id < 20"), vocabulary=path).collect():
        assert r["n_tokens"] == len(owner.library.encode(dict((d, t or "") for d, t, _ in hard_rows())[r["doc_id"]]).ids)


def test_packing_is_whole_gapless_and_cut_well(docs, none):
    pieces = packing.pack_documents(docs, capacity=256, least_power=32, block_windows=4).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault(p["doc_id"], []).append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] * 4 == len(p["ids"]) and p["length"] > 0
            at += p["length"]
        assert at <= 256
    texts = {d: t for d, t, _ in hard_rows() if d not in (None, 0, 2)}
    for d, t in texts.items():
        got = np.frombuffer(b"".join(bytes(p["ids"]) for p in sorted(by_doc[d], key=lambda p: p["start"])), dtype="<u4").tolist()
        assert got == [*library(t), 1] and all(p["doc_tokens"] == len(got) for p in by_doc[d])
    assert sum(p["length"] for p in pieces) == sum(len(library(t)) + 1 for _, t, _ in hard_rows())
    assert packing.pack_documents(none).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        points = np.array(sorted({0, *(rng.randint(1, 60) for _ in range(25)), *range(0, 61, 12)}))
        penalty = np.array([rng.choice([0, 3, 9]) for _ in points])
        cuts = packing.choose_cuts(points, penalty, 16, (4, 8))

        def cost(ends):
            total, begin = 0, 0
            for j in ends:
                n = points[j] - points[begin]
                assert n <= 16
                total += (0 if n in (4, 8) else 16 - n) + penalty[j]
                begin = j
            return total

        best = [0] + [None] * (len(points) - 1)
        for j in range(1, len(points)):
            best[j] = min(best[i] + (0 if points[j] - points[i] in (4, 8) else 16 - points[j] + points[i]) + penalty[j]
                          for i in range(j) if points[j] - points[i] <= 16)
        assert cost(cuts) == best[-1]


def test_license_scan_on_hard_rows(docs, none, spark):
    rows = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    hit = next(r for r in rows.values() if r["n_base"] == 3)
    assert (hit["first_word"], hit["last_word"], hit["base_labels"]) == (0, 5, "cc-by,reserved")
    assert rows[3]["n_words"] == 0 and rows[3]["score"] == 0 and rows[3]["first_word"] is None and rows[3]["labels"] == ""
    assert license_scan.scan(none).count() == 0
    text = "Licensed under the Apache License, Version 2.0. Released under  the MIT-License; licensed under the GNU General Public License"
    one = license_scan.scan(documents(spark, [(1, text, None), (2, "nothing here", None)])).where("doc_id = 1").first()
    assert one["labels"] == "apache-2.0,gpl,mit" and one["score"] == 1.0


def test_sharding_law(docs, none):
    rows = sharding.shard_documents(docs, 8).collect()
    assert len(rows) == len(hard_rows()) and sharding.shard_documents(none).count() == 0
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in hard_rows())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sizes
    assert all(len({r["shard"] for r in rows if r["doc_id"] == d}) == 1 for d in (0, 2))


def test_weighted_shards_and_few_moves(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    two = sharding.assign_shards(ids, "doc_id", [1, 1, 2]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20000 for r in two}
    assert abs(share[2] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    both = ids.select(sharding.rendezvous(ids["doc_id"], [1.0] * 8).alias("a"), sharding.rendezvous(ids["doc_id"], [1.0] * 9).alias("b"))
    moved = both.where("a <> b")
    assert moved.where("b <> 8").count() == 0 and abs(moved.count() / 20000 - 1 / 9) < 0.01


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(4)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        masks = decontaminate.Item(0, pattern, 0).masks()
        assert decontaminate.myers(masks, len(pattern), text)[0] == edit_distance(pattern, text)


def test_decontamination_against_brute_force(spark, none):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randint(8, 25))) for i in range(12)] + [(90, None), (91, ""), (92, "!!"), (93, "dup words here now"), (94, "dup words here now")]
    rows = []
    for d in range(60):
        text = list(sentence(rng, 30))
        if d % 2:
            inner = list(items[d % 12][1])
            for _ in range(rng.randint(0, int(0.12 * len(inner)))):
                k = rng.randrange(len(inner))
                inner[k:k + 1] = rng.choice([[], ["q"], [inner[k], "q"]])
            text[50:50] = ["\n", *inner, "  "]
        rows.append((d, "".join(text), None))
    rows += [(70, None, None), (71, "", None), (72, "x dup  words HERE now", None), (72, "x dup  words HERE now", None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(documents(spark, rows), bench, block_chars=400).select("doc_id", "item_id", "distance").collect()
    want = []
    for d, t, _ in rows:
        for i, s in items:
            s = decontaminate.normalise(s)
            if any(c.isalnum() for c in s):
                n = edit_distance(s, decontaminate.normalise(t))
                if n <= int(decontaminate.RATE * len(s)):
                    want.append((d, i, n))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 15
    docs = documents(spark, rows)
    hit = docs.where(decontaminate.contaminated(docs["text"], bench))
    assert decontaminate.find_items(none, bench).count() == 0 and decontaminate.find_items(documents(spark, rows), bench.limit(0)).count() == 0
    assert {r["doc_id"] for r in hit.select("doc_id").collect()} == {d for d, _, _ in want}


def test_language_by_nearest_centroid(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out(real["doc_id"])
    model = language_id.fit(real.where(~out), sample=100)
    found = real.where(out).select("lang", language_id.identify(model, real["text"]).alias("f")).select("lang", "f.*").toPandas()
    assert (found.iloc[:, 0] == found.iloc[:, 1]).mean() > 0.97 and found["rejected"].mean() < 0.02
    # the same cosines computed plainly
    texts = [r["text"].lower() for r in real.orderBy("doc_id").limit(20).collect()]
    plain = []
    for t in texts:
        b = t.encode()
        fold = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in b)
        v = np.zeros(language_id.WIDTH)
        for i in range(len(fold) - 2):
            g = fold[i] << 16 | fold[i + 1] << 8 | fold[i + 2]
            if g != 0x202020:
                v[(g * 0x9E3779B1 & 0xFFFFFFFF) >> 19] += 1
        v = np.sqrt(v) * model.idf
        plain.append((model.centroids @ (v / np.linalg.norm(v))).max())
    got = model.predict(pa.array(texts)).field("score").to_numpy()
    assert np.abs(got - np.array(plain)).max() < 1e-5
    hard = docs.select("doc_id", language_id.identify(model, docs["text"]).alias("f")).select("doc_id", "f.*").collect()
    und = {r["doc_id"] for r in hard if r["lang"] == "und"}
    assert und >= {3, 4, 5, 6, 15} and 0 not in und and all(0 <= r["score"] <= 1 for r in hard)
    assert language_id.fit(none) is None
    assert none.select(language_id.identify(None, none["text"])).count() == 0
    assert docs.select(language_id.identify(None, docs["text"])["lang"].alias("g")).where("g = 'und'").count() == docs.count()
