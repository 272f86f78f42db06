"""License scan against a plain version, on whole, altered, cut and very long license texts."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerlens.llm import license_scan

from .data import documents, sentence


def words(text):
    return [w for w in re.split(license_scan.SEPARATORS, (text or "").lower()) if w]


def plain(rows, share=license_scan.SHARE):
    """Per id: all matches as (label, place, share), trying every template at every place."""
    holders = Counter(w for _, t in rows for w in set(words(t)))
    weight = {w: 1 + math.floor(1000 * math.log((len(rows) + 1) / (holders[w] + 1)) + 0.5)
              for t in license_scan.TEMPLATES for w in t.words}
    out = {}
    for doc, text in rows:
        ws, out[doc] = words(text), []
        for t in license_scan.TEMPLATES:
            total = sum(weight[w] for w in t.words)
            key = t.words[t.key_at: t.key_at + t.key_words]
            for at in range(len(ws)):
                if tuple(ws[at: at + t.key_words]) == key:
                    first = at - t.key_at
                    got = sum(weight[w] for k, w in enumerate(t.words) if 0 <= first + k < len(ws) and ws[first + k] == w)
                    out[doc].append((t.label, first, pytest.approx(got / total)))
    return out


def texts():
    rng = random.Random(8)
    whole = [" ".join(t.words) for t in license_scan.TEMPLATES]
    out = [*whole, None, "", "!!", sentence(rng, 50)]
    for t in license_scan.TEMPLATES:
        some = list(t.words)
        for k in rng.sample(range(len(some)), max(1, len(some) // 10)):
            some[k] = "changed"
        out.append(sentence(rng, 15) + ". " + ", ".join(some) + " " + sentence(rng, 15))
        out.append(" ".join(t.words[len(t.words) // 3:]))  # begins inside the template
        out.append(" ".join(t.words[: 2 * len(t.words) // 3]).upper())
    out.append(sentence(rng, 30000) + " " + whole[-3] + " " + sentence(rng, 100) + " " + whole[-3] + " " + whole[0])  # over 100 kB
    out.append("public " * 3000 + "general " * 3000 + "general public license " * 50)  # a probe's postings without the phrase
    return out


def test_every_match_of_the_plain_version(spark):
    rows = list(enumerate(texts()))
    found = license_scan.scan(documents(spark, [(d, t, None) for d, t in rows])).collect()
    want = plain(rows)
    assert len(max((t or "" for _, t in rows), key=len)) > 100_000
    for r in found:
        assert sorted((m["label"], m["at"], m["share"]) for m in r["matches"]) == sorted(want[r["doc_id"]], key=lambda x: x[:2]), r["doc_id"]
    by_id = {r["doc_id"]: r for r in found}
    for k, t in enumerate(license_scan.TEMPLATES):  # whole texts carry their label
        assert t.label in by_id[k]["labels"].split(",") and by_id[k]["score"] == 1.0


def test_grants_need_their_key_phrase(spark):
    text = " ".join(next(t for t in license_scan.TEMPLATES if t.label == "mit-text").words)
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(documents(spark, [
        (1, text, None), (2, text.replace("hereby", "gladly", 1), None), (3, text.replace("merge", "join", 1), None), (4, "no words", None)])).collect()}
    assert "mit-text" in got[1] and "mit-text" not in got[2] and "mit-text" in got[3] and got[4] == ""
