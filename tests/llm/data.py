"""Small tables with the hard cases: nulls, empty and long texts, ties, repeats, clashing names."""

import random

CLASHING = ["text_hash", "component", "shard", "slot", "key", "a", "z", "run", "node", "words", "hits", "first", "lang_pred", "score"]


def sentence(rng, n, words=("the and of to in that with this from was are for not but all "
                            "river stone cloud paper green light window garden letter simple").split()):
    return " ".join(rng.choice(words) + (str(rng.randint(0, 999)) if rng.random() < 0.5 else "") for _ in range(n))


def documents(spark, rows, clash=True):
    """rows: (doc_id, text, lang). Columns of documents, with clashing extra columns."""
    extra = ", ".join(f"{c} string" for c in CLASHING) if clash else ""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + extra if extra else "")
    data = [(d, t, g, "src", len(t or ""), *(["x"] * len(CLASHING) if clash else [])) for d, t, g in rows]
    return spark.createDataFrame(data, schema)


def hard_rows():
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = sentence(rng, 60)
    mixed = [sentence(rng, 30) + " " + passage + " " + sentence(rng, 20) for _ in range(3)]
    texts = [base, base, near, None, None, "", "   ", "a", "a", "one two", "one  two", *mixed, "é ü ñ ß", "12 34 !!",
             "x" * 3000, " ".join(["same"] * 400), sentence(rng, 6000), "All rights reserved. CC BY cc by", base.upper(),
             "<|endoftext|> kept as the library does", "tab\tand\nline\r\nends", passage]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    return rows + [(None, base, "en"), (None, None, None), (0, base, None), (2, near, "en")]
