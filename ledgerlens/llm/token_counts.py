"""Token counts at every prefix of a text (operator 1).

Prefix dynamic programming: the count at a span's end is the count at the span before plus the
span's tokens, so one running sum holds the count at every blank. Inside a word, the last
token of each prefix follows from shorter prefixes: the only token that ends there and stays
apart from the last token of what precedes it. Budgets and truncation points are then
lookups, without encoding the text again.

Defined cases: a null text is empty and has 0 tokens; repeated rows are counted each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CAREFUL, Encoder, encoder
from .words import buffers, slices, tidy

SPAN = re.compile("[^\t-\r ]+")


class WordPrefixes:
    """Token counts of every prefix of a word, each prefix read as a word of its own."""

    def __init__(self, owner: Encoder):
        self.names, self.suffix = owner.names, owner.suffix
        self.vocab = owner.spec["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in owner.spec["model"]["merges"])
        self.rank = {tuple(p): i for i, p in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.apart: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge the best ranked neighbours until none is left."""
        while len(symbols) > 1:
            ranked = [(self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(symbols, symbols[1:]))]
            best, i = min(ranked)
            if best == len(self.rank):
                break
            symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2:]
        return symbols

    def symbols(self, token: str) -> list[str]:
        open_end = token.removesuffix(self.suffix)
        return [*open_end] if open_end == token else [*open_end[:-1], open_end[-1] + self.suffix]

    def stays_apart(self, left: str, right: str) -> bool:
        if (left, right) not in self.apart:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            self.apart[left, right] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return self.apart[left, right]

    def counts(self, word: str) -> list[int]:
        """Counts of the prefixes of 1 to ``len(word)`` characters."""
        parts = [ch.translate(self.names) for ch in word]
        name = "".join(parts)
        last, open_count, closed = [""], [0], [0]
        for j in range(1, len(name) + 1):
            for ends, closing in ((False, ""), (True, self.suffix)):
                for i in range(max(0, j - self.longest), j):
                    token = name[i:j] + closing
                    if token in self.vocab and (i == 0 or last[i] and self.stays_apart(last[i], token)):
                        n = open_count[i] + 1
                        break
                else:
                    token, n = "", 0
                if ends:
                    closed.append(n)
                else:
                    last.append(token)
                    open_count.append(n)
        return [closed[b] for b in np.cumsum([len(p) for p in parts]).tolist()]


class TextPrefixes:
    """Exact counts at every character prefix of one text, from its spans' ends and counts."""

    def __init__(self, text: str, owner: Encoder, counts: np.ndarray | None = None):
        self.text, self.owner = text, owner
        self.spans = [(m.start(), m.end()) for m in SPAN.finditer(text)] if owner.by_word else [(0, len(text))]
        counts = owner.encode(pa.array([text])).count if counts is None else counts
        self.count = np.cumsum(counts, dtype=np.int64)
        self.stop = np.array([z for _, z in self.spans], dtype=np.int64)

    def at(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` characters."""
        i = int(np.searchsorted(self.stop, n_chars, side="right"))
        base = int(self.count[i - 1]) if i else 0
        if i == len(self.spans) or self.spans[i][0] >= n_chars:
            return base
        return base + inside(self.owner, self.text[self.spans[i][0]: self.spans[i][1]])[n_chars - self.spans[i][0] - 1]

    def fitting(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        i = int(np.searchsorted(self.count, budget, side="right"))
        if i == len(self.count):
            return len(self.text)
        base = int(self.count[i - 1]) if i else 0
        begin, end = self.spans[i]
        return begin + _fitting(inside(self.owner, self.text[begin:end]), budget - base)


def _fitting(counts: list[int], budget: int) -> int:
    return max((j for j, n in enumerate(counts, 1) if n <= budget), default=0)


def inside(owner: Encoder, span: str) -> list[int]:
    """Counts of the prefixes of one span of 1 to all characters."""
    if not owner.by_word or CAREFUL.search(span):
        return [len(owner.whole(span[:j])) for j in range(1, len(span) + 1)]
    words, low, known, out = _word_prefixes(owner), span.lower(), {}, []
    for j in range(1, len(low) + 1):
        total = 0
        for word in owner.words_of.findall(low[:j]):
            if word not in known:
                for k, n in enumerate(words.counts(word), 1):
                    known[word[:k]] = n
            total += known[word]
        out.append(total)
    return out


def _word_prefixes(owner: Encoder) -> WordPrefixes:
    if not hasattr(owner, "prefixes"):
        owner.prefixes = WordPrefixes(owner)
    return owner.prefixes


def count_tokens(df: DataFrame, id: str = "doc_id", text: str = "text", limit: int = 2048,
                 vocabulary: str | None = None) -> DataFrame:
    """Bytes, tokens, whether over ``limit``, and the characters that fit into the limit, per row."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                done = owner.encode(part.column(1))
                totals = done.totals()
                bounds = buffers(part.column(1))[1]
                chars = pc.fill_null(pc.utf8_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.append(0, np.cumsum(done.count))
                for i in np.flatnonzero(totals > limit).tolist():
                    a, z = done.first[i], done.first[i + 1]
                    k = a + int(np.searchsorted(upto[a + 1: z + 1] - upto[a], limit, side="right"))
                    before = done.data[bounds[i]: done.start[k]].tobytes().decode()
                    span = SPAN.match(done.data[done.start[k]: bounds[i + 1]].tobytes().decode())[0]
                    chars[i] = len(before) + _fitting(inside(owner, span), limit - int(upto[k] - upto[a]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds)), pa.array(totals), pa.array(totals > limit), pa.array(chars)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id), F.col(text).cast("string"))
    return rows.mapInArrow(tidy(count), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(df: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row the character ends of its blank-free spans and the token count up to each of them."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                tables = [TextPrefixes(t or "", owner) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t.stop for t in tables], pa.list_(pa.int64())),
                     pa.array([t.count for t in tables], pa.list_(pa.int64()))], names=["doc_id", "ends", "counts"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id), F.col(text).cast("string")).mapInArrow(tidy(build), f"doc_id {kind}, ends array<long>, counts array<long>")
