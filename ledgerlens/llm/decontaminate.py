"""Benchmark decontamination by pigeonhole edit matching (operator 8).

Texts and items are compared in lower case with runs of white space as one blank. An item of
``n`` characters may differ by ``budget = floor(rate * n)`` edits. It is split into
``budget + 1`` pieces; at least one piece of any occurrence is untouched, so occurrences are
found at exact piece hits and verified with Myers' bit-parallel distance around the hit.

Items are sent to tasks in blocks of bounded size (``block_chars``), every block against all rows;
rows are never shuffled. Defined cases: null or empty texts contain nothing; items without a
letter or digit are not searched; items of equal text are reported each; repeated rows are reported each;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import tidy

RATE = 0.08
_BLANKS = re.compile(r"\s+")


def normalise(text: str | None) -> str:
    return _BLANKS.sub(" ", (text or "").lower()).strip()


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """Bounds of ``budget + 1`` pieces of nearly equal size."""
    cut = [n * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cut, cut[1:]))


def myers(pattern_masks: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of ``text``, and the end of the first best part."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for i, ch in enumerate(text, 1):
        eq = pattern_masks.get(ch, 0)
        across = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        right = down | (~(diagonal | up) & full)
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1) & full
        left = (left << 1) & full
        up = left | (~(across | right) & full)
        down = right & across
        if score < best:
            best, end = score, i
    return best, end


@dataclass
class Item:
    id: object
    text: str
    budget: int

    def masks(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, ch in enumerate(self.text):
            out[ch] = out.get(ch, 0) | 1 << i
        return out


class Index:
    """Exact piece search over a block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [Item(i, t, int(rate * len(t))) for i, t in items]
        self.masks = [it.masks() for it in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, it in enumerate(self.items):
            for a, z in pieces(len(it.text), it.budget):
                places.setdefault(it.text[a:z], []).append((k, z))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, tuple(at))
        if places:
            self.automaton.make_automaton()
        self.some = bool(places)

    def matches(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """Items found in a text: id, distance, end of the best part and budget; one entry an item."""
        if not self.some:
            return []
        body = normalise(text)
        found: dict[int, tuple[int, int]] = {}
        tried: dict[int, tuple[int, int]] = {}
        for last, places in self.automaton.iter(body):
            for k, z in places:
                item = self.items[k]
                n, e = len(item.text), item.budget
                if k in found and found[k][0] == 0:
                    continue
                begin = last + 1 - z  # where the item would start without edits
                lo, hi = tried.get(k, (0, -1))
                if lo <= max(0, begin - e) and hi >= begin + n + e:
                    continue  # this stretch was searched with an earlier piece
                if body.startswith(item.text, max(0, begin)):
                    distance, end = 0, max(0, begin) + n
                else:
                    lo, hi = max(0, begin - 2 * e), begin + n + 2 * e
                    distance, end = myers(self.masks[k], n, body[lo:hi])
                    end += lo
                    tried[k] = (lo, hi)
                if distance <= e and distance < found.get(k, (e + 1, 0))[0]:
                    found[k] = (distance, end)
        return [(self.items[k].id, d, end, self.items[k].budget) for k, (d, end) in sorted(found.items())]


def _blocks(items: DataFrame, id: str, text: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks whose size is bounded by the share of a hash."""
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    count = -(-total // block_chars) or 1
    block = F.pmod(F.xxhash64(id, text), F.lit(count))
    for b in range(count):
        rows = items.where(block == b).select(id, text).collect()  # about block_chars characters
        cleaned = sorted({(r[0], normalise(r[1])) for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0], r[1]))
        yield [(i, t) for i, t in cleaned if any(c.isalnum() for c in t)]


def find_items(df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", rate: float = RATE, block_chars: int = 8 << 20) -> DataFrame:
    """One row per document and item found in it: least distance, end in the normalised text, budget."""
    kind, item_kind = df.schema[id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = df.select(F.col(id), F.col(text).cast("string"))
    out = []
    for block in _blocks(items, item_id, item_text, block_chars):
        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index, kinds, names = Index(block, rate), None, ["doc_id", "item_id", "distance", "end", "budget"]
            for batch in batches:
                kinds = [batch.schema.types[0], None, pa.int64(), pa.int64(), pa.int64()]
                found = [(key, *m) for key, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m in index.matches(t.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        out.append(rows.mapInArrow(tidy(search), f"doc_id {kind}, item_id {item_kind}, distance long, end long, budget long"))
    return reduce(DataFrame.unionByName, out)


def contaminated(text: Column, items: DataFrame, item_id: str = "item_id", item_text: str = "text", rate: float = RATE,
                 block_chars: int = 8 << 20) -> Column:
    """Whether a text column contains any item."""
    def holds(block: list[tuple[object, str]]) -> Column:
        @F.arrow_udf("boolean")
        def any_item(texts: pa.Array) -> pa.Array:
            index = _index(block, rate)
            return pa.array([bool(index.matches(t.as_py())) for t in texts], pa.bool_())

        return F.coalesce(any_item(text), F.lit(False))

    return reduce(lambda a, b: a | b, [holds(b) for b in _blocks(items, item_id, item_text, block_chars)])


_INDEXES: dict[tuple, Index] = {}


def _index(block: list[tuple[object, str]], rate: float) -> Index:
    """The index of a block, kept by content for the life of the worker (one block at a time)."""
    key = (hash(tuple(block)), len(block), rate)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(block, rate)
    return _INDEXES[key]
