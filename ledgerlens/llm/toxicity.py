"""Toxicity by a weighted finite-state grammar over clauses (operator 11).

Words become symbols: insult, threat, target, negation, report, intent, or other. Small transducers over
these symbols each multiply a word's weight by a factor that depends on what stood before it in the clause:
an insult counts more after a target, a threat more after a statement of intent, both less in the scope of a
negation or after a verb of reporting. They are composed into one machine, which runs over every clause that
holds a weighted word; a clause scores the sum of its words' weights as the machine passes them on. A document's
evidence is its strongest clause and, damped, the rest; a monotone curve turns evidence into a score.

What counts as an insult is learned: prefixes of 3 to 8 bytes of words whose share among toxic texts exceeds that
among others by a confidence margin, weighted by its logarithm. A word takes its heaviest prefix. Lists of general
words (fixed below, four languages) seed the grammar. The curve is fitted on evidence under weights learned from
the other half of the texts, so it does not mistake what was learned by heart for what holds in general.

Learning draws at most ``sample`` different texts of each label by hash (equal texts count once, with the label of most
of their rows) and keeps at most ``lexicon`` prefixes: the two bounds here. Texts are not exchanged: ids and hashes
are joined to the labels, and the drawn texts are picked in a second scan.

Defined cases: a null or empty text has no evidence and takes the curve's lowest score; rows without id or label are not
learned from, several labels of an id count as toxic if one is; without labels of both kinds the score follows from the
seed words alone; a text of any length is scored whole, in pieces of about a million bytes cut where a clause ends; a clause
ends at ``. ! ? ;``, a line break, or after 256 words; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle
from .words import buffers, release, slices, tidy

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = range(7)
SHORTEST, LONGEST = 3, 8
CLAUSE_WORDS = 256
SEED_WEIGHT = 2.0

# General words of the grammar in English, German, French and Spanish.
SEEDS = {
    INSULT: "idiot idiots moron stupid loser scum dumm idioten abschaum stupide imbécile idiota imbécil estúpido",
    THREAT: "kill hurt destroy beat burn töten umbringen schlagen tuer frapper brûler matar golpear quemar",
    TARGET: "you your he she him her they them ihr dich euch sie vous tu toi eux elle tú usted ellos ella vosotros",
    NEGATION: "not no never nobody nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says claimed quoted wrote alleged sagte behauptet schrieb dit affirme écrit dijo afirma escribió",
    INTENT: "will shall gonna going must werde wirst soll vais vas doit voy vas debe",
}

_CLAUSE_END = np.zeros(256, dtype=bool)
_CLAUSE_END[list(b".!?;\n\r")] = True
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[b for b in range(128) if not (48 <= b < 58 or 97 <= b < 123)]] = True
_CUT = re.compile(rb"[.!?;\n\r]")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_PIECE = 1 << 20
_MASKS = {k: np.uint64(((1 << 8 * k) - 1) << 8 * (8 - k)) for k in range(1, LONGEST + 1)}


@dataclass
class Transducer:
    """``follow[state, symbol]`` is the next state, ``factor[state, symbol]`` multiplies the word's weight."""

    follow: np.ndarray
    factor: np.ndarray

    @staticmethod
    def of(states: int, moves: dict[tuple[int, int], int], factors: dict[tuple[int, int], float], rest: Sequence[int] | None = None) -> Transducer:
        """``rest``: where a state goes on all other symbols (default: it stays)."""
        follow = np.repeat(np.arange(states) if rest is None else np.asarray(rest), 7).reshape(states, 7)
        factor = np.ones((states, 7))
        for at, to in moves.items():
            follow[at] = to
        for at, f in factors.items():
            factor[at] = f
        return Transducer(follow, factor)

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: pairs of states, factors multiplied."""
        n = len(other.follow)
        follow = self.follow[:, None, :] * n + other.follow[None, :, :]
        factor = self.factor[:, None, :] * other.factor[None, :, :]
        return Transducer(follow.reshape(-1, 7), factor.reshape(-1, 7))

    def run(self, symbols: np.ndarray, weights: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The score of each clause, words ``first`` to ``first + length``; all clauses take a step at a time."""
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        state, score = np.zeros(len(first), dtype=np.int64), np.zeros(len(first))
        for t in range(int(length.max(initial=0))):
            on = int(np.searchsorted(-length, -t, side="left"))  # clauses longer than t
            at = first[:on] + t
            s = symbols[at]
            score[:on] += self.factor[state[:on], s] * weights[at]
            state[:on] = self.follow[state[:on], s]
        out = np.empty(len(score))
        out[order] = score
        return out


def grammar() -> Transducer:
    """The composition of insult, threat, target, negation and reported-speech transducers."""
    calls = (INSULT, THREAT)
    insult = Transducer.of(1, {}, {(0, s): 0.0 for s in (OTHER, TARGET, NEGATION, REPORT, INTENT)})
    threat = Transducer.of(2, {(0, INTENT): 1}, {(0, THREAT): 0.5, (1, THREAT): 1.5})
    target = Transducer.of(2, {(0, TARGET): 1}, {(1, s): 1.25 for s in calls})
    negation = Transducer.of(4, {(i, NEGATION): 3 for i in range(4)}, {(i, s): 0.25 for i in (1, 2, 3) for s in calls}, rest=(0, 0, 1, 2))
    report = Transducer.of(2, {(0, REPORT): 1}, {(1, s): 0.5 for s in calls})
    machine = insult
    for part in (threat, target, negation, report):
        machine = machine.compose(part)
    return machine


def _key(word: bytes) -> int:
    return int.from_bytes(word[:LONGEST].ljust(LONGEST, b"\0"), "big")


def _seed_keys() -> dict[int, int]:
    return {_key(w.encode()): s for s, words in SEEDS.items() for w in words.split()}


@dataclass
class _Words:
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text a word belongs to
    key: np.ndarray  # its first 8 bytes, as a number

    @staticmethod
    def find(data: np.ndarray, offsets: np.ndarray) -> _Words:
        """Words of lower-cased texts."""
        n = len(data)
        inside = ~_SEPARATOR[data]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        before[cut], after[cut - 1] = False, False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        padded = np.append(data, np.zeros(LONGEST, np.uint8))
        key = np.zeros(len(start), dtype=np.uint64)
        for i in range(LONGEST):
            key |= np.where(start + i < end, padded[start + i], 0).astype(np.uint64) << np.uint64(8 * (LONGEST - 1 - i))
        return _Words(start, end, np.searchsorted(offsets, start, side="right") - 1, key)


def _pieces(data: np.ndarray, offsets: np.ndarray, size: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and text numbers; longer texts in pieces that end where a clause does, or a word if none does soon."""
    spans = []
    for i, (a, z) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        while z - a > size:
            ahead = data[a + size: min(z, a + size + (1 << 16))].tobytes()
            at = _CUT.search(ahead) or _GAP.search(ahead)
            if at is None:
                at = _GAP.search(data[a + size: z].tobytes())
            to = a + size + at.end() if at else z
            spans.append((i, a, to))
            a = to
        if z > a:
            spans.append((i, a, z))
    at = 0
    while at < len(spans):
        to = at + 1
        while to < len(spans) and spans[to][2] - spans[at][1] <= size:
            to += 1
        part = spans[at:to]
        base = part[0][1]
        yield data[base: part[-1][2]], np.array([a - base for _, a, _ in part] + [part[-1][2] - base]), np.array([i for i, _, _ in part])
        at = to


@dataclass
class Lexicon:
    """Weighted prefixes in order of their keys, and the grammar's general words."""

    keys: np.ndarray
    weights: np.ndarray
    seed_keys: np.ndarray
    seed_symbols: np.ndarray
    machine: Transducer

    @staticmethod
    def of(weights: dict[int, float], seeds: dict[int, int]) -> Lexicon:
        """A seed insult or threat without a learned weight has ``SEED_WEIGHT``."""
        weights = {**{k: SEED_WEIGHT for k, s in seeds.items() if s in (INSULT, THREAT)}, **weights}
        keys = np.array(sorted(weights), dtype=np.uint64)
        named = np.array(sorted(seeds), dtype=np.uint64)
        return Lexicon(keys, np.array([weights[int(k)] for k in keys]), named, np.array([seeds[int(k)] for k in named], dtype=np.int64), grammar())

    def read(self, words: _Words) -> tuple[np.ndarray, np.ndarray]:
        """The symbol and the weight of each word."""
        symbol, weight = np.zeros(len(words.key), dtype=np.int64), np.zeros(len(words.key))
        if not len(words.key):
            return symbol, weight
        at = np.minimum(np.searchsorted(self.seed_keys, words.key), len(self.seed_keys) - 1)
        symbol[:] = np.where(self.seed_keys[at] == words.key, self.seed_symbols[at], OTHER)
        opens = np.zeros(1 << 16, dtype=bool)
        opens[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        some = np.flatnonzero(opens[(words.key >> np.uint64(48)).astype(np.int64)])
        size = words.end[some] - words.start[some]
        for k in range(SHORTEST, LONGEST + 1):
            own = some[size >= k]
            stem = words.key[own] & _MASKS[k]
            at = np.minimum(np.searchsorted(self.keys, stem), len(self.keys) - 1)
            weight[own] = np.maximum(weight[own], np.where(self.keys[at] == stem, self.weights[at], 0.0))
        symbol[(weight > 0) & (symbol != THREAT)] = INSULT
        return symbol, weight

    def clauses(self, data: np.ndarray, offsets: np.ndarray) -> tuple[_Words, np.ndarray, np.ndarray, np.ndarray]:
        """The words, and of the clauses that hold a weighted word the first word, the length and the score."""
        words = _Words.find(data, offsets)
        symbol, weight = self.read(words)
        hit = np.flatnonzero(weight > 0)
        if not len(hit):
            return words, hit, hit, np.zeros(0)
        ends = np.cumsum(_CLAUSE_END[data], dtype=np.int32)[words.start]
        opens = np.append(True, (ends[1:] != ends[:-1]) | (words.text[1:] != words.text[:-1]))
        place = np.arange(len(opens)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
        first = np.flatnonzero(place % CLAUSE_WORDS == 0)
        length = np.diff(np.append(first, len(opens)))
        own = np.unique(np.searchsorted(first, hit, side="right") - 1)
        return words, first[own], length[own], self.machine.run(symbol, weight, first[own], length[own])

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Of each text: its strongest clause, and a quarter of the logarithm of one plus the others."""
        top, total = np.zeros(len(texts)), np.zeros(len(texts))
        batch, done = pa.RecordBatch.from_arrays([texts], names=["text"]), 0
        for part in slices(batch, 0):
            data, offsets = buffers(pc.utf8_lower(part.column(0)))
            for piece, at, owner in _pieces(data, offsets):
                words, first, _, score = self.clauses(piece, at)
                text = owner[words.text[first]] + done
                np.maximum.at(top, text, score)
                np.add.at(total, text, score)
            done += part.num_rows
        return top + 0.25 * np.log1p(total - top)


@dataclass
class Model:
    lexicon: Lexicon
    at: np.ndarray  # rising evidence, and the share of toxic texts there
    share: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        found = self.lexicon.evidence(texts)
        rising = found / (found + 4.0)  # orders texts on a level part of the curve
        level = np.interp(found, self.at, self.share) if len(self.at) else rising
        return np.clip(0.98 * level + 0.02 * rising, 0.0, 1.0)


def log_odds(toxic, clean, all_toxic, all_clean, log, root, margin: float = 2.0):
    """Logarithm of the ratio of both shares, less ``margin`` standard errors; for numbers or columns."""
    ratio = log((toxic + 0.5) / (all_toxic + 1.0)) - log((clean + 0.5) / (all_clean + 1.0))
    return ratio - margin * root(1.0 / (toxic + 0.5) + 1.0 / (clean + 0.5))


def _monotone(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising curve of the weighted share of toxic texts: level where adjacent violators are pooled, straight between.

    Each level counts one text more with the mean share.
    """
    blocks: list[list[float]] = []  # least and most evidence, toxic, weight, rows
    for e in np.unique(evidence):
        own = evidence == e
        blocks.append([e, e, (weight * toxic)[own].sum(), weight[own].sum(), own.sum()])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], *(x + y for x, y in zip(blocks[-1][2:], last[2:]))]
    mean = float((weight * toxic).sum() / weight.sum())
    share = np.maximum.accumulate([(t + mean * w / n) / (w + w / n) for _, _, t, w, n in blocks])
    return np.array([x for b in blocks for x in b[:2]]), np.repeat(share, 2)


def _drawn(documents: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``sample`` different texts of each label: ``text``, ``toxic``, ``half``; and the number of different texts of each."""
    key = F.xxhash64(F.col("text").cast("string"))
    keyed = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", key.alias("key"))
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    different = keyed.select("doc_id", "key").join(marks, "doc_id").groupBy("key").agg(
        (F.avg("toxic") >= 0.5).cast("int").alias("toxic"), F.min("doc_id").alias("doc_id"))
    different = settle(different.withColumn("draw", F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30))), "labelled")
    sizes = {r["toxic"]: r["n"] for r in different.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label, n in sorted(sizes.items()):
        own = different.where((F.col("toxic") == label) & (F.col("draw") < min(1 << 30, int(2.0 * sample / n * (1 << 30)) + 1)))
        own = own.orderBy("draw", "key").limit(sample).select("key", "toxic", F.col("doc_id").alias("of"), (F.col("draw") % 2).cast("int").alias("half"))
        picked = own if picked is None else picked.union(own)
    if picked is None:
        return None, sizes
    picked = F.broadcast(settle(picked, "drawn"))  # at most sample rows a label
    return keyed.join(picked, (keyed["key"] == picked["key"]) & (keyed["doc_id"] == picked["of"])).drop(keyed["key"]).dropDuplicates(["key"]), sizes


def count_stems(drawn: DataFrame) -> DataFrame:
    """For each prefix (as a number) in how many toxic and other texts of either half it occurs: ``stem``, ``t0``, ``t1``, ``c0``, ``c1``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = (batch.column(1).to_numpy(zero_copy_only=False) * 2 + batch.column(2).to_numpy(zero_copy_only=False)).astype(np.int64)
            done, held = 0, {}
            for part in slices(batch, 0):
                data, offsets = buffers(pc.utf8_lower(part.column(0)))
                for piece, at, owner in _pieces(data, offsets):
                    words = _Words.find(piece, at)
                    size, text = words.end - words.start, owner[words.text] + done
                    for k in range(SHORTEST, LONGEST + 1):
                        own = size >= k
                        for i, stems in _by_text(text[own], words.key[own] & _MASKS[k]):
                            held.setdefault(i, []).append(stems)
                done += part.num_rows
                if held:  # the texts of a slice are complete
                    every = [np.unique(np.concatenate(x)) for x in held.values()]
                    stem, of = np.concatenate(every), np.repeat(kind[list(held)], [len(x) for x in every])
                    held = {}
                    for b in range(4):
                        found, n = np.unique(stem[of == b], return_counts=True)
                        if len(found):
                            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), b, np.int32)), pa.array(n)],
                                                             names=["stem", "kind", "n"])

    found = drawn.select("text", "toxic", "half").mapInArrow(tidy(task), "stem long, kind int, n long")
    names = {0: "c0", 1: "c1", 2: "t0", 3: "t1"}
    return found.groupBy("stem").agg(*[F.sum(F.when(F.col("kind") == b, F.col("n")).otherwise(0)).alias(c) for b, c in names.items()])


def _by_text(text: np.ndarray, stem: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The stems of each text; texts are in order."""
    at = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else []
    for a, z in zip(at, np.append(at[1:], len(text))):
        yield int(text[a]), stem[a:z]


def choose_stems(counts: dict[int, tuple[int, int]], all_toxic: int, all_clean: int, least_texts: int, least_weight: float) -> dict[int, float]:
    """The heaviest stems first; none below a chosen one, and one above chosen ones by what these leave of its texts."""
    def weigh(t: int, c: int) -> float:
        return float(log_odds(t, c, all_toxic, all_clean, np.log, np.sqrt)) if t >= least_texts else 0.0

    chosen: dict[int, float] = {}
    below: dict[int, list[int]] = {}  # of each possible prefix, the texts of the chosen stems under it
    for weight, stem in sorted(((weigh(*n), k) for k, n in counts.items()), reverse=True):
        over = [stem & int(_MASKS[k]) for k in range(SHORTEST, LONGEST + 1)]
        if weight < least_weight or any(o in chosen for o in over if o != stem):
            continue
        t, c = counts[stem]
        if stem in below:
            weight = weigh(max(0, t - below[stem][0]), max(0, c - below[stem][1]))
        if weight >= least_weight:
            chosen[stem] = weight
            for o in set(over) - {stem}:
                below[o] = [x + y for x, y in zip(below.get(o, [0, 0]), (t, c))]
    return chosen


def fit(documents: DataFrame, labels: DataFrame, sample: int = 8192, lexicon: int = 8192, least_texts: int = 5, least_weight: float = 1.5) -> Model:
    """Learn from the texts of ``documents`` that ``labels`` marks with ``toxic`` 0 or 1."""
    seeds = _seed_keys()
    drawn, sizes = _drawn(documents, labels, sample)
    if not (sizes.get(0) and sizes.get(1)):
        return Model(Lexicon.of({}, seeds), np.zeros(0), np.zeros(0))
    drawn = settle(drawn.select("text", "toxic", "half"), "texts")
    held = {(r["toxic"], r["half"]): r["n"] for r in drawn.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}  # 4 rows
    of = {label: [held.get((label, h), 0) for h in (0, 1)] for label in (0, 1)}
    toxic, clean = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    weight = log_odds(toxic, clean, float(sum(of[1])), float(sum(of[0])), F.ln, F.sqrt)
    counted = settle(count_stems(drawn).where((toxic >= least_texts) | F.col("stem").isin([k - (1 << 64) if k >> 63 else k for k in seeds]))
                     .withColumn("weight", weight), "stems")
    top = counted.where(F.col("weight") >= least_weight).orderBy(F.desc("weight"), "stem").limit(lexicon)
    general = counted.where(F.col("stem").isin([k - (1 << 64) if k >> 63 else k for k in seeds]))
    rows = {r["stem"] % (1 << 64): r for r in [*top.collect(), *general.collect()]}  # at most lexicon rows and the seeds

    def learned(halves: Sequence[int]) -> Lexicon:
        n1, n0 = (sum(of[label][h] for h in halves) for label in (1, 0))
        counts = {k: tuple(sum(r[f"{x}{h}"] for h in halves) for x in "tc") for k, r in rows.items()}
        weights = choose_stems(counts, n1, n0, least_texts, least_weight)
        for k, (t, c) in counts.items():
            if seeds.get(k) in (INSULT, THREAT) and t + c >= 8:
                weights.setdefault(k, 0.0)  # a general word that is common in clean texts here
        return Lexicon.of(weights, seeds)

    other = {0: learned([1]), 1: learned([0])}

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(2).to_numpy(zero_copy_only=False)
            found = np.where(half == 0, other[0].evidence(batch.column(0)), other[1].evidence(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.round(found, 6))], names=["toxic", "evidence"])

    points = drawn.mapInArrow(tidy(crossed), "toxic int, evidence double").toPandas()  # at most sample rows a label
    label = points["toxic"].to_numpy()
    share = np.array([sizes[0] / max(1, sum(of[0])), sizes[1] / max(1, sum(of[1]))])
    return Model(learned([0, 1]), *_monotone(points["evidence"].to_numpy(), label.astype(float), share[label]))


def score(model: Model, text: Column) -> Column:
    """The score of a text column, 0 to 1."""
    @F.arrow_udf("double")
    def of_texts(texts: pa.Array) -> pa.Array:
        out = pa.array(model.score(texts))
        release()
        return out

    return of_texts(text.cast("string"))


def matched_clauses(df: DataFrame, id: str, text: str, model: Model) -> DataFrame:
    """A row for each clause with evidence: ``id``, ``start`` and ``length`` in words of the text, the lower-cased ``clause`` and its ``score``."""
    kind = df.schema[id].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data, offsets = buffers(pc.utf8_lower(part.column(1)))
                seen = np.zeros(part.num_rows, dtype=np.int64)  # words of a text in its pieces so far
                for piece, at, owner in _pieces(data, offsets):
                    words, first, length, found = model.lexicon.clauses(piece, at)
                    own = words.text[first]
                    opens = np.searchsorted(words.text, np.arange(len(owner)))
                    spelled = [piece[words.start[a]: words.end[a + n - 1]].tobytes().decode("utf-8", "replace") for a, n in zip(first, length)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(owner[own])), pa.array(first - opens[own] + seen[owner[own]]), pa.array(length),
                         pa.array(spelled, pa.string()), pa.array(found)], names=["id", "start", "length", "clause", "score"])
                    np.add.at(seen, owner[words.text], 1)

    return df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        tidy(task), f"id {kind}, start long, length long, clause string, score double")
