"""Token ids of whole texts as the vocabulary's own library gives them, remembering spans.

A vocabulary that drops white space before merging gives a text the ids of its blank-free
spans in order. Spans of a block of texts are hashed together; each span not seen before goes to
the library, cut into words, once per worker, and ids are laid out by array operations. The
memory of spans is bounded. Texts with characters whose case or composition may depend on their
neighbours, or with openings of special tokens, send each span to the library as it stands.
Other vocabularies go to the library whole, a text at a time.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex

from .words import buffers, find_words

CAREFUL = re.compile("[^\x00-\x1b\x20-įı-˿‐-‧‰-⁞₠-₿]|<\\|")
REMEMBERED = 1_000_000
_SUSPECT = np.zeros(256, dtype=bool)
_SUSPECT[list(range(0x1C, 0x20)) + [0xC4] + list(range(0xCC, 256))] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _ByteNames(dict):
    """For ``str.translate``: a character's bytes under the names the vocabulary uses."""

    def __missing__(self, code: int) -> str:
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self[code] = "".join(part for part, _ in level.pre_tokenize_str(chr(code)))
        return self[code]


def _ragged(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``values[begin[i]:begin[i] + size[i]]`` one after the other."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return values[np.arange(total) + np.repeat(begin - (stop - size), size)]


@dataclass
class Encoded:
    """Blank-free spans of several texts with the number of tokens of each, and all ids in order."""

    data: np.ndarray
    start: np.ndarray  # bytes at which spans start
    count: np.ndarray
    first: np.ndarray  # text i has spans first[i] to first[i+1]
    ids: np.ndarray

    def totals(self) -> np.ndarray:
        upto = np.append(0, np.cumsum(self.count))
        return upto[self.first[1:]] - upto[self.first[:-1]]


class Encoder:
    """Encodes without added, truncated or padded ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = bool(self.suffix) and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"]
        if self.by_word:
            self.words_of = regex.compile(steps[0]["pattern"]["Regex"])
            bare = {**spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.merger = Tokenizer.from_str(json.dumps(bare))
            vocab = spec["model"]["vocab"]
            self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends_word[[i for t, i in vocab.items() if t.endswith(self.suffix)]] = True
        self.names = _ByteNames({32: " "})
        self._forget()

    def _forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text straight from the library."""
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _new_spans(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans without careful characters, and how many each has."""
        cut = [self.words_of.findall(s.lower()) for s in spans]
        words = list({w: None for ws in cut for w in ws})
        ids = np.asarray(self.merger.encode(" ".join(words).translate(self.names), add_special_tokens=False).ids, dtype=np.uint32)
        stop = np.flatnonzero(self.ends_word[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        number = {w: i for i, w in enumerate(words)}
        order = np.array([number[w] for ws in cut for w in ws], dtype=np.int64)
        per_span = np.array([len(ws) for ws in cut], dtype=np.int64)
        begin = np.append(0, stop[:-1])[order] if len(order) else order
        size = stop[order] - begin if len(order) else order
        upto = np.append(0, np.cumsum(size))
        at = np.append(0, np.cumsum(per_span))
        return _ragged(ids, begin, size), upto[at[1:]] - upto[at[:-1]]

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        begin = len(self.store) + np.cumsum(size) - size
        self.store = np.concatenate([self.store, ids])
        order = np.argsort(hashes)
        at = np.searchsorted(self.seen, hashes[order])
        self.seen = np.insert(self.seen, at, hashes[order])
        self.begin = np.insert(self.begin, at, begin[order])
        self.size = np.insert(self.size, at, size[order])

    def encode(self, column: pa.Array) -> Encoded:
        """Spans, token counts and ids of a text column; a null text is empty."""
        data, offsets = buffers(column)
        if not self.by_word:
            ids = [self.whole(t or "") for t in column.to_pylist()]
            return Encoded(data, offsets[:-1], np.array([len(x) for x in ids], np.int64), np.arange(len(offsets)),
                           np.concatenate([np.zeros(0, np.uint32), *ids]))
        spans = find_words(data, offsets, lower=True)
        careful = np.zeros(len(offsets), dtype=bool)
        odd = np.flatnonzero(_SUSPECT[data])
        bars = np.flatnonzero(data[:-1] == ord("<")) if len(data) else odd
        odd = np.append(odd, bars[data[bars + 1] == ord("|")])
        for i in np.unique(np.searchsorted(offsets, odd, side="right") - 1).tolist():
            careful[i] = bool(CAREFUL.search(data[offsets[i]: offsets[i + 1]].tobytes().decode()))
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(spans.first))
        plain = ~careful[owner]
        if len(self.seen) > REMEMBERED:
            self._forget()
        unique, sample, inverse = np.unique(spans.hash[plain], return_index=True, return_inverse=True)
        at = np.searchsorted(self.seen, unique)
        known = at < len(self.seen)
        known[known] = self.seen[at[known]] == unique[known]
        new = np.flatnonzero(~known)
        if len(new):
            place = np.flatnonzero(plain)[sample[new]]
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(spans.start[place].tolist(), spans.end[place].tolist())]
            self._remember(unique[new], *self._new_spans(texts))
            at = np.searchsorted(self.seen, unique)
        begin, size = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        begin[plain], size[plain] = self.begin[at][inverse], self.size[at][inverse]
        store = self.store
        if not plain.all():
            extra, more = len(store), [store]
            for k in np.flatnonzero(~plain).tolist():
                ids = self.whole(data[spans.start[k]: spans.end[k]].tobytes().decode())
                begin[k], size[k] = extra, len(ids)
                extra += len(ids)
                more.append(ids)
            store = np.concatenate(more)
        return Encoded(data, spans.start, size, spans.first, _ragged(store, begin, size))

    def ids(self, text: str) -> np.ndarray:
        return self.encode(pa.array([text], pa.string())).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The encoder of a vocabulary file, kept for the life of the worker."""
    path = path or default_vocabulary()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
