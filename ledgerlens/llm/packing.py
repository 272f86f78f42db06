"""Order-preserving packing of token streams into windows (operator 2).

Documents are laid end to end in table order; window cuts are chosen among document ends,
sentence ends and, inside long sentences, evenly spaced points. Dynamic programming minimises
padding plus a penalty for cuts inside documents and inside sentences. Padding is linear in the
window's start, so the best start within reach is the front of a monotone queue; windows whose
length is a power of two need no padding and are looked up on their own.

Each scan partition is packed as a stream in bounded blocks without a shuffle; a block's open
end is carried into the next. Defined cases: a null text is empty and gives its end id only;
repeated rows are packed each; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder
from .words import slices, tidy

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SENTENCE_END = re.compile(r"[.!?]+[\"')\]]*</w>")


def choose_cuts(points: np.ndarray, penalty: np.ndarray, capacity: int, powers: tuple[int, ...]) -> list[int]:
    """Indices of the best window ends among ``points`` (ascending, the first is 0, the last the total).

    Neighbouring points lie at most ``capacity`` apart. A window costs its padding to
    ``capacity``, none if its length is one of ``powers``, plus the penalty of its end.
    """
    at, cost = points.tolist(), penalty.tolist()
    exact: dict[int, list[int]] = {}
    for p in powers:
        start = np.searchsorted(points, points - p)
        hit = np.flatnonzero((points >= p) & (points[np.minimum(start, len(points) - 1)] == points - p))
        for j, i in zip(hit.tolist(), start[hit].tolist()):
            exact.setdefault(j, []).append(i)
    best, origin = [0] * len(at), [0] * len(at)
    queue = deque([(0, 0)])
    for j in range(1, len(at)):
        x = at[j]
        while x - at[queue[0][1]] > capacity:
            queue.popleft()
        key, i = queue[0]
        value = key + capacity - x
        if j in exact:
            for e in exact[j]:
                if best[e] <= value:
                    value, i = best[e], e
        value += cost[j]
        best[j], origin[j] = value, i
        key = value + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = origin[j]
    return cuts[::-1]


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, spacing: int, sentence_penalty: int, split_penalty: int):
    """Possible cuts with their penalties: document ends 0, sentence ends, and points in long sentences."""
    known = np.union1d(np.union1d([0], doc_ends), sentence_ends)
    gaps = np.diff(known)
    far = np.flatnonzero(gaps > spacing)
    extra = [np.arange(known[k] + spacing, known[k + 1], spacing) for k in far]
    points = np.union1d(known, np.concatenate(extra)) if extra else known
    penalty = np.full(len(points), split_penalty, dtype=np.int64)
    penalty[np.searchsorted(points, sentence_ends)] = sentence_penalty
    penalty[np.searchsorted(points, doc_ends)] = 0
    penalty[0] = 0
    return points.astype(np.int64), penalty


def pack_documents(df: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1,
                   sentence_penalty: int = 4, split_penalty: int = 24, least_power: int = 256,
                   block_windows: int = 128, vocabulary: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids; ``ids`` are little-endian unsigned 32-bit.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's;
    ``doc_tokens`` includes the end id. Sequence ids are unique across partitions.
    """
    powers = tuple(1 << k for k in range(capacity.bit_length()) if least_power <= 1 << k < capacity)
    spacing = max(1, capacity // 32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = encoder(vocabulary)
        vocab = owner.library.get_vocab(with_added_tokens=True)
        ends_sentence = np.zeros(max([*vocab.values(), end_id]) + 1, dtype=bool)
        ends_sentence[[i for t, i in vocab.items() if _SENTENCE_END.fullmatch(t)]] = True
        sequence = None
        keys, ids, starts, totals, held = [], [], [], [], 0
        kind = None

        def flush(last: bool):
            nonlocal sequence, keys, ids, starts, totals, held
            stream = np.concatenate(ids)
            doc_ends = np.cumsum([len(x) for x in ids])
            points, penalty = cut_points(doc_ends, np.flatnonzero(ends_sentence[stream]) + 1, spacing, sentence_penalty, split_penalty)
            stops = points[choose_cuts(points, penalty, capacity, powers)]
            if not last:
                stops = stops[stops <= held - 4 * capacity]
            raw, out, doc, begin = stream.astype("<u4").tobytes(), [], 0, 0
            doc_starts = doc_ends - [len(x) for x in ids]
            for stop in stops.tolist():
                at = begin
                while at < stop:
                    to = min(stop, int(doc_ends[doc]))
                    out.append((keys[doc], starts[doc] + at - int(doc_starts[doc]), to - at, raw[4 * at:4 * to],
                                totals[doc], sequence, at - begin))
                    if to == doc_ends[doc]:
                        doc += 1
                    at = to
                sequence += 1
                begin = stop
            if doc < len(ids):
                done = begin - int(doc_starts[doc])
                ids = [ids[doc][done:], *ids[doc + 1:]]
                starts = [starts[doc] + done, *starts[doc + 1:]]
                keys, totals = keys[doc:], totals[doc:]
            else:
                keys, ids, starts, totals = [], [], [], []
            held -= begin
            columns = list(zip(*out)) or [()] * 7
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.column(0).type
            if sequence is None and batch.num_rows:
                sequence = batch.column(2)[0].as_py() << 40
            for part in slices(batch, 1):
                done = owner.encode(part.column(1))
                stops = np.cumsum(done.totals()).tolist()
                for key, begin, stop in zip(part.column(0).to_pylist(), [0, *stops], stops):
                    tokens = np.append(done.ids[begin:stop], np.uint32(end_id))
                    keys.append(key)
                    ids.append(tokens)
                    starts.append(0)
                    totals.append(len(tokens))
                    held += len(tokens)
                    if held > block_windows * capacity:
                        yield flush(False)
        if keys:
            yield flush(True)

    id_kind = df.schema[id].dataType.simpleString()
    # the scan's own partition number stays the same if a later step coalesces partitions into one task
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).cast("string"), F.spark_partition_id().cast("long"))
    return rows.mapInArrow(tidy(pack), f"doc_id {id_kind}, {SCHEMA}")
