"""Order-preserving packing of token streams into sequences, cut by dynamic programming.

The ids of the documents, each followed by an end id, form a stream in the
order of the input. Window cuts lie at the end of a document or sentence, or,
where those are more than ``LONG_SENTENCE`` ids apart, at a higher price at
places every ``STRIDE`` ids.
A window costs its padding, a fixed price, and a penalty when it ends inside a
document. A window whose length is a power of two needs no padding, any other
is padded to the full length. The least total is found over all cuts: for
padded windows by a monotone queue of the smallest cost so far, for unpadded
ones from the few cuts at such a distance.

A partition is handled in runs of ``RUN`` tokens, so memory doesn't grow with
it; the last window of a run starts the next one. Every id of the input lies
in exactly one piece.

Defined results: a null text counts as empty and gives the end id alone; a row
with a null doc_id is packed like any other, with a null in the result;
repeated rows are packed each; an empty table gives no piece; extra columns
are ignored.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm import tokens

LENGTH = 4096
END_ID = 2
RUN = 1 << 20
SENTENCE_CUT = 6
FORCED_CUT = 32
LONG_SENTENCE = 64
STRIDE = 32
WINDOW_PRICE = 2

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, `offset` bigint"
)


def candidates(sentence: np.ndarray, document: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of the cuts allowed in a stream of ``total`` ids, the end included."""
    places = np.union1d(sentence, document)
    places = np.union1d(places[(places > 0) & (places < total)], [total])
    gaps = np.diff(np.concatenate(([0], places)))
    long = gaps > min(LONG_SENTENCE, length)
    stride = min(STRIDE, length)
    forced = [np.arange(end - gap + stride, end, stride) for end, gap in zip(places[long], gaps[long])]
    if forced:
        places = np.union1d(places, np.concatenate(forced))
    penalty = np.full(len(places), FORCED_CUT, dtype=np.int64)
    penalty[np.isin(places, sentence, assume_unique=False)] = SENTENCE_CUT
    penalty[np.isin(places, document, assume_unique=False)] = 0
    penalty[-1] = 0
    return places, penalty


def cut(places: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Ends of the windows with the least total of padding, penalties and prices."""
    at = np.concatenate(([0], places))
    exact_to, exact_from = [], []
    step = 1
    while step <= length:
        before = np.searchsorted(at, at - step)
        hit = np.flatnonzero((at >= step) & (at[np.minimum(before, len(at) - 1)] == at - step))
        exact_to.append(hit)
        exact_from.append(before[hit])
        step *= 2
    to, source = np.concatenate(exact_to), np.concatenate(exact_from)
    order = np.argsort(to, kind="stable")
    to, source = to[order].tolist() + [len(at)], source[order].tolist()
    position, extra = at.tolist(), [0, *(penalty + WINDOW_PRICE).tolist()]
    best, previous, queue = [0] * len(at), [0] * len(at), deque([(0, 0)])
    pointer = 0
    for j in range(1, len(at)):
        here = position[j]
        while position[queue[0][1]] < here - length:
            queue.popleft()
        low, i = queue[0]
        cost = low + length - here
        while to[pointer] == j:
            if best[source[pointer]] < cost:
                cost, i = best[source[pointer]], source[pointer]
            pointer += 1
        best[j], previous[j] = cost + extra[j], i
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(at) - 1
    while j:
        ends.append(position[j])
        j = previous[j]
    return ends[::-1]


@dataclass
class Document:
    doc_id: int | None
    ids: np.ndarray
    start: int = 0


class Packer:
    """Takes documents in order, gives pieces: (doc_id, start, length, ids, doc_tokens, window, offset)."""

    def __init__(self, sentence_ends: np.ndarray, length: int = LENGTH, run: int = RUN):
        self.ends, self.length, self.run = sentence_ends, length, max(run, 2 * length)
        self.waiting: list[Document] = []
        self.held, self.window = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.waiting.append(Document(doc_id, ids))
        self.held += len(ids)
        if self.held >= self.run:
            yield from self.flush(last=False)

    def flush(self, last: bool = True):
        if not self.held:
            return
        remains = [d.ids[d.start :] for d in self.waiting]
        stream = np.concatenate(remains)
        borders = np.cumsum([len(r) for r in remains])
        sentence = np.flatnonzero(self.ends[np.minimum(stream, len(self.ends) - 1)]) + 1
        ends = cut(*candidates(sentence, borders, len(stream), self.length), self.length)
        if not last and len(ends) > 1:
            ends.pop()
        begins = [0, *ends[:-1]]
        number = 0
        for low, high in zip(begins, ends):
            while number < len(borders) and borders[number] <= low:
                number += 1
            at, k = low, number
            while at < high:
                doc = self.waiting[k]
                first = int(borders[k]) - len(remains[k])
                stop = min(high, int(borders[k]))
                start = doc.start + at - first
                piece = doc.ids[start : start + stop - at]
                yield doc.doc_id, start, stop - at, piece, len(doc.ids), self.window, at - low
                at, k = stop, k + 1
            self.window += 1
        done, kept, at = ends[-1], [], 0
        for doc, rest in zip(self.waiting, remains):
            if at + len(rest) > done:
                kept.append(Document(doc.doc_id, doc.ids, doc.start + max(0, done - at)))
            at += len(rest)
        self.waiting, self.held = kept, len(stream) - done


def pack(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, run: int = RUN
) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of at most ``length`` ids; each partition is packed by itself.

    ``vocabulary`` is the path of a tokenizers file. Pieces hold their ids as
    little-endian 32-bit integers. Sequence ids are unique over partitions.
    """

    def task(batches):
        from pyspark import TaskContext

        from postlens.llm.tables import slices

        encode = tokens.encoder(vocabulary)
        packer = Packer(encode.sentence_ends(), length, run)
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()

        def documents():
            for whole in batches:
                for batch in slices(whole):
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        yield from packer.add(doc_id, np.frombuffer(encode.ids(text or "") + end, dtype="<u4"))
            yield from packer.flush()

        rows: list[tuple] = []
        size = 0
        for row in documents():
            rows.append(row)
            size += row[2]
            if size >= 1 << 20:
                yield as_batch(rows, base)
                rows, size = [], 0
        if rows:
            yield as_batch(rows, base)

    return docs.select("doc_id", "text").mapInArrow(task, PIECES)


def as_batch(rows: list[tuple], base: int) -> pa.RecordBatch:
    doc_id, start, length, ids, total, window, offset = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_id, pa.int64()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array([i.tobytes() for i in ids], pa.binary()),
            pa.array(total, pa.int64()),
            pa.array([base + w for w in window], pa.int64()),
            pa.array(offset, pa.int64()),
        ],
        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )
