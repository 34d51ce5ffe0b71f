"""Context-triggered piecewise hashes of texts and their likeness.

The bytes of a text pass a rolling hash over seven bytes. Where its low bits
are all ones, a piece ends; at block size b that is one place in b on average.
A piece's hash gives one sign of a 64-letter alphabet. The block size is the
smallest power of two with at most ``MOST`` pieces, found from the triggers
of the whole text (from 1 on for texts below ``SMALL`` bytes, else from 4); the fingerprint ``b:signs:signs:signs`` holds the signs at b, 2b
and 4b. Two fingerprints are compared at the block sizes they share by the
edit distance of their signs, where an exchange counts as a deletion and an
insertion and a run of one sign counts as three at most; without a common run
of ``RUN`` signs the likeness is 0.

Defined results: a null text counts as empty; the empty text has ``1:::``, is
like itself by 1 and like all others by 0; equal texts have equal
fingerprints. Texts are read in segments, so very long ones need no more
memory than their bytes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm.tables import slices, stored
from postlens.llm.words import mix64, powers, prefix_sums

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SMALL = 4096
MOST = 64
RUN = 4
SIZES = 3
ROLL = 7
SEGMENT = 1 << 20
_BASE = int(powers(2)[0][1])
_INVERSE = int(powers(2)[1][1])
_WRAP = (1 << 64) - 1
_LONG_RUN = re.compile(r"(.)\1{3,}")
_SIGNS = np.frombuffer(LETTERS.encode(), dtype=np.uint8)


def triggers(data: bytes, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, levels, sums): where pieces may end, up to which power of two, and the prefix hash there.

    The last entry is the end of the data, at every level.
    """
    ends, levels, sums = [], [], []
    before, tail = 0, b""
    for at in range(0, len(data), SEGMENT):
        part = np.frombuffer(tail + data[at : at + SEGMENT], dtype=np.uint8).astype(np.uint64)
        values = part * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F)
        prefix = prefix_sums(values)
        lead = len(tail)
        stop = np.arange(max(lead, ROLL - 1) + 1, len(prefix))
        low = stop - ROLL
        roll = mix64((prefix[stop] - prefix[low]) * powers(len(prefix))[1][low])
        hit = np.flatnonzero((roll & np.uint64(least - 1)) == least - 1)
        ones = ~roll[hit]
        ones &= np.uint64(0) - ones
        begin = at - lead
        scale = np.uint64(pow(_BASE, begin, 1 << 64)) if begin else np.uint64(1)
        ends.append(stop[hit] + begin)
        levels.append(np.where(ones == 0, 64.0, np.log2(np.maximum(ones, 1).astype(np.float64))).astype(np.int64))
        base = (before - int(prefix[lead]) * int(scale)) & _WRAP
        sums.append(prefix[stop[hit]] * scale + np.uint64(base))
        before = (int(prefix[-1]) * int(scale) + base) & _WRAP
        tail = data[max(0, at + SEGMENT - ROLL + 1) : at + SEGMENT]
    last = np.array([len(data)]), np.array([64]), np.array([before], dtype=np.uint64)
    if ends and len(ends[-1]) and ends[-1][-1] == len(data):
        ends[-1], levels[-1], sums[-1] = ends[-1][:-1], levels[-1][:-1], sums[-1][:-1]
    return tuple(np.concatenate([*found, end]) for found, end in zip((ends, levels, sums), last))


def signs(ends: np.ndarray, sums: np.ndarray) -> str:
    """One sign for each piece between the given ends."""
    starts = np.concatenate(([0], ends[:-1]))
    heads = np.concatenate((np.zeros(1, dtype=np.uint64), sums[:-1]))
    down = np.array([pow(_INVERSE, int(s), 1 << 64) for s in starts], dtype=np.uint64)
    return _SIGNS[(mix64((sums - heads) * down) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "1:::"
    level = 0 if len(data) < SMALL else 2
    ends, levels, sums = triggers(data, 1 << level)
    while np.count_nonzero(levels >= level) > MOST:
        level += 1
    kept = [levels >= level + step for step in range(SIZES)]
    return ":".join([str(1 << level), *(signs(ends[k], sums[k]) for k in kept)])


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of it in the bits of one integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        matched = row & masks.get(c, 0)
        row = ((row + matched) | (row - matched)) & full
    return len(a) - row.bit_count()


def share_run(a: str, b: str, run: int) -> bool:
    return not {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1))


def sign_likeness(a: str, b: str) -> float:
    run = min(RUN, len(a), len(b))
    if not run:
        return float(a == b)
    if a == b:
        return 1.0
    return 2.0 * common_length(a, b) / (len(a) + len(b)) if share_run(a, b, run) else 0.0


def likeness(one: str, other: str) -> float:
    """0 to 1; 0 where no block size is shared."""
    if one == other:
        return 1.0
    a, b = by_size(one), by_size(other)
    return max((sign_likeness(a[k], b[k]) for k in a.keys() & b.keys()), default=0.0)


def by_size(mark: str) -> dict[int, str]:
    """Block size -> signs, runs shortened; none for the empty text."""
    size, *found = mark.split(":")
    return {int(size) << step: _LONG_RUN.sub(r"\1\1\1", s) for step, s in enumerate(found) if s}


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the next one's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def compared(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following)
    changed_mark = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, mark, changed_mark, likeness(mark, changed_mark), likeness(mark, next_mark)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
             pa.int64(), pa.bool_(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*_NAMES, "part", "first", "first_text", "last_text"])


def _walk(batches):
    """Compares each row with the next of its partition; the first and the last row's texts go along."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held, rows, first = None, [], True
    for whole in batches:
        for batch in slices(whole):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                mark = fingerprint(text)
                if held is not None:
                    rows.append((*compared(*held, text, mark), part, first, held[1] if first else None, None))
                    first = False
                held = (doc_id, text, mark)
            if rows:
                yield _as_batch(rows)
                rows = []
    if held is not None:
        yield _as_batch([(held[0], len(held[1]), None, held[2], None, None, None, part, first, held[1] if first else None, held[1])])


def _ends(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            rows.append(compared(r["doc_id"], r["last_text"], r["fingerprint"], r["next_text"], r["next_mark"]))
        if rows:
            yield pa.RecordBatch.from_arrays([c for c in _as_batch([(*r, 0, False, None, None) for r in rows]).columns[:7]], _NAMES)


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their texts edited with the next one in descending doc_id.

    One shuffle by ranges of doc_id brings neighbours together. Only the rows
    at the borders of partitions (two a partition) wait for a second step,
    which joins each partition's last row with the first of the next one, and
    the last row of all with the first of all. Rows of equal doc_id are
    ordered by text; null ids come last.
    """
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(count, F.desc_nulls_last("doc_id"))
    ordered = ordered.sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    walked = stored(ordered.mapInArrow(_walk, f"{COLUMNS}, part bigint, first boolean, first_text string, last_text string"), "fingerprints")
    heads = walked.where("first").select("part", F.col("first_text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    # One row a partition, hence a window without partitions; the last one is followed by the first.
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(whole)).alias("next_part"))
    tails = walked.where("last_text IS NOT NULL").join(following, "part")
    joined = tails.join(heads.withColumnRenamed("part", "head_part"), F.col("next_part") == F.col("head_part"))
    ends = joined.select("doc_id", "last_text", "fingerprint", "next_text", "next_mark").mapInArrow(_ends, COLUMNS)
    return walked.where("last_text IS NULL").select(*_NAMES).unionByName(ends)
