"""Benchmark decontamination: every occurrence of a benchmark window in training texts, found by FM-indexes.

A word is a run of characters outside ``\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F`` after
lower-casing A-Z. The windows of an item are its runs of ``WINDOW`` words; an
item with fewer words, but some, is one window. Training texts are indexed
where they lie: each task gathers words into shards of at most ``SHARD``,
turns them into symbols (all words that no item has share one), cuts them into
pieces that overlap by ``WINDOW - 1`` words, and builds the shard's FM-index
over the pieces. All windows are searched backwards at once; occurrences
are located by sampled suffix positions in lots of ``LOT``, and their spans
are merged.

The benchmark goes to the tasks in blocks of about ``BLOCK_BYTES`` of text
(its size is measured first, the block of an item is a hash); each block is
one more pass over the same rows inside the same tasks, without a shuffle.

Defined results: a null or empty text, or one without words, has no words and
no hit; a null or empty item has no window; the id of an item is its string,
a null id counts as the empty one; repeated rows of documents are judged one
by one, repeated items count once; other columns of either table are ignored.
A text of any length is read whole: beyond a shard its words go to several
shards that overlap by ``WINDOW - 1`` words.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.fmindex import Index
from postlens.llm.tables import slices

WINDOW = 10
SHARD = 1 << 19
PIECE = 247
LOT = 1 << 19
BLOCK_BYTES = 4 << 20
SEGMENT = 1 << 20
OTHER = 1
# Fixed value: a word in lower-cased UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None):
    """Lists of the words of a text, a segment at a time."""
    data = (text or "").encode().lower()
    at = 0
    while at < len(data):
        gap = _GAP.search(data, min(len(data), at + SEGMENT))
        stop = gap.start() if gap else len(data)
        yield WORD.findall(data, at, stop)
        at = stop


class Windows:
    """The distinct windows of some items as rows of symbols, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        self.items = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.items)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            words = [w for part in words_of(text) for w in part]
            ids = [self.symbols.setdefault(w, OTHER + 1 + len(self.symbols)) for w in words]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + width]), set()).add(place[name])
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.patterns = np.zeros((len(owners), width), dtype=np.int64)
        for row, window in enumerate(owners):
            self.patterns[row, width - len(window) :] = window
        self.owner_counts = np.array([len(o) for o in owners.values()], dtype=np.int64)
        self.owner_starts = np.cumsum(self.owner_counts) - self.owner_counts
        self.owners = np.array([i for o in owners.values() for i in sorted(o)], dtype=np.int64)
        self.width = width

    @property
    def size(self) -> int:
        return OTHER + 1 + len(self.symbols)

    def encode(self, text: str | None) -> np.ndarray:
        parts = [
            np.fromiter(map(self.symbols.get, words, repeat(OTHER)), dtype=np.int32, count=len(words))
            for words in words_of(text)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count of them."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def cut(lengths: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, length) of parts of sequences: starts every ``most``, parts run on by ``overlap``."""
    counts = np.maximum(1, -(-lengths // most)) * (lengths > 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    start = expand(np.zeros(len(lengths), dtype=np.int64), counts) * most
    return owner, start, np.minimum(most + overlap, lengths[owner] - start)


def search_shard(words: np.ndarray, owner: np.ndarray, windows: Windows, depth: np.ndarray, found: set) -> None:
    """Adds the occurrences in one shard: +1 and -1 at their borders in ``depth``, (row, item) to ``found``.

    ``words`` are symbols of consecutive units; ``owner`` has (row, place of the
    unit's first word in ``depth``, length) of each.
    """
    lengths = owner[:, 2]
    unit, start, size = cut(lengths, PIECE, windows.width - 1)
    base = np.cumsum(lengths) - lengths
    source = expand(base[unit] + start, size)
    index = Index(words[source], size, windows.size)
    low, high = index.search(windows.patterns, windows.lengths)
    counts = high - low
    live = np.flatnonzero(counts)
    ends = np.cumsum(counts[live])
    first_word = np.repeat(owner[:, 1] - base, lengths) if len(live) else None
    row_of = np.repeat(owner[:, 0], lengths) if len(live) else None
    for at in range(0, int(ends[-1]) if len(live) else 0, LOT):
        lot = np.arange(at, min(at + LOT, int(ends[-1])))
        which = np.searchsorted(ends, lot, side="right")
        window = live[which]
        rows = low[window] + lot - (ends[which] - counts[window])
        place = source[index.locate(rows)]
        target = place + first_word[place]
        np.add.at(depth, target, 1)
        np.add.at(depth, target + windows.lengths[window], -1)
        pairs = np.unique(row_of[place] * len(windows.patterns) + window)
        row, window = np.divmod(pairs, len(windows.patterns))
        many = windows.owner_counts[window]
        items = windows.owners[expand(windows.owner_starts[window], many)]
        found.update(np.unique(np.repeat(row, many) * len(windows.items) + items).tolist())


def search_rows(parts: list[np.ndarray], windows: Windows) -> tuple[list[np.ndarray], list[list[str]]]:
    """For each row of symbols its merged spans (start, end in words) and the ids of the items that occur."""
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    spans: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)] * len(parts)
    items: list[list[str]] = [[] for _ in parts]
    if not len(windows.patterns) or not lengths.sum():
        return spans, items
    words = np.concatenate(parts)
    base = np.cumsum(lengths) - lengths
    row, start, size = cut(lengths, SHARD, windows.width - 1)
    depth, found = np.zeros(len(words) + 1, dtype=np.int32), set()
    shard = np.cumsum(size) // SHARD
    for number in np.unique(shard):
        mine = np.flatnonzero(shard == number)
        units = np.stack([row[mine], base[row[mine]] + start[mine], size[mine]], axis=1)
        search_shard(words[expand(units[:, 1], units[:, 2])], units, windows, depth, found)
    hit = (np.cumsum(depth[:-1]) > 0).astype(np.int8)
    # spans end with their row: a border counts as a gap
    change = np.diff(hit, prepend=0)
    begins = np.flatnonzero((change == 1) | ((hit == 1) & np.isin(np.arange(len(hit)), base[lengths > 0])))
    row_end = np.repeat(base + lengths, lengths)
    gaps = np.append(np.flatnonzero(hit == 0), len(hit))
    stops = np.minimum(gaps[np.searchsorted(gaps, begins)], row_end[begins])
    rows = np.searchsorted(base + lengths, begins, side="right")
    for r in np.unique(rows):
        mine = rows == r
        spans[r] = np.stack([begins[mine], stops[mine]], axis=1) - base[r]
    for code in sorted(found):
        items[code // len(windows.items)].append(windows.items[code % len(windows.items)])
    return spans, items


def merged(spans) -> list[dict]:
    """Spans in order, those that meet or overlap as one."""
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": int(start), "end": int(end)})
    return out


def without(text: str, spans: list[dict]) -> str:
    """The text without the spans of words; what lies between two words of a span goes with them."""
    if not spans:
        return text
    data, kept, at = text.encode(), [], 0
    places = [m.span() for m in WORD.finditer(data.lower())]
    for span in spans:
        kept.append(data[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def _pass(shared, last: bool):
    def run(batches):
        windows, rows, symbols, held = shared.value, [], [], 0
        for whole in batches:
            for batch in slices(whole):
                for row in batch.to_pylist():
                    rows.append(row)
                    symbols.append(windows.encode(row["text"]))
                    held += len(symbols[-1]) + 1
                    if held >= SHARD:
                        yield _as_batch(rows, symbols, windows, last)
                        rows, symbols, held = [], [], 0
        if rows:
            yield _as_batch(rows, symbols, windows, last)

    return run


def _as_batch(rows, symbols, windows, last) -> pa.RecordBatch:
    spans, items = search_rows(symbols, windows)
    for row, words, more, names in zip(rows, symbols, spans, items):
        row["n_words"] = len(words)
        row["spans"] = merged([(s["start"], s["end"]) for s in row["spans"] or ()] + [*map(tuple, more.tolist())])
        row["items"] = sorted({*(row["items"] or ()), *names})
        row["digest"] = hashlib.sha256(",".join(row["items"]).encode()).hexdigest() if last else None
    columns = [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", _SPANS),
               ("items", pa.list_(pa.string())), ("digest", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in columns], [n for n, _ in columns])


def blocks_of(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """Lists of (id, text) of items, of about ``most`` bytes each; the benchmark's size decides their number."""
    items = benchmark.where("text IS NOT NULL").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"
    ).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = -(-size // most) or 1
    for block in range(count):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [(r["item_id"], r["text"]) for r in mine.toLocalIterator()]


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, n_words, spans (start, end in words), items (ids, sorted), digest of the joined ids."""
    sc = docs.sparkSession.sparkContext
    shape = "doc_id bigint, text string, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, digest string"
    now = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").selectExpr(
        "*", "cast(null as array<struct<start:bigint,end:bigint>>) AS spans", "cast(null as array<string>) AS items"
    )
    blocks = [sc.broadcast(Windows(items)) for items in blocks_of(benchmark, block_bytes)]
    for i, shared in enumerate(blocks):
        now = now.mapInArrow(_pass(shared, i == len(blocks) - 1), shape)
        if i < len(blocks) - 1:
            now = now.select("doc_id", "text", "spans", "items")
    return now


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text without the words inside benchmark windows."""
    return find(docs, benchmark).select("doc_id", F.pandas_udf(_cleaned, "string")("text", "spans").alias("text"))


def _cleaned(texts, spans):
    import pandas as pd

    return pd.Series([None if t is None else without(t, list(s)) for t, s in zip(texts, spans)], dtype=object)


def report(found: DataFrame) -> DataFrame:
    """Per document: words, words inside windows, items, digest of their ids, verdict."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.col("digest").alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )
