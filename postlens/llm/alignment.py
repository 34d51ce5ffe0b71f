"""Cross-tokenizer alignment: which ids of two vocabularies stand for the same bytes, counted by inverted pair bitmaps.

A text is encoded by A (byte-level pairs, of space + text) and by B (pieces,
which add the space themselves). The bytes where tokens of both end cut the
text into groups; an A token and a B token of one group are linked. Documents
are gathered into blocks where they lie. A block inverts its links: each id
pair has one compressed bitmap of documents for each binary digit of its
multiplicity (a sorted list of 16-bit places, or a bitset where that is
shorter). The OR of a pair's digit planes is its set of documents: popcounts
added over blocks give document counts, popcounts weighted by the digit give
link counts. The counts then return to the blocks, and each block's postings
add them up for its documents.

Both vocabularies never join a character other than white space to a space or
line end after it (checked when they are loaded), so texts are cut there into
chunks, and a chunk that comes again is encoded and aligned once.

Defined results: a null or empty text, or one whose joined bytes by A or by B
differ from space + text, has no tokens: zeros and an empty digest. Repeated
rows are documents of their own, null ids are kept, other columns ignored.
Texts of any length are encoded whole; memory follows the longest text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postlens.llm.decontaminate import expand
from postlens.llm.tables import slices, stored
from postlens.llm.tokens import byte_alphabet

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:\s+\Z)?|\s+\Z")
# Fixed value: how the vocabulary of byte-level pairs cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Control characters that may count as white space in one library and not in the other.
_UNSURE = re.compile("[\x00\x1c-\x1f\x85]")
CACHED = 400_000
LOT = 1 << 16
PLACE_BITS = 14
BLOCK_CHUNKS = 1 << 20
WIDE = 1 << 14
SHIFT = 20
_TABLE = (
    "block bigint, place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pair bigint, plane int, dense boolean, docs binary, ones bigint, n_docs bigint"
)


class Tokens:
    """Both vocabularies: ids of chunks, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        bytes_of = {c: b for b, c in byte_alphabet().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes([bytes_of[c] for c in token])
        model = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        byte = model.SentencePiece.BYTE
        self.b_bytes = [bytes([int(p[3:5], 16)]) if k == byte else p.replace("▁", " ").encode() for p, k in zip(pieces, kinds)]
        spec = json.loads(self.a.to_str())
        self.chunked = (
            spec["normalizer"] is None
            and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and model.normalizer_spec.name == "identity"
            and not model.normalizer_spec.remove_extra_whitespaces
            and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        )
        ordered = spec["model"]["type"] == "BPE" and all(
            vocabulary.get("".join(m)) == 256 + i for i, m in enumerate(spec["model"]["merges"])
        )
        # Where merges come in the order of ids, merging by ranks is the same; its patterns agree on Latin-1.
        ranks = {t: i for i, t in enumerate(self.a_bytes)}
        self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered and self.chunked else None
        # The space is part of the chunks here, so B must not add one more.
        model.normalizer_spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.a_sizes = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(" " + text) if self.chunked else [" " + text]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, tuple, tuple]:
        """(numbers of the chunks whose bytes agree, their ids by A, by B): ids end to end, and how many each chunk has."""
        a, b = self._encode_a(chunks), self.b.encode(chunks, num_threads=1)
        good = [i for i, chunk in enumerate(chunks) if a[i] and self._same(chunk, a[i], b[i])]
        return np.array(good, dtype=np.int64), _flat([a[i] for i in good]), _flat([b[i] for i in good])

    def _encode_a(self, chunks: list[str]) -> list[list[int]]:
        """Latin-1 chunks by ranks, all others (and all, where ids aren't ranks) by the library of the vocabulary."""
        ids: list[list[int]] = [[]] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if self.ranks and max(c) < "\u0100" and not c[-1].isspace() and not _UNSURE.search(c)]
        # A chunk starts with white space after a character that isn't, so chunks end to end are cut as they are alone.
        found = self.ranks.encode_ordinary("".join([chunks[i] for i in plain])) if plain else []
        ends = np.cumsum(self.a_sizes[np.array(found, dtype=np.int64)])
        stops = np.searchsorted(ends, np.cumsum([len(chunks[i].encode()) for i in plain]), side="right").tolist()
        for i, low, high in zip(plain, [0, *stops], stops):
            ids[i] = found[low:high]
        done = set(plain)
        for i, chunk in enumerate(chunks):
            if i not in done:
                ids[i] = self.a.encode(chunk, add_special_tokens=False).ids
        return ids

    def _same(self, chunk: str, a: list[int], b: list[int]) -> bool:
        data = chunk.encode()
        return b"".join([self.a_bytes[i] for i in a]) == data and b"".join([self.b_bytes[i] for i in b]) == data


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(chain.from_iterable(lists)), dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64)


@functools.lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


class Aligner:
    """Chunks met so far, numbered: their counts, group texts, and linked pairs with multiplicities (end to end)."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.number: dict[str, int] = {}
        self.shown: list[bytes | None] = []  # None: the bytes differ
        self.counts = np.zeros((0, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links
        self.pair_starts = np.zeros(1, dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.times = np.zeros(0, dtype=np.int64)

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        fresh = list(dict.fromkeys(c for chunks in texts for c in chunks if c not in self.number))
        for at in range(0, len(fresh), LOT):
            self._learn(fresh[at : at + LOT])
        return [[self.number[c] for c in chunks] for chunks in texts]

    def _learn(self, fresh: list[str]) -> None:
        good, a, b = self.tokens.encode(fresh)
        self.number.update(zip(fresh, range(len(self.shown), len(self.shown) + len(fresh))))
        counts = np.zeros((len(fresh), 4), dtype=np.int64)
        sizes = np.zeros(len(fresh), dtype=np.int64)
        shown: list[bytes | None] = [None] * len(fresh)
        if len(good):
            known = aligned(a, b, self.tokens)
            counts[good], sizes[good] = known.counts, known.sizes
            for chunk, text in zip(good.tolist(), known.shown):
                shown[chunk] = text
            self.pairs = np.append(self.pairs, known.pairs)
            self.times = np.append(self.times, known.times)
        self.shown += shown
        self.counts = np.concatenate([self.counts, counts])
        self.pair_starts = np.append(self.pair_starts, self.pair_starts[-1] + np.cumsum(sizes))


@dataclass
class Aligned:
    """For some chunks: counts, texts, and their linked pairs with multiplicities, ``sizes`` of them each."""

    counts: np.ndarray
    shown: list[bytes]
    pairs: np.ndarray
    times: np.ndarray
    sizes: np.ndarray


def aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], tokens: Tokens) -> Aligned:
    """Aligns chunks given as (ids end to end, ids of each chunk) by A and by B with the same bytes."""
    (a_ids, n_a), (b_ids, n_b) = a, b
    a_ends, b_ends = np.cumsum(tokens.a_sizes[a_ids]), np.cumsum(tokens.b_sizes[b_ids])
    # A chunk's end is an end of both, so no group passes it.
    common = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
    a_stop, b_stop = np.searchsorted(a_ends, common, side="right"), np.searchsorted(b_ends, common, side="right")
    in_a, in_b = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    groups = np.diff(np.searchsorted(a_stop, np.cumsum(n_a), side="right"), prepend=0)
    chunk = np.repeat(np.arange(len(n_a)), groups)
    links = np.zeros(len(n_a), dtype=np.int64)
    np.add.at(links, chunk, in_a * in_b)
    narrow = np.flatnonzero(in_a * in_b <= WIDE)
    owner, pair, times = [], [], []
    for low in range(0, len(narrow), LOT):
        mine = narrow[low : low + LOT]
        x, y = in_a[mine], in_b[mine]
        each_a = expand(a_stop[mine] - x, x)
        many = np.repeat(y, x)
        left = np.repeat(a_ids[each_a], many)
        right = b_ids[expand(np.repeat(b_stop[mine] - y, x), many)]
        owner.append(np.repeat(chunk[mine], x * y))
        pair.append(left << SHIFT | right)
        times.append(np.ones(len(left), dtype=np.int64))
    for g in np.flatnonzero(in_a * in_b > WIDE).tolist():  # few ids come again and again there
        left, left_times = np.unique(a_ids[a_stop[g] - in_a[g] : a_stop[g]], return_counts=True)
        right, right_times = np.unique(b_ids[b_stop[g] - in_b[g] : b_stop[g]], return_counts=True)
        pair.append((left[:, None] << SHIFT | right[None, :]).reshape(-1))
        times.append((left_times[:, None] * right_times[None, :]).reshape(-1))
        owner.append(np.full(len(pair[-1]), chunk[g]))
    owner, pair, times = np.concatenate(owner), np.concatenate(pair), np.concatenate(times)
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
    sizes = np.bincount(owner[first], minlength=len(n_a))
    shown = texts_of(a_ids, a_stop, b_ids, b_stop, np.cumsum(groups))
    return Aligned(np.stack([n_a, n_b, groups, links], axis=1), shown, pair[first], np.add.reduceat(times, first), sizes)


def texts_of(a_ids, a_stop, b_ids, b_stop, chunk_stop) -> list[bytes]:
    """The groups of each chunk as ``a1,a2|b1;a3|b2``: decimal digits of all ids at once, then one mark after each."""
    total = len(a_ids) + len(b_ids)
    in_a, in_b = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    begin = a_stop - in_a + b_stop - in_b
    ids, marks = np.empty(total, dtype=np.int64), np.full(total, ord(","), dtype=np.uint8)
    ids[expand(begin, in_a)] = a_ids
    ids[expand(begin + in_a, in_b)] = b_ids
    marks[begin + in_a - 1] = ord("|")
    marks[begin + in_a + in_b - 1] = ord(";")
    width = max(1, len(str(int(ids.max()))))
    digits = np.empty((total, width + 1), dtype=np.uint8)
    keep = np.ones((total, width + 1), dtype=bool)
    for place in range(width):
        high = ids // 10 ** (width - 1 - place)
        digits[:, place] = high % 10 + ord("0")
        keep[:, place] = high > 0
    keep[:, width - 1] = True
    digits[:, width] = marks
    ends = np.cumsum(keep.sum(axis=1))[(begin + in_a + in_b - 1)[chunk_stop - 1]].tolist()
    data = digits[keep].tobytes()
    return [data[low : high - 1] for low, high in zip([0, *ends], ends)]


def containers(places: np.ndarray, ends: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
    """Compressed bitmaps of the rising places between ends: (their bytes, whether each is a bitset of ``size`` bits)."""
    starts = np.append(0, ends[:-1])
    counts = ends - starts
    width = -(-size // 8)
    dense = counts * 2 > width
    lengths = np.where(dense, width, counts * 2)
    offsets = np.append(0, np.cumsum(lengths))
    data = np.zeros(int(offsets[-1]), dtype=np.uint8)
    light = np.repeat(~dense, counts)
    target = expand(offsets[:-1][~dense], lengths[~dense])
    data[target] = places[light].astype("<u2").view(np.uint8)
    where = np.flatnonzero(dense)
    for at in range(0, len(where), 1024):
        lot = where[at : at + 1024]
        bits = np.zeros((len(lot), width * 8), dtype=bool)
        bits[np.repeat(np.arange(len(lot)), counts[lot]), places[expand(starts[lot], counts[lot])]] = True
        data[expand(offsets[lot], lengths[lot])] = np.packbits(bits, axis=1, bitorder="little").reshape(-1)
    kind = pa.binary()
    buffers = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(kind, len(ends), buffers), dense


def opened(docs: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bitmap, place) for every bit set."""
    docs = docs.combine_chunks() if isinstance(docs, pa.ChunkedArray) else docs
    offsets = np.frombuffer(docs.buffers()[1], dtype=np.int32, count=len(docs) + 1 + docs.offset)[docs.offset :].astype(np.int64)
    data = np.frombuffer(docs.buffers()[2], dtype=np.uint8) if docs.buffers()[2] else np.zeros(0, dtype=np.uint8)
    lengths = np.diff(offsets)
    light = np.flatnonzero(~dense)
    rows, places = [np.repeat(light, lengths[light] // 2)], [data[expand(offsets[light], lengths[light])].view("<u2").astype(np.int64)]
    where = np.flatnonzero(dense)
    for at in range(0, len(where), 1024):
        lot = where[at : at + 1024]
        width = int(lengths[lot[0]])
        bits = np.unpackbits(data[expand(offsets[lot], lengths[lot])].reshape(len(lot), width), axis=1, bitorder="little")
        row, place = np.nonzero(bits)
        rows.append(lot[row])
        places.append(place)
    return np.concatenate(rows), np.concatenate(places)


def postings(documents: list[np.ndarray], aligner: Aligner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place of the document, multiplicity), sorted by pair and place, of documents given as chunk numbers."""
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    chunk = np.concatenate(documents) if len(documents) else np.zeros(0, dtype=np.int64)
    place = np.repeat(np.arange(len(documents)), lengths)
    keys, uses = np.unique(place << 32 | chunk, return_counts=True)
    place, chunk = keys >> 32, keys & 0xFFFFFFFF
    counts = aligner.pair_starts[chunk + 1] - aligner.pair_starts[chunk]
    at = expand(aligner.pair_starts[chunk], counts)
    keys = aligner.pairs[at] << PLACE_BITS | np.repeat(place, counts)
    order = np.argsort(keys)
    keys, weight = keys[order], (aligner.times[at] * np.repeat(uses, counts))[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.add.reduceat(weight, first) if len(first) else weight
    return keys[first] >> PLACE_BITS, keys[first] & ((1 << PLACE_BITS) - 1), times


def planes(pair: np.ndarray, place: np.ndarray, times: np.ndarray, size: int) -> list[tuple]:
    """One row for each pair and digit of its multiplicities: the bitmap of documents whose count has that digit."""
    parts = []
    begin = np.flatnonzero(np.diff(pair, prepend=-1))
    n_docs = np.diff(np.append(begin, len(pair)))  # the popcount of the OR of the pair's planes
    number = np.repeat(np.arange(len(begin)), n_docs)
    told = np.zeros(len(begin), dtype=bool)
    for plane in range(int(times.max(initial=0)).bit_length()):
        mine = np.flatnonzero(times >> plane & 1)
        if not len(mine):
            continue
        first = np.flatnonzero(np.diff(number[mine], prepend=-1))
        docs, dense = containers(place[mine], np.append(first[1:], len(mine)), size)
        which = number[mine][first]
        count = np.where(told[which], 0, n_docs[which])
        told[which] = True
        ones = np.diff(np.append(first, len(mine)))
        parts.append((pair[begin][which], np.full(len(first), plane), dense, docs, ones, count))
    return parts


class Block:
    """Documents of one block: their rows, and the chunks they consist of."""

    def __init__(self, aligner: Aligner, number: int):
        self.aligner, self.number = aligner, number
        self.rows: list[tuple] = []
        self.documents: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        cut = [self.aligner.tokens.chunks(t) if t else [] for t in texts]
        for doc, chunks in zip(ids, self.aligner.numbers(cut)):
            numbers = np.array(chunks, dtype=np.int64)
            self.held += len(chunks) + 1
            shown = [self.aligner.shown[c] for c in chunks]
            if not chunks or None in shown:
                self.rows.append((doc, 0, 0, 0, 0, ""))
                self.documents.append(numbers[:0])
                continue
            n = self.aligner.counts[numbers].sum(axis=0).tolist()
            self.rows.append((doc, *n, hashlib.sha256(b";".join(shown)).hexdigest()))
            self.documents.append(numbers)

    def batches(self):
        names = [part.split()[0] for part in _TABLE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
        n = len(self.rows)
        columns = [pa.array([r[i] for r in self.rows], kinds[2 + i]) for i in range(6)]
        head = [pa.array([self.number] * n, kinds[0]), pa.array(range(n), kinds[1]), *columns]
        yield pa.RecordBatch.from_arrays(head + [pa.nulls(n, k) for k in kinds[8:]], names)
        for pair, plane, dense, docs, *numbers in planes(*postings(self.documents, self.aligner), n):
            m = len(pair)
            tail = [pa.array(pair), pa.array(plane, pa.int32()), pa.array(dense), docs, *map(pa.array, numbers)]
            whole = pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, self.number)), *[pa.nulls(m, k) for k in kinds[1:8]], *tail], names
            )
            yield from slices(whole)


_KEPT: list[Aligner] = []


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner: it outlives blocks and tasks and starts anew once it knows ``CACHED`` chunks."""
    tokens = vocabularies(a_path, b_path)
    if not _KEPT or _KEPT[0].tokens is not tokens or len(_KEPT[0].shown) >= CACHED:
        _KEPT[:] = [Aligner(tokens)]
    return _KEPT[0]


def _inverted(a_path: str, b_path: str):
    def run(batches):
        number = TaskContext.get().partitionId() << 24
        block = Block(aligner_of(a_path, b_path), number)
        for whole in batches:
            for piece in slices(whole, 1 << 20):
                for at in range(0, piece.num_rows, 1 << 10):
                    batch = piece.slice(at, 1 << 10)
                    if len(block.rows) + batch.num_rows > 1 << PLACE_BITS or block.held >= BLOCK_CHUNKS:
                        yield from block.batches()
                        number += 1
                        block = Block(aligner_of(a_path, b_path), number)
                    block.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if block.rows:
            yield from block.batches()

    return run


def inverted(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The stored table of documents and of their blocks' pair bitmaps (rows with a pair)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_inverted(a_path, b_path), _TABLE), "pair-bitmaps")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, a, b, n_docs (documents that hold the pair linked), n_links, top (n_docs is the highest of its A id)."""
    links = F.sum(F.col("ones") * F.pow(F.lit(2), F.col("plane")).cast("bigint")).alias("n_links")
    counts = table.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), links)
    counts = counts.withColumn("a", F.shiftright("pair", SHIFT))
    # At most one row for each A id, and their number is that of the vocabulary.
    best = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(best), "a").select(
        "pair", "a", F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b"), "n_docs", "n_links",
        (F.col("n_docs") == F.col("most")).alias("top"),
    )


def _returned(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Adds the scores of a block's pairs to its documents."""
    block = key[0].as_py()
    plane = np.asarray(table.column("plane")).astype(np.int64)
    dense = np.asarray(table.column("dense"))
    row, place = opened(table.column("docs"), dense)
    size = int(place.max(initial=-1)) + 1
    weight = np.left_shift(np.int64(1), plane)
    total, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    np.add.at(total, place, (weight * np.asarray(table.column("score")))[row])
    np.add.at(best, place, (weight * np.asarray(table.column("top")))[row])
    return pa.table(
        {
            "block": pa.array(np.full(size, block)),
            "place": pa.array(np.arange(size, dtype=np.int32)),
            "n_best": pa.array(best),
            "count_sum": pa.array(total),
        }
    )


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the module)."""
    table = inverted(docs, a_path, b_path)
    scores = pair_counts(table).select("pair", F.col("n_docs").alias("score"), "top")
    postings = table.where("pair IS NOT NULL").select("block", "pair", "plane", "dense", "docs")
    scored = postings.join(scores, "pair").select("block", "plane", "dense", "docs", "score", "top")
    returned = scored.groupBy("block").applyInArrow(_returned, "block bigint, place int, n_best bigint, count_sum bigint")
    rows = table.where("pair IS NULL").select(
        "block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"
    )
    return rows.join(returned, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0).cast("bigint")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("bigint")).alias("count_sum"), "groups_sha256",
    )
