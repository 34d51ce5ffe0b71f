"""Records of split files: CSV with quoted line breaks and JSON arrays, cut where they end, not where a split ends.

Files are read as fragments between separators (line ends, or closing braces),
a chunk being one split of a file. A first pass folds each chunk into what it
does to the state of a reader: whether it turns "inside quotes" over, and by
how much it changes the depth of brackets from either start. A running sum
over the chunks of a file (few rows) gives each chunk its true start. The
second pass cuts records inside chunks; a record that runs over a border is
put together from its pieces by their chunk numbers. No task reads more than
its split; only one record has to fit in memory.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlens.session import scratch_path, stored

# Encodings tried in order, by Python's names; the first also drops a mark at the start.
ENCODINGS = ("utf-8-sig", "cp950", "big5")
_MARK = re.compile(rb'\\.|["{}\[\]]', re.S)
_EFFECT = "file string, at bigint, lead string, odd boolean, turns boolean, depth_out bigint, depth_in bigint, " + ", ".join(
    f"bad_{i} boolean" for i in range(len(ENCODINGS))
)
MANY = 100_000
LOT, LOT_BYTES = 256, 1 << 20
_PIECE = "file string, at bigint, ord bigint, opens boolean, closes boolean, body binary"


def fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, at (start of the split), place, body (raw bytes between separators), in file order inside each task."""
    lines = spark.read.option("lineSep", separator).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("body"),
    )


# --- readers of one chunk ---------------------------------------------------------


class Quotes:
    """CSV: a line end inside quotes belongs to the record."""

    separator = b"\n"

    def effect(self, body: bytes) -> tuple[bool, int, int]:
        return body.count(b'"') % 2 == 1, 0, 0

    def pieces(self, bodies, inside: bool, depth: int):
        """(opens, closes, body) of the records of a chunk that starts in this state."""
        held: list[bytes] = []
        opens = not inside
        for body in bodies:
            held.append(body)
            inside ^= body.count(b'"') % 2 == 1
            if not inside:
                yield opens, True, self.separator.join(held)
                held, opens = [], True
        if held:
            yield opens, False, self.separator.join(held)


class Brackets:
    """An array of JSON objects: a record runs from an opening brace at depth one to the brace that closes it."""

    separator = b"}"

    @staticmethod
    def _marks(body: bytes):
        """Quotes and brackets of a fragment in order, without escaped ones."""
        for mark in _MARK.finditer(body):
            c = body[mark.start()]
            if c != 0x5C:
                yield mark.start(), c

    def effect(self, body: bytes) -> tuple[bool, int, int]:
        quoted, depth = False, [0, 0]
        for _, c in self._marks(body):
            if c == 0x22:
                quoted = not quoted
            else:
                depth[quoted] += 1 if c in b"{[" else -1
        # The separator after the fragment closes a brace, unless it stands inside quotes.
        depth[quoted] -= 1
        return quoted, depth[0], depth[1]

    def pieces(self, bodies, inside: bool, depth: int):
        held: list[bytes] = []
        opens, going = False, depth >= 2
        for body in bodies:
            start = 0
            for at, c in self._marks(body):
                if c == 0x22:
                    inside = not inside
                elif not inside:
                    if c == 0x7B and depth == 1 and not going:
                        start, going, opens = at, True, True
                    depth += 1 if c in b"{[" else -1
            if not inside:
                depth -= 1
            if going:
                held.append(body[start:] + self.separator)
                if not inside and depth == 1:
                    yield opens, True, b"".join(held)
                    held, opens, going = [], False, False
        if held:
            yield opens, False, b"".join(held)


# --- passes ---------------------------------------------------------------------


def _rows(batches, names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of a task, a few at a time as Python objects, whatever the size of a batch."""
    for batch in batches:
        columns = batch.select(list(names))
        for start in range(0, batch.num_rows, LOT):
            yield from zip(*[c.to_pylist() for c in columns.slice(start, LOT).columns])


def _lots(rows: Iterator[tuple], names: list[str], kinds: list, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``LOT_BYTES``, so that a task holds no more of its output."""
    while True:
        held, full = [], 0
        for row in rows:
            held.append(row)
            full += size(row)
            if full >= LOT_BYTES or len(held) >= 1 << 14:
                break
        if not held:
            return
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _effects(reader):
    """What the chunks in a task do to the state, and which encodings cannot decode them (a fragment is whole characters)."""

    def run(batches):
        totals: dict[tuple, list] = {}
        for file, at, body in _rows(batches, ("file", "at", "body")):
            if (file, at) not in totals:
                lead = body.removeprefix(codecs.BOM_UTF8).lstrip()[:1].decode("latin-1")
                totals[file, at] = [False, 0, 0, *[False] * len(ENCODINGS), lead, False]
            total = totals[file, at]
            turns, out, quoted = reader.effect(body)
            total[-1] |= turns
            # Depth changes seen from a start outside and inside quotes; a turn swaps which one counts next.
            first, second = (quoted, out) if total[0] else (out, quoted)
            total[1], total[2] = total[1] + first, total[2] + second
            total[0] ^= turns
            if not body.isascii():
                for i, name in enumerate(ENCODINGS):
                    if not total[3 + i]:
                        try:
                            body.decode(name)
                        except UnicodeDecodeError:
                            total[3 + i] = True
        rows = [(*key, *total[-2:], *total[:-2]) for key, total in totals.items()]
        if rows:
            names = [part.split()[0] for part in _EFFECT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return run


def _cut(reader):
    """The pieces of the chunks of a task, given out as they are found; a task may hold several chunks, and a chunk several batches."""
    names = [p.split()[0] for p in _PIECE.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def pieces(batches):
        rows = _rows(batches, ("file", "at", "inside", "depth", "body"))
        for (file, at, inside, depth), chunk in groupby(rows, lambda row: row[:4]):
            for n, piece in enumerate(reader.pieces((row[4] for row in chunk), inside, depth)):
                yield file, at, n, *piece

    return lambda batches: _lots(pieces(batches), names, kinds, lambda row: len(row[5]))


def starts(effects: DataFrame) -> DataFrame:
    """file, at, inside, depth: the state in which each chunk starts. One row a chunk, in order within a file."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1
    known = effects.withColumn("inside", turned)
    change = F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out"))
    depth = F.coalesce(F.sum("change").over(before), F.lit(0))
    return known.withColumn("change", change).withColumn("depth", depth).select("file", "at", "inside", "depth")


def encodings(effects: DataFrame) -> DataFrame:
    """file, encoding: the first one that decodes all of a file; null where none does."""
    bad = effects.groupBy("file").agg(*[F.bool_or(f"bad_{i}").alias(f"bad_{i}") for i in range(len(ENCODINGS))])
    choice = F.lit(None).cast("string")
    for i in reversed(range(len(ENCODINGS))):
        choice = F.when(~F.col(f"bad_{i}"), F.lit(ENCODINGS[i])).otherwise(choice)
    return bad.select("file", choice.alias("encoding"))


def chunk_effects(spark: SparkSession, path: str, reader) -> DataFrame:
    """One row a chunk: its first mark, whether a fragment turns quotes over, its effect, encodings that fail."""
    raw = fragments(spark, path, reader.separator.decode()).select("file", "at", "body")
    return stored(raw.mapInArrow(_effects(reader), _EFFECT), "chunk-effects")


def cut_records(spark: SparkSession, path: str, reader, effects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, at, ord, body: whole records as raw bytes in their files' order; file, encoding)."""
    raw = fragments(spark, path, reader.separator.decode())
    effects = chunk_effects(spark, path, reader) if effects is None else effects
    # One row a chunk.
    if effects.count() <= MANY:
        located = raw.join(F.broadcast(starts(effects)), ["file", "at"])
    else:
        located = raw.join(starts(effects), ["file", "at"]).sortWithinPartitions("file", "at", "place")
    pieces = stored(located.mapInArrow(_cut(reader), _PIECE), "record-pieces")
    whole = pieces.where("opens AND closes").select("file", "at", "ord", "body")
    # Pieces over borders: at most two a chunk. Each goes to the last piece before it that opens a record.
    torn = pieces.where("NOT opens OR NOT closes")
    order = Window.partitionBy("file").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0)
    torn = torn.withColumn("number", F.sum(F.col("opens").cast("int")).over(order)).where("number > 0")
    parts = F.array_sort(F.collect_list(F.struct("at", "ord", "body")))
    glue = F.unhex(F.lit(reader.separator.hex())) if isinstance(reader, Quotes) else F.unhex(F.lit(""))
    joined = F.aggregate(
        F.slice("parts", 2, 1 << 30), F.get("parts", F.lit(0))["body"], lambda a, p: F.concat(a, glue, p["body"])
    )
    mended = torn.groupBy("file", "number").agg(parts.alias("parts"), F.bool_or("closes").alias("closed"))
    first = F.get("parts", F.lit(0))
    mended = mended.where("closed" if isinstance(reader, Brackets) else "true")
    mended = mended.select("file", first["at"].alias("at"), first["ord"].alias("ord"), joined.alias("body"))
    return whole.unionByName(mended), encodings(effects)


def _decoded(batches):
    def texts():
        for file, at, ord_, body, encoding in _rows(batches, ("file", "at", "ord", "body", "encoding")):
            text = body.decode("utf-8" if encoding == "utf-8-sig" and (at or ord_) else encoding)
            yield file, at, ord_, text[:-1] if text.endswith("\r") else text

    yield from _lots(texts(), ["file", "at", "ord", "record"], [pa.string(), pa.int64(), pa.int64(), pa.string()], lambda row: len(row[3]))


def text_records(spark: SparkSession, path: str, reader, effects: DataFrame | None = None) -> DataFrame:
    """file, at, ord, record: decoded with each file's own encoding; a file that none decodes is an error."""
    records, names = cut_records(spark, path, reader, effects)
    names = stored(names, "encodings")
    lost = names.where("encoding IS NULL").select("file").limit(3).collect()
    if lost:
        raise ValueError(f"could not decode {', '.join(r['file'] for r in lost)} with {', '.join(ENCODINGS)}")
    # One row a file.
    with_names = records.join(F.broadcast(names) if names.count() <= MANY else names, "file")
    return with_names.select("file", "at", "ord", "body", "encoding").mapInArrow(_decoded, "file string, at bigint, ord bigint, record string")


def split_csv(spark: SparkSession, path: str, effects: DataFrame | None = None) -> DataFrame:
    """Columns of CSV files with a header each: quoted line breaks, splits and one encoding a file. All strings.

    Every file's first record is its header and has to name the same columns;
    empty lines are skipped; missing fields are null and surplus ones dropped.
    """
    records = stored(text_records(spark, path, Quotes(), effects).where("record <> ''"), "csv-records")
    heads = records.groupBy("file").agg(F.min_by("record", F.struct("at", "ord")).alias("head"), F.min(F.struct("at", "ord")).alias("first"))
    some = heads.select("head").distinct().limit(2).collect()
    if len(some) > 1:
        raise ValueError("the files have different headers")
    if not some:
        return spark.createDataFrame([], "value string").limit(0)
    names = next(csv.reader(io.StringIO(some[0]["head"], newline="")))
    columns = {f"c{i}": name for i, name in enumerate(names)}
    schema = ", ".join(f"{c} string" for c in columns)
    rows = records.join(F.broadcast(heads.select("file", "first")) if heads.count() <= MANY else heads, "file")
    rows = rows.where((F.col("at") != F.col("first.at")) | (F.col("ord") != F.col("first.ord")))
    parsed = rows.select(F.from_csv("record", schema, {"quote": '"', "escape": '"', "multiLine": "true"}).alias("row"))
    return parsed.select(*[F.col(f"row.{c}").alias(name) for c, name in columns.items()])


def split_json(spark: SparkSession, path: str, effects: DataFrame | None = None) -> DataFrame:
    """Records of UTF-8 files that each hold one JSON array of objects, values as Spark infers them (primitives as strings)."""
    records = text_records(spark, path, Brackets(), effects)
    lines = scratch_path(spark, "json-lines")
    # A line end between tokens is white space; inside a string JSON has none.
    records.select(F.regexp_replace("record", "[\\r\\n]+", " ").alias("value")).write.text(lines)
    return spark.read.option("primitivesAsString", True).json(lines)


def sha256_of(spark: SparkSession, path: str, block: int = 1 << 16) -> DataFrame:
    """path, length, sha256 of files of any size: a file a task, ``block`` bytes at a time through Arrow's file systems.

    A store that Arrow does not open (see ``streams``) is read by Spark's
    binaryFile source, whose files end at 2 GB.
    """
    listed = spark.read.format("binaryFile").load(path)
    files = listed.select("path", "length")
    first = files.limit(1).collect()
    if first and not streams(first[0]["path"]):
        return listed.select("path", "length", F.sha2("content", 256).alias("sha256"))
    many = max(1, min(files.count(), 10_000))
    return files.repartition(many, "path").mapInArrow(_digests(block), "path string, length bigint, sha256 string")


def streams(uri: str) -> bool:
    """Whether Arrow has a file system for this address."""
    try:
        _opened(uri).close()
    except (OSError, pa.ArrowInvalid, NotImplementedError):
        return False
    return True


def _opened(uri: str):
    from urllib.parse import unquote

    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + unquote(uri.removeprefix("file:")).lstrip("/"), compression=None)
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)


def _digests(block: int) -> Callable:
    def run(batches):
        import hashlib

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                digest, length = hashlib.sha256(), 0
                with _opened(uri) as stream:
                    while part := stream.read(block):
                        digest.update(part)
                        length += len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri]), pa.array([length]), pa.array([digest.hexdigest()])], ["path", "length", "sha256"]
                )

    return run
