"""Token files: the ids of all documents in order of doc_id, as coded segments in a table of Parquet files.

Documents are brought into order by one shuffle on ranges of doc_id; each
partition writes its stream of ids, each document closed by an end id, as rows
(part, segment, start, n_ids, documents, blob). ``blob`` is a segment of
``coder``; ``documents`` lists the documents with ids in it, so every row can
be read by itself and in any order, from any store that Spark reads.

Defined results: a null text counts as empty and gives the end id alone; rows
of equal doc_id are ordered by text and stay documents of their own; null ids
come first; an empty table writes no segment and reads as no document; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm import coder, tokens
from postlens.llm.tables import stored

END_ID = 1
SEGMENT = coder.LANES * coder.BLOCK

FILES = (
    "part bigint, segment bigint, start bigint, n_ids bigint, "
    "documents array<struct<doc_id:bigint,number:bigint,offset:bigint,first:boolean,last:boolean>>, blob binary"
)
PIECES = (
    "part bigint, number bigint, doc_id bigint, segment bigint, start bigint, first boolean, last boolean, ids binary"
)
_DOCUMENT = pa.struct(
    [("doc_id", pa.int64()), ("number", pa.int64()), ("offset", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_())]
)


class Segments:
    """Cuts a stream of documents into segments: (start, documents, ids). Only documents above a segment's size are cut."""

    def __init__(self, size: int = SEGMENT):
        self.size, self.start, self.number = size, 0, 0
        self.held: list[bytes] = []
        self.documents: list[dict] = []
        self.length = 0

    def add(self, doc_id: int | None, ids: bytes):
        at, total = 0, len(ids) // 4
        if self.length + total > self.size:
            yield from self.flush()
        while at < total:
            taken = min(total - at, self.size - self.length)
            self.documents.append(
                {"doc_id": doc_id, "number": self.number, "offset": self.length, "first": at == 0, "last": at + taken == total}
            )
            self.held.append(ids[4 * at : 4 * (at + taken)])
            self.length += taken
            at += taken
            if self.length == self.size:
                yield from self.flush()
        self.number += 1

    def flush(self):
        if self.length:
            yield self.start, self.documents, np.frombuffer(b"".join(self.held), dtype="<u4")
            self.start += self.length
            self.held, self.documents, self.length = [], [], 0


def write(docs: DataFrame, vocabulary: str, end_id: int = END_ID, partitions: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """Writes docs(doc_id, text) as token files in the shared folder and returns the table, read back."""
    count = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches):
        from pyspark import TaskContext

        from postlens.llm.tables import slices

        part, number = TaskContext.get().partitionId(), 0
        encode, cutter = tokens.encoder(vocabulary), Segments(segment)
        end = np.array([end_id], dtype="<u4").tobytes()

        def segments():
            for whole in batches:
                for batch in slices(whole):
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        yield from cutter.add(doc_id, encode.ids(text or "") + end)
            yield from cutter.flush()

        for start, documents, ids in segments():
            columns = [[part], [number], [start], [len(ids)], [documents], [coder.encode(ids)]]
            kinds = [pa.int64()] * 4 + [pa.list_(_DOCUMENT), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "segment", "start", "n_ids", "documents", "blob"]
            )
            number += 1

    ordered = docs.select("doc_id", "text").repartitionByRange(count, F.asc_nulls_first("doc_id"))
    return stored(ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text").mapInArrow(task, FILES), "token-files")


def read_pieces(files: DataFrame) -> DataFrame:
    """The documents' ids from the files, a row for each document and segment; checksums are verified."""

    def task(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                ids = coder.decode(row["blob"].as_py())
                documents = row["documents"].as_py()
                borders = [d["offset"] for d in documents] + [len(ids)]
                n, start = len(documents), row["start"].as_py()
                columns = [
                    pa.array([row["part"].as_py()] * n, pa.int64()),
                    *(pa.array([d[name] for d in documents], pa.int64()) for name in ("number", "doc_id")),
                    pa.array([row["segment"].as_py()] * n, pa.int64()),
                    pa.array([start + d["offset"] for d in documents], pa.int64()),
                    *(pa.array([d[name] for d in documents], pa.bool_()) for name in ("first", "last")),
                    pa.array([ids[a:b].tobytes() for a, b in zip(borders, borders[1:])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in PIECES.split(", ")])

    return files.select("part", "segment", "start", "documents", "blob").mapInArrow(task, PIECES)


def bases(files: DataFrame) -> DataFrame:
    """(of_part, base): ids in all parts before each; one row a part."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("ids_in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("part").alias("of_part"), F.coalesce(F.sum("ids_in_part").over(before), F.lit(0)).alias("base"))


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids): each document's ids as little-endian 32-bit integers and the number of ids before it.

    Only documents larger than a segment are put together by a shuffle. The
    parts' bases (a row a part) are broadcast.
    """
    is_cut = F.exists("documents", lambda d: ~(d["first"] & d["last"]))
    whole = read_pieces(files).where("first AND last").select("part", "doc_id", "start", "ids")
    split = (
        read_pieces(files.where(is_cut))
        .where("NOT (first AND last)")
        .groupBy("part", "number")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.array_sort(F.collect_list(F.struct("segment", "ids"))).alias("parts"),
        )
        .select("part", "doc_id", "start", F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"])).alias("ids"))
    )
    parts = F.broadcast(bases(files))
    rows = whole.unionByName(split).join(parts, F.col("part") == F.col("of_part"))
    return rows.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "ids")
