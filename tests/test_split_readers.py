"""Readers of split files against readers that take a file whole."""

import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from postlens.sources import readers, records


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def csv_file(path, rows, encoding="utf-8", end="\r\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quoted_breaks_at_every_offset(spark, tmp_path, tiny_splits):
    rng = random.Random(4)
    for pad in (0, 17, 52, 113):
        folder = tmp_path / f"t{pad}"
        folder.mkdir()
        rows = [["id", "body", "n"], ["x" * pad, "one\ntwo, \"three\"\n\n\nfour", "1"]]
        for i in range(14):
            body = rng.choice(["plain", "a\nb", 'say ""\n', "", ",", "\n", "long " * 40 + "\n" + "tail " * 30, 'q"q'])
            rows.append([str(i), body, rng.choice(["", "7"])])
        csv_file(folder / "a.csv", rows, end=rng.choice(["\n", "\r\n"]))
        whole = readers.read_csv(spark, str(folder), "UTF-8", multiline=True)
        split = readers.read_csv(spark, str(folder))
        assert split.columns == whole.columns and rows_of(split) == rows_of(whole)


def test_largest_task_is_bounded_by_the_split(spark, tmp_path, tiny_splits):
    csv_file(tmp_path / "a.csv", [["id", "body"], *[[str(i), f"line {i}\nnext"] for i in range(600)]])
    raw = records.fragments(spark, str(tmp_path), "\n")
    bytes_of = raw.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("body") + 1).alias("n")).collect()
    assert len(bytes_of) > 30 and max(r["n"] for r in bytes_of) < 450
    assert readers.read_csv(spark, str(tmp_path)).count() == 600


def test_one_encoding_a_file(spark, tmp_path, tiny_splits):
    rows = [["id", "text"], ["1", "颱風來了"], ["2", "加油\n台灣"]]
    for name in ("utf-8", "utf-8-sig", "cp950", "big5"):
        csv_file(tmp_path / f"{name}.csv", [rows[0], *[[f"{name}{i}", t] for i, t in rows[1:]]], name)
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    got = dict(tuple(r) for r in readers.read_csv(spark, str(tmp_path)).collect())
    assert got == {f"{n}{i}": t for n in ("utf-8", "utf-8-sig", "cp950", "big5") for i, t in rows[1:]}
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_undecodable_file_and_unlike_headers(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"id,text\n1,\xff\xff\xfe\n")
    with pytest.raises(ValueError, match="bad.csv"):
        readers.read_csv(spark, str(tmp_path)).collect()
    other = tmp_path / "two"
    other.mkdir()
    csv_file(other / "a.csv", [["id"], ["a\nb"]])
    csv_file(other / "b.csv", [["key"], ["c"]])
    with pytest.raises(ValueError, match="headers"):
        readers.read_csv(spark, str(other)).collect()


def test_header_only_and_empty_files(spark, tmp_path):
    csv_file(tmp_path / "a.csv", [["id", "te\nxt"]])
    (tmp_path / "b.csv").write_bytes(b"")
    got = readers.read_csv(spark, str(tmp_path))
    assert got.columns == ["id", "te\nxt"] and got.count() == 0


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_are_split(spark, tmp_path, tiny_splits, indent):
    rng = random.Random(indent or 1)
    texts = ["plain", 'a "quoted" }{ word', "back\\slash \\\" }", "[1, {2}]", "line\nbreak", "", "é 颱風 }", "x" * 90]
    for name in ("a", "b"):
        items = [{"id": i, "text": rng.choice(texts), "deep": {"k": [{"v": rng.choice(texts)}, {}], "n": None}} for i in range(40)]
        (tmp_path / f"{name}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=rng.random() < 0.5), encoding="utf-8")
    (tmp_path / "empty.json").write_text("[]")
    whole = readers.all_string(spark.read.option("multiLine", True).option("primitivesAsString", True).json(str(tmp_path)))
    split = readers.read_json(spark, str(tmp_path))
    assert split.columns == whole.columns
    assert rows_of(split) == rows_of(whole.where("id IS NOT NULL")) and split.count() == 80


def test_other_json_shapes_are_read_whole(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": 1, "inner": {"a": 2}}')
    assert rows_of(readers.read_json(spark, str(tmp_path))) == [("1", '{"a":"2"}')]


def test_digest_in_blocks(spark, tmp_path):
    data = random.Random(2).randbytes(300_001)
    (tmp_path / "a b.bin").write_bytes(data)
    got = {r["path"].rpartition("/")[2]: (r["length"], r["sha256"]) for r in records.sha256_of(spark, str(tmp_path), 4096).collect()}
    assert (300_001, hashlib.sha256(data).hexdigest()) in got.values()
    assert not records.streams("nosuch://host/file")


def test_digest_memory_does_not_follow_the_file(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((2 << 30) + 5)  # a sparse file above the limit of whole-file sources
    digest = hashlib.sha256()
    for _ in range(2 << 10):
        digest.update(bytes(1 << 20))
    digest.update(bytes(5))
    row = records.sha256_of(spark, str(tmp_path)).first()
    assert (row["length"], row["sha256"]) == ((2 << 30) + 5, digest.hexdigest())


@pytest.mark.parametrize("reader", [records.Quotes(), records.Brackets()])
def test_a_task_gives_records_out_before_it_has_read_its_chunk(reader):
    """Neither a chunk's fragments nor its records are held as a whole."""
    import pyarrow as pa

    body = (b'[{"a": "' if isinstance(reader, records.Brackets) else b"") + b"x" * 10_000 + (b'"' if isinstance(reader, records.Brackets) else b"")
    taken = []

    def batches():
        for i in range(400):
            taken.append(i)
            n, first = 10, body if i == 0 else body.replace(b"[", b",")
            rows = [["f"] * n, [0] * n, [False] * n, [0] * n, [first, *[body.replace(b"[", b",")] * (n - 1)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["file", "at", "inside", "depth", "body"])

    out = records._cut(reader)(batches())
    first = next(out)
    assert len(taken) < 40 and first.nbytes < 4 * records.LOT_BYTES
    ords = first.column("ord").to_pylist() + [o for batch in out for o in batch.column("ord").to_pylist()]
    assert ords == list(range(4000)) and len(taken) == 400
