"""Small helpers shared by the operators: reading tables, stored steps, mapping batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postlens.session import stored

__all__ = ["read", "stored", "map_rows", "broadcast_if_small", "BROADCAST_ROWS"]

BROADCAST_ROWS = 200_000
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes, at least one row each."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Maps lists of columns to lists of columns, batch by batch, next to the data.

    ``make`` runs once in each task and returns the function of one batch, so
    that models and caches are set up once. Batches are cut to a few megabytes.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        work = make()
        for whole in batches:
            for batch in slices(whole):
                out = work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([as_array(out[n], kinds[n]) for n in names], names)

    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    return df.mapInArrow(run, schema)


ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
    "array<float>": pa.list_(pa.float32()),
}


def as_array(values, kind: str) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, ARROW[kind])


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table of narrow rows for broadcast when it has at most ``most`` rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
