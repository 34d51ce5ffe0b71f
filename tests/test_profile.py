"""Column profiles against a plain count, whatever the values, partitions and width."""

import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import profile


def plain(rows, names):
    """The profile by sets and sorting."""
    out = {}
    for i, name in enumerate(names):
        given = [r[i] for r in rows]
        filled = [v for v in given if v is not None and v.strip()]
        distinct = {v for v in given if v is not None}
        smallest = sorted({v for v in distinct if v.strip()}, key=lambda v: (v[:120].encode(), v))[:5]
        n = max(len(rows), 1)
        out[name] = (
            i,
            round((1 - len(filled) / n) * 100 * 100) / 100,
            round(len(distinct) / n * 100 * 100) / 100,
            [v[:120] for v in smallest],
        )
    return out


def profiled(frame):
    return {
        r["name"]: (r["ordinal"], r["null_pct"], r["unique_pct"], r["sample_values"])
        for r in profile.profile_columns(frame).collect()
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    begin = "same beginning " * 10
    return [
        (
            f"p{rng.randrange(10**9)}",
            rng.choice(["a", "b", None]),
            rng.choice([begin + str(rng.randrange(40)), "", "  ", None, "z" * 200]),
            None,
            str(rng.randrange(3000)),
            rng.choice(["文", "é", "word"]) + str(rng.randrange(20)),
        )
        for _ in range(4000)
    ]


NAMES = ["an id", "two.parts", "begins`alike", "nothing", "number", "letters"]


@pytest.mark.parametrize("parts", [1, 7, 90])
def test_profile_equals_a_plain_count(spark, rows, parts):
    frame = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)).repartition(parts)
    assert profiled(frame) == plain(rows, NAMES)


def test_wide_tables_are_read_in_blocks(spark, rows):
    wide = [tuple(r[i % 6] for i in range(40)) for r in rows[:300]]
    names = [f"c{i}" for i in range(40)]
    frame = spark.createDataFrame(wide, ", ".join(f"{n} string" for n in names))
    assert profiled(frame) == plain(wide, names)


def test_empty_tables_and_other_types(spark):
    frame = spark.createDataFrame([], "a string, b int")
    assert profiled(frame) == {"a": (0, 100.0, 0.0, []), "b": (1, 100.0, 0.0, [])}
    typed = spark.createDataFrame([(1, 2.5, True), (1, None, False)], "a int, b double, c boolean")
    found = {r["name"]: (r["dtype"], r["unique_pct"], r["sample_values"]) for r in profile.profile_columns(typed).collect()}
    assert found == {
        "a": ("int", 50.0, ["1"]),
        "b": ("double", 50.0, ["2.5"]),
        "c": ("boolean", 100.0, ["false", "true"]),
    }


def test_many_values_are_counted_within_the_stated_error(spark):
    frame = spark.range(400_000, numPartitions=9).select(
        F.concat(F.lit("p"), "id").alias("all"), (F.col("id") % 150_000).cast("string").alias("some")
    )
    found = profiled(frame)
    assert abs(found["all"][2] - 100) < 1.6 and abs(found["some"][2] - 37.5) < 0.6
    assert found["all"][3] == ["p0", "p1", "p10", "p100", "p1000"]


def test_no_row_per_cell(spark, rows, capsys):
    frame = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    profile.profile_columns(frame).explain("formatted")
    plan = capsys.readouterr().out
    assert "posexplode" not in plan and "Expand" not in plan
