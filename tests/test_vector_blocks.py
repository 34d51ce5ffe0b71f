"""Vectors in blocks of posts: no row a post and term is moved or written, and nothing is left behind."""

import time

import numpy as np
from pyspark.sql import functions as F

from postlens.operators import vectors
from postlens.session import drop_stored, stored


def corpus(spark, posts=300, words=40):
    rng = np.random.default_rng(5)
    rows = [(i, [f"w{w}" for w in rng.integers(0, 60, words)]) for i in range(posts)]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


def test_reduction_writes_posts_and_terms_not_their_pairs(spark, monkeypatch):
    sizes = []

    def written(df, name, **options):
        table = stored(df, name, **options)
        sizes.append((name, table.count()))
        return table

    monkeypatch.setattr(vectors, "stored", written)
    posts = corpus(spark).repartition(3)
    found = vectors.sparse_vectors(posts, packed=True)
    coords = vectors.reduce_sparse(found, 2, 300).collect()
    assert len(coords) == 300 and max(n for _, n in sizes) <= 300 + 60


def test_blocks_are_the_vectors_and_reduce_to_the_same(spark):
    rows = corpus(spark, 50).union(corpus(spark, 20, 7))  # ids that come twice make one vector
    plain = vectors.sparse_vectors(rows)
    packed = vectors.sparse_vectors(rows, packed=True)
    assert sum(len(r["ids"]) for r in packed.collect()) == plain.select("id").distinct().count() == 50
    a, b = ({r["id"]: np.array(r["coords"]) for r in vectors.reduce_sparse(v, 2, 70).collect()} for v in (stored(plain, "rows"), packed))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-9) for i in a)


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().endswith(".data")}

    before, until = files(), time.time() + 20
    table = stored(spark.range(50_000).repartition(3, F.col("id") % 7), "freed")
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and table.count() == 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    path = table.inputFiles()[0]
    drop_stored(table)
    assert not spark._jvm.java.io.File(path.removeprefix("file:")).exists()
