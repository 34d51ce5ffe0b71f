"""Near-duplicate classes by circulant MinHash, with every link confirmed on full shingle sets.

A document's set holds its distinct five-word shingles. Two permutations of
the 32-bit integers serve all coordinates: the first scatters the shingles,
the second, shifted circularly by k, gives coordinate k, the least value over
the set. 32 bands of 4 coordinates make candidate pairs: a pair at similarity
0.75 shares no band with a chance of 5e-6.

Documents of one set are one class from the start. In each bucket a member is
compared with the bucket's leader, first the smallest id, then one drawn by a
hash; only members of buckets that still hold several components are compared
again. At last each meets every member of the other components: as pairs in
buckets of up to ``PAIRS_UP_TO`` members, and in larger ones chunk by chunk.
Each member of a large bucket has one chunk of bounded size, that carries the
full sets; two chunks that meet in a bucket are compared at once by a product
of their incidence matrices, and only the links come out. So no pair of a
bucket is left out but those already connected, and no group is expanded into
rows of pairs.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; fewer than five words are one shingle; repeated
rows of a doc_id are one document each with the same class; rows with a null
doc_id form no class: component_id null and kept. Extra columns are ignored.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from postlens.llm.components import components
from postlens.llm.tables import BROADCAST_ROWS, map_rows, stored
from postlens.llm.words import mix64, shingle_set

BANDS = 32
ROWS = 4
SIMILARITY = 75
PAIRS_UP_TO = 12
CHUNK_SHINGLES = 1 << 16
CHUNK_MEMBERS = 512
_SLICE = 512


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signature(marks: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` coordinates: the least of the second permutation, shifted by k, over the scattered set."""
    scattered = _permute((marks >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(size, dtype=np.uint32)
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(scattered), _SLICE):
        values = scattered[at : at + _SLICE, None] - shifts[None, :]
        np.minimum(least, _permute(values, 0x2C1B3C6D, 0x297A2D39).min(axis=0), out=least)
    return least


def band_keys(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    grid = coordinates.reshape(-1, rows).astype(np.uint64)
    keys = np.arange(1, len(grid) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        keys = mix64(keys ^ grid[:, i])
    return keys.view(np.int64)


def _sketch():
    def work(batch: dict) -> dict:
        out: dict[str, list] = {"n_shingles": [], "digest": [], "keys": []}
        for text in batch["text"]:
            marks = shingle_set(text or "")
            out["n_shingles"].append(len(marks))
            out["digest"].append(hashlib.blake2b(marks.tobytes(), digest_size=16).hexdigest() if len(marks) else None)
            out["keys"].append(band_keys(signature(marks)).tolist() if len(marks) else [])
        return out | {"doc_id": batch["doc_id"]}

    return work


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, keys of the bands)."""
    return map_rows(
        docs.select("doc_id", "text"), _sketch, "doc_id bigint, n_shingles bigint, digest string, keys array<bigint>"
    )


def _overlaps():
    def work(batch: dict) -> dict:
        linked = []
        for left, right in zip(batch["left_text"], batch["right_text"]):
            a, b = shingle_set(left or ""), shingle_set(right or "")
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(both > 0 and 100 * both >= SIMILARITY * (len(a) + len(b) - both))
        return {"a": batch["a"], "b": batch["b"], "linked": linked}

    return work


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b), stored, with linked: whether the full sets of both texts are similar enough."""
    texts = needed(texts, pairs.select(F.explode(F.array("a", "b")).alias("needed_id")))
    left = texts.select(F.col("doc_id").alias("left_id"), F.col("text").alias("left_text"))
    right = texts.select(F.col("doc_id").alias("right_id"), F.col("text").alias("right_text"))
    joined = pairs.join(left, F.col("a") == F.col("left_id")).drop("left_id")
    joined = joined.join(right, F.col("b") == F.col("right_id")).drop("right_id")
    return map_rows(joined.select("a", "b", "left_text", "right_text"), _overlaps, "a bigint, b bigint, linked boolean")


def needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of these ids (one column); while there are few, the others are left where they lie."""
    ids = stored(ids.distinct(), "needed")
    if ids.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return texts
    return texts.join(F.broadcast(ids), texts["doc_id"] == ids[ids.columns[0]], "left_semi")


def _similar_size():
    small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
    return 100 * small >= SIMILARITY * large


def _with_roots(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Bucket rows with their component, only of buckets that hold more than one."""
    if roots is None:
        named = buckets.withColumn("root", F.col("rep"))
    else:
        named = buckets.join(roots, buckets["rep"] == roots["id"], "left").withColumn("root", F.coalesce("root", "rep")).drop("id")
    return named


def _open(named: DataFrame) -> DataFrame:
    """Keys of the buckets with several components, and their leaders."""
    drawn = F.min_by(F.struct("rep", "n", "root"), F.xxhash64("rep", "key"))
    least = F.min(F.struct("rep", "n", "root"))
    return (
        named.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), least.alias("first"), drawn.alias("drawn"),
             F.count("*").alias("members"))
        .where("low <> high")
        .select(F.col("key").alias("open_key"), "first", "drawn", "members")
    )


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where(_similar_size() & (F.col("root") != F.col("other_root"))).select(
        F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")
    ).distinct()


def _with_leader(named: DataFrame, which: str) -> DataFrame:
    keys = _open(named).select(
        "open_key",
        F.col(f"{which}.rep").alias("other"),
        F.col(f"{which}.n").alias("other_n"),
        F.col(f"{which}.root").alias("other_root"),
    )
    return _pairs(named.join(keys, named["key"] == keys["open_key"]))


def _all_across(named: DataFrame, keys: DataFrame) -> DataFrame:
    rows = named.join(keys, named["key"] == keys["open_key"], "left_semi")
    others = rows.select(
        F.col("key").alias("other_key"), F.col("rep").alias("other"), F.col("n").alias("other_n"), F.col("root").alias("other_root")
    )
    return _pairs(rows.join(others, (F.col("key") == F.col("other_key")) & (F.col("root") < F.col("other_root"))))


def _chunks(named: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members(rep, root, chunk), cells(left_chunk, right_chunk)) of the large buckets.

    A member's chunk lies in the largest of its buckets and holds about
    ``CHUNK_SHINGLES`` shingles and ``CHUNK_MEMBERS`` members.
    """
    rows = stored(named.join(keys, named["key"] == keys["open_key"]).drop("open_key"), "large-buckets")
    home = rows.groupBy("rep").agg(
        F.max(F.struct("members", "key")).alias("home"), F.first("n").alias("n"), F.first("root").alias("root")
    )
    parts = F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK_MEMBERS)).cast("bigint")
    sizes = home.groupBy(F.col("home.key").alias("home_key")).agg(parts.alias("parts"))
    members = home.join(sizes, F.col("home.key") == F.col("home_key")).select(
        "rep", "root", F.xxhash64("home_key", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("chunk")
    )
    members = stored(members, "chunk-members")
    met = rows.select("key", "rep").join(members.select("rep", "chunk"), "rep").select("key", "chunk").distinct()
    left, right = met.withColumnRenamed("chunk", "left_chunk"), met.withColumnRenamed("chunk", "right_chunk")
    cells = left.join(right, "key").where("left_chunk <= right_chunk").select("left_chunk", "right_chunk").distinct()
    return members, cells


def _sets():
    def work(batch: dict) -> dict:
        return batch | {"marks": [shingle_set(t or "").tobytes() for t in batch["text"]]}

    return work


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    grid = np.zeros((len(sets), len(columns)), dtype=np.float32)
    for i, marks in enumerate(sets):
        at = np.searchsorted(columns, marks)
        at[at == len(columns)] = 0
        grid[i, at[columns[at] == marks]] = 1
    return grid


def linked_pairs(left: list[tuple], right: list[tuple], same: bool) -> list[tuple[int, int]]:
    """Links between members (id, root, set) of two chunks in different components."""
    if len({m[1] for m in left} | {m[1] for m in right}) < 2:
        return []
    a, b = [m[2] for m in left], [m[2] for m in right]
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(shared), 4096):
        columns = shared[at : at + 4096]
        both += _incidence(a, columns) @ _incidence(b, columns).T
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    whole = size_a[:, None] + size_b[None, :] - both
    fits = (both > 0) & (100 * both.astype(np.float64) >= SIMILARITY * whole)
    fits &= np.array([m[1] for m in left])[:, None] != np.array([m[1] for m in right])[None, :]
    if same:
        fits = np.triu(fits, 1)
    return [(left[i][0], right[j][0]) for i, j in np.argwhere(fits).tolist()]


def _cell_links():
    def members(side: list[dict]) -> list[tuple]:
        return [(m["rep"], m["root"], np.frombuffer(m["marks"], dtype=np.uint64)) for m in side]

    def work(batch: dict) -> dict:
        links: list[tuple[int, int]] = []
        for i, j, left, right in zip(batch["left_chunk"], batch["right_chunk"], batch["left_members"], batch["right_members"]):
            links += linked_pairs(members(left), members(right), i == j)
        return {"a": [min(x) for x in links], "b": [max(x) for x in links]}

    return work


def chunk_links(named: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components in the large buckets."""
    members, cells = _chunks(named, keys)
    texts = needed(texts, members.select("rep"))
    found = texts.join(members, texts["doc_id"] == members["rep"]).select("rep", "root", "chunk", "text")
    sets = map_rows(found, _sets, "rep bigint, root bigint, chunk bigint, marks binary").dropDuplicates(["rep"])
    chunks = stored(sets.groupBy("chunk").agg(F.collect_list(F.struct("rep", "root", "marks")).alias("held")), "chunks")
    left = chunks.select(F.col("chunk").alias("left_chunk"), F.col("held").alias("left_members"))
    right = chunks.select(F.col("chunk").alias("right_chunk"), F.col("held").alias("right_members"))
    return map_rows(cells.join(left, "left_chunk").join(right, "right_chunk"), _cell_links, "a bigint, b bigint")


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text)."""
    found = stored(sketches(docs), "sketches")
    reps = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min_by(F.struct(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "keys"), "doc_id").alias("r")
    )
    reps = stored(reps.select("digest", "r.*"), "representatives")
    spread = reps.select("rep", "n", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select(F.col("key").alias("k"))
    buckets = stored(spread.join(shared, spread["key"] == shared["k"], "left_semi"), "buckets")
    texts = docs.select("doc_id", "text")
    links: DataFrame | None = None
    roots: DataFrame | None = None
    for leader in ("first", "drawn"):
        named = _with_roots(buckets, roots)
        pairs = stored(_with_leader(named, leader), "pairs")
        if pairs.isEmpty():
            continue
        found_links = stored(confirm(pairs, texts).where("linked").select("a", "b").distinct(), "links")
        links = found_links if links is None else links.unionByName(found_links)
        roots = stored(components(links), "roots")
    named = stored(_with_roots(buckets, roots), "named-buckets")
    keys = stored(_open(named), "open-buckets")
    pairs = stored(_all_across(named, keys.where(F.col("members") <= PAIRS_UP_TO)), "pairs")
    more = [] if pairs.isEmpty() else [stored(confirm(pairs, texts).where("linked").select("a", "b").distinct(), "links")]
    large = keys.where(F.col("members") > PAIRS_UP_TO).select("open_key", "members")
    if not large.isEmpty():
        more.append(stored(chunk_links(named, large, texts), "links"))
    for found_links in more:
        links = found_links if links is None else links.unionByName(found_links)
    if links is None:
        links = pairs.select("a", "b").limit(0)
    roots = stored(components(links), "roots") if more or roots is None else roots
    classes = reps.select(F.col("digest").alias("class_digest"), "rep")
    classes = classes.join(roots, classes["rep"] == roots["id"], "left").withColumn("rep", F.coalesce("root", "rep"))
    classes = classes.select("class_digest", F.col("rep").alias("class_id"))
    joined = found.join(classes, found["digest"] == classes["class_digest"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of docs.

    Of rows equal in doc_id and text one stays; rows that share a doc_id but
    differ in text all stay if the id does; rows without an id stay.
    """
    kept = near_classes(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.where("doc_id IS NULL"))
