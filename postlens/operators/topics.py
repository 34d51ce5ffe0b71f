"""Topics: corpus, vectors, reduction, density clusters, keywords, labels.

``fit_topics`` clusters by true neighbours (see ``neighbours``).
``density_topics`` is a cheaper grid in the style of CLIQUE (Agrawal et al.,
SIGMOD 1998): posts are counted per cell of a grid over the middle 98 % of each
axis (posts beyond lie in the border cells), dense cells that share a face grow
together, everything else is an outlier.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.functions.components import connected_components
from postlens.functions.numbers import percent
from postlens.functions.ranking import top_k_per_group
from postlens.functions.spanning import spanning_tree, strongest
from postlens.operators import vectors
from postlens.operators.neighbours import neighbour_topics, typical_distance
from postlens.schema import Thresholds
from postlens.session import drop_stored, stored

MIN_TEXT_CHARS = 4
MIN_ROWS = 30
OUTLIER = -1
BOX = (0.01, 0.99)
MIN_DF = 2

# Labels of the outlier class and of drafts.
OUTLIER_LABEL = "未歸類貼文（離群值）"
DRAFT_LABEL = "T%02d：%s（待標記）"


# --- corpus -------------------------------------------------------------------


def topic_corpus(labelled: DataFrame) -> DataFrame:
    """Posts whose normalised text has at least 4 characters."""
    return labelled.where(F.length("text_norm") >= MIN_TEXT_CHARS)


def topic_corpus_summary(labelled: DataFrame) -> DataFrame:
    valid = F.coalesce(F.length("text_norm") >= MIN_TEXT_CHARS, F.lit(False))
    return labelled.agg(F.count_if(valid).alias("row_count"), F.count_if(~valid).alias("filtered_short_text"))


def topic_gate(corpus: DataFrame, minimum: int = MIN_ROWS) -> DataFrame:
    """row_count, skipped, reason (null when there are enough rows)."""
    n = F.col("row_count")
    reason = F.format_string(f"only %d valid posts; need ≥{minimum} for clustering", n)
    return corpus.agg(F.count(F.lit(1)).alias("row_count")).select(
        n, (n < minimum).alias("skipped"), F.when(n < minimum, reason).alias("reason")
    )


# --- vectors ------------------------------------------------------------------


def embed_posts(corpus: DataFrame, model: Callable) -> DataFrame:
    """Adds ``vector`` by a model: a function from a text column to an array column, such as ``vectors.encoder`` makes."""
    return corpus.withColumn("vector", array_to_vector(model(F.col("text_norm"))))


def reduce_dims(embedded: DataFrame, dims: int = 4, vector: str = "vector") -> DataFrame:
    """Adds ``coords``, the first principal components of a model's vectors; the driver holds one width x width matrix.

    Sparse vectors of a whole vocabulary go to ``vectors.reduce_sparse``.
    """
    model = PCA(k=dims, inputCol=vector, outputCol="pca").fit(embedded)
    return model.transform(embedded).withColumn("coords", vector_to_array("pca")).drop("pca")


def walsh_coords(embedding: Column, dims: int) -> Column:
    """``dims`` coordinates: signed sums over the embedding with Walsh function signs.

    A linear reduction that needs no fitting: coordinate j adds element i with
    the sign of the parity of the bits shared by i and 2^j.
    """

    def coordinate(mask: int) -> Column:
        signed = F.transform(
            embedding,
            lambda x, i: F.when(F.bit_count(i.bitwiseAND(F.lit(mask))) % 2 == 0, x.cast("double")).otherwise(
                -x.cast("double")
            ),
        )
        return F.aggregate(signed, F.lit(0.0), lambda a, x: a + x)

    return F.array(*[coordinate(1 << j) for j in range(dims)])


# --- clusters -----------------------------------------------------------------


def _cell_column(coords: str, lows: list[Column], highs: list[Column], bins: int) -> Column:
    """Grid cell as one number, mixed radix over the axes; what lies beyond an edge belongs to the slice there."""
    parts = []
    for axis in range(len(lows)):
        width = (highs[axis] - lows[axis]) / bins
        position = (F.get(F.col(coords), F.lit(axis)) - lows[axis]) / width
        inside = F.greatest(F.least(F.floor(position), F.lit(bins - 1)), F.lit(0))
        slot = F.when(width > 0, inside).otherwise(F.lit(0))
        parts.append(slot.cast("bigint") * bins**axis)
    return reduce(lambda a, b: a + b, parts)


def density_topics(
    located: DataFrame,
    dims: int,
    bins: int = 8,
    min_points: int = 5,
    min_topic_size: int = Thresholds.min_topic_size,
    coords: str = "coords",
) -> DataFrame:
    """Adds topic_id: 0, 1, ... by falling size, -1 for posts outside every topic.

    A cell is dense with at least ``min_points`` posts; dense cells that share
    a face belong together; groups below ``min_topic_size`` posts are outliers.
    Only cells with posts make rows. The grid spans the middle of each axis, by
    approximate quantiles in one pass, so a post far out does not widen it.
    """
    edges = [F.get(F.col(coords), F.lit(a)) for a in range(dims)]
    box = located.agg(
        F.array(*[F.percentile_approx(e, BOX[0], 10_000) for e in edges]).alias("low"),
        F.array(*[F.percentile_approx(e, BOX[1], 10_000) for e in edges]).alias("high"),
    )
    placed = located.withColumns({"low": box.select("low").scalar(), "high": box.select("high").scalar()}).withColumn(
        "cell",
        _cell_column(
            coords,
            [F.get(F.col("low"), F.lit(a)) for a in range(dims)],
            [F.get(F.col("high"), F.lit(a)) for a in range(dims)],
            bins,
        ),
    )
    placed = placed.drop("low", "high")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    dense = stored(cells.where(F.col("n") >= min_points), "dense-cells")
    topics = number_topics(grow_cells(dense, dims, bins), min_topic_size)
    return (
        placed.join(topics, "cell", "left")
        .withColumn("topic_id", F.coalesce("topic_id", F.lit(OUTLIER)))
        .drop("cell")
    )


def grow_cells(dense: DataFrame, dims: int, bins: int) -> DataFrame:
    """cell, n, component: dense cells joined across shared faces."""
    steps = [
        F.when(F.floor(F.col("cell") / bins**axis) % bins < bins - 1, F.col("cell") + bins**axis)
        for axis in range(dims)
    ]
    forward = dense.select(F.col("cell").alias("src"), F.explode(F.array_compact(F.array(*steps))).alias("dst"))
    faces = forward.join(dense.select(F.col("cell").alias("dst")), "dst", "left_semi").select("src", "dst")
    components = connected_components(dense.select(F.col("cell").alias("id")), faces)
    return dense.join(components.withColumnRenamed("id", "cell"), "cell")


def number_topics(grown: DataFrame, min_topic_size: int) -> DataFrame:
    """cell, topic_id for the components that are large enough; ids by falling size."""
    sizes = grown.groupBy("component").agg(F.sum("n").alias("size")).where(F.col("size") >= min_topic_size)
    # One row a topic, hence a window without partitions.
    by_size = Window.orderBy(F.desc("size"), F.asc("component"))
    ids = sizes.withColumn("topic_id", (F.row_number().over(by_size) - 1).cast("int"))
    return grown.join(ids.select("component", "topic_id"), "component").select("cell", "topic_id")


def kmeans_topics(
    embedded: DataFrame, k: int, max_distance: float, min_topic_size: int = Thresholds.min_topic_size, seed: int = 7
) -> DataFrame:
    """Adds topic_id by k-means on ``vector``; posts farther than ``max_distance`` from their centre are outliers."""
    model = KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster").fit(embedded)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    mine = F.get(centres, F.col("cluster"))
    squares = F.zip_with(vector_to_array("vector"), mine, lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))
    near = model.transform(embedded).withColumn("cluster", F.when(distance <= max_distance, F.col("cluster")))
    # At most k rows.
    sizes = near.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    by_size = Window.orderBy(F.desc("size"), F.asc("cluster"))
    ids = sizes.where(F.col("size") >= min_topic_size).select(
        "cluster", (F.row_number().over(by_size) - 1).cast("int").alias("topic_id")
    )
    return (
        near.join(F.broadcast(ids), "cluster", "left")
        .withColumn("topic_id", F.coalesce("topic_id", F.lit(OUTLIER)))
        .drop("cluster")
    )


# --- keywords -----------------------------------------------------------------


def corpus_terms(topics: DataFrame, text: str = "tokens_lem_str", copies: str | None = None) -> DataFrame:
    """topic_id, term, copies: every word of two or more characters, lower-cased.

    Equal texts of a topic are read once; ``copies`` is the number of posts that carry the text.
    With a column ``copies`` a row already stands for so many posts, and no text is moved.
    """
    if copies is None:
        texts = topics.groupBy("topic_id", F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    else:
        texts = topics.select("topic_id", F.col(text).alias("text"), F.col(copies).alias("copies"))
    return texts.select("topic_id", F.explode(_words("text")).alias("term"), "copies")


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))


def topic_term_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("topic_id", "term").agg(F.sum("copies").alias("tf"))


def vocab(topics: DataFrame, df_unit: str = "topic", min_df: int = MIN_DF, max_terms: int | None = None) -> DataFrame:
    """term, df, tf: terms in at least ``min_df`` topics (or posts); with ``max_terms`` only the most frequent ones."""
    if df_unit == "topic":
        per_unit = topic_term_counts(corpus_terms(topics)).select("term", "tf", F.lit(1).alias("df"))
    else:
        # A post counts each of its words once towards df and every use towards tf; equal posts are read once.
        texts = topics.groupBy("tokens_lem_str").agg(F.count(F.lit(1)).alias("copies"))
        words, n, none = _words("tokens_lem_str"), F.col("copies"), F.lit(0).cast("bigint")
        uses = F.transform(words, lambda w: F.struct(w.alias("term"), n.alias("tf"), none.alias("df")))
        once = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("term"), none.alias("tf"), n.alias("df")))
        per_unit = texts.select(F.inline(F.concat(uses, once)))
    terms = per_unit.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= min_df)
    return terms if max_terms is None else terms.orderBy(F.desc("tf"), F.asc("term")).limit(max_terms)


def ctfidf(topics: DataFrame, min_df: int = MIN_DF, max_terms: int | None = None, copies: str | None = None) -> DataFrame:
    """topic_id, term, tf, score: class TF-IDF (Grootendorst 2022) over the vocabulary.

    score = tf / words in the topic * ln(1 + A / uses of the term), A = mean words per topic.
    ``topics`` is read once; its counts by topic and term are written. With a
    column ``copies`` a row stands for so many posts.
    """
    counts = stored(topic_term_counts(corpus_terms(topics, copies=copies)), "term-counts")
    terms = (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))
        .where(F.col("df") >= min_df)
        .select("term", "uses")
    )
    if max_terms is not None:
        terms = terms.orderBy(F.desc("uses"), F.asc("term")).limit(max_terms)
    kept = counts.join(terms, "term")
    sizes = kept.groupBy("topic_id").agg(F.sum("tf").alias("words"))
    mean_words = sizes.agg(F.floor(F.avg("words")).alias("mean")).scalar()
    idf = F.log(F.lit(1.0) + mean_words / F.col("uses"))
    return kept.join(sizes, "topic_id").select(
        "topic_id", "term", "tf", (F.col("tf") / F.col("words") * idf).alias("score")
    )


def top_keywords(scored: DataFrame, n: int = 10) -> DataFrame:
    """topic_id, rank, term, score for the n best terms of each topic; none for outliers."""
    return top_k_per_group(
        scored.where(F.col("topic_id") != OUTLIER),
        ["topic_id"],
        [F.desc(F.round("score", 12)), F.asc("term")],
        n,
        "term",
    ).select("topic_id", "rank", "term", "score")


def similar_topics(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """topic_a, topic_b, cosine for topic pairs at or above the threshold.

    Prefix filtering (Chaudhuri et al., ICDE 2006; Bayardo et al., WWW 2007):
    terms are ordered by the number of topics that use them, rarest first, and a
    topic is only looked up by the leading terms that together could carry a
    cosine of ``threshold``. Terms all topics share never bring topics together,
    and no pair at or above the threshold is lost. From the first term that a
    pair shares, its cosine is at most the product of what both topics have
    left there (Cauchy-Schwarz), so a shared term makes a pair only where that
    product reaches the threshold. ``scored`` is read several times, so give it
    as a stored table.
    """
    real = scored.where((F.col("topic_id") != OUTLIER) & (F.col("score") > 0))
    lengths = real.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    spread = real.groupBy("term").agg(F.count(F.lit(1)).alias("topics_with"))
    unit = (
        real.join(lengths, "topic_id")
        .join(spread, "term")
        .select("topic_id", "term", "topics_with", (F.col("score") / F.col("norm")).alias("w"))
    )
    # The weight left from a term on; once it falls below the threshold the rest cannot reach it alone.
    # Summed from the last term backwards: a frame that ends with the partition is added up anew for every row.
    onwards = Window.partitionBy("topic_id").orderBy(F.desc("topics_with"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = (
        unit.withColumn("left_over", F.sqrt(F.sum(F.col("w") * F.col("w")).over(onwards)))
        .where(F.col("left_over") >= threshold - 1e-9)
        .select("topic_id", "term", "left_over")
    )
    a = prefix.select(F.col("topic_id").alias("topic_a"), "term", F.col("left_over").alias("left_a"))
    b = prefix.select(F.col("topic_id").alias("topic_b"), F.col("term").alias("term_b"), F.col("left_over").alias("left_b"))
    reachable = F.col("left_a") * F.col("left_b") >= threshold - 1e-9
    meet = (F.col("term") == F.col("term_b")) & (F.col("topic_a") < F.col("topic_b")) & reachable
    candidates = a.join(b, meet).select("topic_a", "topic_b").distinct()
    left = unit.select(F.col("topic_id").alias("topic_a"), "term", F.col("w").alias("w_a"))
    right = unit.select(F.col("topic_id").alias("topic_b"), "term", F.col("w").alias("w_b"))
    return (
        candidates.join(left, "topic_a")
        .join(right, ["topic_b", "term"])
        .groupBy("topic_a", "topic_b")
        .agg(F.sum(F.col("w_a") * F.col("w_b")).alias("cosine"))
        .where(F.col("cosine") >= threshold)
    )


def merge_topics(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """topic_id, merged_id: topics linked by similar keyword vectors share the smallest (largest topic's) id."""
    scored = stored(scored, "topic-terms")
    ids = scored.select(F.col("topic_id").alias("id")).distinct()
    pairs = similar_topics(scored, threshold).select(F.col("topic_a").alias("src"), F.col("topic_b").alias("dst"))
    return connected_components(ids, pairs).select(
        F.col("id").alias("topic_id"), F.col("component").alias("merged_id")
    )


def merge_to_count(scored: DataFrame, topics: int, floor: float = 0.01) -> DataFrame:
    """topic_id, merged_id: the most alike topics merged until ``topics`` are left, as single linkage does.

    Outliers stay apart and aren't counted. Topics whose cosine is below
    ``floor`` are never joined, so more than ``topics`` can be left.
    """
    scored = stored(scored.where(F.col("topic_id") != OUTLIER), "topic-terms")
    ids = stored(scored.select(F.col("topic_id").alias("id")).distinct(), "topic-ids")
    links = similar_topics(scored, floor).select(F.col("topic_a").alias("src"), F.col("topic_b").alias("dst"), "cosine")
    kept = strongest(spanning_tree(ids, stored(links, "topic-links")), ids.count() - topics)
    return connected_components(ids, kept).select(F.col("id").alias("topic_id"), F.col("component").alias("merged_id"))


# --- labels and summaries -----------------------------------------------------


def draft_label(topic_id: Column, keywords: Column, max_words: int = 3) -> Column:
    head = F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, max_words), "·")).otherwise(F.lit("?"))
    return F.when(topic_id == OUTLIER, F.lit(OUTLIER_LABEL)).otherwise(F.format_string(DRAFT_LABEL, topic_id, head))


def auto_label(topic_ids: DataFrame, keywords: DataFrame) -> DataFrame:
    """topic_id, auto_label for every id present."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda k: k["term"])
    lists = keywords.groupBy("topic_id").agg(in_order.alias("keywords"))
    none = F.array().cast("array<string>")
    return (
        topic_ids.select("topic_id")
        .distinct()
        .join(lists, "topic_id", "left")
        .select("topic_id", draft_label(F.col("topic_id"), F.coalesce("keywords", none)).alias("auto_label"))
    )


def with_labels(topics: DataFrame, labels: DataFrame) -> DataFrame:
    """analyst_label from the draft labels."""
    return topics.join(labels.withColumnRenamed("auto_label", "analyst_label"), "topic_id", "left")


def apply_labels(topics: DataFrame, answers: DataFrame) -> DataFrame:
    """Answered labels (topic_id, label) win, the old label stays where there is no answer."""
    return (
        topics.join(answers.select("topic_id", "label"), "topic_id", "left")
        .withColumn("analyst_label", F.coalesce("label", "analyst_label"))
        .drop("label")
    )


def topic_sizes(topics: DataFrame) -> DataFrame:
    return topics.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))


def topic_summary(topics: DataFrame, alarm_pct: float = Thresholds.outlier_rerun_pct) -> DataFrame:
    """row_count, topic_count, outlier_pct, outlier_alarm."""
    outliers = F.coalesce(F.sum(F.when(F.col("topic_id") == OUTLIER, F.col("size"))), F.lit(0))
    return (
        topic_sizes(topics)
        .agg(
            F.coalesce(F.sum("size"), F.lit(0)).alias("row_count"),
            F.count_if(F.col("topic_id") != OUTLIER).alias("topic_count"),
            outliers.alias("outliers"),
        )
        .withColumn("outlier_pct", percent(F.col("outliers"), F.greatest(F.col("row_count"), F.lit(1))))
        .withColumn("outlier_alarm", F.col("outlier_pct") > alarm_pct)
        .drop("outliers")
    )


def topic_samples(topics: DataFrame, n: int = 8, text_chars: int = 120) -> DataFrame:
    """The n posts of each topic with most engagement, texts cut to 120 characters.

    They are found without their texts, which are fetched for them alone; ``topics`` is read twice, so give it as a
    written stage.
    """
    has = set(topics.columns)
    weight = F.coalesce(F.col("engagement").try_cast("double"), F.lit(0.0)) if "engagement" in has else F.lit(0.0)
    extra = [c for c in ("platform", "final_label") if c in has]
    real = topics.where(F.col("topic_id") != OUTLIER).withColumn("engagement", weight)
    order = [F.desc("engagement"), F.asc("id")]
    best = top_k_per_group(real.select("topic_id", "id", "engagement"), ["topic_id"], order, n, "id")
    best = best.select(*[F.col(c).alias(f"best_{c}") for c in ("topic_id", "id", "engagement")]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"best_{c}")) for c in ("topic_id", "id", "engagement")])
    # At most n rows a topic.
    slim = real.join(F.broadcast(best), same, "left_semi").select(
        "topic_id", "id", *extra, F.substring("text", 1, text_chars).alias("text"), "engagement"
    )
    return top_k_per_group(slim, ["topic_id"], order, n, "id")


def fit_topics(
    corpus: DataFrame,
    dims: int = 4,
    radius: float = 0.2,
    min_points: int = 5,
    min_topic_size: int = Thresholds.min_topic_size,
    model: Callable | None = None,
    merge_at: float | None = 0.7,
    topics: int | None = None,
    id_col: str = "id",
    texts: DataFrame | None = None,
    key: str = "text_id",
) -> DataFrame:
    """Vectors, reduction, clusters, and topics of alike words merged: adds topic_id to the corpus.

    Vectors are sparse over the whole vocabulary, or a model's. Clusters are
    those of true neighbours within ``radius`` times the typical distance of a
    post from the mean. ``merge_at`` is the least cosine of two topics' term
    scores (None keeps all apart); ``topics`` merges the most alike until so
    many are left instead. Posts without terms are outliers. Posts with the
    same tokens are one vector that counts as often, where ids are unique; else
    the rows of an id make one vector together. ``corpus`` is read several
    times, so give it as a stored table.

    Texts are moved once each, not once a post: with ``texts`` (``key``,
    tokens, tokens_lem_str; a stored table with one row a key) the corpus only
    has to carry the key. Without it they are taken from the corpus.
    """
    if model is not None:
        points, copies = reduce_dims(embed_posts(corpus, model), dims).drop("vector"), None
    else:
        if texts is None:
            while key in corpus.columns:
                key += "_"
            posts, texts = _interned(corpus, key)
        else:
            posts = corpus
        uses = stored(posts.groupBy(key).agg(F.count(F.lit(1)).alias("copies")), "text-uses")
        unique = _unique(posts, id_col)
        if unique:
            # Texts with the same tokens, whatever else tells them apart, are one vector.
            named = texts.select(key, F.sha2(F.to_json(F.struct("tokens")), 256).alias("vector_id"), "tokens").join(uses, key)
            groups = named.groupBy("vector_id").agg(F.min(key).alias("first"), F.sum("copies").alias("copies"))
            groups = stored(groups, "distinct-tokens")
            firsts = groups.select(F.col("first").alias(key), "vector_id", "copies")
            sparse = vectors.sparse_vectors(texts.select(key, "tokens").join(firsts, key), id_col="vector_id", copies="copies", packed=True)
        else:
            members = posts.select(F.col(id_col).alias("vector_id"), key)
            groups = stored(members.groupBy("vector_id").agg(F.count(F.lit(1)).alias("copies")), "distinct-ids")
            sparse = vectors.sparse_vectors(members.join(texts.select(key, "tokens"), key), id_col="vector_id", packed=True)
        many = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        coords = vectors.reduce_sparse(sparse, dims, many)
        points = groups.select(F.col("vector_id").alias("id"), "copies").join(coords, "id", "left")
        copies = "copies"
    points = stored(points, "coords")
    if model is None:
        drop_stored(sparse)
    scale = typical_distance(points, dims, copies=copies)
    if not scale:
        return corpus.withColumn("topic_id", F.lit(OUTLIER))
    found = neighbour_topics(points, dims, radius * scale, min_points, min_topic_size, copies=copies).drop("coords")
    if model is not None:
        if merge_at is None and topics is None:
            return found
        found = stored(found, "raw-topics")
        scored = ctfidf(found.where(F.col("topic_id") != OUTLIER))
        return _with_merged(found, _merged(scored, merge_at, topics))
    found = stored(found.select(F.col("id").alias("vector_id"), "topic_id"), "vector-topics")
    if unique:
        # The topic of a text.
        by_text = named.select(key, "vector_id", "copies").join(found, "vector_id").select(key, "topic_id", "copies")
        by_text = stored(by_text, "text-topics")
        placed = posts.join(by_text.select(key, "topic_id"), key, "left")
        counted = by_text
    else:
        placed = posts.withColumn("vector_id", F.col(id_col)).join(found, "vector_id", "left").drop("vector_id")
        counted = members.join(found, "vector_id").groupBy(key, "topic_id").agg(F.count(F.lit(1)).alias("copies"))
    placed = placed.withColumn("topic_id", F.coalesce("topic_id", F.lit(OUTLIER)))
    placed = placed.select(*corpus.columns, "topic_id")
    if merge_at is None and topics is None:
        return placed
    words = texts.select(key, "tokens_lem_str").join(counted.where(F.col("topic_id") != OUTLIER), key)
    return _with_merged(placed, _merged(ctfidf(words, copies="copies"), merge_at, topics))


def _merged(scored: DataFrame, merge_at: float | None, topics: int | None) -> DataFrame:
    return merge_topics(scored, merge_at) if topics is None else merge_to_count(scored, topics)


def _with_merged(found: DataFrame, merged: DataFrame) -> DataFrame:
    return found.join(merged, "topic_id", "left").withColumn("topic_id", F.coalesce("merged_id", "topic_id").cast("int")).drop("merged_id")


def _interned(corpus: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The corpus with ``key``, a digest of tokens and tokens_lem_str, and a stored table of these with one row a key."""
    words = ["tokens", "tokens_lem_str"] if "tokens_lem_str" in corpus.columns else ["tokens"]
    posts = corpus.withColumn(key, F.sha2(F.to_json(F.struct(*words)), 256))
    # Grouped by one string, as lists take several times the room.
    packed = corpus.select(F.to_json(F.struct(*words)).alias("packed")).distinct()
    read = F.from_json("packed", "tokens array<string>, tokens_lem_str string")
    return posts, stored(packed.select(F.sha2("packed", 256).alias(key), read.alias("w")).select(key, "w.tokens", "w.tokens_lem_str"), "distinct-texts")


def _unique(rows: DataFrame, key: str) -> bool:
    """Whether no two rows share the key and none lacks it."""
    uses = rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return uses.where(F.col("key").isNull() | (F.col("n") > 1)).isEmpty()
