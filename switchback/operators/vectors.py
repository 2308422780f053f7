"""Queries over a table of vectors (id, vector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from switchback.functions.vectors import cosine, cosine_distance, l2_normalise, norm


def scored(items: DataFrame, query: DataFrame) -> DataFrame:
    """Each item's cosine to each query of ``query(query_id, query_vector)``, itself excluded.

    The stated queries are few (one user's question): they are broadcast when Spark sees that they are small.
    """
    return items.join(query, F.col("id") != F.col("query_id")).select("query_id", "id", cosine(F.col("vector"), F.col("query_vector")).alias("score"))


def top_k(items: DataFrame, query_id, k: int = 5, where: Column | None = None, least: float | None = None) -> DataFrame:
    """The k most similar others of one item, after an optional filter and a score floor."""
    one = items.where(F.col("id") == F.lit(query_id)).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    pool = items if where is None else items.where(where)
    hits = scored(pool, F.broadcast(one.limit(1)))
    return (hits if least is None else hits.where(F.col("score") >= least)).orderBy(F.desc("score"), "id").limit(k)


#: Queries that are broadcast together, and the bytes of their vectors at most.
QUERY_BLOCK = 1_000
QUERY_BYTES = 64 << 20


def top_k_per_query(items: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, id, score, rank, margin)``: the k most similar others of each query of ``queries(query_id, query_vector)``.

    Queries are scored in blocks of bounded size against all items.  A task keeps the ``k + 1`` best of each query
    while it reads, so that this many rows a query and task are shuffled, not the scores.  Vectors of another
    length than the query's and those that are null or zero have no score; ties go to the smaller id.
    """
    from collections.abc import Iterator
    from functools import reduce

    import numpy as np
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in items.schema}["id"], {f.name: f.dataType.simpleString() for f in queries.schema}["query_id"]
    out_schema = f"query_id {kind[1]}, id {kind[0]}, score double"
    spark = items.sparkSession

    def scores_of(block: list) -> DataFrame:
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        for size in {len(v) for _, v in block}:
            own = [(i, v) for i, v in block if len(v) == size]
            by_size[size] = [i for i, _ in own], np.array([v for _, v in own], float).reshape(len(own), size)
        shared = spark.sparkContext.broadcast(by_size)

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict = {}
            for f in frames:
                f = f[f["vector"].notna()]
                sizes = f["vector"].map(len)
                for size, (asked, q) in shared.value.items():
                    g = f[(sizes == size).to_numpy()].sort_values("id", kind="stable")
                    if not len(g) or not size:
                        continue
                    x = np.stack(g["vector"].to_numpy()).astype(float)
                    length = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
                    with np.errstate(all="ignore"):
                        score = np.einsum("nd,qd->nq", x, q) / length
                    ids = g["id"].to_numpy()
                    for c, who in enumerate(asked):
                        fine = np.flatnonzero(np.isfinite(score[:, c]) & (ids != who))
                        top = fine[np.argsort(-score[fine, c], kind="stable")[: k + 1]]
                        held = sorted([*best.get(who, []), *zip(-score[top, c], ids[top])])
                        best[who] = held[: k + 1]
            rows = [(who, i, -s) for who, held in best.items() for s, i in held]
            yield pd.DataFrame(rows, columns=["query_id", "id", "score"])

        return items.select("id", "vector").where("id is not null").mapInPandas(scan, out_schema)

    parts, block, size = [], [], 0
    for r in queries.select("query_id", "query_vector").where("query_id is not null and query_vector is not null").toLocalIterator():
        if block and (len(block) >= QUERY_BLOCK or size + 8 * len(r.query_vector) > QUERY_BYTES):
            parts.append(scores_of(block))
            block, size = [], 0
        block.append((r.query_id, r.query_vector))
        size += 8 * len(r.query_vector)
    parts.append(scores_of(block))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    return best.withColumn("margin", F.col("score") - F.lead("score").over(w)).where(F.col("rank") <= k)


def centroids(items: DataFrame, by: str) -> DataFrame:
    """Mean vector per group, at unit length: element sums are combined before the shuffle."""
    parts = items.select(by, F.posexplode("vector").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("mean"))
    return mean.select(by, l2_normalise(F.col("mean")).alias("centroid"))


def distances(items: DataFrame, by: str, centre: DataFrame | None = None) -> DataFrame:
    """Distance of each item (normalised) to its group's centroid."""
    centre = centroids(items.where(norm(F.col("vector")) > 0).withColumn("vector", l2_normalise(F.col("vector"))), by) if centre is None else centre
    return items.join(centre, by).withColumn("distance", cosine_distance(l2_normalise(F.col("vector")), F.col("centroid"))).drop("centroid")


def taste(items: DataFrame, ids: list, k: int = 5) -> DataFrame:
    """Items most similar to the mean of a few liked ones, these excluded."""
    liked = items.where(F.col("id").isin(ids))
    mean = liked.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    one = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("q"))
    rest = items.where(~F.col("id").isin(ids)).join(F.broadcast(one), how="cross")
    return rest.select("id", cosine(F.col("vector"), F.col("q")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def pair_distances(items: DataFrame, by: str, blocks: int = 16) -> DataFrame:
    """Mean cosine distance of all pairs within and between groups, without forming the pairs.

    The sum of all dot products of two groups is the dot product of their vector sums, so
    group sums (as many as groups) replace the self-join.
    """
    unit = items.where(norm(F.col("vector")) > 0).select(by, l2_normalise(F.col("vector")).alias("u"))
    sums = unit.select(by, F.posexplode("u").alias("pos", "x")).groupBy(by, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    # one row a group; one side is cut into blocks and the other sent to each, so that pairs of groups - the result - are spread by an equi-join
    whole = sums.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("s"), F.max("n").alias("n"))
    a, b = whole.select(F.col(by).alias("group_a"), F.col("s").alias("sa"), F.col("n").alias("na"), F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int").alias("block")), whole.select(
        F.col(by).alias("group_b"), F.col("s").alias("sb"), F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    dots = F.aggregate(F.zip_with("sa", "sb", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    both = a.join(b, "block").where("group_a <= group_b").select("group_a", "group_b", dots.alias("dots"), "na", "nb")
    inside = (F.col("dots") - F.col("na")) / F.nullif(F.col("na") * (F.col("na") - 1), F.lit(0))
    return both.select("group_a", "group_b", F.when(F.col("group_a") == F.col("group_b"), 1 - inside).otherwise(1 - F.col("dots") / (F.col("na") * F.col("nb"))).alias("mean_distance"))
