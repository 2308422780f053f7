"""Lexical, semantic and hybrid ranking of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from switchback.functions.text import keyword_tokens, search_tokens
from switchback.functions.vectors import cosine

K1, B, ALPHA = 1.2, 0.3, 0.6


def keyword_rank(docs: DataFrame, query: str, k: int = 5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Documents by the number of query words they hold as whole words, ties by id: ``(id, hits)``."""
    words = docs.sparkSession.range(1).select(keyword_tokens(F.lit(query)).alias("w")).first().w
    hits = sum((F.lower(F.col(text_col)).rlike(rf"\b{w}\b").cast("int") for w in words), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(hits, F.lit(0)).alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(k)


def _equals(word: str):
    return lambda x: x == F.lit(word)


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """``(id, score)`` for every document, 0 without a match.

    Only the query's tokens are counted, inside each row, so nothing is exploded; the corpus statistics are
    one aggregation of as many numbers as the query has terms.
    """
    terms = list(dict.fromkeys(docs.sparkSession.range(1).select(search_tokens(F.lit(query)).alias("w")).first().w))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(search_tokens(F.col(text_col)), F.array().cast("array<string>")).alias("t")).select(
        "id", F.size("t").cast("double").alias("len"), *[F.size(F.filter("t", _equals(w))).cast("double").alias(f"tf{i}") for i, w in enumerate(terms)]
    )
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))).otherwise(0.0)
    # one row of statistics: bounded by the query, whatever the corpus
    return rows.join(F.broadcast(stats), how="cross").select("id", score.alias("score"))


def min_max(scores: DataFrame, col: str = "score", out: str = "norm") -> DataFrame:
    """Scores scaled to 0..1 over the table; all 0 if they do not differ."""
    ends = scores.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return scores.join(F.broadcast(ends), how="cross").withColumn(out, F.when(span > 1e-9, (F.col(col) - F.col("_lo")) / span).otherwise(0.0)).drop("_lo", "_hi")


def blend(semantic: Column, lexical: Column, alpha: float = ALPHA) -> Column:
    return F.lit(alpha) * semantic + F.lit(1 - alpha) * lexical


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], alpha: float = ALPHA) -> DataFrame:
    """``(id, cosine, semantic_norm, lexical, lexical_norm, combined)`` of ``docs(id, text)`` and ``vectors(id, vector)``."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    semantic = min_max(vectors.select("id", cosine(F.col("vector"), q).alias("cosine")), "cosine", "semantic_norm")
    lexical = min_max(bm25(docs, query).withColumnRenamed("score", "lexical"), "lexical", "lexical_norm")
    return semantic.join(lexical, "id").withColumn("combined", blend(F.col("semantic_norm"), F.col("lexical_norm"), alpha))


def ranked(hits: DataFrame, k: int, by: str = "combined", per: str | None = None) -> DataFrame:
    """The k best with ``rank`` and ``margin`` to the next; ties by id; ``per``: one ranking per value of a column."""
    if per is None:
        top = hits.orderBy(F.desc(by), "id").limit(k + 1)
        w = Window.orderBy(F.desc(by), "id")
    else:
        w = Window.partitionBy(per).orderBy(F.desc(by), "id")
        top = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")
    return top.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col(by) - F.lead(by).over(w)).where(F.col("rank") <= k)


def context(hits: DataFrame) -> DataFrame:
    """One row: the retrieved texts in rank order, for a prompt."""
    part = F.format_string("chunk_id:%s\nsource:%s\n%s", "id", "source", "text")
    return hits.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


def recall_at_k(hits: DataFrame, wanted: DataFrame, alphas: list[float], k: int) -> DataFrame:
    """Recall and mean margin by alpha over ``hits(question, id, semantic_norm, lexical_norm)`` and ``wanted(question, id)``."""
    spread = hits.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    spread = spread.withColumn("combined", F.col("alpha") * F.col("semantic_norm") + (1 - F.col("alpha")) * F.col("lexical_norm")).withColumn("_q", F.struct("alpha", "question"))
    top = ranked(spread, k, per="_q")
    met = top.join(wanted.withColumn("met", F.lit(1)), ["question", "id"], "left")
    per = met.groupBy("alpha", "question").agg(F.max("met").alias("met"), F.max(F.when(F.col("rank") == 1, F.col("margin"))).alias("margin"))
    return per.groupBy("alpha").agg(F.avg(F.coalesce("met", F.lit(0))).alias("recall"), F.avg("margin").alias("mean_margin"))
