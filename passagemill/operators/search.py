"""Ranked retrieval: vector and keyword search, fusion, and the filters after it, for many queries at once.

Every function takes and gives DataFrames with a ``query_id``; a single query is a table of one
row.  Query tables are small and bounded by :data:`MAX_QUERIES`, which is checked before any of
them is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.vectors import any_of, squared_l2

RRF_K = 60
K1, B = 1.2, 0.75
MAX_QUERIES = 20_000
MAX_TERMS = 500_000  #: of all queries together
MAX_HITS = 500_000  #: hits that are broadcast to fetch their rows; beyond, the join shuffles
DEFAULT_TOP_K, MAX_TOP_K = 8, 100
TOKEN = r"[\p{L}\p{N}]+"


def in_scope(source: Column, prefixes: list[str] | None) -> Column:
    """Whether a source is one of the prefixes or lies under one; all are where there are none.
    Literal, pushed down to Parquet."""
    bases = [p.rstrip("/") for p in prefixes or []]
    return any_of([(source == b) | source.startswith(f"{b}/") for b in bases])


def fetch_size(top_k: int) -> int:
    return max(4 * top_k, 50)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def bounded(rows: DataFrame, most: int, what: str) -> DataFrame:
    """A table of queries or their terms for broadcasting, after its size was checked."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what} at once")
    return F.broadcast(rows)


def vector_search(chunks: DataFrame, queries: DataFrame, fetch: int, scopes: list[str] | None = None) -> DataFrame:
    """``(query_id, id, distance, vec_rank)``: the ``fetch`` nearest chunks of each query by squared
    L2, ranks from 0, ties by id.  The queries are stated rows against all rows, kept per task by
    ``WindowGroupLimit`` before anything is shuffled."""
    rows = chunks.where(in_scope(F.col("source"), scopes) & F.col("vector").isNotNull()).select("id", "vector")
    met = rows.join(bounded(queries.select("query_id", F.col("vector").alias("q")), MAX_QUERIES, "queries"), F.size("vector") == F.size("q"))
    scored = met.select("query_id", "id", squared_l2(F.col("vector"), F.col("q")).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fetch).withColumn("vec_rank", F.col("n") - 1).drop("n")


def postings(chunks: DataFrame, field: str) -> DataFrame:
    """``(id, term, tf, dl)`` of one field."""
    said = chunks.select("id", terms(F.coalesce(F.col(field), F.lit(""))).alias("terms")).withColumn("dl", F.size("terms"))
    return said.select("id", "dl", F.explode("terms").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def _asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def _scored(hits: DataFrame, wanted: DataFrame, totals: DataFrame, scopes: list[str] | None) -> DataFrame:
    """``(query_id, id, score)`` from the postings ``(field, term, id, source, tf, dl)`` of the wanted
    terms and the totals ``(field, n, avgdl)``: the score of the better field."""
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # Small sides: at most a row a term and field of the checked queries, and a row a field.
    met = hits.where(in_scope(F.col("source"), scopes)).join(F.broadcast(df), ["field", "term"]).join(F.broadcast(totals), "field").join(wanted, "term")
    return met.withColumn("part", part).groupBy("query_id", "id", "field").agg(F.sum("part").alias("score")).groupBy("query_id", "id").agg(F.max("score").alias("bm25"))


def bm25(chunks: DataFrame, queries: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """``(query_id, id, bm25)`` of the chunks that hold a term of the query in text or title, from the
    texts themselves.

    Statistics are global.  Only postings of the queries' terms are kept, before the first shuffle:
    the wanted terms are a bounded table, joined by broadcast on the exploded terms.
    """
    wanted = bounded(_asked_terms(queries), MAX_TERMS, "terms of queries")
    field = lambda f: F.struct(F.lit(f).alias("field"), terms(F.coalesce(F.col(f), F.lit(""))).alias("terms"))
    said = chunks.select("id", "source", F.explode(F.array(field("text"), field("title"))).alias("x")).select("id", "source", "x.field", "x.terms").withColumn("dl", F.size("terms"))
    totals = said.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = said.select("id", "source", "field", "dl", F.explode("terms").alias("term")).join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").groupBy("id", "source", "field", "term", "dl").agg(F.count("*").alias("tf"))
    return _scored(hits, wanted, totals, scopes)


def stored_bm25(listed: DataFrame, totals: DataFrame, queries: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """:func:`bm25` from stored postings, which lie by term within each file: no text is read."""
    wanted = bounded(_asked_terms(queries), MAX_TERMS, "terms of queries")
    hits = listed.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    return _scored(hits, wanted, totals, scopes)


def keyword_search(chunks: DataFrame, queries: DataFrame, fetch: int, scopes: list[str] | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(query_id, id, bm25, key_rank)``: text and title are scored apart; the larger counts.  With an
    ``index`` of stored postings and totals, ``chunks`` is not read."""
    best = stored_bm25(*index, queries, scopes) if index else bm25(chunks, queries, scopes)
    order = Window.partitionBy("query_id").orderBy(F.round("bm25", 9).desc(), "id")
    return best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fetch).withColumn("key_rank", F.col("n") - 1).drop("n")


def fuse(vectors: DataFrame, keywords: DataFrame | None, weight: float) -> DataFrame:
    """``(query_id, id, score, distance, rank)``: weighted reciprocal ranks, a missing side adding
    nothing.  With no weight on keywords the score is that of the distance alone."""
    if weight <= 0 or keywords is None:
        out = vectors.withColumn("key_rank", F.lit(None).cast("int")).withColumn("score", 1 / (1 + F.col("distance")))
        order = [F.col("vec_rank")]
    else:
        part = lambda side, w: F.coalesce(F.lit(w) / (RRF_K + F.col(side) + 1), F.lit(0.0))
        out = vectors.join(keywords, ["query_id", "id"], "full_outer").withColumn("score", part("vec_rank", 1 - weight) + part("key_rank", weight))
        order = [F.round("score", 12).desc(), F.col("vec_rank").asc_nulls_last(), F.col("key_rank")]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).select("query_id", "id", "score", "distance", "rank")


def within_distance(hits: DataFrame, most: float | None) -> DataFrame:
    """Hits without a distance, or with a larger one, go."""
    return hits if most is None else hits.where(F.col("distance") <= most)


def near_groups(hits: DataFrame, mode: str) -> DataFrame:
    """Keep the first (``similar``) or the first two (``related``) groups of distances.

    Groups are parted by gaps of more than twice the mean gap; with fewer than three distances or
    no gap at all, and for hits without a distance, everything stays.
    """
    most = {"similar": 1, "related": 2}[mode]
    per = Window.partitionBy("query_id")
    order = per.orderBy("distance", "rank")
    seen = hits.where("distance is not null").withColumn("gap", F.col("distance") - F.lag("distance").over(order))
    seen = seen.withColumn("n", F.count("*").over(per)).withColumn("mean", F.avg("gap").over(per))
    wide = F.when((F.col("n") >= 3) & (F.col("mean") > 0) & (F.col("gap") > 2 * F.col("mean")), 1).otherwise(0)
    kept = seen.withColumn("group", F.sum(wide).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("group") < most)
    return kept.select(*hits.columns).unionByName(hits.where("distance is null"))


def first_sources(hits: DataFrame, most: int | None) -> DataFrame:
    """Hits of the first ``most`` different sources in rank order."""
    if most is None:
        return hits
    first = hits.withColumn("first", F.min("rank").over(Window.partitionBy("query_id", "source")))
    return first.withColumn("nth", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first"))).where(F.col("nth") <= most).drop("first", "nth")


def top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search(chunks: DataFrame, queries: DataFrame, top_k: int = DEFAULT_TOP_K, weight: float = 0.6, scopes: list[str] | None = None, max_distance: float | None = None, grouping: str | None = None, max_files: int | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(query_id, place, id, source, title, chunk_index, text, parent_id, score, distance)``.

    ``queries`` has ``query_id, text, vector``; ``index`` is what the store keeps for keywords.  The order of the filters is fixed: distance,
    groups, files, top k.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    top_k = min(top_k, MAX_TOP_K)
    n = fetch_size(top_k)
    vectors = vector_search(chunks, queries, n, scopes)
    keywords = keyword_search(chunks, queries, n, scopes, index) if weight > 0 else None
    hits = within_distance(fuse(vectors, keywords, weight), max_distance)
    if grouping:
        hits = near_groups(hits, grouping)
    shown = chunks.select("id", "source", "title", "chunk_index", "text", "parent_id")
    few = queries.count() * 2 * n <= MAX_HITS  # at most 2 n hits a query, whatever the chunks are
    named = shown.join(F.broadcast(hits) if few else hits, "id")
    return top(first_sources(named, max_files), top_k).select("query_id", "place", "id", "source", "title", "chunk_index", "text", "parent_id", "score", "distance")
