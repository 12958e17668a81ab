"""Queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import titles, tokens, vectors
from passagemill.operators import navigate, reconcile, search
from passagemill.plans.passages import passage_stage
from passagemill.sources.files import html_to_markdown
from passagemill.sources.guard import url_verdicts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SCOPES = ["/corpus/en/it", "/corpus/de/", "/corpus/fr/legal"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.current(table(spark, sf_dir, "chunks"))


# The rows of chunks as the engine reads them: one per id, missing values filled in.
CURRENT = """cur AS (SELECT * EXCLUDE (parent_id, ocr_engine, scheme_version, nth), coalesce(parent_id, '') AS parent_id, coalesce(ocr_engine, '') AS ocr_engine, coalesce(scheme_version, 0) AS scheme_version
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS nth FROM chunks) WHERE nth = 1)"""


# A fold over lines: the open fence, a mark, and the text so far with images outside fences stripped.
_FENCE_STEP = r"""(CASE WHEN split_part(acc, chr(2), 1) = '' THEN regexp_extract(x, '^[ \t]*(`{3,}|~{3,})', 1) WHEN starts_with(ltrim(x, ' ' || chr(9)), split_part(acc, chr(2), 1)) THEN '' ELSE split_part(acc, chr(2), 1) END)
 || substr(acc, strpos(acc, chr(2))) || chr(10) || (CASE WHEN split_part(acc, chr(2), 1) = '' AND NOT regexp_matches(x, '^[ \t]*(`{3,}|~{3,})') THEN regexp_replace(x, '!\[[ \t]*([^\]\n]*?)[ \t]*\]\([ \t]*data:[^)\n]*\)', '\1', 'g') ELSE x END)"""


# ---- scalar functions -----------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, CAST(ceil(letters / 2.5) + (length(text) - letters) + 2 AS INTEGER) AS tokens
FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\p{L}\p{Nl}\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]', '', 'g')) AS letters FROM documents)"""
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.estimate_column(F.col("text")).alias("tokens"))


@query(
    """SELECT doc_id, list_transform([1, 9, 17, 25, 33, 41, 49, 57], lambda i: round(v[CAST((i + 7) / 8 AS INTEGER)] / n, 6)) AS vector FROM (
  SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
    SELECT doc_id, list_transform([1, 9, 17, 25, 33, 41, 49, 57], lambda i: CAST(('0x' || substr(sha256(text), CAST(i AS INTEGER), 8))::BIGINT AS DOUBLE) / 4294967296.0 - 0.5) AS v FROM documents))"""
)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", vectors.hash_embedding(F.col("text")).alias("v"))
    return rows.select("doc_id", F.transform("v", lambda x: F.round(x, 6)).alias("vector"))


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
  round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine
FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"""
)
def vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    first = rows.where("vec_id = 0").agg(F.first("embedding").alias("q")).scalar()
    v, q = F.col("embedding"), F.col("q")
    return rows.withColumn("q", first).select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.cosine(v, q), 6).alias("cosine"))


@query(
    r"""SELECT doc_id, coalesce(h1, '') AS h1, strip_images, display, informative FROM (
  SELECT doc_id, nullif(regexp_extract(regexp_replace(regexp_replace(text, '(?s)(^|\n)[ \t]*```.*?(\n[ \t]*```[ \t]*(\n|$)|$)', chr(10), 'g'), '(?s)(^|\n)[ \t]*~~~.*?(\n[ \t]*~~~[ \t]*(\n|$)|$)', chr(10), 'g'), '(?m)^#[ \t]+(\S.*?)[ \t]*$', 1), '') AS h1,
    length(CASE WHEN trim(regexp_replace(stripped, '\s+', ' ', 'g')) = '' THEN text ELSE stripped END) AS strip_images,
    trim(regexp_replace(replace(coalesce(title, ''), '_', ' '), '\s+', ' ', 'g')) AS display,
    length(regexp_replace(coalesce(title, ''), '[\s_\-.]+', '', 'g')) >= 4 AND len(list_filter(regexp_extract_all(lower(coalesce(title, '')), '\p{L}+|\p{Nd}+'), lambda w: NOT regexp_matches(w, '^\p{Nd}+$')
      AND w NOT IN ({GENERIC}))) > 0 AS informative
  FROM (SELECT *, substr(folded, strpos(folded, chr(2)) + 2) AS stripped FROM (SELECT *, list_reduce(string_split(text, chr(10)), lambda acc, x: {STEP}, chr(2)) AS folded FROM documents)))""".replace("{GENERIC}", ", ".join(f"'{w}'" for w in titles.GENERIC_STEM_WORDS)).replace("{STEP}", _FENCE_STEP)
)
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.coalesce("title", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(titles.first_h1(F.col("text")), F.lit("")).alias("h1"),
        F.length(titles.strip_data_images(F.col("text"))).cast("bigint").alias("strip_images"),
        titles.display_stem(title).alias("display"),
        titles.informative(title).alias("informative"),
    )


@query()
def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "parsed_docs").dropDuplicates(["source"])
    meta = F.when(F.col("has_title"), F.col("title"))
    return docs.select("source", titles.file_title(meta, F.col("markdown"), F.col("source")).alias("title"))


@query(
    """WITH """ + CURRENT + """ SELECT DISTINCT source, CASE WHEN starts_with(source, '/corpus/en/it/') THEN substr(source, 15) WHEN starts_with(source, '/corpus/') THEN substr(source, 9) ELSE source END AS display FROM cur WHERE source IS NOT NULL"""
)
def display_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = chunks(spark, sf_dir).select("source").where("source is not null").distinct()
    return sources.select("source", titles.display_path(F.col("source"), ["/corpus", "/corpus/en/it"]).alias("display"))


# ---- filters --------------------------------------------------------------------------------------


@query(
    "WITH " + CURRENT + """ SELECT id FROM cur WHERE source = '/corpus/en/it' OR starts_with(source, '/corpus/en/it/') OR source = '/corpus/de' OR starts_with(source, '/corpus/de/') OR source = '/corpus/fr/legal' OR starts_with(source, '/corpus/fr/legal/')"""
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(search.in_scope(F.col("source"), SCOPES)).select("id")


# ---- rollups and navigation -----------------------------------------------------------------------


@query(
    "WITH " + CURRENT + """ SELECT source, count(*) AS chunk_count, min(scheme_version) AS scheme_version, arg_min(source_type, (chunk_index, id)) AS source_type, arg_min(coalesce(title, ''), (chunk_index, id)) AS title,
  coalesce(arg_min(CASE WHEN ocr_engine <> '' THEN ocr_engine END, CASE WHEN ocr_engine <> '' THEN (chunk_index, ocr_engine) END), '') AS ocr_engine FROM cur GROUP BY source"""
)
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = navigate.list_sources(chunks(spark, sf_dir))
    return rolled.select("source", "chunk_count", "scheme_version", "source_type", F.coalesce("title", F.lit("")).alias("title"), "ocr_engine")


@query("WITH " + CURRENT + " SELECT count(*) AS chunks, count(DISTINCT source) AS sources, CAST(sum(CASE WHEN scheme_version < 3 THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM cur")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.counts(chunks(spark, sf_dir))


@query(
    "WITH " + CURRENT + """ SELECT a.source, a.chunk_index AS anchor, c.chunk_index, c.text FROM (SELECT DISTINCT source, chunk_index FROM cur) a JOIN cur c ON c.source = a.source AND c.chunk_index BETWEEN greatest(0, a.chunk_index - 1) AND a.chunk_index + 2"""
)
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return navigate.neighbours(rows, rows.select("source", "chunk_index").distinct(), before=1, after=2)


# The rebuilding of texts as SQL: lines in common with the passage before go, then a fold that joins.
_REJOINED = r"""u AS (SELECT *, string_split(text, chr(10)) AS l, lag(string_split(text, chr(10))) OVER (PARTITION BY {key} ORDER BY chunk_index, text) AS p FROM rows WHERE regexp_matches(text, '\S')),
c AS (SELECT *, least(4, len(l) - 1, coalesce(len(p), 0)) AS most FROM u),
s AS (SELECT *, CASE WHEN most >= 4 AND l[1:4] = p[1:4] THEN 4 WHEN most >= 3 AND l[1:3] = p[1:3] THEN 3 WHEN most >= 2 AND l[1:2] = p[1:2] THEN 2 WHEN most >= 1 AND l[1] = p[1] THEN 1 ELSE 0 END AS same FROM c),
o AS (SELECT *, CASE WHEN p IS NULL THEN text ELSE regexp_replace(array_to_string(l[same + 1:], chr(10)), '^([^\S\n]*\n)+', '') END AS own FROM s),
f AS (SELECT {key}, min(chunk_index) AS first, list_filter(list(own ORDER BY chunk_index, text), lambda x: x <> '' AND regexp_matches(x, '\S')) AS owns FROM o GROUP BY {key}),
j AS (SELECT {key}, first, list_reduce(owns, lambda acc, x: rtrim(acc, chr(10)) || (CASE WHEN regexp_matches(string_split(rtrim(acc, chr(10)), chr(10))[-1], '^[ \t]*(?:\*\*[^*\n]{1,80}\*\*[ \t]+)?((?:\d{1,2}:)?\d{1,2}:\d{2})[ \t]*$')
   OR (regexp_matches(string_split(rtrim(acc, chr(10)), chr(10))[-1], '^[ \t]*\|.*\|[ \t]*$') AND regexp_matches(string_split(x, chr(10))[1], '^[ \t]*\|.*\|[ \t]*$')) THEN chr(10) ELSE chr(10) || chr(10) END) || x) AS text FROM f WHERE len(owns) > 0)"""


@query("WITH " + CURRENT + ",\nrows AS (SELECT parent_id, chunk_index, text FROM cur WHERE parent_id <> ''),\n" + _REJOINED.replace("{key}", "parent_id") + " SELECT parent_id, text FROM j")
def parent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return navigate.parent_texts(rows, rows)


@query("WITH " + CURRENT + ",\nrows AS (SELECT source, CASE WHEN parent_id <> '' THEN parent_id ELSE '#' || id END AS part, chunk_index, text FROM cur),\n" + _REJOINED.replace("{key}", "source, part") + " SELECT source, first, text FROM j WHERE text <> ''")
def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.document_parts(chunks(spark, sf_dir))


# ---- passages -------------------------------------------------------------------------------------


@query()
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = docs.select(F.concat_ws("/", "source", "doc_id").alias("source"), "title", F.col("title").isNotNull().alias("seed_title"), F.col("text").alias("markdown"))
    return passage_stage(made).where("error is null").drop("error")


@query()
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the index: cut, numbered and embedded."""
    docs = table(spark, sf_dir, "parsed_docs").dropDuplicates(["source"])
    title = titles.file_title(F.when(F.col("has_title"), F.col("title")), F.col("markdown"), F.col("source"))
    made = passage_stage(docs.select("source", title.alias("title"), F.lit(True).alias("seed_title"), titles.strip_data_images(F.col("markdown")).alias("markdown")))
    vector = F.transform(vectors.hash_embedding(F.col("text")), lambda x: F.round(x, 6))
    return made.where("error is null").select(F.concat_ws("#", "source", "chunk_index").alias("id"), "source", "title", "chunk_index", "text", vector.alias("vector"), "parent_id")


@query(
    r"""SELECT doc_id, CASE WHEN stamps >= 5 AND stamps >= 0.15 * filled THEN 'transcript' WHEN slides >= 2 THEN 'slides' WHEN CAST(split_part(folded, chr(2), 2) AS INTEGER) >= 2 THEN 'headings' ELSE 'generic' END AS category FROM (
  SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '\S'))) AS filled, len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*(?:\*\*[^*\n]{1,80}\*\*[ \t]+)?((?:\d{1,2}:)?\d{1,2}:\d{2})[ \t]*$'))) AS stamps,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*<!--\s*Slide number:\s*(\d+)\s*-->[ \t]*$'))) AS slides,
    list_reduce(l, lambda acc, x: (CASE WHEN split_part(acc, chr(2), 1) = '' THEN regexp_extract(x, '^\s*(`{3,}|~{3,})', 1) WHEN starts_with(ltrim(x, ' ' || chr(9)), split_part(acc, chr(2), 1)) THEN '' ELSE split_part(acc, chr(2), 1) END)
      || chr(2) || CAST(CAST(split_part(acc, chr(2), 2) AS INTEGER) + (CASE WHEN split_part(acc, chr(2), 1) = '' AND regexp_matches(x, '^#{1,6}[ \t]') THEN 1 ELSE 0 END) AS VARCHAR), chr(2) || '0') AS folded
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""
)
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.plans.passages import detect_category

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([detect_category(t or "") for t in batch.column(1).to_pylist()], type=pa.string())], names=["doc_id", "category"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, category string")


# ---- search ---------------------------------------------------------------------------------------
# Queries: the rows of embeddings and documents whose id is divisible by 50, against all rows.


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the embedding of the same number, as chunks of the engine."""
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    met = docs.join(vecs.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    return met.select(F.col("doc_id").alias("id"), "source", "title", F.lit(0).alias("chunk_index"), "text", "vector", F.lit("").alias("parent_id"))


def _asked(rows: DataFrame) -> DataFrame:
    words = F.array_join(F.slice(search.terms(F.col("text")), 1, 6), " ")
    return rows.where((F.col("id") % 50 == 0) & F.col("vector").isNotNull()).select(F.col("id").alias("query_id"), words.alias("text"), "vector")


_VECTOR = r"""p AS (SELECT d.doc_id AS id, d.source, d.title, d.text, e.embedding AS vector FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
q AS (SELECT id AS query_id, vector AS qv, array_to_string(list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1, 6), ' ') AS qt FROM p WHERE id % 50 = 0 AND vector IS NOT NULL),
v AS (SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS vec_rank FROM (
  SELECT query_id, id, list_sum(list_transform(list_zip(vector, qv), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance FROM p, q WHERE vector IS NOT NULL)) WHERE vec_rank < {n})"""
_KEYWORD = r"""w AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(qt, '[\p{L}\p{N}]+')) AS term FROM q),
f AS (SELECT id, 'text' AS field, coalesce(text, '') AS said FROM p UNION ALL SELECT id, 'title', coalesce(title, '') FROM p),
t AS (SELECT id, field, regexp_extract_all(lower(said), '[\p{L}\p{N}]+') AS terms FROM f),
s AS (SELECT field, count(*) AS n, avg(len(terms)) AS avgdl FROM t GROUP BY field),
h AS (SELECT id, field, term, len(any_value(terms)) AS dl, count(*) AS tf FROM (SELECT id, field, terms, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM w) GROUP BY id, field, term),
d AS (SELECT field, term, count(*) AS df FROM h GROUP BY field, term),
b AS (SELECT query_id, id, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN d USING (field, term) JOIN s USING (field) JOIN w USING (term) GROUP BY query_id, id, field),
m AS (SELECT query_id, id, max(score) AS bm25 FROM b GROUP BY query_id, id),
k AS (SELECT * FROM (SELECT query_id, id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) - 1 AS key_rank FROM m) WHERE key_rank < {n})"""
_FUSED = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_rank NULLS LAST, key_rank) - 1 AS rank FROM (
  SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id, distance, vec_rank, key_rank, coalesce({a} / (60 + vec_rank + 1), 0.0) + coalesce({b} / (60 + key_rank + 1), 0.0) AS score
  FROM v FULL OUTER JOIN k ON v.query_id = k.query_id AND v.id = k.id))"""


def _fused_sql(weight: float, top_k: int) -> str:
    n = max(4 * top_k, 50)
    parts = [_VECTOR.replace("{n}", str(n)), _KEYWORD.replace("{n}", str(n)), _FUSED.replace("{a}", str(round(1 - weight, 6))).replace("{b}", str(weight))]
    return "WITH " + ",\n".join(parts)


@query(
    r"""SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id AS id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)) GROUP BY id, term"""
)
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return search.postings(rows, "text").withColumn("dl", F.col("dl").cast("bigint"))


@query("WITH " + _VECTOR.replace("{n}", "50") + " SELECT query_id, id, round(distance, 6) AS distance, vec_rank FROM v")
def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return search.vector_search(rows, _asked(rows), 50).select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("vec_rank").cast("bigint").alias("vec_rank"))


@query("WITH " + _VECTOR.replace("{n}", "50") + ",\n" + _KEYWORD.replace("{n}", "50") + " SELECT query_id, id, round(bm25, 6) AS bm25, key_rank FROM k")
def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return search.keyword_search(rows, _asked(rows), 50).select("query_id", "id", F.round("bm25", 6).alias("bm25"), F.col("key_rank").cast("bigint").alias("key_rank"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("place").cast("bigint").alias("place"), "id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


_TOP = " SELECT query_id, rank + 1 AS place, id, round(score, 6) AS score, round(distance, 6) AS distance FROM r WHERE rank < 8"


@query(_fused_sql(0.6, 8) + _TOP)
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _shown(search.search(rows, _asked(rows)))


@query(_fused_sql(0.6, 8).replace("FROM p, q WHERE vector IS NOT NULL", "FROM p, q WHERE vector IS NOT NULL AND (source = '/corpus/en' OR starts_with(source, '/corpus/en/'))").replace("JOIN w USING (term) GROUP BY", "JOIN w USING (term) JOIN p USING (id) WHERE (p.source = '/corpus/en' OR starts_with(p.source, '/corpus/en/')) GROUP BY") + _TOP)
def search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _shown(search.search(rows, _asked(rows), scopes=["/corpus/en/"]))


@query(_fused_sql(1.0, 8) + _TOP)
def search_keywords_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _shown(search.search(rows, _asked(rows), weight=1.0))


@query("WITH " + _VECTOR.replace("{n}", "50") + " SELECT query_id, vec_rank + 1 AS place, id, round(1 / (1 + distance), 6) AS score, round(distance, 6) AS distance FROM v WHERE vec_rank < 8")
def search_vectors_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _shown(search.search(rows, _asked(rows), weight=0.0))


@query(_fused_sql(0.6, 8) + " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, id, round(score, 6) AS score, round(distance, 6) AS distance FROM r WHERE distance <= 1.2 QUALIFY place <= 8")
def search_within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _shown(search.search(rows, _asked(rows), max_distance=1.2))


def _grouped_sql(most: int) -> str:
    return _fused_sql(0.6, 12) + f""",
g AS (SELECT *, distance - lag(distance) OVER (PARTITION BY query_id ORDER BY distance, rank) AS gap, count(*) OVER (PARTITION BY query_id) AS n FROM r WHERE distance IS NOT NULL),
gm AS (SELECT *, avg(gap) OVER (PARTITION BY query_id) AS mean FROM g),
gg AS (SELECT *, sum(CASE WHEN n >= 3 AND mean > 0 AND gap > 2 * mean THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY distance, rank ROWS UNBOUNDED PRECEDING) AS grp FROM gm),
kept AS (SELECT query_id, id, score, distance, rank FROM gg WHERE grp < {most} UNION ALL SELECT query_id, id, score, distance, rank FROM r WHERE distance IS NULL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, id, round(score, 6) AS score, round(distance, 6) AS distance FROM kept QUALIFY place <= 12"""


@query(_grouped_sql(1))
def search_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _shown(search.search(rows, _asked(rows), top_k=12, grouping="similar"))


@query(_grouped_sql(2))
def search_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _shown(search.search(rows, _asked(rows), top_k=12, grouping="related"))


@query(
    _fused_sql(0.6, 8) + """,
n1 AS (SELECT r.*, p.source, min(rank) OVER (PARTITION BY query_id, source) AS first FROM r JOIN p USING (id)),
n2 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS nth FROM n1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, id, round(score, 6) AS score, round(distance, 6) AS distance FROM n2 WHERE nth <= 3 QUALIFY place <= 8"""
)
def search_few_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return _shown(search.search(rows, _asked(rows), max_files=3))


@query(
    _fused_sql(0.6, 8) + """,
x AS (SELECT r.query_id, rank + 1 AS place, p.source, p.title FROM r JOIN p USING (id) WHERE rank < 8)
SELECT query_id, source, coalesce(arg_min(coalesce(title, ''), place), '') AS title, count(*) AS hits, min(place) AS best FROM x GROUP BY query_id, source"""
)
def search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    hits = search.search(rows, _asked(rows)).withColumn("title", F.coalesce("title", F.lit("")))
    return navigate.hit_sources(hits).withColumn("best", F.col("best").cast("bigint"))


# ---- reconciliation -------------------------------------------------------------------------------

_INDEXED = (
    "WITH " + CURRENT + """,
idx AS (SELECT source, min(scheme_version) AS scheme_version, arg_min(source_type, (chunk_index, id)) AS source_type, arg_min(mtime, (chunk_index, id)) AS mtime FROM cur GROUP BY source),
files AS (SELECT * FROM idx WHERE source_type = 'file'),
disk AS (SELECT path, CAST(max((mtime, size))[1] AS DOUBLE) AS mtime, max((mtime, size))[2] AS size FROM scan_entries GROUP BY path)"""
)


@query(
    _INDEXED + """ SELECT coalesce(path, source) AS source, CASE WHEN path IS NULL THEN 'delete' WHEN size > 500000 THEN 'oversized' WHEN source IS NULL OR scheme_version < 3 THEN 'ingest' WHEN disk.mtime = files.mtime THEN 'unchanged' ELSE 'ingest' END AS action
FROM disk FULL OUTER JOIN files ON path = source"""
)
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = navigate.list_sources(chunks(spark, sf_dir))
    return reconcile.sync_diff(table(spark, sf_dir, "scan_entries"), indexed, max_file_size=500_000)


@query(
    _INDEXED + """ SELECT path AS source, CASE WHEN source IS NULL THEN 'not_ingested' WHEN disk.mtime = files.mtime THEN CASE WHEN scheme_version < 3 THEN 'stale_scheme' ELSE 'ingested' END ELSE 'stale' END AS state
FROM disk LEFT JOIN files ON path = source UNION ALL SELECT source, CASE WHEN scheme_version < 3 THEN 'stale_scheme' ELSE 'ingested' END FROM idx WHERE source_type <> 'file'"""
)
def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = navigate.list_sources(chunks(spark, sf_dir))
    return reconcile.file_states(table(spark, sf_dir, "scan_entries"), indexed)


@query(
    "WITH " + CURRENT + """ SELECT id, source FROM cur WHERE NOT (source = '/corpus/en/it' OR starts_with(source, '/corpus/en/it/')) AND source IS NOT NULL
UNION ALL SELECT upper(id), source FROM cur WHERE source = '/corpus/en/it' OR starts_with(source, '/corpus/en/it/')"""
)
def replaced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).where("source is not null")
    fresh = rows.where(search.in_scope(F.col("source"), ["/corpus/en/it"])).withColumn("id", F.upper("id"))
    return reconcile.replace_sources(rows, fresh, fresh).select("id", "source")


# ---- sources --------------------------------------------------------------------------------------


@query(
    r"""SELECT DISTINCT source AS url, CASE WHEN regexp_matches(source, '^https?://[^/]+') THEN 'ok' WHEN regexp_matches(source, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'scheme ' || lower(regexp_extract(source, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) ELSE 'scheme none' END AS verdict FROM chunks WHERE source IS NOT NULL AND regexp_full_match(source, '[\x20-\x7e]*')"""
)
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "chunks").where(F.col("source").isNotNull() & F.col("source").rlike(r"^[\x20-\x7e]*$"))
    return url_verdicts(urls.select(F.col("source").alias("url")).distinct())


@query()
def url_guard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every source, in any script; ``url_guard`` is the part that its SQL can say."""
    urls = table(spark, sf_dir, "chunks").where("source is not null")
    return url_verdicts(urls.select(F.col("source").alias("url")).distinct())


@query()
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [html_to_markdown(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for m, _ in made], type=pa.string()), pa.array([t for _, t in made], type=pa.string())], names=["source", "markdown", "title"])

    pages = table(spark, sf_dir, "parsed_docs").where(F.col("markdown").rlike(r"(?i)<(p|div|h[1-6]|table|ul|ol)\b")).dropDuplicates(["source"])
    return pages.select("source", "markdown").mapInArrow(run, "source string, markdown string, title string")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
