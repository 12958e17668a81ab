"""Queries of the corpus operators over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.llm.common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.transcripts import speaker_turns

    turns = speaker_turns(table(spark, sf_dir, "sections"), table(spark, sf_dir, "speakers"))
    return turns.select("parent_id", "turn_no", "speaker_no", "start_second")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.word_sets import near_duplicate_pairs

    return near_duplicate_pairs(table(spark, sf_dir, "chunks"), threshold=0.7, shingle=1)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.word_sets import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), id_col="doc_id")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.languages import detect_languages, fit

    chunks = table(spark, sf_dir, "chunks")
    model = fit(chunks, table(spark, sf_dir, "chunk_labels"), "id", "text", "lang")
    return detect_languages(chunks.dropDuplicates(["id"]), model)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.languages import wrong_labels

    return wrong_labels(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_labels"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.markup import labelled_blocks

    found = [
        labelled_blocks(table(spark, sf_dir, tab), key, text).select(F.lit(tab).alias("tab"), F.col("key").alias("record_key"), "block_no", "kind")
        for tab, key, text in (("chunks", "id", "text"), ("parsed_docs", "source", "markdown"))
    ]
    return found[0].unionByName(found[1])


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.markup import clean_text

    return clean_text(table(spark, sf_dir, "parsed_docs"), "source", "markdown")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.vector_join import nearest_vectors

    near = nearest_vectors(table(spark, sf_dir, "chunks"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.scans import scan_findings

    return scan_findings(table(spark, sf_dir, "chunks"))


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.scans import repair_scans

    return repair_scans(table(spark, sf_dir, "chunks"))


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.same_look import one_form

    return one_form(table(spark, sf_dir, "chunks"), ["source", "title"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.same_look import same_looking

    return same_looking(table(spark, sf_dir, "chunks"), ["source", "title"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.leaks import leaked

    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("run >= 12").select("doc_id", "item_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.leaks import leaked

    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("score >= 20")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep: every document placed once or in numbered pieces, no container over its
    capacity, all but the last piece of a document full."""
    from passagemill.llm.packing import CAPACITY, pack_documents

    placed = pack_documents(table(spark, sf_dir, "documents"))
    over = placed.groupBy("container").agg(F.sum("tokens").alias("n")).where(F.col("n") > CAPACITY).count()
    full = F.coalesce(F.sum(F.when(F.col("tokens") == CAPACITY, 1)), F.lit(0))
    per = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("pieces"), F.max("piece").alias("last"), full.alias("full"))
    kept = (F.col("n") == F.col("pieces")) & (F.col("last") == F.col("n") - 1) & (F.col("full") >= F.col("n") - 1)
    return per.select("doc_id", kept.alias("kept"), F.lit(over).cast("bigint").alias("over"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.llm.splitting import split_documents

    return split_documents(table(spark, sf_dir, "documents"))


def p10_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What splitting must keep: pieces from the first character to the last without a gap, none over
    the limit."""
    from passagemill.llm.splitting import LIMIT, split_documents

    docs = table(spark, sf_dir, "documents")
    order = Window.partitionBy("doc_id").orderBy("piece")
    pieces = split_documents(docs).select("doc_id", "piece", "start", "end", "tokens").withColumn("gap", F.col("start") > F.lag("end", 1, 0).over(order))
    per = pieces.groupBy("doc_id").agg(F.max("end").alias("end"), F.max("gap").alias("gap"), F.sum((F.col("tokens") > LIMIT).cast("bigint")).alias("over"))
    return per.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").select("doc_id", (~F.col("gap") & (F.col("end") == F.col("n"))).alias("kept"), "over")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


# By brute force; the others are tested against definitions on fixtures, since SQL cannot say them.
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
SQL = {
    "p8_whole": "SELECT doc_id, true AS kept, CAST(0 AS BIGINT) AS over FROM documents",
    "p10_whole": "SELECT doc_id, true AS kept, CAST(0 AS BIGINT) AS over FROM documents WHERE text <> ''",
    "p2_found": f"""WITH w AS (SELECT DISTINCT id, unnest({_WORDS}) AS w FROM (SELECT DISTINCT id, text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL)),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
j AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM j JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9""",
    "p5_found": """WITH v AS (SELECT id, any_value(CAST(vector AS DOUBLE[])) AS v FROM chunks WHERE id IS NOT NULL AND len(vector) = 64 AND list_sum(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY id),
r AS (SELECT a.id AS x, b.id AS y, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS nth FROM v a JOIN v b ON a.id <> b.id)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE nth <= 5""",
    "p9_found": f"""WITH i AS (SELECT item_id, {_WORDS} AS t FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, {_WORDS} AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, array_to_string(list_slice(t, k, k + 11), ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 10)) AS k FROM i)),
h AS (SELECT DISTINCT doc_id, array_to_string(list_slice(t, k, k + 11), ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
