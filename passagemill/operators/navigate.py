"""Rollups, neighbours and the rebuilding of sections and documents from stored passages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators.search import in_scope
from passagemill.plans.passages import SCHEME_VERSION, rejoined


def current(chunks: DataFrame) -> DataFrame:
    """One row per id, the latest ingested; older layouts get the columns they lack."""
    defaults = {"parent_id": F.lit(""), "ocr_engine": F.lit(""), "scheme_version": F.lit(0)}
    for name, value in defaults.items():
        chunks = chunks.withColumn(name, F.coalesce(F.col(name), value) if name in chunks.columns else value)
    latest = Window.partitionBy("id").orderBy(F.col("ingested_at").desc_nulls_last())
    return chunks.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")


def list_sources(chunks: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """One row per source: count, oldest scheme, first row's type, title, hash and time, and the
    first engine named.  Only metadata columns are read."""
    rows = chunks.where(in_scope(F.col("source"), scopes))
    first = F.min_by(F.struct("source_type", "title", "file_hash", "mtime"), F.struct("chunk_index", "id"))
    named = F.when(F.col("ocr_engine") != "", F.struct("chunk_index", "ocr_engine"))
    rolled = rows.groupBy("source").agg(F.count("*").alias("chunk_count"), F.min("scheme_version").alias("scheme_version"), first.alias("f"), F.min(named).alias("e"))
    return rolled.select("source", "f.source_type", "f.title", "f.file_hash", "f.mtime", "chunk_count", "scheme_version", F.coalesce("e.ocr_engine", F.lit("")).alias("ocr_engine"))


def counts(chunks: DataFrame) -> DataFrame:
    stale = F.sum((F.col("scheme_version") < SCHEME_VERSION).cast("int"))
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.coalesce(stale, F.lit(0)).alias("stale"))


def neighbours(chunks: DataFrame, anchors: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """``(source, anchor, chunk_index, text)``: the passages around each ``(source, chunk_index)``.

    An equi-join: each anchor names the places it wants.
    """
    lo = F.greatest(F.lit(0), F.col("chunk_index") - before)
    wanted = anchors.select("source", F.col("chunk_index").alias("anchor"), F.explode(F.sequence(lo, F.greatest(lo, F.col("chunk_index") + after))).alias("chunk_index"))
    return wanted.join(chunks.select("source", "chunk_index", "text"), ["source", "chunk_index"]).select("source", "anchor", "chunk_index", "text")


def _fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Passages of each group, in order, rebuilt to one text."""
    gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"))
    listed = gathered.select(*keys, F.transform("parts", lambda x: x["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([rejoined([t for t in x if t is not None]) for x in batch.column(batch.num_columns - 1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    kinds = dict(listed.dtypes)
    return listed.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "text string"]))


def parent_texts(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """``(parent_id, text)`` of the wanted, non-empty parents.  A parent is a section with a capped
    size, so its passages fit one row."""
    wanted = parents.select("parent_id").where("parent_id <> ''").distinct()
    return _fold(chunks.join(wanted, "parent_id", "left_semi"), ["parent_id"])


def document_parts(chunks: DataFrame) -> DataFrame:
    """``(source, first, text)``: the rebuilt sections of every document, in the order of ``first``,
    the index of their first passage.  A document is its parts with a blank line between them.

    A parent's passages follow each other, so they are one part; passages without a parent stay by
    themselves.  The groups are sections, whose size is capped, never whole sources.
    """
    part = F.when(F.col("parent_id") != "", F.col("parent_id")).otherwise(F.concat(F.lit("#"), F.col("id")))
    rows = chunks.withColumn("part", part)
    first = rows.groupBy("source", "part").agg(F.min("chunk_index").alias("first"))
    return _fold(rows, ["source", "part"]).join(first, ["source", "part"]).where("text <> ''").select("source", "first", "text")


def hit_sources(hits: DataFrame) -> DataFrame:
    """``(query_id, source, title, hits, best)``: the sources of each query's hits, best first."""
    return hits.groupBy("query_id", "source").agg(F.min_by("title", "place").alias("title"), F.count("*").alias("hits"), F.min("place").alias("best"))
