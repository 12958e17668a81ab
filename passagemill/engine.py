"""The engine: what a user of the index calls."""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.config import EngineConfig
from passagemill.functions import titles, vectors
from passagemill.functions.tokens import estimate
from passagemill.operators import navigate, reconcile, search
from passagemill.plans.passages import SCHEME_VERSION, Count, passage_stage
from passagemill.sources import fetch as web
from passagemill.sources import files, guard
from passagemill.sources.store import SCHEMA, IndexStore
from passagemill.sync import SyncManager, sync_lock


class EmptyDocumentError(ValueError):
    """A document without any passage."""


class Engine:
    """``embed`` turns a text column into a vector column, and ``count`` gives a text's tokens; both
    can be replaced by a model's."""

    def __init__(self, spark: SparkSession, config: EngineConfig, embed=None, count: Count = estimate):
        self.spark, self.config, self.count = spark, config, count
        self.embed = embed or (lambda text: vectors.hash_embedding(text).cast("array<float>"))
        self.store = IndexStore(spark, config.index_path, config.dim)
        self.jobs = SyncManager(config.index_path, self._sync)

    # -- writing --------------------------------------------------------------------------------

    def rows(self, documents: DataFrame) -> DataFrame:
        """Index rows, and rows with an ``error``, from ``(source, source_type, title, seed_title,
        markdown, file_hash, mtime, ocr_engine)``."""
        made = passage_stage(documents, self.count, self.config.token_budget)
        facts = documents.select("source", "source_type", "file_hash", "mtime", "ocr_engine")
        joined = made.join(facts, "source")
        return joined.select(
            F.concat_ws("#", "source", F.col("chunk_index").cast("string")).alias("id"), "source", "source_type", "title", "chunk_index", "text",
            F.when(F.col("text").isNotNull(), self.embed(F.col("text"))).alias("vector"), "file_hash", "mtime",
            F.lit(datetime.now(UTC).isoformat()).alias("ingested_at"), "parent_id", F.coalesce("ocr_engine", F.lit("")).alias("ocr_engine"), F.lit(SCHEME_VERSION).alias("scheme_version"), "error",
        )

    def _write(self, documents: DataFrame) -> tuple[int, list[dict]]:
        """One distributed stage for all documents, one commit; failed ones keep their old rows."""
        made = self.rows(documents).cache()
        try:
            errors = [{"source": r["source"], "error": r["error"]} for r in made.where("error is not null").select("source", "error").toLocalIterator()]
            good = made.where("error is null").drop("error")
            done = good.select("source").distinct()
            n = done.count()
            if n:
                self.store.replace(good.select(*SCHEMA.fieldNames()), done)
            return n, errors
        finally:
            made.unpersist()

    def _titled(self, texts: DataFrame) -> DataFrame:
        """Documents from ``(source, source_type, title, markdown)``: without a title the first top
        heading is one; the id that stands in for a missing title is put above no text."""
        cleaned = texts.withColumn("markdown", titles.strip_data_images(F.coalesce("markdown", F.lit(""))))
        own = F.coalesce(F.nullif(F.trim(F.col("title")), F.lit("")), titles.first_h1(F.col("markdown")))
        return cleaned.select("source", "source_type", F.coalesce(own, "source").alias("title"), own.isNotNull().alias("seed_title"), "markdown", F.lit("").alias("file_hash"), F.lit(0.0).alias("mtime"), F.lit("").alias("ocr_engine"))

    def ingest_table(self, documents: DataFrame, source: str, text: str, title: str | None = None) -> tuple[int, list[dict]]:
        """Texts of any table, under the ids of one of its columns."""
        name = F.col(title).cast("string") if title else F.lit(None).cast("string")
        return self._write(self._titled(documents.select(F.col(source).cast("string").alias("source"), F.lit("data").alias("source_type"), name.alias("title"), F.col(text).alias("markdown"))))

    def ingest_data(self, text: str, source: str, fmt: str = "text", title: str | None = None, source_type: str = "data") -> int:
        if fmt not in ("text", "markdown", "html"):
            raise ValueError(f"UnsupportedFormatError: {fmt!r}")
        markdown, own = files.html_to_markdown(text) if fmt == "html" else (text, None)
        row = [(source, source_type, (title or "").strip() or own, markdown)]
        n, errors = self._write(self._titled(self.spark.createDataFrame(row, "source string, source_type string, title string, markdown string")))
        if errors:
            raise EmptyDocumentError(errors[0]["error"])
        return n

    def ingest_url(self, url: str, fetch=None, resolve=guard.resolve_host, source: str | None = None, title: str | None = None) -> int:
        """``fetch`` gets a checked URL and gives its HTML; the default checks every redirect as well."""
        guard.check_url(url, self.config.allow_private_urls, resolve)
        page = fetch(url) if fetch else web.fetch(url, self.config.allow_private_urls, resolve)
        return self.ingest_data(page, source or url, "html", title, source_type="url")

    def ingest_files(self, entries: DataFrame) -> tuple[int, list[dict]]:
        """Scanned files ``(path, size, mtime)``; too large and unreadable ones are errors."""
        limit = self.config.max_file_size
        large = [{"source": r["path"], "error": f"FileTooLargeError: over {limit} bytes"} for r in entries.where(F.col("size") > limit).toLocalIterator()]
        done = files.parsed(files.read_files(self.spark, entries, limit)).join(entries.select("path", "mtime"), "path")
        bad = [{"source": r["path"], "error": r["error"]} for r in done.where("error is not null").select("path", "error").toLocalIterator()]
        good = done.where("error is null").select(F.col("path").alias("source"), F.lit("file").alias("source_type"), titles.file_title(F.col("meta_title"), F.col("markdown"), F.col("path")).alias("title"), F.lit(True).alias("seed_title"), "markdown", "file_hash", "mtime", F.lit("").alias("ocr_engine"))
        n, errors = self._write(good)
        return n, [*large, *bad, *errors]

    def ingest_file(self, path: str) -> int:
        real = guard.check_path(path, self.config.roots)
        n, errors = self.ingest_files(self.spark.createDataFrame([(real, os.path.getsize(real), os.path.getmtime(real))], "path string, size bigint, mtime double"))
        if errors:
            raise ValueError(errors[0]["error"])
        return n

    def delete(self, source: str) -> int:
        return self.store.delete(source)

    # -- keeping up to date ---------------------------------------------------------------------

    def sync(self, scope: str | None = None) -> tuple[dict, list[dict]]:
        with sync_lock(self.config.index_path):
            return self._sync(scope)

    def _on_disk(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The scan, the indexed sources, the hashes of files whose time differs, and the indexed files
        outside the scan that are still there."""
        entries = files.scan(self.spark, self.config.roots)
        indexed = navigate.list_sources(self.store.read())
        known = indexed.where("source_type = 'file'")
        doubtful = entries.join(known.select(F.col("source").alias("path"), F.col("mtime").alias("known")), "path").where("mtime <> known").drop("known")
        hashed = files.read_files(self.spark, doubtful, self.config.max_file_size).select(F.col("path").alias("source"), F.sha2("content", 256).alias("hash"))
        there = files.still_there(known.select("source").join(entries.select(F.col("path").alias("source")), "source", "left_anti"))
        return entries, indexed, hashed, there

    def _diff(self, scope: str | None) -> tuple[DataFrame, DataFrame]:
        scopes = [os.path.realpath(scope)] if scope else None
        entries, indexed, hashed, there = self._on_disk()
        return entries, reconcile.sync_diff(entries, indexed, self.config.max_file_size, scopes, hashed, existing=there).cache()

    def _sync(self, scope: str | None) -> tuple[dict, list[dict]]:
        entries, diff = self._diff(scope)
        try:
            n = {r["action"]: r["count"] for r in diff.groupBy("action").count().collect()}
            errors = [{"source": r["source"], "error": f"over {self.config.max_file_size} bytes" if r["action"] == "oversized" else "kept: this installation cannot read the file"} for r in diff.where("action in ('oversized', 'unreadable')").toLocalIterator()]
            done, failed = 0, []
            if n.get("ingest"):
                wanted = diff.where("action = 'ingest'").select(F.col("source").alias("path"))
                done, failed = self.ingest_files(entries.join(wanted, "path", "left_semi"))
            if n.get("delete"):
                self.store.drop(diff.where("action = 'delete'").select("source"))
            counts = {"scanned": sum(n.get(k, 0) for k in ("ingest", "unchanged", "oversized")), "ingested": done, "skipped": n.get("unchanged", 0), "deleted": n.get("delete", 0), "unreadable": n.get("unreadable", 0), "failed": n.get("oversized", 0) + len(failed)}
            return counts, [*errors, *failed]
        finally:
            diff.unpersist()

    # -- reading --------------------------------------------------------------------------------

    def query(self, text: str, top_k: int = search.DEFAULT_TOP_K, scopes: list[str] | None = None) -> DataFrame:
        if not text.strip():
            raise ValueError("the query is blank")
        one = self.spark.createDataFrame([(0, text)], "query_id int, text string").withColumn("vector", self.embed(F.col("text")))
        return self.query_many(one, top_k, scopes)

    def query_many(self, queries: DataFrame, top_k: int = search.DEFAULT_TOP_K, scopes: list[str] | None = None) -> DataFrame:
        c = self.config
        return search.search(self.store.read(), queries, top_k, c.hybrid_weight, scopes, c.max_distance, c.grouping, c.max_files, self.store.postings())

    def parents(self, hits: DataFrame) -> DataFrame:
        return navigate.parent_texts(self.store.read(), hits)

    def sources_of(self, hits: DataFrame) -> DataFrame:
        return navigate.hit_sources(hits).withColumn("displayPath", titles.display_path(F.col("source"), list(self.config.roots)))

    def read_neighbours(self, source: str, index: int, before: int = 1, after: int = 1) -> DataFrame:
        anchor = self.spark.createDataFrame([(source, index)], "source string, chunk_index int")
        return navigate.neighbours(self.store.read(), anchor, before, after).orderBy("chunk_index")

    def read_document(self, source: str) -> str:
        found = navigate.document_parts(self.store.read(source)).orderBy("first").collect()
        if not found:
            raise KeyError(f"not in the index: {source}")
        return "\n\n".join(r["text"] for r in found)

    def list_files(self, scope: str | None = None) -> DataFrame:
        scopes = [os.path.realpath(scope)] if scope else None
        entries, indexed, hashed, there = self._on_disk()
        return reconcile.file_states(entries, indexed, scopes, hashed, existing=there).orderBy("source")

    def get_source(self, source: str) -> dict | None:
        """What the index knows of one source; None if it does not hold it."""
        found = navigate.list_sources(self.store.read(source)).first()
        return found.asDict() if found else None

    def all_chunks(self, source: str) -> DataFrame:
        return self.store.read(source).orderBy("chunk_index")

    def status(self) -> dict:
        """Always answers: what cannot be read is said under ``error``."""
        known = {"index": self.config.index_path, "dim": self.config.dim, "scheme": SCHEME_VERSION, "job": self.jobs.job.to_dict() if self.jobs.job else None}
        try:
            n = navigate.counts(self.store.read()).first().asDict()
        except Exception as e:  # noqa: BLE001 - a broken index is part of the status
            return {**known, "error": f"{type(e).__name__}: {e}"}
        notes = [f"{n['stale']} passages were cut by an older scheme: sync again"] if n["stale"] else []
        return {**n, **known, "notes": notes, "ocr": "a recogniser is passed in by the caller; none is part of this package"}


def result_columns() -> list[Column]:
    """A hit as it is sent out."""
    return [F.col("text"), F.col("source"), F.col("title"), F.col("chunk_index").alias("chunkIndex"), F.col("score"), F.col("distance"), F.nullif("parent_id", F.lit("")).alias("parentId")]
