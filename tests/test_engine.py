"""Store, engine, reconciliation, sync and sources, end to end on small folders."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from passagemill.config import ConfigError, load_config
from passagemill.engine import EmptyDocumentError, Engine, result_columns
from passagemill.functions import titles
from passagemill.operators import navigate, reconcile
from passagemill.sources import files, guard
from passagemill.sources.store import DimensionMismatchError, IndexStore
from passagemill.sync import SyncBusyError, SyncManager, lasted, sync_lock


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    return Engine(spark, load_config({}, [str(tmp_path / "docs")], str(tmp_path / "index")))


def write(engine, name, text):
    path = os.path.join(engine.config.roots[0], name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_sync_ingests_changes_and_deletes(engine):
    a, b = write(engine, "a.md", "# Alpha\n\nThe heron stands."), write(engine, "sub/_b.txt", "A plain note about otters.")
    write(engine, ".hidden.md", "no")
    write(engine, "node_modules/x.md", "no")
    write(engine, "deck.pptx", "binary")
    counts, errors = engine.sync()
    assert (counts["scanned"], counts["ingested"], counts["failed"]) == (3, 2, 1) and "deck.pptx" in errors[0]["source"]
    assert engine.sync()[0]["skipped"] == 2
    os.utime(a, (1, 1))
    assert engine.sync()[0]["skipped"] == 2  # another time, the same hash
    write(engine, "a.md", "# Alpha\n\nThe heron has left.")
    os.utime(a, (2, 2))
    os.remove(b)
    counts, _ = engine.sync()
    assert (counts["ingested"], counts["deleted"]) == (1, 1)
    assert "left" in engine.read_document(a)
    with pytest.raises(KeyError):
        engine.read_document(b)
    states = {r["source"]: r["state"] for r in engine.list_files().collect()}
    assert states[a] == "ingested" and states[os.path.join(engine.config.roots[0], "deck.pptx")] == "not_ingested"


def test_data_query_neighbours_and_delete(engine):
    engine.ingest_data("Herons fish at dawn.\n\nOtters swim at night.", "note-1", "markdown", "River life")
    engine.ingest_data("<html><head><title>Tax</title></head><body><p>Ledgers &amp; rates</p><script>x</script></body></html>", "note-10", "html")
    hits = engine.query("herons", scopes=["note-1"]).orderBy("place").select(*result_columns()).collect()
    assert hits[0]["source"] == "note-1" and "Herons" in " ".join(h["text"] for h in hits) and {h["source"] for h in hits} == {"note-1"}
    assert engine.read_neighbours("note-1", 0).count() == 2
    assert engine.sources_of(engine.query("rates")).where("source = 'note-10'").first()["title"] == "Tax"
    assert engine.parents(engine.query("herons")).count() >= 1
    assert engine.delete("note-1") > 0 and engine.delete("note-1") == 0
    with pytest.raises(EmptyDocumentError):
        engine.ingest_data("  ", "note-10", "text")
    assert engine.read_document("note-10")
    with pytest.raises(ValueError, match="blank"):
        engine.query("  ")
    assert engine.status()["sources"] == 1


def test_stored_vectors_are_those_of_the_text(engine):
    engine.ingest_data("One.\n\nTwo.", "n", "markdown")
    rows = engine.store.read()
    assert rows.where(F.expr("size(vector) <> 8")).count() == 0
    again = rows.withColumn("again", engine.embed(F.col("text")))
    assert again.where("vector <> again").count() == 0


def test_old_layout_and_other_dimension(spark, tmp_path):
    spark.createDataFrame([("a#0", "a", "file", "A", 0, "t", [1.0], "", 0.0, "x")], "id string, source string, source_type string, title string, chunk_index int, text string, vector array<float>, file_hash string, mtime double, ingested_at string").write.parquet(str(tmp_path / "i/snapshot-1"))
    (tmp_path / "i/current.json").write_text(json.dumps({"snapshot": "snapshot-1", "dim": 8}))
    row = IndexStore(spark, str(tmp_path / "i"), 8).read().first()
    assert (row["parent_id"], row["ocr_engine"], row["scheme_version"]) == ("", "", 0)
    with pytest.raises(DimensionMismatchError):
        IndexStore(spark, str(tmp_path / "i"), 16)


def test_diff_truth_table(spark):
    disk = spark.createDataFrame([("/same", 1, 1.0), ("/same", 1, 1.0), ("/hash", 1, 2.0), ("/changed", 1, 2.0), ("/new", 1, 1.0), ("/big", 99, 1.0), ("/old", 1, 1.0), ("note", 1, 9.0)], "path string, size bigint, mtime double")
    index = spark.createDataFrame([("/same", "file", "h", 1.0, 3), ("/hash", "file", "h", 1.0, 3), ("/changed", "file", "h", 1.0, 3), ("/big", "file", "h", 1.0, 3), ("/old", "file", "h", 1.0, 2), ("/gone", "file", "h", 1.0, 3), ("/kept.png", "file", "h", 1.0, 3), ("note", "data", "", 0.0, 3)], "source string, source_type string, file_hash string, mtime double, scheme_version int")
    hashes = spark.createDataFrame([("/hash", "h"), ("/changed", "other")], "source string, hash string")
    there = spark.createDataFrame([("/kept.png",)], "source string")
    got = {r["source"]: r["action"] for r in reconcile.sync_diff(disk, index, 50, hashes=hashes, existing=there).collect()}
    assert got == {"/same": "unchanged", "/hash": "unchanged", "/changed": "ingest", "/new": "ingest", "/big": "oversized", "/old": "ingest", "/gone": "delete", "/kept.png": "unreadable", "note": "ingest"}
    states = {(r["source"], r["state"]) for r in reconcile.file_states(disk, index, hashes=hashes).collect()}
    assert {("/old", "stale_scheme"), ("/changed", "stale"), ("/hash", "ingested"), ("note", "ingested"), ("/new", "not_ingested")} <= states and not any(s == "/gone" for s, _ in states)


def test_rollups(spark):
    rows = spark.createDataFrame([(f"s#{i}", "s", "file", "T", i, f"p{i // 10}\n\ntext {i}", f"s#p{i // 10}", "" if i else None, 3, "t") for i in range(30)] + [("s#3", "s", "file", "T", 3, "p0\n\nlate", "s#p0", "", 3, "z"), ("e#0", "e", "data", None, 0, "alone", None, "scan", None, "t")], "id string, source string, source_type string, title string, chunk_index int, text string, parent_id string, ocr_engine string, scheme_version int, ingested_at string")
    rows = rows.withColumn("file_hash", F.lit("")).withColumn("mtime", F.lit(0.0))
    now = navigate.current(rows)
    assert now.count() == 31 and now.where("id = 's#3'").first()["text"].endswith("late")
    listed = {r["source"]: r for r in navigate.list_sources(now).collect()}
    assert listed["s"]["chunk_count"] == 30 and listed["e"]["ocr_engine"] == "scan" and listed["e"]["scheme_version"] == 0
    anchor = spark.createDataFrame([("s", 15), ("s", 0), ("none", 1)], "source string, chunk_index int")
    got = sorted((r["anchor"], r["chunk_index"]) for r in navigate.neighbours(now, anchor, 2, 2).collect())
    assert got == [(0, 0), (0, 1), (0, 2), *[(15, i) for i in range(13, 18)]]
    assert navigate.parent_texts(now, now).count() == 3
    whole = {(r["source"], r["first"]): r["text"] for r in navigate.document_parts(now).collect()}
    assert sorted(whole) == [("e", 0), ("s", 0), ("s", 10), ("s", 20)] and whole["s", 0].count("p0") == 1 and whole["e", 0] == "alone"
    assert navigate.counts(now).first()["stale"] == 1


@pytest.mark.parametrize(("url", "said"), [("http://127.0.0.1/x", "loopback address"), ("http://169.254.169.254/", "link-local address"), ("http://10.0.0.1", "private address"), ("http://0.0.0.0", "unspecified address"), ("http://[::ffff:127.0.0.1]/", "loopback address"), ("http://[::ffff:93.184.216.34]/", "ok"), ("ftp://x", "scheme ftp"), ("file:///etc/passwd", "scheme file"), ("http://[::1", "malformed"), ("https://example.com/a", "ok"), (None, "scheme none")])
def test_url_guard(url, said):
    assert guard.verdict(url) == said
    assert guard.verdict("http://name", resolve=lambda h: ["93.184.216.34", "10.0.0.1"]) == "private address"
    assert guard.verdict("http://10.0.0.1", allow_private=True) == "ok"


def test_path_guard(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f").write_text("x")
    os.symlink("/etc/hosts", tmp_path / "in/link")
    assert guard.check_path(str(tmp_path / "in/f"), [str(tmp_path / "in")])
    for bad in (str(tmp_path / "in/link"), "in/f", str(tmp_path / "inside")):
        with pytest.raises(guard.SecurityError):
            guard.check_path(bad, [str(tmp_path / "in")])


def test_html_and_tables():
    md, title = files.html_to_markdown("<title>T</title><h2>Head</h2><p>One <b>two</b></p><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><th>x</th></tr><tr><td>1</td></tr></table><pre>code  here</pre><style>p{}</style>")
    assert title == "T" and "## Head" in md and "**two**" in md and "- a" in md and "  - b" in md and "| x |\n| --- |\n| 1 |" in md and "```\ncode  here\n```" in md and "p{}" not in md
    assert files.csv_to_markdown("a,b\n1,2").splitlines() == ["| a | b |", "| --- | --- |", "| 1 | 2 |"]
    assert files.notebook_to_markdown(json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1"]}]})) == "```python\nx = 1\n```"


def test_line_boxes():
    box = lambda x, y, h=10: [[x, y], [x + 5, y], [x + 5, y + h], [x, y + h]]
    assert files.assemble_lines([box(50, 1), box(0, 0), box(0, 30)], ["b", "a", "c"]) == "a b\nc"
    assert files.assemble_lines([], []) == ""
    with pytest.raises(ValueError, match="boxes"):
        files.assemble_lines([box(0, 0)], [])
    assert files.page_text("x" * 30, "seen", 25) == ("x" * 30, None)
    assert files.page_text("x", "seen", 25) == ("x\n\nseen", None)
    assert files.page_text(" ", None, 25)[1].startswith("OcrError")
    assert files.page_text(" ", "seen", 0) == (" ", None)


@pytest.mark.parametrize(("name", "says"), [("scan_001", False), ("IMG_20260807", False), ("Копия документа (2)", False), ("New Document", False), ("a1", False), ("Document Management Policy", True), ("И-112_ЗПС", True)])
def test_informative_stems(spark, name, says):
    assert spark.createDataFrame([(name,)], "n string").select(titles.informative(F.col("n"))).first()[0] is says


@pytest.mark.parametrize(("meta", "md", "path", "title"), [("Given", "# Other", "/x/a.md", "Given"), (None, "# Real **title**", "/x/a.md", "Real **title**"), (None, "# 1. Introduction", "/x/Leave_policy.pdf.pdf", "Leave policy"), (None, "# Scope", "/x/scan_1.pdf", "Scope"), (None, "```\n# no\n```", "/x/doc.md", "doc")])
def test_file_titles(spark, meta, md, path, title):
    row = spark.createDataFrame([(meta, md, path)], "a string, b string, c string")
    assert row.select(titles.file_title(F.col("a"), F.col("b"), F.col("c"))).first()[0] == title


def test_display_path(spark):
    rows = spark.createDataFrame([("/r/sub/f",), ("/r/f",), ("/root/f",), ("note",)], "s string")
    assert [r[0] for r in rows.select(titles.display_path(F.col("s"), ["/r", "/r/sub/"])).collect()] == ["f", "f", "/root/f", "note"]


@pytest.mark.parametrize("env", [{"CHUNK_TOKEN_BUDGET": "15"}, {"CHUNK_TOKEN_BUDGET": "x"}, {"RAG_HYBRID_WEIGHT": "1.1"}, {"RAG_GROUPING": "odd"}, {"RAG_MAX_FILES": "0"}, {"BASE_DIRS": "[]"}, {"BASE_DIRS": "{"}, {"ALLOW_PRIVATE_URLS": "maybe"}, {"RAG_OCR_LANG": " "}, {"RAG_MAX_DISTANCE": "-1"}])
def test_bad_settings(env):
    with pytest.raises(ConfigError):
        load_config(env)


def test_settings_levels(tmp_path):
    env = {"BASE_DIRS": json.dumps([str(tmp_path)]), "BASE_DIR": "/elsewhere", "RAG_GROUPING": "similar"}
    assert load_config(env).roots == (str(tmp_path.resolve()),)
    assert load_config(env, ["/flag"]).roots == ("/flag",) and load_config(env).grouping == "similar"


def test_lock_and_jobs(tmp_path):
    go = threading.Event()
    jobs = SyncManager(str(tmp_path), lambda scope: (go.wait(5), ({"scanned": 1}, []))[1])
    job = jobs.start()
    with pytest.raises(SyncBusyError):
        jobs.start()
    with pytest.raises(SyncBusyError, match="process"), sync_lock(str(tmp_path)):
        pass
    go.set()
    jobs.wait(5)
    assert jobs.status(job.job_id).state == "succeeded" and job.to_dict()["counts"] == {"scanned": 1}
    with sync_lock(str(tmp_path)):
        pass
    bad = SyncManager(str(tmp_path), lambda scope: 1 / 0)
    bad.start()
    bad.wait(5)
    assert bad.status().state == "failed" and "zero" in bad.status().error
    with pytest.raises(KeyError):
        bad.status("other")
    assert [lasted(x) for x in (5, 65, 3_725)] == ["5s", "1m05s", "1h02m05s"]
    time.sleep(0)


def test_stream_replaces_sources(engine, spark, tmp_path):
    from passagemill.streaming.ingest import ingest_stream, watch, windowed_counts

    schema = "source string, title string, text string, arrived timestamp"
    rows = spark.createDataFrame([("x", "X", "Old words.", "2024-01-01"), ("x", "X", "New words.", "2024-01-02"), ("y", None, "Other.", None)], "source string, title string, text string, a string").withColumn("arrived", F.to_timestamp("a")).drop("a")
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest_stream(engine, watch(spark, str(tmp_path / "in"), schema), str(tmp_path / "ck")).awaitTermination(120)
    assert "New" in engine.read_document("x") and engine.status()["sources"] == 2
    events = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:01:50", "a"), ("2024-01-01 00:02:10", "b")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    assert sorted(r["n"] for r in windowed_counts(events).collect()) == [1, 2]


def test_sources_in_any_script_get_a_verdict(spark, tmp_path):
    from passagemill.plans import queries

    said = {
        "/corpus/de/übersicht.md": "scheme none", "/корпус/файл.md": "scheme none", "ｆｉｌｅ:///etc/passwd": "scheme none", "https://пример.рф/файл": "ok",
        "http://１２７.０.０.１/": "loopback address", "http://127。0。0。1/": "loopback address", "http://10.0.0.1/é": "private address", "": "scheme none", "a\nb": "scheme none",
    }
    spark.createDataFrame([(s,) for s in [*said, None, ""]], "source string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = queries.queries()["url_guard_all"](spark, str(tmp_path)).collect()
    assert {r["url"]: r["verdict"] for r in got} == said and len(got) == len(said)


def test_one_document_touches_its_part_only(engine):
    for i in range(6):
        engine.ingest_data(f"Herons stand in pond {i}.", f"note-{i}", "markdown")
    before = engine.store._manifest()["held"]
    engine.ingest_data("Otters swim.", "note-3", "markdown")
    after = engine.store._manifest()["held"]
    mine = str(engine.spark.range(1).select(engine.store.part_of(F.lit("note-3"))).first()[0])
    assert len(before) > 2 and {k for k in after if after[k] != before.get(k)} == {mine}
    assert "Otters" in engine.read_document("note-3") and engine.store.read().count() == 6
    assert engine.delete("note-3") == 1 and engine.get_source("note-3") is None and engine.get_source("note-4")["chunk_count"] == 1
    assert [r["chunk_index"] for r in engine.all_chunks("note-4").collect()] == [0]
    held = engine.store._manifest()
    names = {x["rows"].split("/")[0] for x in held["held"].values()} | set(held["before"])
    assert {d for d in os.listdir(engine.config.index_path) if d.startswith("data-")} <= names


def test_keyword_search_reads_stored_postings(engine):
    engine.ingest_data("Herons fish at dawn.", "a", "markdown", "Birds")
    engine.ingest_data("Otters fish at night, fish by fish.", "b", "markdown", "Herons and others")
    asked = engine.spark.createDataFrame([(0, "herons fish"), (1, "night"), (2, "none")], "query_id int, text string")
    from passagemill.operators import search

    stored = search.keyword_search(engine.store.read(), asked, 50, index=engine.store.postings())
    fresh = search.keyword_search(engine.store.read(), asked, 50)
    rows = lambda df: sorted((r["query_id"], r["id"], round(r["bm25"], 9), r["key_rank"]) for r in df.collect())
    assert rows(stored) == rows(fresh) and len(rows(stored)) == 3
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan.split("Scan parquet")[1].split("\n")[0] and "/rows/" not in plan


def test_titles_of_data(engine):
    engine.ingest_data("Preface\n\n```\n# code\n```\n\n# River life\n\nHerons.", "n1", "markdown")
    engine.ingest_data("Only text.", "n2", "text")
    engine.ingest_data("<body><h1>Tax</h1><p>Rates.</p></body>", "n3", "html")
    got = {s: engine.get_source(s)["title"] for s in ("n1", "n2", "n3")}
    assert got == {"n1": "River life", "n2": "n2", "n3": "Tax"}


def test_data_images_stay_in_fences(spark):
    text = "![ a b ](data:image/png;base64,xx) and ![x](http://x/y.png)\n```\n![c](data:image/png;base64,yy)\n```\n![d](data:z)"
    only = "![](data:image/png;base64,xx)"
    split = "![a\n](data:image/png;base64,xx)"
    rows = spark.createDataFrame([(text,), (only,), (split,), ("~~~\n![e](data:q)",)], "t string").select(titles.strip_data_images(F.col("t")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["a b and ![x](http://x/y.png)\n```\n![c](data:image/png;base64,yy)\n```\nd", only, split, "~~~\n![e](data:q)"]


@pytest.mark.parametrize("url", ["http://localhost/x", "http://a.localhost", "http://2130706433/", "http://0x7f.1/", "http://127.1", "http://LOCALHOST:8080/", "http://１２７.0.0.1/"])
def test_names_of_this_machine_are_refused(url):
    assert guard.verdict(url) == "loopback address"
    with pytest.raises(guard.SecurityError):
        guard.check_url(url)


def test_names_are_resolved_and_redirects_checked(engine, monkeypatch):
    monkeypatch.setattr(guard.socket, "getaddrinfo", lambda host, *a, **k: [(0, 0, 0, "", ("10.0.0.7" if host == "inner" else "93.184.216.34", 0))] if host != "gone" else (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(guard.SecurityError, match="private"):
        guard.check_url("http://inner/x")
    with pytest.raises(guard.URLResolutionError):
        guard.check_url("http://gone/x")
    guard.check_url("http://outer/x")
    from passagemill.sources import fetch

    handler = fetch._CheckedRedirects(lambda u: guard.check_url(u))
    with pytest.raises(guard.SecurityError):
        handler.redirect_request(None, None, 302, "", {}, "http://inner/secret")
    with pytest.raises(guard.BlockedFetchError):
        fetch.fetch("http://inner/x")
    monkeypatch.undo()
    assert engine.ingest_url("http://outer/p", fetch=lambda u: "<title>Pond</title><p>Herons.</p>", resolve=lambda host: ["93.184.216.34"]) == 1


def test_files_without_a_reader_are_kept(engine, spark):
    kept = write(engine, "scan.png", "x")
    engine.store.replace(engine.rows(engine._titled(spark.createDataFrame([(kept, "file", "Scan", "Text of the scan.")], "source string, source_type string, title string, markdown string"))).drop("error"), spark.createDataFrame([(kept,)], "source string"))
    counts, errors = engine.sync()
    assert (counts["unreadable"], counts["deleted"]) == (1, 0) and errors[0]["source"] == kept
    assert {(r["source"], r["state"]) for r in engine.list_files().collect()} == {(kept, "unreadable")}
    os.remove(kept)
    assert engine.sync()[0]["deleted"] == 1


def test_a_touched_file_is_ingested_still(engine):
    path = write(engine, "a.md", "# A\n\nText.")
    engine.sync()
    os.utime(path, (5, 5))
    assert [r["state"] for r in engine.list_files().collect()] == ["ingested"]


def test_status_always_answers(engine):
    assert engine.status()["chunks"] == 0
    engine.ingest_data("Text.", "n")
    os.rename(engine.config.index_path + "/" + engine.store._manifest()["held"].popitem()[1]["rows"].split("/")[0], engine.config.index_path + "/lost")
    assert "error" in engine.status()
