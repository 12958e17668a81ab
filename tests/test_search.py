"""Ranking, fusion and the filters after it, on hand-placed vectors."""

import pytest
from pyspark.sql import functions as F

from passagemill.operators import search as S

SCHEMA = "id string, source string, title string, chunk_index int, text string, vector array<double>, parent_id string"


def v(x):
    return [1.0 - x, x, *[0.0] * 6]


def rows():
    out = []
    for name, n, place, words in (("/near.md", 3, lambda i: v(0.001 * i), "zebra " * 100), ("/mid.md", 3, lambda i: v(0.30 + 0.001 * i), "zebra " * 100), ("/filler.md", 50, lambda i: v(1 - 0.0005 * i), "nothing here"), ("/keyed.md", 3, lambda i: [-1.0 - 0.01 * i, *[0.0] * 7], "zebra " * 50)):
        out += [(f"{name}#{i}", name, name, i, words, place(i), f"{name}#p0") for i in range(n)]
    return out


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "zebra", v(0.0))], "query_id int, text string, vector array<double>")


def test_distance_is_squared(spark, chunks, asked):
    got = {r["id"]: r["distance"] for r in S.vector_search(chunks, asked, 50).collect()}
    assert got["/mid.md#0"] == pytest.approx(0.18)
    assert "/keyed.md#0" not in got


def test_keyword_only_hits_have_no_distance_and_survive_grouping(chunks, asked):
    for mode, n in (("similar", 3), ("related", 6)):
        hits = S.search(chunks, asked, top_k=12, grouping=mode).collect()
        assert sum(h["distance"] is not None for h in hits) == n
        assert sum(h["distance"] is None for h in hits) == 3


def test_max_distance_drops_hits_without_one(chunks, asked):
    hits = S.search(chunks, asked, top_k=12, max_distance=0.5).collect()
    assert len(hits) == 6 and all(h["distance"] <= 0.5 for h in hits)


def test_weight_one_keeps_vector_hits_last_with_no_score(chunks, asked):
    hits = sorted(S.search(chunks, asked, top_k=12, weight=1.0).collect(), key=lambda h: h["place"])
    assert all(h["score"] > 0 for h in hits[:9]) and all(h["score"] == 0 for h in hits[9:])


def test_weight_zero_scores_by_distance(chunks, asked):
    hits = sorted(S.search(chunks, asked, top_k=3, weight=0.0).collect(), key=lambda h: h["place"])
    assert hits[0]["id"] == "/near.md#0" and hits[0]["score"] == 1.0


def test_max_files_and_top_k(chunks, asked):
    hits = S.search(chunks, asked, top_k=4, max_files=1).collect()
    assert len({h["source"] for h in hits}) == 1 and len(hits) <= 4
    with pytest.raises(ValueError, match="top_k"):
        S.search(chunks, asked, top_k=0)


@pytest.mark.parametrize(("distances", "similar", "related"), [([0.1, 0.11], 2, 2), ([0.10, 0.11, 0.12, 0.55, 0.56], 3, 5), ([0.10, 0.11, 0.40, 0.41, 0.80, 0.81], 2, 4), ([0.10, 0.11, 0.20, 0.21, 0.30], 5, 5), ([0.5] * 4, 4, 4)])
def test_gap_groups(spark, distances, similar, related):
    hits = spark.createDataFrame([(1, str(i), 0.0, d, i) for i, d in enumerate(distances)], "query_id int, id string, score double, distance double, rank int")
    assert S.near_groups(hits, "similar").count() == similar
    assert S.near_groups(hits, "related").count() == related


@pytest.mark.parametrize(("prefix", "source", "inside"), [("/data/proj", "/data/proj", True), ("/data/proj/", "/data/proj/f.md", True), ("/", "/any/where", True), ("/data/proj", "/data/project-secret/f.md", False), ("/data/proj", "/data/pro", False), ("note-1", "note-10", False), ("a%", "abc", False)])
def test_scope(spark, prefix, source, inside):
    one = spark.createDataFrame([(source,)], "source string")
    assert one.where(S.in_scope(F.col("source"), [prefix])).count() == int(inside)
    assert one.where(S.in_scope(F.col("source"), [])).count() == 1


def test_titles_are_found_and_blank_queries_give_nothing(spark):
    chunks = spark.createDataFrame([("a", "s", "quarterly ledger", 0, "plain body", None, ""), ("b", "s", None, 1, "ledger body", None, ""), ("c", "s", None, 2, None, None, "")], SCHEMA)
    ask = spark.createDataFrame([(1, "ledger", None), (2, "?!", None), (3, "quarterly", None)], "query_id int, text string, vector array<double>")
    got = {(r["query_id"], r["id"]) for r in S.keyword_search(chunks, ask, 50).collect()}
    assert got == {(1, "a"), (1, "b"), (3, "a")}


def test_scope_is_pushed_to_the_scan(spark, tmp_path, chunks):
    chunks.write.parquet(str(tmp_path / "c"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = spark.read.parquet(str(tmp_path / "c")).where(S.in_scope(F.col("source"), ["/near.md", "/x"])).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(source,/x/)" in plan and "vector" not in plan.split("ReadSchema")[-1]


def test_only_the_best_of_a_task_are_shuffled(chunks, asked):
    plan = S.vector_search(chunks, asked, 50)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "WindowGroupLimit" in S.keyword_search(chunks, asked, 50)._jdf.queryExecution().executedPlan().toString()


def test_query_tables_are_checked(chunks, asked, monkeypatch):
    monkeypatch.setattr(S, "MAX_HITS", 0)  # the join that shuffles gives the same
    assert S.search(chunks, asked, top_k=12).count() == 12
    monkeypatch.setattr(S, "MAX_QUERIES", 0)
    with pytest.raises(ValueError, match="queries at once"):
        S.search(chunks, asked)
