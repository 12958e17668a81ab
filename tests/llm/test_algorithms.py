"""Vector join, word-set join, leaks, look-alikes: against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import leaks, same_look, vector_join, word_sets

DIM = 64


def brute(ids, rows, k):
    unit = rows.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    out = set()
    for i in range(len(ids)):
        cosine = np.einsum("j,ij->i", unit[i], unit)
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cosine[j], ids[j]))
        out |= {(ids[i], ids[j]) for j in order[:k]}
    return out


def table(spark, ids, rows):
    return spark.createDataFrame([(i, [float(x) for x in r], "other", 1) for i, r in zip(ids, rows, strict=True)], "id string, vector array<float>, neighbour string, g int")


def pairs(df):
    return {(r["id"], r["neighbour"]) for r in df.collect()}


@pytest.mark.parametrize("shape", ["clusters", "spread", "mixed"])
@pytest.mark.parametrize("block", [4_096, 40])
def test_nearest_vectors_is_exact(spark, shape, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, DIM))
    near = (centres[rng.integers(0, 6, 150)] + 0.05 * rng.standard_normal((150, DIM))).astype(np.float32)
    far = rng.standard_normal((90, DIM)).astype(np.float32)
    rows = {"clusters": near, "spread": far, "mixed": np.vstack([near, far])}[shape]
    ids = [f"c{i:03}" for i in rng.permutation(len(rows))]
    got = pairs(vector_join.nearest_vectors(table(spark, ids, rows), k=5, block_rows=block))
    assert got == brute(ids, rows, 5)


def test_few_leaders_change_nothing(spark):
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((120, DIM)).astype(np.float32)
    ids = [f"v{i}" for i in range(120)]
    got = pairs(vector_join.nearest_vectors(table(spark, ids, rows), k=3, max_leaders=7, sample_rows=30, block_rows=25))
    assert got == brute(ids, rows, 3)


def test_more_clusters_than_a_sample_holds_are_not_copied_to_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((300, DIM))
    rows = (np.repeat(centres, 8, axis=0) + 0.05 * rng.standard_normal((2_400, DIM))).astype(np.float32)
    ids = [f"m{i:04}" for i in rng.permutation(len(rows))]
    written = {}

    def stored(df, label, store=vector_join.stored):
        out = store(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(vector_join, "stored", stored)
    got = pairs(vector_join.nearest_vectors(table(spark, ids, rows), k=5, sample_rows=40, block_rows=25))
    assert got == brute(ids, rows, 5)
    assert written["vector-join"] < 2 * 5 * len(rows)


@pytest.mark.parametrize("leaders", [0, 7, 1_000])
def test_rows_with_many_groups_to_ask_are_sent_out_in_slabs(spark, monkeypatch, leaders):
    rng = np.random.default_rng(8)
    near = rng.standard_normal((5, DIM))[rng.integers(0, 5, 100)] + 0.05 * rng.standard_normal((100, DIM))
    rows = np.vstack([near, rng.standard_normal((80, DIM))]).astype(np.float32)
    rows[150:165] = rows[100]
    ids = [f"s{i:03}" for i in rng.permutation(len(rows))]
    monkeypatch.setattr(vector_join, "SLAB_ROWS", 40)
    df = table(spark, ids, rows)
    for most in (0, 3):
        got = pairs(vector_join.nearest_vectors(df.unionAll(df.limit(30)), k=5, max_leaders=leaders, sample_rows=30, block_rows=25, most_probes=most))
        assert got == brute(ids, rows, 5)


def test_equal_vectors_go_to_the_smaller_id(spark):
    rows = np.ones((40, DIM), dtype=np.float32)
    ids = [f"e{i:02}" for i in range(40)]
    for block in (4_096, 8):
        assert pairs(vector_join.nearest_vectors(table(spark, ids, rows), k=5, block_rows=block)) == brute(ids, rows, 5)


def test_many_copies_are_thinned_out(spark):
    rng = np.random.default_rng(6)
    rows = np.vstack([np.tile(rng.standard_normal((1, DIM)), (300, 1)), rng.standard_normal((60, DIM))]).astype(np.float32)
    rows[300:330] = rows[0] * 2  # as near, in double precision, as the copies
    ids = [f"h{i:03}" for i in rng.permutation(len(rows))]
    df = table(spark, ids, rows)
    assert pairs(vector_join.nearest_vectors(df.unionAll(df.limit(50)), k=5, block_rows=64)) == brute(ids, rows, 5)


def test_unusable_vectors_take_no_part(spark):
    good = [1.0] + [0.0] * 63
    rows = [("a", good), ("a", good), ("b", [0.0] * 64), ("c", None), ("d", [1.0] * 32), (None, good), ("f", [float("nan")] + good[1:]), ("g", [2.0] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    assert pairs(vector_join.nearest_vectors(df)) == {("a", "g"), ("g", "a")}
    assert vector_join.nearest_vectors(df.where("false")).count() == 0


TEXTS = ["the quick brown fox jumps over the lazy dog near the river bank today", "the quick brown fox jumps over the lazy dog near the river bank tonight", "today the river bank near the lazy dog over jumps fox brown quick the", "nothing in common with any of those other lines here", "", None, "one", "one", "One!"]


def jaccard_pairs(rows, t, shingle):
    sets = [(i, word_sets.elements(x or "", shingle)) for i, x in rows]
    return {(min(a, b), max(a, b)) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if a != b and x and y and len(x & y) >= t * len(x | y) - 1e-9}


@pytest.mark.parametrize(("t", "shingle"), [(0.7, 1), (0.8, 5), (0.5, 2)])
def test_similar_sets_against_brute_force(spark, t, shingle, monkeypatch):
    monkeypatch.setattr(word_sets, "BLOCK_ROWS", 20)  # hot elements are cut into blocks
    rng = np.random.default_rng(8)
    common, rare = [f"w{i}" for i in range(25)], [f"r{i}" for i in range(400)]
    rows = [(f"t{i}", x) for i, x in enumerate(TEXTS)]
    for i in range(120):
        base = [*rng.choice(common, 14, replace=False), *rng.choice(rare, 4, replace=False)]
        rows.append((f"a{i}", " ".join(base)))
        edit = list(base)
        for _ in range(rng.integers(0, 5)):
            edit[rng.integers(0, len(edit))] = rng.choice(rare)
        rows.append((f"b{i}", " ".join(edit if i % 3 else rng.permutation(edit))))
    df = spark.createDataFrame([(i, x, 0, 0) for i, x in rows], "id string, text string, a int, class int")
    got = {(r["id_a"], r["id_b"]) for r in word_sets.near_duplicate_pairs(df, threshold=t, shingle=shingle).collect()}
    assert got == jaccard_pairs(rows, t, shingle)


def test_one_row_per_id_with_links(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = {r["id"]: r for r in word_sets.near_duplicates(df, threshold=0.7, shingle=1).collect()}
    assert rows["6"]["copies"] == 3 and rows["0"]["links"] == 1 and rows["3"]["links"] == 0 and "4" not in rows
    assert word_sets.near_duplicate_pairs(df.where("false")).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def test_leaks_are_found_in_any_dress(spark):
    words = ITEM.split()
    docs = [
        (1, "Before. " + ITEM.upper().replace(" ", ",\n") + " after"),
        (2, " ".join(words[:12])),
        (3, " ".join(words[:11]) + " other words follow here"),
        (4, "so " + " ".join(w for i, w in enumerate(words) if i != 8) + " so"),
        (5, "nothing"), (6, None), (7, ""), (2, " ".join(words[:12])), (8, "x " * 30_000 + ITEM), (None, ITEM),
    ]
    items = [(1, ITEM), (1, ITEM), (2, "too short"), (3, None)]
    d, e = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.leaked(d.withColumn("item_id", F.lit(0)), e).collect()}
    assert {k for k, r in got.items() if r["run"] >= 12} == {(1, 1), (2, 1), (8, 1)}
    assert (4, 1) in got and got[4, 1]["score"] >= 20  # an edited copy
    assert leaks.leaked(d.where("false"), e).count() == 0 and leaks.leaked(d, e.where("false")).count() == 0


@pytest.mark.parametrize("step", [6, 8, 10, 11, 12])
def test_the_only_copy_is_found_though_edited(spark, step):
    item = [f"w{i}" for i in range(60)]
    copy = " ".join("new" if i % step == step - 1 else w for i, w in enumerate(item))
    d = spark.createDataFrame([(1, "so it says " + copy + " and no more"), (2, "w0 w1 w2 w3 only"), (3, "nothing")], "doc_id int, text string")
    got = leaks.leaked(d, spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)] and got[0]["run"] == step - 1 and got[0]["score"] > 60


def test_items_of_any_number_of_different_words(spark):
    item = " ".join(f"w{i}" for i in range(60_000))
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(59_980, 59_995))), (2, "w5 w6 w7 w9 w10 w11")], "doc_id int, text string")
    got = leaks.leaked(d, spark.createDataFrame([(1, item)], "item_id int, text string")).collect()
    assert [(r["doc_id"], r["run"]) for r in got] == [(1, 15)]


def test_edited_copies_among_phrases_that_all_use(spark):
    """Copies with a word changed every eight, in a corpus whose sentences share phrases with the items."""
    rng = np.random.default_rng(8)
    phrases = [" ".join(f"p{i}x{j}" for j in range(7)) for i in range(40)]
    texts = [" ".join(f"{phrases[rng.integers(40)]} t{rng.integers(9_000)} u{rng.integers(9_000)} v{rng.integers(9_000)} z{rng.integers(9_000)}" for _ in range(8)) for _ in range(300)]
    copy = lambda t: " ".join(f"n{rng.integers(9_000)}" if k % 8 == 7 else w for k, w in enumerate(t.split()))
    docs = [(i, "so " + (copy(t) if i < 20 else t)) for i, t in enumerate(texts)]
    found = leaks.leaked(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(i, texts[i]) for i in range(20)], "item_id int, text string"))
    assert {(i, i) for i in range(20)} <= {(r["doc_id"], r["item_id"]) for r in found.where("score >= 60").collect()}


def test_many_pairs_at_once_are_as_one_by_one():
    rng = np.random.default_rng(4)
    items = leaks._Items([(i, " ".join(f"w{x}" for x in rng.integers(0, 30, 10 + i))) for i in range(8)], 2)
    texts = [rng.integers(-1, len(items.number), n) for n in (0, 1, 5, 40, 41, 90)]
    pairs = [(items.words[i], ids) for i in range(8) for ids in texts]
    scores = [leaks.align(a, b) for a, b in pairs]
    assert leaks.many(pairs).tolist() == scores
    assert leaks.many(pairs, runs=True).tolist() == [leaks.longest_run(a, b) for a, b in pairs]
    for least in (1, 6, 12):
        best = [max((leaks.align(items.words[i], x) for x in items.stretches(i, ids, least)), default=0) for i in range(8) for ids in texts]
        assert all(x == y for x, y in zip(best, scores, strict=True) if y >= least)


def test_local_alignment_scores():
    a = np.array([1, 2, 3, 4, 5])
    assert leaks.align(a, a) == 10
    assert leaks.align(a, np.array([9, 1, 2, 3, 7, 4, 5])) == 9
    assert leaks.align(a, np.array([-1, -1])) == 0
    assert leaks.longest_run(a, np.array([0, 2, 3, 4, 9])) == 3


SAME = [("cafe\u0301", "café"), ("Ａｂｃ１", "Abc1"), ("a\u200bb", "ab"), ("a\u00a0b", "a b"), ("Сорок", "Copoк"), ("и\u0306", "й"), ("\ufefftitle", "title"), ("Ρayment", "Payment"), ("a\u3000b", "a b"), ("e\u200b\u0301", "é"), ("ｅ\u0301", "é")]
OTHER = [("cafe", "café"), ("abc", "Abc"), ("a b", "ab"), ("l1", "11"), ("a-b", "a–b"), ("O", "0")]


@pytest.mark.parametrize(("x", "y"), SAME)
def test_same_looks_are_levelled(x, y):
    assert same_look.level(x) == same_look.level(y)
    assert same_look.canonical(x) == same_look.canonical(y)
    assert same_look.canonical(same_look.canonical(x)) == same_look.canonical(x)


@pytest.mark.parametrize(("x", "y"), OTHER)
def test_other_looks_stay_apart(x, y):
    assert same_look.level(x) != same_look.level(y)


def test_canonical_words_are_of_one_script():
    assert same_look.canonical("Cлужба") == "Служба" and same_look.canonical("Treаsury") == "Treasury"


def test_same_looking_values(spark):
    df = spark.createDataFrame([("café", "x"), ("cafe\u0301", None), ("café", "X"), (None, "x"), ("", "")], "source string, title string").withColumn("value", F.lit(1)).withColumn("form", F.lit("f"))
    got = [tuple(r) for r in same_look.same_looking(df, ["source", "title"]).collect()]
    assert got == [("source", "cafe\u0301", "café")]
    assert same_look.same_looking(df.where("false"), ["source"]).count() == 0
    assert same_look.level("") == "" and len(same_look.level("é" * 100_000)) == 200_000
