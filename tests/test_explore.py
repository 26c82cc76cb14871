"""The gate, the order, clusters and budgets of an answer, on small tables."""

from pyspark.sql import functions as F

from graphmill.operators import explore, intervals

FILES = "file_path string, graph double, is_central boolean, is_entry boolean, is_named boolean, hits int, score int, symbols int"


def files(spark, *rows):
    return spark.createDataFrame([(p, g, c, e, n, h, s, 1) for p, g, c, e, n, h, s in rows], FILES)


def test_the_gate(spark):
    some = files(spark, ("a", 1.0, False, False, False, 0, 0), ("b", 0.06, False, False, False, 0, 0), ("c", 0.05, False, False, False, 1, 9), ("d", 0.0, True, False, False, 0, 0), ("e", 0.0, False, True, False, 0, 0), ("f", 0.0, False, False, False, 2, 0))
    assert {r["file_path"] for r in explore.gated(some).collect()} == {"a", "b", "d", "e", "f"}
    one = files(spark, ("a", 1.0, False, False, False, 0, 0), ("c", 0.0, False, False, False, 1, 9))
    assert explore.gated(one).count() == 2
    assert explore.gated(files(spark, ("a", 0.0, True, True, False, 9, 0), ("c", 0.0, False, False, False, 0, 9))).count() == 2
    assert explore.gated(some.limit(0)).count() == 0


def test_the_order_of_files(spark):
    some = files(
        spark, ("low", 0.5, False, False, False, 1, 0), ("named", 0.0, False, False, True, 0, 0), ("both", 0.1, False, True, False, 2, 0), ("twice", 0.1, False, False, False, 3, 0), ("top", 1.0, False, False, False, 0, 0),
        ("near", 0.996, False, False, False, 5, 0), ("x_test.go", 0.5, False, False, False, 1, 99), ("a.pb.go", 0.5, False, False, False, 1, 50), ("more", 0.5, False, False, False, 1, 7),
    )
    got = [r["file_path"] for r in explore.ranked_files(some, 20).orderBy("rank").collect()]
    assert got[:2] == ["named", "both"] and got[2:4] == ["near", "top"] and got[4:6] == ["more", "low"] and got[-1] == "twice"
    assert [r["file_path"] for r in explore.ranked_files(some, 2).orderBy("rank").collect()] == got[:2]


def test_tiers():
    assert [explore.budget_of(n).chars for n in (0, 149, 150, 499, 500, 14999, 99999)] == [13000, 13000, 18000, 18000, 24000, 24000, 24000]
    assert [explore.calls_of(n) for n in (1, 499, 500, 5000, 15000, 25000)] == [1, 1, 2, 3, 4, 5]
    assert explore.budget_of(4999)[1:] == (8, 6500, 12, True)


def test_envelopes_clusters_and_sections(spark):
    nodes = spark.createDataFrame([("f", "class", 1, 90), ("f", "class", 10, 20), ("f", "method", 1, 80), ("f", "method", 0, 0)], "file_path string, kind string, start int, end int")
    kept = explore.ranges_of(nodes, spark.createDataFrame([("f", 100)], "file_path string, n_lines int"))
    assert sorted((r["kind"], r["start"]) for r in kept.collect()) == [("class", 10), ("method", 1)]
    ranges = spark.createDataFrame([("f", 1, 4, 1, False, None), ("f", 6, 9, 3, False, None), ("f", 20, 20, 10, False, None), ("f", 40, 300, 1, True, 200), ("f", 41, 42, 1, False, None)], "file_path string, start int, end int, importance int, spine boolean, call_line int")
    found = explore.clusters(ranges, 2)
    got = {r["start"]: r for r in found.collect()}
    assert [(s, got[s]["end"], got[s]["score"], got[s]["top"], got[s]["rank"]) for s in (1, 20, 40)] == [(1, 9, 4, 3, 3), (20, 20, 10, 10, 2), (40, 300, 2, 1, 1)]
    text = "\n".join(f"line {i}" for i in range(1, 311))
    parts = {r["start"]: r["section"] for r in explore.with_sections(found, spark.createDataFrame([("f", text)], "file_path string, text string")).collect()}
    assert parts[1].split("\n")[0] == "line 1" and parts[1].endswith("line 12") and parts[20].split("\n") == [f"line {i}" for i in range(17, 24)]
    assert parts[40].startswith("line 40\nline 41\nline 42\nline 43\nline 44\n\n... (gap) ...\n\nline 172\n") and parts[40].endswith("line 228")


def test_what_fits_is_taken_greedily(spark):
    budget = explore.Budget(1000, 2, 100, 5, True)
    rows = [("f", 1, 1, False, 150), ("f", 2, 2, False, 10), ("g", 1, 1, False, 40), ("g", 2, 2, False, 90), ("g", 3, 3, False, 30), ("g", 4, 4, True, 120), ("g", 5, 5, False, 1), ("h", 1, 1, False, 90), ("i", 1, 1, False, 1)]
    found = spark.createDataFrame(rows, "file_path string, rank int, start int, spine boolean, chars int")
    kept = {(r["file_path"], r["rank"]) for r in explore.chosen_clusters(found, budget).collect()}
    assert kept == {("f", 1), ("g", 1), ("g", 3), ("g", 4), ("h", 1), ("i", 1)}
    order = spark.createDataFrame([("f", 1, False), ("g", 2, False), ("h", 3, False), ("i", 4, True)], "file_path string, rank int, is_named boolean")
    small = budget._replace(chars=700, files=3)
    picked = {(r["file_path"], r["file_rank"]) for r in explore.selection(order, found, small).collect()}
    assert picked == {("f", 1), ("h", 2), ("i", 3)}


def test_siblings_confidence_and_diversity(spark):
    edges = spark.createDataFrame([("a", "s", "extends"), ("b", "s", "implements"), ("c", "s", "extends"), ("a", "t", "extends"), ("a", "t", "calls")], "source string, target string, kind string")
    assert sorted(map(tuple, explore.siblings(edges).collect())) == [("a", "s"), ("b", "s"), ("c", "s")]
    hits = spark.createDataFrame([("1", "run", "x"), ("2", "go", "x")], "id string, name string, term string")
    marked = F.col("name").rlike("[_0-9]")
    assert not explore.confidence(hits, marked).first()[0]
    assert explore.confidence(hits.union(spark.createDataFrame([("1", "run", "y")])), marked).first()[0]
    assert explore.confidence(hits.union(spark.createDataFrame([("3", "run_it", "y")])), marked).first()[0]
    assert not explore.confidence(hits.limit(0), marked).first()[0]
    nodes = spark.createDataFrame([(str(i), "f" if i < 9 else f"t{i}", float(i), i == 0, i < 9) for i in range(20)], "id string, file_path string, score double, root boolean, made boolean")
    got = explore.diverse(nodes, 10, F.lit(1), F.col("root"), F.col("made"))
    assert {r["id"] for r in got.where("made").collect()} == {"0", "8", "7", "6", "5"} and got.where("not made").count() == 3


def test_greedy_budget_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([("k", 1, 50), ("k", 2, 60), ("k", 3, 40), ("k", 4, 11), ("k", 5, 10), ("m", 1, 500), ("m", 2, 1)], "key string, at int, size int")
    got = sorted((r["key"], r["at"]) for r in intervals.greedy_budget(rows, "key", ["at"], "size", 100).collect())
    assert got == [("k", 1), ("k", 3), ("k", 5), ("m", 1)]
