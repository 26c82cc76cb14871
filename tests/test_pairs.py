"""Joins that pair nodes of one name or key, where a name or key has many."""

from pyspark.sql import functions as F

from graphmill import store
from graphmill.operators import resolve, traverse
from graphmill.sources import code


def test_pairs_of_one_name_are_dealt_to_many_tasks(spark):
    rows = [(f"n{i}", "hot" if i % 50 else f"cold{i % 3}", f"f{i % 4}", i % 3 == 0 if i % 17 else None) for i in range(600)]
    nodes = spark.createDataFrame(rows, "id string, qualified_name string, file_path string, mark boolean")
    got = resolve.same_name_elsewhere(nodes, F.col("mark"), piece=20).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and a[3] is False and b[3])
    assert sorted((r["source"], r["target"]) for r in got) == want
    tasks = [r["task"] for r in got]
    assert len(set(tasks)) > 50 and max(map(tasks.count, set(tasks))) < len(tasks) / 10


def test_pairs_of_one_name_shuffle_few_rows(spark, monkeypatch):
    """4,000 nodes a side have 12,800,000 pairs: the side that streams is sent once, the other as lists. Null ids are ids, null files are nowhere."""
    sent = []
    monkeypatch.setattr(resolve, "dealt", lambda df, *key: sent.append(df) or store.dealt(df, *key))
    rows = [(f"n{i}", "hot", f"f{i // 2 % 5}", i % 2 == 0) for i in range(8000)] + [(None, "two", "f1", True), (None, "two", "f1", True), ("x", "two", "f2", False), ("y", "two", None, False), (None, "two", "f3", False), ("z", None, "f", True), ("w", None, "g", False)]
    nodes = spark.createDataFrame(rows, "id string, qualified_name string, file_path string, mark boolean")
    got = resolve.same_name_elsewhere(nodes, F.col("mark"))
    assert sum(df.count() for df in sent) < 4100
    assert got.count() == 4000 * 3200 + 4 and got.distinct().count() == 4000 * 3200 + 2
    assert sorted((r["source"], r["n"]) for r in got.where("target is null").groupBy("source").agg(F.count("*").alias("n")).collect() if r["source"]) == [("x", 2)]


def test_sets_are_covered_through_their_rarest_items(spark, monkeypatch):
    """4,000 sets hold an item that 4,000 owners have, 16,000,000 pairs; their other items are rare. Only what rare items leave is written."""
    written = []
    settled = store.settled
    monkeypatch.setattr(resolve, "settled", lambda df, name="step": written.append(settled(df, name)) or written[-1])
    have = [(i, "common") for i in range(4000)] + [(i, f"rare{i // 2}") for i in range(4000)] + [(7, "x"), (7, "y"), (None, "x"), (None, "y")]
    want = [(i, "common") for i in range(4000)] + [(i, f"rare{i}") for i in range(4000)] + [(-1, "x"), (-2, "x"), (-2, "y"), (-3, "x"), (-3, "y"), (-3, "rare3"), (-3, "common"), (-4, None), (-5, "x"), (-5, "none"), (None, "x")]
    got = sorted(resolve.covering(spark.createDataFrame(have, "owner long, item string"), spark.createDataFrame(want, "wanted long, item string")).collect(), key=repr)
    items = {o: {i for x, i in have if x == o} for o in (None, 7)}
    more = [(o, w) for o in items for w in (-1, -2, -3, -4, -5) if {i for x, i in want if x == w} <= items[o]]
    assert sorted(map(tuple, got), key=repr) == sorted([(o, o // 2) for o in range(4000)] + more, key=repr)
    assert written and sum(df.count() for df in written) < 100_000


def read_times(spark, df):
    """(df, a function that gives how many rows of it were read)."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), lambda: seen.value


def test_pairs_of_files_are_made_once(spark):
    pairs = [(f"f{i + 1}", f"f{i}") for i in range(4)] + [("t1", "f3"), ("t0", "f0"), ("t2", "t0")]
    files, read = read_times(spark, spark.createDataFrame(pairs, "source_file string, target_file string"))
    got = traverse.affected_files(files, spark.createDataFrame([("f0",)], "id string"), F.col("id").startswith("t")).collect()
    assert {(r["id"], r["depth"]) for r in got} == {("t0", 1), ("t1", 4)}
    assert read() == len(pairs)


def test_edges_of_one_name_are_moved_by_id(spark):
    """Edges never go by file, kind and name: very many may share them."""
    node = "id string, kind string, name string, file_path string, start_line int"
    old = spark.createDataFrame([(f"o{i}", "struct", "same", "f", i) for i in range(20)] + [("gone", "struct", "gone", "f", 1)], node)
    new = spark.createDataFrame([("n1", "struct", "same", "f", 1), ("n2", "struct", "same", "f", 2)], node)
    edges = spark.createDataFrame([(f"s{i}", f"o{i % 20}", "calls", i) for i in range(200)] + [("s", "gone", "calls", 0)], "source string, target string, kind string, line int")
    moved = store.rekey_edges(edges, old, new)
    assert {tuple(r) for r in moved.collect()} == {(f"s{i}", "n2", "calls", i) for i in range(200)}
    # The join by id is the outer one: it stands before any by name in the plan.
    joins = [x for x in moved._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert "target" in joins[0] and "_name" not in joins[0] and "_name" in joins[1]


def test_files_that_pack_well_are_parsed_by_many_tasks(spark):
    """600 files that come from a shuffle and are few bytes, as files of one shape are."""
    text = F.concat(F.lit("class C"), F.col("id").cast("string"), F.lit(":\n    def run(self):\n        return 0\n"))
    files = spark.range(600).groupBy("id").count().select(F.concat(F.lit("m/c"), F.col("id").cast("string"), F.lit(".py")).alias("path"), text.alias("text"), F.lit("python").alias("language"))
    got = code.extract(files).where("what = 'node'").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 1800 and len({r["name"] for r in got if r["kind"] == "class"}) == 600
    tasks = [r["task"] for r in got]
    assert len(set(tasks)) > 50 and max(map(tasks.count, set(tasks))) < len(tasks) / 10


def test_rounds_of_components_send_nothing_through_the_driver(spark, monkeypatch):
    plans, settled = [], store.settled
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(traverse, "settled", lambda df, name="step": plans.append(shown(df)) or settled(df, name))
    got = traverse.components(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "at long, to long"))
    plans.append(shown(got))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2), (6, 6, 1)]
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
