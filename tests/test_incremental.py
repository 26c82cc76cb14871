"""References after changes, against resolving all of them anew; chains and paths against listing all of them."""

import random

import pytest
from pyspark.sql import functions as F

from graphmill import store
from graphmill.operators import incremental, names, tools, walk

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, return_type string, is_exported boolean"
REFS = "ref_id long, from_id string, ref_name string, ref_kind string, ref_file string, ref_line int, ref_language string"
WORDS = ["Alpha", "alpha", "Beta", "beta", "run", "Run", "stop"]


def snapshot(rng, files):
    """Nodes and references of each file, by file."""
    nodes, refs = {}, {}
    for f in files:
        nodes[f], refs[f] = [(f"file:{f}", "file", f.split("/")[-1], f, f, "python", 1, None, True)], []
        for line in range(rng.randint(1, 4)):
            name, owner = rng.choice(WORDS), rng.choice(WORDS[:4])
            kind = rng.choice(["function", "method", "class"])
            nodes[f].append((f"{f}:{line}:{name}", kind, name, f"{owner}::{name}" if kind == "method" else name, f, "python", line, rng.choice([None, "Alpha", "Beta"]) if kind != "class" else None, False))
        for line in range(rng.randint(1, 5)):
            name = rng.choice([rng.choice(WORDS), f"{rng.choice(WORDS)}.{rng.choice(WORDS)}", f"{rng.choice(WORDS)}::{rng.choice(WORDS)}", f"{rng.choice(WORDS)}.{rng.choice(WORDS)}().{rng.choice(WORDS)}", rng.choice(files).split("/")[-1], rng.choice(files)])
            refs[f].append((abs(hash((f, line, name))) % 10**12, f"{f}:x", name, rng.choice(["calls", "references", "imports", "function_ref"]), f, line, "python"))
    return nodes, refs


def table(spark, by_file, schema, files=None):
    rows = [r for f, rs in by_file.items() if files is None or f in files for r in rs]
    return store.settled(spark.createDataFrame(rows, schema))


def rows(df):
    return sorted((r["ref_id"], r["target"], round(float(r["confidence"]), 6), r["resolved_by"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_an_update_gives_what_a_full_resolution_gives(spark, seed):
    rng = random.Random(seed)
    files = [f"src/{a}/f{i}.py" for i, a in enumerate("aabbcc")]
    nodes, refs = snapshot(rng, files)
    state = incremental.State(table(spark, nodes, NODES), table(spark, refs, REFS), None)
    state = state._replace(resolved=store.settled(names.cascade(state.refs, state.nodes)))
    new_nodes, new_refs = snapshot(rng, [*files, "src/new.py"])
    # One file is edited, one goes, one comes, one is reported but unchanged.
    changed = [files[0], files[1], "src/new.py", files[2]]
    for f in (files[0], "src/new.py"):
        nodes[f], refs[f] = new_nodes[f], new_refs[f]
    nodes.pop(files[1]), refs.pop(files[1])
    at = spark.createDataFrame([(f,) for f in [*changed, changed[0]]], "file_path string")
    after, again = incremental.update(state, at, table(spark, nodes, NODES, changed), table(spark, refs, REFS, changed))
    assert rows(after.resolved) == rows(names.cascade(table(spark, refs, REFS), table(spark, nodes, NODES)))
    assert sorted(r["id"] for r in after.nodes.select("id").collect()) == sorted(r[0] for rs in nodes.values() for r in rs)
    assert sorted(r["ref_id"] for r in after.refs.collect()) == sorted(r[0] for rs in refs.values() for r in rs)
    assert again.count() <= after.refs.count()


def test_only_what_a_change_touches_is_asked_again(spark):
    nodes = spark.createDataFrame([("a", "function", "run", "run", "a.py", "python", 1, None, False), ("b", "function", "stop", "stop", "b.py", "python", 1, None, False)], NODES)
    refs = spark.createDataFrame([(1, "x", "run", "calls", "c.py", 1, "python"), (2, "x", "stop", "calls", "c.py", 2, "python"), (3, "x", "o.RUN", "calls", "d.py", 2, "python"), (4, "x", "alias", "calls", "d.py", 3, "python"), (5, "x", "stop", "calls", "a.py", 9, "python")], REFS)
    state = incremental.State(nodes, refs, names.cascade(refs, nodes))
    imports = spark.createDataFrame([("d.py", "alias", "run", "a"), ("c.py", "stop", "stop", "b")], "ref_file string, local string, exported string, module string")
    moved = nodes.where("id = 'a'").withColumn("start_line", F.lit(5))
    at = spark.createDataFrame([("a.py",)], "file_path string")
    _, again = incremental.update(state, at, moved, refs.where("ref_file = 'a.py'"), imports=imports)
    assert {r["ref_id"] for r in again.collect()} == {1, 3, 4, 5}
    _, again = incremental.update(state, at, nodes.where("id = 'a'"), refs.where("ref_file = 'a.py'"), imports=imports)
    assert {r["ref_id"] for r in again.collect()} == {5}


def all_chains(edges, named, hops, bridge):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out, todo = {}, [((s,), 0) for s in sorted(named)[:8]]
    while todo:
        path, streak = todo.pop()
        if len(path) > 1 and streak == 0:
            out.setdefault(path[0], []).append(path)
        for b in after.get(path[-1], ()) if len(path) < hops else ():
            s = 0 if b in named else streak + 1
            if b not in path and s <= bridge:
                todo.append(((*path, b), s))
    return {s: min(ps, key=lambda p: (-len(p), -sum(x in named for x in p), ">".join(map(str, p)))) for s, ps in out.items()}


@pytest.mark.parametrize("seed", range(2))
def test_longest_chains(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(1, 14), rng.randint(1, 14)) for _ in range(24)]
    named = {rng.randint(1, 14) for _ in range(7)}
    m, n = spark.createDataFrame([*edges, *edges[:2]], "at int, to int"), spark.createDataFrame([(x,) for x in named], "id int")
    assert {r["seed"]: tuple(r["path"]) for r in walk.longest_chains(m, n, 5).collect()} == all_chains(edges, named, 5, 1)
    # However many moves a node has, no more states than the beam go on.
    dense = spark.createDataFrame([(a, b) for a in range(40) for b in range(40) if a != b], "at int, to int")
    every = spark.createDataFrame([(x,) for x in range(40)], "id int")
    assert max(len(r["path"]) for r in walk.longest_chains(dense, every, 6, beam=50).collect()) == 6
    assert walk.paths(dense, every, 4, beam=30).count() == 3


def test_definitions_at_a_line_and_in_a_part_of_a_path(spark):
    nodes = spark.createDataFrame([("1", "function", "go", "go", "a/x.py", "python", 1, 5), ("2", "function", "go", "go", "b/y.py", "python", 20, 30), ("3", "function", "go", "go", "b/z.py", "python", 40, None)], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(tools.symbols(nodes, "go")) == ["1", "2", "3"] and ids(tools.symbols(nodes, "go", "B/")) == ["2", "3"] and ids(tools.symbols(nodes, "go", "none")) == ["1", "2", "3"]
    assert ids(tools.at_line(nodes, 25)) == ["2"] and ids(tools.at_line(nodes, 35)) == ["3"] and ids(tools.at_line(nodes, 9)) == ["1"] and ids(tools.at_line(nodes.limit(0), 9)) == []
