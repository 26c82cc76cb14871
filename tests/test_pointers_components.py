"""Function pointers in small C programs, the fixpoint of what slots hold, and strongly connected components."""

import random

import pytest
from pyspark.sql import functions as F

from graphmill import store
from graphmill.operators import pointers, traverse
from graphmill.sources import pointers as sources


def linked(spark, **files):
    """{(source, target, via)} by names of functions, of files named a_c for a.c."""
    rows = [(name.replace("_", "."), text) for name, text in files.items()]
    facts = store.settled(sources.facts(spark.createDataFrame(rows, "path string, text string").repartition(2)))
    functions = facts.where("what = 'function'").select(F.concat_ws(":", "file_path", "value").alias("id"), F.col("value").alias("name"), "file_path")
    return {(r["source"], r["target"], r["via"]) for r in pointers.pointer_calls(facts, functions).collect()}


def test_tables_typedefs_and_chains(spark):
    header = "typedef int (*hook_fn)(int);\ntypedef void op_t(int);\nstruct cmd { const char *name; hook_fn run; int flags; };\nstruct client { int fd; struct cmd *cmd; };\n"
    table = """
    int add(int x) { return x; }
    int del(int x) { return x; }
    static struct cmd cmds[] = {{"add, or {", add, 0}, {.name = "del", .run = &del}, /* {"no", gone, 0}, */ {"nil", NULL, 0}};
    int direct(struct cmd *c, int n) { return c->run(n); }
    int chained(struct client *c) { return c->cmd->run(1); }
    int indexed(int i) { return (cmds[i].run)(2); }
    int unrelated(struct client *c) { return c->fd; }
    """
    got = linked(spark, types_h=header, table_c=table)
    assert got == {(f"table.c:{s}", f"table.c:{t}", "cmd.run") for s in ("direct", "chained", "indexed") for t in ("add", "del")}


def test_assignments_copies_and_fields_of_one_struct(spark):
    text = """
    struct hook { int (*func)(int); };
    struct entry { int id; int (*fn)(int); };
    int one(int x) { return x; }
    int two(int x) { return x; }
    void fill(struct entry *e) { e->fn = one; }
    void set(struct hook *h, struct entry *found) { h->func = found->fn; h->func = two; }
    int fire(void *p) { return unknown()->func(1); }
    int guess(void *q) { return q->fn(1); }
    int call_it(struct hook *h) { if (h->func) { return h->func(3); } }
    """
    got = linked(spark, h_c=text)
    assert {x[1] for x in got if x[0] == "h.c:call_it"} == {"h.c:one", "h.c:two"}
    assert {x[1] for x in got if x[0] == "h.c:guess"} == {"h.c:one"}


def test_inline_structs_and_arrays(spark):
    a = """
    typedef void op_t(int);
    typedef void (*dtor_t)(int);
    static void nop(int x) { }
    static void inc(int x) { }
    static op_t *ops[256] = {nop, [3] = inc, 0};
    static dtor_t gone[] = {(dtor_t)nop};
    static int plain[] = {nop};
    struct tag { char *s; void (*go)(int); } table[] = { {"x", inc}, };
    void run(int i) { ops[i](1); }
    void end(int i) { (*gone[kind(i)])(1); plain[i](2); }
    void each(int i) { table[i].go(1); }
    """
    b = "static void nop(int x) { }\nstatic op_t *ops[2] = {nop};\nvoid step(int i) { ops[i](1); }\n"
    got = linked(spark, a_c=a, b_c=b, d_c="void other(int i) { ops[i](1); gone[i](1); }")
    assert {x[1:] for x in got if x[0] == "a.c:run"} == {("a.c:nop", "ops[]"), ("a.c:inc", "ops[]")}
    assert {x[1:] for x in got if x[0] == "b.c:step"} == {("b.c:nop", "ops[]")}
    assert {x[1:] for x in got if x[0] == "a.c:end"} == {("a.c:nop", "gone[]")}
    assert {x[1:] for x in got if x[0] == "a.c:each"} == {("a.c:inc", "tag.go")}
    # Two arrays of one name, neither in the file: none; the only one of its name: that.
    assert {x[1:] for x in got if x[0] == "d.c:other"} == {("a.c:nop", "gone[]")}


def test_fan_out_is_cut_after_the_closure(spark):
    many = "".join(f"int f{i}(int x) {{ return x; }}\n" for i in range(12))
    table = "struct s { int (*go)(int); };\nstruct s t[] = {" + ", ".join(f"{{f{i}}}" for i in range(12)) + "};\nint call(struct s *p) { return p->go(1); }\n"
    facts = store.settled(sources.facts(spark.createDataFrame([("m.c", many + table), ("n.c", None), ("o.c", "")], "path string, text string")))
    functions = facts.where("what = 'function'").select(F.col("value").alias("id"), F.col("value").alias("name"), "file_path")
    assert pointers.pointer_calls(facts, functions).count() == 12
    assert [r["target"] for r in pointers.pointer_calls(facts, functions, 3).orderBy("target").collect()] == ["f0", "f1", "f10"]


def test_all_targets_of_large_sets(spark, monkeypatch):
    """700 functions of a table, called by ten functions, one of them through a second field that holds half of the same; no target is left out."""
    monkeypatch.setattr(pointers, "PIECE", 50)
    many = "".join(f"int f{i}(int x) {{ return x; }}\n" for i in range(700))
    table = "struct s { int (*go)(int); int (*no)(int); };\nstruct s t[] = {" + ", ".join(f"{{f{i}, f{i // 2}}}" for i in range(700)) + "};\n"
    calls = "".join(f"int call{i}(struct s *p) {{ return p->go(1); }}\n" for i in range(9)) + "int both(struct s *p) { p->no(1); return p->go(1) + p->no(2); }\n"
    got = linked(spark, m_c=many + table + calls)
    want = {(f"m.c:call{i}", f"m.c:f{j}", "s.go") for i in range(9) for j in range(700)}
    # Both calls stand on one line, so the lesser slot comes first.
    assert got == want | {("m.c:both", f"m.c:f{j}", "s.go") for j in range(700)}


def test_slots_share_sets_and_add_their_own(spark):
    """A row of 40 copies of 500 targets, of which each slot adds one: its set is not written again for every slot."""
    bound = [("s0", f"f{i}") for i in range(500)] + [(f"s{i}", f"own{i}") for i in range(40)] + [("s9", "f7")]
    copies = [(f"s{i + 1}", f"s{i}") for i in range(39)]
    names, sets = pointers.shared_sets(spark.createDataFrame(bound, "slot string, target string"), spark.createDataFrame(copies, "to_slot string, from_slot string"))
    got = sorted((r["slot"], r["target"]) for r in names.join(sets, "of").collect())
    assert got == sorted((f"s{i}", t) for i in range(40) for t in [f"f{j}" for j in range(500)] + [f"own{j}" for j in range(i + 1)])
    assert sets.count() < 2000


@pytest.mark.parametrize("seed", range(2))
def test_points_to_is_the_least_fixpoint(spark, seed):
    rng = random.Random(seed)
    bound = {(f"s{rng.randint(0, 9)}", f"f{rng.randint(0, 5)}") for _ in range(8)}
    copies = {(f"s{rng.randint(0, 12)}", f"s{rng.randint(0, 12)}") for _ in range(16)} | {(f"r{i + 1}", f"r{i}") for i in range(11)} | {("r0", "s0")}
    want = set(bound)
    while more := {(to, f) for to, from_ in copies for s, f in want if s == from_} - want:
        want |= more
    got = pointers.points_to(spark.createDataFrame(list(bound), "slot string, target string"), spark.createDataFrame(list(copies), "to_slot string, from_slot string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plain_components(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def reached(a):
        seen, todo = {a}, [a]
        while todo:
            for y in after[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    all_of = {a: reached(a) for a in after}
    group = {a: [b for b in all_of[a] if a in all_of[b]] for a in after}
    return sorted((a, min(g), len(g)) for a, g in group.items())


@pytest.mark.parametrize("seed, nodes, edges", [(1, 30, 40), (2, 25, 60), (3, 40, 36)])
def test_components_of_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    e = [(rng.randint(1, nodes), rng.randint(1, nodes)) for _ in range(edges)]
    got = traverse.components(spark.createDataFrame([*e, *e[:3], (None, 1)], "at int, to int"))
    assert sorted(map(tuple, got.collect())) == plain_components(e)


def test_components_of_nothing_and_cyclic(spark):
    assert traverse.components(spark.createDataFrame([], "at string, to string")).count() == 0
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("b", "d")], "at string, to string")
    assert sorted(r["id"] for r in traverse.cyclic(e).collect()) == ["a", "b", "c"]


def test_rings_of_copies_take_few_rounds(spark, monkeypatch):
    """A ring of 400 slots, a row that hangs on it and one slot that copies from two: a round a slot would write hundreds of tables."""
    written = []
    monkeypatch.setattr(pointers, "settled", lambda df, name="step": written.append(name) or store.settled(df, name))
    copies = [(f"r{(i + 1) % 400:03}", f"r{i:03}") for i in range(400)] + [(f"t{i}", f"t{i - 1}" if i else "r007") for i in range(6)] + [("both", "t5"), ("both", "apart")]
    bound = [(f"r{i:03}", f"f{i:03}") for i in range(0, 400, 4)] + [("t2", "a"), ("t4", "f000"), ("apart", "b"), ("free", "f1")]
    got = {}
    for r in pointers.points_to(spark.createDataFrame(bound, "slot string, target string"), spark.createDataFrame(copies, "to_slot string, from_slot string")).collect():
        assert r["target"] not in got.setdefault(r["slot"], set())
        got[r["slot"]].add(r["target"])
    ring = {f"f{i:03}" for i in range(0, 400, 4)}
    want = {f"r{i:03}": ring for i in range(400)} | {f"t{i}": ring | ({"a"} if i >= 2 else set()) for i in range(6)}
    assert got == want | {"both": ring | {"a", "b"}, "apart": {"b"}, "free": {"f1"}}
    assert len(written) < 150


def test_first_targets_of_shared_sets(spark):
    """With `keep`, every slot's set is the first of what it may hold, on graphs with rings and slots that copy from several."""
    draw = random.Random(11)
    copies = {(f"s{draw.randrange(30)}", f"s{draw.randrange(30)}") for _ in range(34)}
    bound = {(f"s{draw.randrange(30)}", f"f{draw.randrange(60):02}") for _ in range(70)}
    held = {s: {t for x, t in bound if x == s} for s in {x for c in copies for x in c} | {x for x, _ in bound}}
    for _ in held:
        for a, b in copies:
            held[a] |= held[b]
    names, sets = pointers.shared_sets(spark.createDataFrame(list(bound), "slot string, target string"), spark.createDataFrame(list(copies), "to_slot string, from_slot string"), 5)
    got = {r["slot"]: sorted(r["t"]) for r in names.join(sets, "of").groupBy("slot").agg(F.collect_list("target").alias("t")).collect()}
    assert got == {s: sorted(t)[:5] for s, t in held.items() if t}
