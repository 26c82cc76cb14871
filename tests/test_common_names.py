"""Names that very many nodes bear: strategies must count them before they join them."""

import random

from pyspark.sql import functions as F

from graphmill.operators import names

NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int"
REF = "ref_id long, ref_name string, ref_kind string, ref_file string, ref_line int, ref_language string, from_id string"


def plain_values(refs, nodes):
    """as_value, reference by reference."""
    out = set()
    for ref, name, _, file, _, language, source in refs:
        member, last = "::" in name, name.split("::")[-1]
        met = [n for n in nodes if n[2] == last and n[0] != source and n[5] == language]
        met = [n for n in met if (n[3] == name or n[3].endswith("::" + name) if member else n[1] == "function" or language != "python")]
        here = sorted((n[6], n[0]) for n in met if n[4] == file)
        if here or len(met) == 1:
            out.add((ref, here[0][1] if here else met[0][0], 0.9 if member else 0.8 if not here else 0.95 if len(here) == 1 else 0.9))
    return out


def test_function_values_are_those_of_a_plain_version(spark):
    draw = random.Random(5)
    nodes = []
    for i in range(160):
        name, method = f"do{draw.choice([0, 0, 1, 2, i])}", draw.random() < 0.5
        nodes.append((f"n{i}", "method" if method else "function", name, f"a::T{draw.randrange(4)}::{name}" if method else name, f"f{draw.randrange(5)}", draw.choice(["java", "python"]), draw.randrange(9)))
    refs = []
    for i in range(600):
        n = draw.choice(nodes)
        name = draw.choice([n[2], n[2], "::".join(n[3].split("::")[-2:]), n[3], "T9::do0"])
        refs.append((i, name, "function_ref", draw.choice([n[4], f"f{draw.randrange(5)}", None]), 1, n[5], draw.choice([n[0], "n3", None, "elsewhere"])))
    got = names.as_value(spark.createDataFrame(refs, REF), spark.createDataFrame(nodes, NODE)).collect()
    assert len(got) == len({r["ref_id"] for r in got})
    assert {(r["ref_id"], r["target"], float(r["confidence"])) for r in got} == plain_values(refs, nodes)


def test_function_values_do_not_list_all_pairs(spark):
    """60,000 references to a name of 60,000 functions: the pairs would be 3,600,000,000 rows."""
    n = 60_000
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    i = F.col("id")
    nodes = spark.range(n).select(text("n", i).alias("id"), F.lit("function").alias("kind"), F.lit("do").alias("name"), F.lit("do").alias("qualified_name"), text("f", i % 50).alias("file_path"), F.lit("java").alias("language"), i.cast("int").alias("start_line"))
    refs = spark.range(n).select(i.alias("ref_id"), F.lit("do").alias("ref_name"), F.lit("function_ref").alias("ref_kind"), text("f", i % 100).alias("ref_file"), F.lit(1).alias("ref_line"), F.lit("java").alias("ref_language"), text("n", i).alias("from_id"))
    got = {r["target"]: r["n"] for r in names.as_value(refs, nodes).groupBy("target").agg(F.count("*").alias("n")).collect()}
    # Each file's first function for all of the file, but for that function itself, which gets the next.
    assert got == {f"n{j}": n // 100 - 1 for j in range(50)} | {f"n{j + 50}": 1 for j in range(50)}
