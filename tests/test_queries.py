"""Every query of the reference's own operators against its SQL, and the entry points."""

import decimal
import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from graphmill.plans import catalogue, dispatch, projects, resolution, serving

QUERIES = catalogue.QUERIES | resolution.QUERIES | serving.QUERIES | dispatch.QUERIES | projects.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | resolution.ORACLE_SQL | serving.ORACLE_SQL | dispatch.ORACLE_SQL | projects.ORACLE_SQL


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_folders(tmp_path):
    """The repository stays usable where graphmill/llm, tests/llm and corpus_pipeline.py are gone, in any combination."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "a", ignore=skip)
    shutil.copytree(tmp_path / "a", tmp_path / "b", ignore=shutil.ignore_patterns("corpus_pipeline.py"))
    for copy in ("a", "b"):
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
        done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / copy, env=os.environ | {"PYTHONPATH": str(tmp_path / copy)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("word, want", [("running", {"runn", "runne", "run"}), ("Cities", {"city"}), ("caches", {"cach"}), ("parsed", {"pars", "parse"}), ("agreed", set()), ("parser", {"pars", "parse"}), ("section", {"sect"}), ("class", set()), ("used", set())])
def test_stems(word, want):
    from graphmill.functions.text import stems

    assert stems(word) == want
