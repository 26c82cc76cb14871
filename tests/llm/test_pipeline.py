"""Each stage of the pipeline against a plain version of what it decides, on its own input."""

import re

import brute
import corpus_pipeline
from test_contracts import check_packing

from graphmill.llm.common import stage, table


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def check_language(before, after):
    kept = dict(after)
    assert set(after) <= set(before)
    assert not any(t is None or not re.search(r"[^\W\d_]", t) for t in kept.values())
    prose = [d for d, t in before if t and len(brute.WORD.findall(t)) >= 30]
    assert sum(d in kept for d in prose) >= 0.95 * len(prose)


def check_lines(before, after):
    assert after == [(d, t) for d, t, _, _ in brute.lines(before)]


def check_near(before, after):
    first = {d for d, _, _, kept in brute.near(before, 5) if kept}
    assert after == [x for x in before if x[0] in first]


def test_stages(spark, sf):
    items = [(r[0], r[1]) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]

    def check_benchmarks(before, after):
        clean = {r[0] for r in brute.leaks(before, items) if r[2] == 0}
        assert after == [x for x in before if x[0] in clean]

    checks = {"language": check_language, "lines": check_lines, "near_duplicates": check_near, "benchmarks": check_benchmarks}
    docs = table(spark, sf, "documents")
    names = docs.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, docs = pairs(docs), stage(f(spark, docs, sf), f"test-{name}")
        after = pairs(docs)
        assert docs.columns == names and 0 < len(after) <= len(before)
        checks[name](before, after)
    check_packing(pairs(docs), corpus_pipeline.STAGES[-1][1](spark, docs, sf))
