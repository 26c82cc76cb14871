"""Finding symbols and texts: full text with BM25, LIKE, fuzzy and exact channels, and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.text import kind_bonus, name_bonus, parse_query, path_score, search_terms
from graphmill.operators.intervals import top_per_group
from graphmill.schema import Graph

#: Okapi BM25; the usual constants.
K1, B = 1.2, 0.75
#: Weight of each column that is searched.
COLUMN_WEIGHTS = {"name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}


def tokens(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """term, id, tf, len."""
    words = docs.select(F.col(id).alias("id"), tokens(F.col(text)).alias("words"))
    return words.select("id", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id: str, text: str, terms: list[str], prefix: bool = False) -> DataFrame:
    """id, score: sum over the terms of idf * tf (k1 + 1) / (tf + k1 (1 - b + b len / mean len)); idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Terms are tested inside each text's words, so only matches leave the scan. prefix: a term finds words that begin with it.
    """
    words = docs.select(F.col(id).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    fits = lambda t: (lambda w: F.startswith(w, F.lit(t))) if prefix else (lambda w: w == F.lit(t))
    hit = [F.size(F.filter("words", fits(t))).alias(f"t{i}") for i, t in enumerate(terms)]
    counted = words.select("id", F.size("words").alias("len"), *hit)
    stats = counted.agg(F.count("*").alias("N"), F.avg("len").alias("mean"), *(F.count(F.when(F.col(f"t{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"t{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("N") - df + 0.5) / (df + 0.5))
        score += F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0)
    some = reduce(lambda a, b: a | b, (F.col(f"t{i}") > 0 for i in range(len(terms))), F.lit(False))
    return counted.where(some).join(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row


def full_text(nodes: DataFrame, query: str, most: int = 100) -> DataFrame:
    """id, score: BM25 over the searched columns by prefix, summed by their weights."""
    terms = search_terms(query, with_stems=False) or [query.lower()]
    have = [c for c in COLUMN_WEIGHTS if c in nodes.columns]
    found = reduce(DataFrame.unionByName, (bm25(nodes, "id", c, terms, prefix=True).withColumn("score", F.col("score") * COLUMN_WEIGHTS[c]) for c in have))
    return found.groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "id").limit(most)


def like_ranked(nodes: DataFrame, text: str) -> DataFrame:
    """id, name, score: 1 the name itself, 0.9 its beginning, 0.8 inside it, 0.7 inside the qualified name. Case of ASCII letters
    does not matter but for the name itself; % and _ in text are wild cards."""
    name, qualified = F.col("name"), F.col("qualified_name")
    score = F.when(name == text, 1.0).when(F.ilike(name, F.lit(f"{text}%")), 0.9).when(F.ilike(name, F.lit(f"%{text}%")), 0.8).when(F.ilike(qualified, F.lit(f"%{text}%")), 0.7)
    return nodes.select("id", "name", score.alias("score")).where("score is not null")


def fuzzy(nodes: DataFrame, text: str, names: int = 50, per_name: int = 5) -> DataFrame:
    """id, name, distance, score: names within one edit (up to four letters) or two; score 1 / (1 + distance)."""
    most = 1 if len(text) <= 4 else 2
    near = nodes.select("name").distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lit(text.lower()), most)).where("distance >= 0")
    near = near.orderBy("distance", "name").limit(names)
    return top_per_group(nodes.join(F.broadcast(near), "name"), ["name"], ["id"], per_name).select("id", "name", "distance", (1 / (1 + F.col("distance"))).alias("score"))


def exact_names(nodes: DataFrame, names: list[str], limit: int = 50, rare: int = 10) -> DataFrame:
    """id, name, score: nodes of the names, 20 more in a file that also holds a name which fewer than `rare` files hold."""
    low = F.lower("name")
    hits = nodes.where(low.isin([n.lower() for n in names])).select("id", low.alias("name"), "file_path")
    spread = hits.groupBy("name").agg(F.countDistinct("file_path").alias("files")).where(F.col("files") < rare)
    special = hits.join(spread, "name", "left_semi").select("file_path").distinct().withColumn("near", F.lit(20.0))
    scored = hits.join(special, "file_path", "left").select("id", "name", (1 + F.coalesce("near", F.lit(0.0))).alias("score"))
    return top_per_group(scored, ["name"], [F.desc("score"), "id"], max(8, -(-limit // max(1, len(names))))).drop("rank").orderBy(F.desc("score"), "id").limit(limit)


def filtered(nodes: DataFrame, kinds=(), languages=(), limit: int = 500) -> DataFrame:
    """Search without text: by name, score 1."""
    n = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    n = n.where(F.col("language").isin(*languages)) if languages else n
    return n.select("id", "name", F.lit(1.0).alias("score")).orderBy("name", "id").limit(limit)


def merge_max(*channels: DataFrame) -> DataFrame:
    """id, score: the best score of any channel."""
    return reduce(DataFrame.unionByName, (c.select("id", "score") for c in channels)).groupBy("id").agg(F.max("score").alias("score"))


def rescored(found: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """found with the bonuses of names, kinds and paths added to score."""
    n = found.join(nodes.select("id", "name", "kind", "file_path"), "id")
    return n.withColumn("score", F.col("score") + name_bonus(F.col("name"), query) + kind_bonus(F.col("kind")) + path_score(F.col("file_path"), query))


def search(nodes: DataFrame, raw: str, limit: int = 100, index=None) -> DataFrame:
    """id, name, kind, file_path, score: the cascade of full text, then LIKE, then fuzzy (each if nothing was found before), with exact
    names at the best score; bonuses; the limit; and only then the path: and name: filters of the query, so fewer rows may come back. index: a stored TextIndex of all
    nodes; then words are looked up instead of every text being read, and a word's rarity is that among all nodes."""
    from graphmill.operators import textindex

    q = parse_query(raw)
    n = nodes.where(F.col("kind").isin(*q.kinds)) if q.kinds else nodes
    n = n.where(F.col("language").isin(*q.languages)) if q.languages else n
    if not q.text:
        found = filtered(n, limit=5 * limit)
    else:
        found = full_text(n, q.text, max(5 * limit, 100)) if index is None else textindex.full_text(index, q.text, n, max(5 * limit, 100))
        if len(q.text) > 1 and found.isEmpty():
            found = like_ranked(n, q.text)
            if len(q.text) > 2 and found.isEmpty():
                found = fuzzy(n, q.text)
        best = found.agg(F.max("score")).first()[0] or 1.0
        names = [w for w in q.text.split() if len(w) > 1]
        if names:
            found = merge_max(found, exact_names(n, names, 20 * len(names)).withColumn("score", F.lit(float(best))))
    scored = rescored(found.select("id", "score"), n, q.text).orderBy(F.desc("score"), "id").limit(limit)
    for p in q.paths:
        scored = scored.where(F.contains(F.lower("file_path"), F.lit(p.lower())))
    for p in q.names:
        scored = scored.where(F.contains(F.lower("name"), F.lit(p.lower())))
    return scored


def corroborated(hits: DataFrame, groups: int) -> DataFrame:
    """id, score: hits (id, term_group, score) scored by how many of the query's term groups support them: 1 + half a point for each
    group beyond the first, and 0.3 of the score where only one of several does."""
    got = hits.groupBy("id").agg(F.max("score").alias("score"), F.countDistinct("term_group").alias("n"))
    factor = F.when((F.col("n") == 1) & F.lit(groups > 1), 0.3).otherwise(1 + 0.5 * (F.col("n") - 1))
    return got.select("id", (F.col("score") * factor).alias("score"), "n")


def relevant(graph: Graph, query: str, limit: int = 20, cap_share: float = 0.2, most: int = 100) -> DataFrame:
    """id, score, file_path: hybrid retrieval. Full text, exact names and names that begin with a term are merged by their best score,
    tests count 0.3, corroboration is applied, and a file may give at most max(5, cap_share * most) nodes."""
    from graphmill.functions.predicates import is_test

    terms = search_terms(query, with_stems=False)
    n = graph.nodes
    by_term = [n.where(F.contains(F.lower("name"), F.lit(t))).select("id", F.lit(i).alias("term_group"), (10 + F.when(F.lower("name").startswith(t), 10).otherwise(0)).cast("double").alias("score")) for i, t in enumerate(terms)]
    hits = full_text(n, query, 5 * limit).withColumn("term_group", F.lit(-1))
    hits = reduce(DataFrame.unionByName, by_term, hits.select("id", "term_group", "score"))
    scored = corroborated(hits, max(1, len(terms))).join(n.select("id", "file_path"), "id")
    scored = scored.withColumn("score", F.when(is_test(F.col("file_path")), F.col("score") * 0.3).otherwise(F.col("score")))
    return top_per_group(scored, ["file_path"], [F.desc("score"), "id"], max(5, int(cap_share * most))).orderBy(F.desc("score"), "id").limit(limit).select("id", "score", "file_path")


def nearest_by_name(nodes: DataFrame, part: str, limit: int) -> DataFrame:
    """Names that hold a part but do not begin with it, shortest first."""
    low = F.lower("name")
    return nodes.where(F.contains(low, F.lit(part.lower())) & ~low.startswith(part.lower())).select("id", "name").orderBy(F.length("name"), "name", "id").limit(limit)


def ranked(df: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    return df.withColumn("rank", F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order)))
