"""Line dedup by winnowing over line hashes, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import NULL_ID, join_hot, row_key, stage

#: Lines in the shortest run that counts as repeated, and words of a line that counts as a run of its own.
MIN_RUN, LONG_WORDS = 3, 20
_BLANKS = r"[ \t\r\f\x0B]+"


def line_hashes(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, row_hash, and of each line that is not blank, without white space at its ends: hashes, and seconds: a second hash,
    by another seed, of lines of long_words words or more (else null)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\u000b"))), lambda x: x != "")
    # long_words words have at least that many letters and one blank between each two; the others need not be cut.
    is_long = lambda x: (F.length(x) >= 2 * long_words - 1) & (F.size(F.split(x, _BLANKS)) >= long_words)
    seconds = F.transform("lines", lambda x: F.when(is_long(x), F.xxhash64(F.lit(17), x)))
    cut = row_key(docs).where("text is not null").select("doc_id", "row_hash", lines.alias("lines"))
    return cut.select("doc_id", "row_hash", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), seconds.alias("seconds"))


def fingerprints(hashed: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, row_hash, at, fp, g, near: what winnowing selects of each document, a row a selected line.

    The smallest hash of each window of min_run lines (of equal ones the rightmost) is selected, once however many windows
    choose it, so every run of min_run lines holds a fingerprint (fp, at line `at`, from 0). Long lines are selected
    too. near: the hashes of the lines around, min_run - 1 before and after (null beyond the ends).
    """
    n, w = F.size("hashes"), min_run
    at = lambda i: F.get("hashes", i)
    # The rightmost smallest of w hashes from i on: each next one takes over if it is no larger.
    place = lambda i: reduce(lambda best, k: F.when(at(i + k) <= F.array_min(F.slice("hashes", i + 1, k)), i + k).otherwise(best), range(1, w), i)
    minima = F.when(n >= w, F.transform(F.sequence(F.lit(0), n - w), place)).otherwise(F.array().cast("array<int>")) if w > 1 else F.sequence(F.lit(0), n - 1)
    long_ones = F.filter(F.transform("seconds", lambda g, i: F.when(g.isNotNull(), i)), lambda i: i.isNotNull())
    chosen = hashed.where(n > 0).select("*", F.explode(F.array_union(minima, long_ones)).alias("at"))
    near = F.array(*(at(F.col("at") + k) for k in range(1 - w, w)))
    return chosen.select("doc_id", "row_hash", "at", at(F.col("at")).alias("fp"), F.get("seconds", F.col("at")).alias("g"), near.alias("near"))


def _extension(near: Column, other: Column, at: Column, other_at: Column, step: int, most: int) -> Column:
    """How many lines in a row, from one step beyond, are alike around two matching places; most: how far to look."""
    alike, total = F.lit(True), F.lit(0)
    for k in range(1, most + 1):
        alike = alike & F.coalesce(F.get(near, at + step * k) == F.get(other, other_at + step * k), F.lit(False))
        total = total + alike.cast("int")
    return total


def repeated_lines(hashed: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, row_hash, deleted: array of (first, after the last) lines of each maximal run that repeats an earlier one.

    Lines count as equal by 64 bits each, so a run by 64 * min_run bits; a long line on its own by 128.
    """
    w = min_run
    found = stage(fingerprints(hashed, w), "fingerprints")
    # A run can only repeat if its fingerprint occurs at two places; (min, max, count) is combined before the shuffle.
    place = F.struct("doc_id", "row_hash", "at")
    twice = found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a != b").select("fp", "n")
    candidates = join_hot(found, stage(twice, "repeated"), ["fp"]).drop("n")
    # The windows whose fingerprint this is, by all their lines. head: where in `near` the window begins.
    windows = [F.struct(F.lit(head).alias("head"), F.lit(w).alias("size"), F.slice("near", head + 1, w).alias("key")) for head in range(w)]
    windows = F.filter(F.array(*windows), lambda x: ~F.exists(x["key"], lambda h: h.isNull()) & (F.array_min(x["key"]) == F.col("fp")))
    alone = F.when(F.col("g").isNotNull(), F.array(F.struct(F.lit(w - 1).alias("head"), F.lit(1).alias("size"), F.array("fp", "g").alias("key")))).otherwise(F.slice(windows, 1, 0))
    cut = stage(candidates.select("doc_id", "row_hash", "at", "near", F.inline(F.concat(windows, alone))).withColumn("from", F.col("at") + F.col("head") - (w - 1)), "windows")
    # Each place meets the earliest place of the same lines, one row each: never pairs of later places.
    place = F.struct("doc_id", "row_hash", "from")
    first = cut.groupBy("size", "key").agg(F.min(F.struct(place.alias("place"), "head", "near")).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = stage(first.where("first.place != last").select("size", "key", "first", "n"), "first")
    met = join_hot(cut, first, ["size", "key"]).where(place > F.col("first.place"))
    # A match goes on to the left and to the right as long as the lines there match too; the next fingerprint is within reach.
    reach = lambda at, other, step: F.when(F.col("size") == w, _extension(F.col("near"), F.col("first.near"), at, other, step, w - 1)).otherwise(0)
    left, right = reach(F.col("head"), F.col("first.head"), -1), reach(F.col("head") + w - 1, F.col("first.head") + w - 1, 1)
    later = met.select("doc_id", "row_hash", (F.col("from") - left).alias("from"), (F.col("from") + F.col("size") + right).alias("to")).distinct()
    order = Window.partitionBy("doc_id", "row_hash").orderBy("from", "to")
    reached = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("from") <= F.col("reached"), 0).otherwise(1)).over(order)
    runs = later.withColumn("reached", reached).withColumn("run", run).groupBy("doc_id", "row_hash", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return runs.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("deleted"))


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with each later repeated run of lines deleted from text, and n_lines and n_deleted.

    A run is min_run or more consecutive lines (blank ones don't count, and white space at a line's
    ends neither), or one line of long_words or more words, that also stand, in that order, at an earlier place: in a document with a smaller
    doc_id, or further up in the same one. Rows of one doc_id go by a hash of their texts; of rows
    alike in both, each counts as the same place, so neither is emptied by the other. A null doc_id
    comes first. Null text stays null with 0 lines; shorter texts stay as they are; blank lines stay.
    Columns of the given names are replaced. n_chars, where docs has it, is kept in step with text.

    Shuffles: fingerprints (numbers; about every second line) twice, but for those of hot lines, and texts once, to meet
    what is to be deleted from them.
    """
    gone = repeated_lines(line_hashes(docs, long_words), min_run)
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted", "row_id", "row_hash", "deleted", "lines", "places", "gone")]
    keyed = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("row_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"))
    met = keyed.join(gone.withColumnRenamed("doc_id", "row_id"), ["row_id", "row_hash"], "left")
    blank = lambda x: F.btrim(x, F.lit(" \t\r\f\u000b")) == ""
    met = met.withColumn("lines", F.split("text", "\n"))
    places = F.transform(F.filter(F.transform("lines", lambda x, i: F.struct(blank(x).alias("blank"), i.alias("i"))), lambda s: ~s["blank"]), lambda s: s["i"])
    met = met.withColumn("places", places)
    # From numbers of lines that aren't blank to numbers of all lines.
    met = met.withColumn("gone", F.transform("deleted", lambda r: F.struct(F.element_at("places", r["from"] + 1).alias("a"), F.element_at("places", r["to"]).alias("z"))))
    left = F.array_join(F.filter("lines", lambda x, i: blank(x) | ~F.exists("gone", lambda r: (i >= r["a"]) & (i <= r["z"]))), "\n")
    text = F.when(F.col("deleted").isNull(), F.col("text")).otherwise(left)
    n_lines = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    n_deleted = F.coalesce(F.aggregate("deleted", F.lit(0), lambda a, r: a + r["to"] - r["from"]), F.lit(0)).cast("long")
    out = met.select(*(text.alias(c) if c == "text" else F.col(c) for c in columns), n_lines.alias("n_lines"), n_deleted.alias("n_deleted"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


ORACLE_SQL = r"""
with docs as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
lines as (
  select doc_id, i, line, trim(line, chr(32)||chr(9)||chr(13)||chr(12)||chr(11)) as t
  from (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as i from docs)),
kept as (select doc_id, i, t, row_number() over (partition by doc_id order by i) as n from lines where t <> ''),
windows as (
  select doc_id, i, n, t || chr(10) || lead(t) over w || chr(10) || lead(t, 2) over w as win
  from kept window w as (partition by doc_id order by n)),
firsts as (
  select doc_id, n, 3 as size, row_number() over (partition by win order by doc_id, n) as nth from windows where win is not null
  union all select doc_id, n, 1, row_number() over (partition by t order by doc_id, n) from kept where len(string_split_regex(t, '[ \t\r\f\x0B]+')) >= 20),
gone as (select distinct doc_id, n + k as n from firsts, (values (0), (1), (2)) v(k) where nth > 1 and k < size),
left_over as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text
  from lines l left join kept k on k.doc_id = l.doc_id and k.i = l.i left join gone g on g.doc_id = k.doc_id and g.n = k.n
  where g.n is null group by l.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(o.text, '') end as text,
  (select count(*) from kept k where k.doc_id = d.doc_id) as n_lines,
  (select count(*) from gone g where g.doc_id = d.doc_id) as n_deleted
from docs d left join left_over o on o.doc_id = d.doc_id
"""
