"""The trie of conversations' first turns, by prefix doubling: blocks of 1, 2, 4, .. turns get dense names in logarithmically many join rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import stage

_ROW_BITS = 33


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with `number`: 0, 1, 2, .. in the order of its partitions and of the rows within each. Only the partitions' sizes meet in one place."""
    rows = stage(df.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", _ROW_BITS).alias("part")
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy(part).agg(F.count("*").alias("size")).select("part", before.alias("before"))
    number = (F.col("before") + F.col("at").bitwiseAND((1 << _ROW_BITS) - 1)).alias("number")
    return rows.select("*", part).join(F.broadcast(offsets), "part").select(*df.columns, number)


def named(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with its keys replaced by `name`: a dense number, the same for the same keys. A key of many rows is counted before it is shuffled, and is one row to meet."""
    names = numbered(df.select(*keys).distinct(), f"names-{name}").withColumnRenamed("number", "name")
    return stage(df.join(names, keys).drop(*keys), name)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (0, 1, ..), digest, n_bytes of each turn, in order of turn (null first), of equal turns by digest.

    Null role or text is empty; rows without conv_id are left out, as are other columns. digest tells (role, text) apart by 256 bits. Rows are
    numbered along one sorted order that is dealt out by ranges, so a long conversation is no task of its own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)).alias("digest")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest, F.octet_length(text).cast("long").alias("n_bytes"))
    by = ["conv_id", "turn", "digest"]
    turns = numbered(turns.repartitionByRange(*by).sortWithinPartitions(*by), "turns")
    first = turns.groupBy("conv_id").agg(F.min("number").alias("first"))
    return turns.join(first, "conv_id").select("conv_id", (F.col("number") - F.col("first")).alias("pos"), "digest", "n_bytes")


def sizes(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations with n_turns) where each conversation c begins with the first h turns of conversation c - c % 5 and goes on after its own first h;
    h: the crc32 of the decimal id modulo 9. The remainder has the sign of c. Each row is read at most 10 times, whatever the conversations' sizes."""
    turns = stage(turns, "ordered")
    own = sizes(turns).select("conv_id", "n_turns", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    had = own.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("there"))
    own = stage(own.join(had, "base", "left").select("conv_id", "base", "h", "n_turns", F.least("h", F.coalesce("there", F.lit(0))).alias("head")), "conversations")
    heads = turns.where("pos < 8").withColumnRenamed("conv_id", "base").join(own.select("conv_id", "base", "h"), "base").where("pos < h")
    tails = turns.join(own.select("conv_id", "h", "head"), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    whole = ["conv_id", "pos", "digest", "n_bytes"]
    n_turns = F.col("head") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    return heads.select(*whole).unionByName(tails.select(*whole)), own.select("conv_id", n_turns.alias("n_turns"))


def _blocks(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, pos, size, name of each block of size = 1, 2, 4, .. turns that begins at a multiple of its size: about two rows a turn."""
    level = named(turns.select("conv_id", "pos", "digest"), ["digest"], "block-1")
    blocks, size = level.withColumn("size", F.lit(1).cast("long")), 1
    while 2 * size <= longest:
        left = level.where(F.col("pos") % (2 * size) == 0).withColumnRenamed("name", "a")
        right = level.where(F.col("pos") % (2 * size) == size).select("conv_id", (F.col("pos") - size).alias("pos"), F.col("name").alias("b"))
        size *= 2
        level = named(left.join(right, ["conv_id", "pos"]), ["a", "b"], f"block-{size}")
        blocks = blocks.unionByName(level.withColumn("size", F.lit(size).cast("long")))
    return blocks


def _prefixes(blocks: DataFrame, longest: int) -> DataFrame:
    """conv_id, depth, name: names of the first `depth` turns, the same for the same turns (among those of one depth).

    A prefix is the one without the lowest binary digit of its depth, and the block of that digit. So prefixes whose depths have
    j digits 1 come from those with j - 1, and each is named once.
    """
    digits = F.bit_count("pos")
    low = F.col("pos").bitwiseAND(-F.col("pos"))
    last = blocks.where("pos = 0").select("conv_id", F.col("size").alias("depth"), "name")
    all_of, j = last, 1
    while (1 << (j + 1)) - 1 <= longest:
        more = blocks.where((F.col("pos") > 0) & (digits == j) & (F.col("size") < low)).withColumnRenamed("name", "b")
        met = more.join(last.select("conv_id", F.col("depth").alias("pos"), F.col("name").alias("a")), ["conv_id", "pos"])
        met = met.select("conv_id", (F.col("pos") + F.col("size")).alias("depth"), "a", "b").withColumn("d", F.col("depth"))
        last = named(met, ["d", "a", "b"], f"prefix-{j + 1}").select("conv_id", "depth", "name")
        all_of, j = all_of.unionByName(last), j + 1
    return all_of


def _before(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """depth, name, and the sums of columns over the nodes above that have the same smallest member. One running sum over all nodes,
    dealt out by ranges of (conv_id, depth), less where the conversation's begins."""
    by = ["conv_id", "depth"]
    rows = stage(nodes.select("depth", "name", "conv_id", *columns).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()), "chains")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(*(F.sum(c).alias(c) for c in columns)).select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"o_{c}") for c in columns))
    local = rows.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"w_{c}") for c in columns))
    sums = stage(local.join(F.broadcast(offsets), "part").select("depth", "name", "conv_id", *((F.col(f"o_{c}") + F.col(f"w_{c}")).alias(c) for c in columns)), "sums")
    begins = sums.groupBy("conv_id").agg(*(F.min(c).alias(f"b_{c}") for c in columns))
    return sums.join(begins, "conv_id").select("depth", "name", *((F.col(c) - F.col(f"b_{c}")).alias(f"before_{c}") for c in columns))


def _listed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, name, conv_id) to the ids of each node in this batch, comma-joined, with the first of them."""
    for b in batches:
        depth, name, ids = (b.column(c).to_pylist() for c in ("depth", "name", "conv_id"))
        out, at = [], 0
        while at < len(ids):
            to = at + 1
            while to < len(ids) and name[to] == name[at] and depth[to] == depth[at]:
                to += 1
            out.append((depth[at], name[at], ids[at], ",".join(map(str, ids[at:to]))))
            at = to
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["depth", "name", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's lists in order; only its state is held, however many ids a node has."""
    key, state, done = None, None, []
    for b in batches:
        for depth, name, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "name", "ids"))):
            if key != (depth, name):
                done += [(*key, state.hexdigest())] if key else []
                key, state = (depth, name), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done)], names=["depth", "name", "ends_sha256"])
            done = []
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=["depth", "name", "ends_sha256"])


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The members of all nodes: conv_id, depth, name, n_bytes (of the last text), n_turns (of the conversation), written.

    turns: as ordered_turns gives them. conversations: conv_id, n_turns, once each, those without turns too. A node is (depth, name); the root is (0, 0) and has
    every conversation. The conversations' greatest length is the one number that comes to the driver. Work: about two rows a turn for blocks and one for prefixes.
    """
    turns, conversations = stage(turns, "members"), stage(conversations, "lengths")
    longest = conversations.agg(F.max("n_turns")).first()[0] or 0
    names = _prefixes(_blocks(turns, longest), longest)
    texts = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_bytes")
    rows = names.join(texts, ["conv_id", "depth"]).join(conversations, "conv_id").select("conv_id", "depth", "name", "n_bytes", "n_turns")
    zero = F.lit(0).cast("long")
    return stage(rows.unionByName(conversations.select("conv_id", zero.alias("depth"), zero.alias("name"), zero.alias("n_bytes"), "n_turns")), "trie")


def nodes(rows: DataFrame) -> DataFrame:
    """A row a node of trie's members: depth, name, conv_id (smallest member), parent_name, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.

    Sums over a subtree: what the nodes of one smallest member weigh is summed a conversation, then over a node's members, less what lies above the node.
    No conversations give no rows.
    """
    node = ["depth", "name"]
    plain = rows.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_turns").alias("deepest"), F.min("n_bytes").alias("n_bytes"))
    weighed = plain.select("*", (F.col("deepest") == F.col("depth")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("weight"))
    above = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_name"))
    linked = stage(weighed.join(above, ["conv_id", "depth"], "left"), "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("parent_name").alias("name")]
    children = linked.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    weights = ["leaf", "weight"]
    owned = linked.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in weights))
    below = rows.select(*node, "conv_id").join(owned, "conv_id").groupBy(*node).agg(*(F.sum(c).alias(f"all_{c}") for c in weights))
    out = linked.join(_before(linked, weights), node).join(below, node, "left").join(children, node, "left")
    parents = linked.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, ["depth", "parent_name"], "left")
    total = lambda c: (F.coalesce(f"all_{c}", F.lit(0)) - F.col(f"before_{c}")).cast("long")
    return out.select(*node, "conv_id", "parent_name", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), total("leaf").alias("n_leaves"), total("weight").alias("saved_tokens"))


def ends_digest(rows: DataFrame) -> DataFrame:
    """depth, name, ends_sha256: of the members that end at the node, their decimal ids in order, comma-joined. Ids are sorted and joined in ranges;
    only the joined pieces of a node meet, and are read one after another."""
    by = ["depth", "name", "conv_id"]
    pieces = rows.where("depth = n_turns").select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_listed_ids, "depth long, name long, first long, ids string")
    order = ["depth", "name", "first"]
    return pieces.repartition("depth", "name").sortWithinPartitions(*order).mapInArrow(_hashed_ids, "depth long, name long, ends_sha256 string")


def digest(rows: DataFrame) -> DataFrame:
    """A row a node with the contract's columns."""
    nobody: Column = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes(rows).join(ends_digest(rows), ["depth", "name"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


ORACLE_SQL = r"""
with recursive crc_table as (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end) as t
  from (select unnest(range(256))::bigint as i)),
crc as (select list(t order by i) as t from crc_table),
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
convs as (
  select conv_id, n, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8))) % 9 as h
  from (select conv_id, count(*) as n from turns group by conv_id), crc),
lengths as (select c.conv_id, c.conv_id - c.conv_id % 5 as base, c.n, c.h, least(c.h, coalesce(b.n, 0)) as head from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 5),
built as (
  select l.conv_id, t.pos, t.role, t.text from lengths l join turns t on t.conv_id = l.base where t.pos < l.h
  union all select l.conv_id, t.pos - l.h + l.head, t.role, t.text from lengths l join turns t on t.conv_id = l.conv_id where t.pos >= l.h),
numbered as (select conv_id, pos, text, md5(length(role) || ':' || role || text) as word from built),
chains as (
  select conv_id, 0::bigint as depth, '' as path, '' as parent, 0::bigint as bytes, head + greatest(n - h, 0) as size from lengths
  union all
  select c.conv_id, c.depth + 1, md5(c.path || n.word), c.path, strlen(n.text), c.size
  from chains c join numbered n on n.conv_id = c.conv_id and n.pos = c.depth),
nodes as (
  select depth, path, min(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, max(size) as deepest, (count(*) - 1) * min(bytes) as weight,
    sha256(coalesce(string_agg(case when size = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from chains group by depth, path),
pairs as (
  select depth, path, depth as at, path as top, parent as up from nodes
  union all
  select p.depth, p.path, n.depth, n.path, n.parent from pairs p join nodes n on p.at > 0 and n.depth = p.at - 1 and n.path = p.up)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, (select count(*) from nodes c where c.depth = n.depth + 1 and c.parent = n.path) as n_children,
  s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n left join nodes u on u.depth = n.depth - 1 and u.path = n.parent
join (select p.at, p.top, count(*) filter (d.deepest = d.depth) as n_leaves, sum(d.weight)::bigint as saved_tokens
  from pairs p join nodes d on d.depth = p.depth and d.path = p.path group by p.at, p.top) s on s.at = n.depth and s.top = n.path
"""
