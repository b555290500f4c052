"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns, named by its depth and four sums of 32 digest bits for each turn and its
place, so that one running window gives all names of a path. A node belongs to its smallest member. As the members of a
child are members of its parent, each conversation owns a suffix of its path, so a node's place in the result is (owner,
depth), and where the suffix starts says all about ownership: one number for each conversation.

Two group-bys by prefix, both summed in each task first, do the rest: one finds the smallest member and whether a path
goes on; the other, after a window over each conversation has marked what it owns, adds up members, the tokens that
occur but are not owned, the children (members that own the next node) and the leaves (members that own a leaf). No group
of members is ever gathered: the root, which all conversations share, is a sum like any other node.

Only digests and lengths move, the texts stay where they were read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import spread_join, stored
from ._crc_sql import crc32_sql

LANES = ("l0", "l1", "l2", "l3")
NODE = ["depth", *LANES]
#: Conversations are rebuilt on the first turns of the one whose id is the next lower multiple of this.
FAMILY = 100
#: At most one turn less than this is shared.
SHARED = 6
#: Ids that lie in one stretch of this length are joined to one string before they meet.
STRETCH = 1 << 13

_ENDS = "depth long, l0 long, l1 long, l2 long, l3 long, ends_sha256 string"


def _lanes(role: Column, text: Column) -> list[Column]:
    """Four numbers of 32 bits from a digest of a turn's role and text."""
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(LANES)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, pos, l0..l3, len): the turns of each conversation in order from 1, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.length(text).cast("long").alias("len"), *_lanes(role, text))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", *LANES)
    return rows.select("conv", F.row_number().over(order).alias("pos"), *LANES, "len")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, part, pos, l0..l3, len) of rebuilt conversations: the root (part -1), turns of the base (0), own ones (1)."""
    shared = F.crc32(F.coalesce(F.col("conv").cast("string"), F.lit("")).cast("binary")) % SHARED
    turn = F.struct("pos", *LANES, "len")
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < SHARED)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    convs = turns.select("conv").where("pos = 1").withColumn("h", shared.cast("int")).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    given = convs.join(heads, "base").where("h > 0").select("conv", F.lit(0).alias("part"), F.explode(F.slice("head", F.lit(1), F.col("h"))).alias("t")).select("conv", "part", "t.*")
    own = turns.where(F.col("pos") > shared).select("conv", F.lit(1).alias("part"), "pos", *LANES, "len")
    zero = F.lit(0).cast("long")
    return convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("pos"), *[zero.alias(x) for x in LANES], zero.alias("len")).unionByName(given).unionByName(own)


def paths_of(rows: DataFrame) -> DataFrame:
    """(conv, depth, l0..l3, len, upto, more) of rows of rebuilt(): each conversation's nodes from the root on, the tokens
    up to each, and whether it goes on. A turn's numbers are mixed with its depth before they are summed, so the same
    turns in another order give another name."""
    way = Window.partitionBy("conv").orderBy("part", "pos")
    placed = rows.withColumn("depth", F.row_number().over(way).cast("long") - 1)
    mixed = [F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64("depth", F.lit(i), *LANES), 32)).alias(x) for i, x in enumerate(LANES)]
    along = Window.partitionBy("conv").orderBy("depth")
    sums = [F.sum(x).over(along).alias(x) for x in LANES]
    return placed.select("conv", "depth", *mixed, "len").select("conv", "depth", *sums, "len", F.sum("len").over(along).alias("upto"), (F.lead("depth").over(along).isNotNull()).alias("more"))


def endings(paths: DataFrame) -> DataFrame:
    """(depth, l0..l3, conv): the node in which each conversation with an id ends."""
    return paths.where(~F.col("more") & F.col("conv").isNotNull()).select(*NODE, "conv")


def end_digests(ends: DataFrame) -> DataFrame:
    """The digest of the ids that end in each node, of rows of endings(). A stretch of the id range holds STRETCH ids at most and becomes one
    string; the strings of a node then stream through a task in order, and only the digest's state is held."""
    stretch = F.floor(F.col("conv") / STRETCH)
    strings = ends.groupBy(*NODE, stretch.alias("stretch")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches):
        at, state = None, None
        for rb in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in rb.columns[:5]), rb.column(5).to_pylist(), strict=True):
                if row[:5] != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = row[:5], hashlib.sha256(row[5].encode())
                else:
                    state.update(b"," + row[5].encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*NODE, "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, state.hexdigest())], names=[*NODE, "ends_sha256"])

    return strings.repartition(*NODE).sortWithinPartitions(*NODE, "stretch").select(*NODE, "ids").mapInArrow(digest, _ENDS)


def trie(paths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of each node, and its name l0..l3;
    paths are written rows of paths_of()."""
    nodes = stored(paths.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.max("more").alias("inner")), "trie-nodes")
    starts = nodes.groupBy("owner").agg(F.min("depth").alias("start"), F.max((~F.col("inner")).cast("long")).alias("leaf"))
    marked = paths.join(starts, F.col("conv").eqNullSafe(F.col("owner")), "left").select("conv", *NODE, "len", "upto", "more", F.coalesce("start", F.lit(2**62)).alias("start"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    edge = F.max(F.when(F.col("depth") < F.col("start"), F.col("upto"))).over(Window.partitionBy("conv"))
    shared = F.when(F.col("depth") < F.col("start"), edge - F.col("upto") + F.col("len")).otherwise(0)
    sums = marked.select("conv", *NODE, "leaf", shared.alias("shared"), (F.col("more") & (F.col("depth") + 1 >= F.col("start"))).cast("long").alias("child")).groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens")
    )
    # Where an owned suffix starts, the parent belongs to another conversation: the owner of the node before.
    before = paths.join(starts.where("start > 0"), F.col("conv").eqNullSafe(F.col("owner")) & (F.col("depth") == F.col("start") - 1)).select("conv", *NODE)
    parents = spread_join(before, nodes.select(*NODE, F.col("owner").alias("parent")), NODE).select(F.col("conv").alias("_conv"), (F.col("depth") + 1).alias("_depth"), "parent", F.lit(True).alias("_other"))
    found = sums.join(parents, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("depth") == F.col("_depth")), "left")
    parent = F.when(F.col("_other"), F.col("parent")).when(F.col("depth") > 0, F.col("conv_id"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", *LANES)


def conversation_trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of the rebuilt conversations (columns conv_id, turn, role, text): a row for each node, as trie() gives it,
    and the written paths of all conversations, from which endings() tells who ends where.

    Turns are ordered by turn, null first; turns of one number by role and then by a digest of role and text. A null role
    or text counts as empty, an empty turn is a turn. Repeated rows are turns of their own. Rows with a null conv_id form
    one conversation without a base: it counts as a member, but endings() leaves it out, and conv_id is null only where it is
    the sole member. A conversation that keeps no turn is a member of the root. An empty table has no
    nodes. Other columns are ignored. Conversations may have up to 2**31 turns.
    """
    turns = stored(turns_of(conversations), "trie-turns")
    paths = stored(paths_of(rebuilt(turns)), "trie-paths")
    return trie(paths), paths


def trie_report(conversations: DataFrame) -> DataFrame:
    """The nodes with the digest of the ids that end in each, decimal, ascending and joined by commas."""
    nodes, paths = conversation_trie(conversations)
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return nodes.join(end_digests(endings(paths)), NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Whole prefixes as strings of digests; subtrees by walking each node's smallest member back to the root.
SQL = f"""
WITH turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
convs AS (SELECT conv, {crc32_sql("CAST(conv AS VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT conv FROM turns)),
parts AS (
  SELECT c.conv, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.conv - c.conv % {FAMILY} AND t.pos <= c.h
  UNION ALL SELECT c.conv, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.conv AND t.pos > c.h),
paths AS (
  SELECT conv, row_number() OVER w AS depth, length(text) AS len, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS prefix
  FROM parts WINDOW w AS (PARTITION BY conv ORDER BY part, pos)
  UNION ALL SELECT conv, 0, 0, '' FROM convs),
members AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv) AS ends, lag(prefix) OVER (PARTITION BY conv ORDER BY depth) AS parent FROM paths),
nodes AS (SELECT prefix, depth, min(conv) AS conv_id, count(*) AS n_convs, min(len) AS len, min(parent) AS parent, bool_and(ends) AS leaf,
    sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY prefix, depth),
children AS (SELECT parent AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
below AS (SELECT p.prefix, sum((u.n_convs - 1) * u.len) AS saved, count(*) FILTER (u.leaf) AS leaves
  FROM nodes u JOIN paths p ON p.conv = u.conv_id AND p.depth <= u.depth GROUP BY p.prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (prefix) LEFT JOIN nodes p ON p.prefix = n.parent LEFT JOIN children c ON c.prefix = n.prefix
"""
