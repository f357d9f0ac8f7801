"""The prefix trie of conversations, found by fingerprints and verified turn by turn.

A turn's place in its conversation and the polynomial fingerprint of the turns up to it are running sums, scanned with
numpy by ranges (see ``running_sums``), so a conversation may be of any length. The fingerprint is the sum of
``hash * base**depth`` modulo 2**31 - 1, twice with different hashes and bases. Conversations with one fingerprint at one
depth are a candidate group; its least conversation is the representative. Every other member's turn is compared with
the representative's, role and text, and so is the group that the turn before it belongs to. Members that differ get another
key and are grouped again, until none differs: then by induction over the depth each group is one prefix, and one prefix
is one group, whatever the hashes did.

Parent rollup: the least member of a node is the least of the nodes below it on its way, so each conversation owns one
chain of nodes that ends in its last turn. A chain's total goes to each stretch of its path that another conversation
owns, as one row; there the totals and the chain's own nodes are summed from the end. That is at most one row a turn and
no rounds, however deep the trie is.

Groups of more than ``n / HOT_GROUPS`` rows are fewer than ``HOT_GROUPS`` and are sent to the workers; the members of one group
are dealt over as many salts as they need, with a copy of the representative for each.

Defined cases: a null role or text is empty; rows with a null conv_id belong to no conversation and are left out; null
turns come first; equal turns go by role, then by text, and rows that repeat are turns of their own; an empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import read_table, stored
from redactory.llm.running_sums import running_sums

#: Moduli and bases of the two fingerprints.
PRIME, BASES = (1 << 31) - 1, (1_103_515_249, 741_103_597)
HOT_GROUPS, SALT_ROWS = 100_000, 1000
WORDS = r"[^\x20\x09-\x0D]+"


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, n_words): turns numbered from 1 in each conversation."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("conv_id IS NOT NULL").withColumn("one", F.lit(1).cast("long"))
    turn = F.asc_nulls_first("turn")
    numbered = running_sums(rows, "conv_id", [turn, F.asc("role"), F.asc("text")], ["one"], ranged=[turn])
    return numbered.select("conv_id", F.col("one_sum").alias("pos"), "role", "text", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("n_words"))


def _powers(depth: np.ndarray, base: int) -> np.ndarray:
    """base**depth modulo PRIME, by squaring."""
    out, square, left = np.ones(len(depth), np.int64), base % PRIME, depth.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def fingerprinted(rebuilt: DataFrame) -> DataFrame:
    """rebuilt (c, depth, h1, h2, ...) with ``key``, the fingerprint up to the turn, and ``before``, that up to the one before it."""

    def terms(batches):
        for b in batches:
            depth = b.column("depth").to_numpy()
            made = [np.mod(b.column(h).to_numpy(), PRIME) * _powers(depth, base) % PRIME for h, base in zip(("h1", "h2"), BASES)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in made)], names=[*b.schema.names, "f1", "f2"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rebuilt.schema.fields)
    summed = running_sums(rebuilt.mapInArrow(terms, f"{kinds}, f1 long, f2 long"), "c", [F.asc("depth")], ["f1", "f2"])

    def key(a: Column, b: Column) -> Column:
        return F.shiftleft(F.pmod(a, F.lit(PRIME)), 31).bitwiseOR(F.pmod(b, F.lit(PRIME)))

    f1, f2 = F.col("f1_sum"), F.col("f2_sum")
    return summed.select(*rebuilt.columns, key(f1, f2).alias("key"), key(f1 - F.col("f1"), f2 - F.col("f2")).alias("before"))


def _grouped(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows (c, depth, key, before, conv, pos) with their group's size n and representative rep (c, conv, pos, before)."""
    least = max(64, n_rows // HOT_GROUPS)
    groups = rows.groupBy("depth", "key").agg(F.count("*").alias("n"), F.min(F.struct("c", "conv", "pos", "before")).alias("rep"))
    hot = F.broadcast(groups.where(F.col("n") > least))  # fewer than HOT_GROUPS, or n_rows / 64 if that is less
    in_hot = rows.join(hot, ["depth", "key"])
    alone = rows.join(hot.select("depth", "key"), ["depth", "key"], "left_anti").join(groups, ["depth", "key"])
    return in_hot.unionByName(alone)


def _unlike(grouped: DataFrame, texts: DataFrame) -> DataFrame:
    """(c, depth) of the members whose turn, or whose group a turn before, is not the representative's."""
    pairs = grouped.where("n > 1 AND c <> rep.c").select("c", "depth", "conv", "pos", "n", (F.col("before") != F.col("rep.before")).alias("strays"), F.col("rep.conv").alias("rep_conv"), F.col("rep.pos").alias("rep_pos"))
    strays = pairs.where("strays").select("c", "depth")
    # one physical turn that stands in several conversations needs no comparison with itself
    other = pairs.where("NOT strays AND (conv <> rep_conv OR pos <> rep_pos)")
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    said = texts.select("conv_id", "pos", "role", "text")
    wanted = other.groupBy("rep_conv", "rep_pos").agg(F.max(salts).alias("salts"))
    rep = wanted.join(said.select(F.col("conv_id").alias("rep_conv"), F.col("pos").alias("rep_pos"), F.col("role").alias("rep_role"), F.col("text").alias("rep_text")), ["rep_conv", "rep_pos"])
    rep = rep.select("rep_conv", "rep_pos", "rep_role", "rep_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    mine = other.join(said.withColumnRenamed("conv_id", "conv"), ["conv", "pos"]).withColumn("salt", F.pmod(F.xxhash64("c"), salts).cast("int"))
    differs = mine.join(rep, ["rep_conv", "rep_pos", "salt"]).where("role <> rep_role OR text <> rep_text").select("c", "depth")
    return strays.unionByName(differs)


def grouped_prefixes(rows: DataFrame, texts: DataFrame, most_rounds: int = 40) -> DataFrame:
    """fingerprinted rows with n and rep, where groups are equal prefixes and nothing else."""
    n_rows = rows.count()
    for number in range(most_rounds):
        grouped = stored(_grouped(rows, n_rows))
        unlike = stored(_unlike(grouped, texts))
        if unlike.isEmpty():
            return grouped
        other_key = F.xxhash64("key", "h1", "h2", "before", F.lit(number))
        new = rows.join(unlike.withColumn("is_unlike", F.lit(True)), ["c", "depth"], "left").withColumn("key", F.when(F.col("is_unlike"), other_key).otherwise(F.col("key"))).drop("is_unlike")
        above = new.select("c", (F.col("depth") + 1).alias("depth"), F.col("key").alias("above"))
        rows = stored(new.join(above, ["c", "depth"], "left").withColumn("before", F.coalesce("above", F.lit(0))).select(*rows.columns))
    raise RuntimeError(f"prefixes did not settle in {most_rounds} rounds")


def digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of members (owner, depth, c): the digest of the ids in order, joined by commas.

    Ranges of the members become pieces of text first; the digest of a node then streams over its pieces, as a digest can
    only be taken in order.
    """

    def pieces(batches):
        for b in batches:
            owner, depth, c = (b.column(i).to_numpy() for i in range(3))
            at = np.concatenate([[0], np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1, [len(c)]]) if len(c) else [0]
            for i, j in zip(at, at[1:]):
                yield pa.RecordBatch.from_pydict({"owner": owner[i : i + 1], "depth": depth[i : i + 1], "c": c[i : i + 1], "ids": [",".join(map(str, c[i:j].tolist()))]})

    def joined(batches):
        node, digest = None, None
        for b in batches:
            out = []
            for owner, depth, ids in zip(b.column("owner").to_pylist(), b.column("depth").to_pylist(), b.column("ids").to_pylist()):
                if (owner, depth) == node:
                    digest.update(b",")
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (owner, depth), hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["owner", "depth", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=["owner", "depth", "ends_sha256"])

    cut = ends.select("owner", "depth", "c").repartitionByRange("owner", "depth", "c").sortWithinPartitions("owner", "depth", "c").mapInArrow(pieces, "owner long, depth long, c long, ids string")
    return cut.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "c").mapInArrow(joined, "owner long, depth long, ends_sha256 string")


def rolled_up(grouped: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) over each node's subtree.

    grouped: (c, depth, owner, above), above the owner a turn before, null at depth 1; nodes: (conv_id, depth, leaf, saved).
    """
    chains = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    # the owner changes between depth - 1 and depth: the stretch of the one before ends there
    stretches = grouped.where("above <> owner").select("c", F.col("above").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    given = stretches.join(chains, "c").groupBy("conv_id", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    both = nodes.select("conv_id", "depth", "leaf", "saved").unionByName(given).groupBy("conv_id", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    summed = running_sums(both, "conv_id", [F.desc("depth")], ["leaf", "saved"])
    return summed.select("conv_id", "depth", F.col("leaf_sum").alias("n_leaves"), F.col("saved_sum").alias("saved_tokens"))


def trie(convs: DataFrame, rebuilt: DataFrame, texts: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations.

    convs: (c, length), each conversation once; rebuilt: (c, depth from 1, conv, pos, n_words, h1, h2), their turns, told by
    where each stands in texts (conv_id, pos, role, text). Columns of the result: see ``op12_prefix_trie``.
    """
    grouped = grouped_prefixes(fingerprinted(rebuilt), texts)
    member = grouped.select("c", "depth", F.col("rep.c").alias("owner"), "n", "n_words")
    above = member.select("c", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("above"))
    member = stored(member.join(above, ["c", "depth"], "left"))
    own = member.where("c = owner")
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    first = root.first()
    if not first:
        return convs.sparkSession.createDataFrame([], TRIE)
    children = own.select(F.coalesce("above", F.lit(first["conv_id"])).alias("conv_id"), (F.col("depth") - 1).alias("depth")).groupBy("conv_id", "depth").agg(F.count("*").alias("n_children"))
    nodes = own.select(
        F.col("c").alias("conv_id"), "depth", F.coalesce("above", F.lit(first["conv_id"])).alias("parent_conv_id"), F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("n_words")).alias("saved")
    ).unionByName(root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("saved")))
    nodes = stored(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")))
    below = rolled_up(member, nodes.where("depth > 0"))
    total = nodes.agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).select(F.lit(first["conv_id"]).alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_leaves", "saved_tokens")
    last = member.join(convs.select("c", F.col("length").alias("depth")), ["c", "depth"]).select("owner", "depth", "c")
    turnless = convs.where("length = 0").select(F.lit(first["conv_id"]).alias("owner"), F.lit(0).cast("long").alias("depth"), "c")
    ended = digests(last.unionByName(turnless)).withColumnRenamed("owner", "conv_id")
    out = nodes.join(below.unionByName(total), ["conv_id", "depth"]).join(ended, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt first: the first h turns are those of the conversation at the next lower multiple of 20."""
    texts = stored(placed(read_table(spark, sf_dir, "conversations")))
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(4))
    turns = texts.select("conv_id", "pos", "n_words", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    convs = texts.where("pos = 1").select(F.col("conv_id").alias("c")).withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % 20)
    heads = turns.where("pos <= 3 AND conv_id % 20 = 0").withColumnRenamed("conv_id", "base")
    borrowed = stored(convs.join(heads, "base").where("pos <= h").select("c", F.col("pos").alias("depth"), F.col("base").alias("conv"), "pos", "n_words", "h1", "h2"))
    lent = borrowed.groupBy("c").agg(F.count("*").alias("n_lent"))
    known = convs.join(lent, "c", "left").select("c", "h", F.coalesce("n_lent", F.lit(0)).alias("n_lent"))
    # own turns move up where the conversation lent from has fewer than h
    short = known.where("n_lent < h").select("c", (F.col("n_lent") - F.col("h")).alias("shift"))
    own = turns.withColumnRenamed("conv_id", "c").withColumn("h", h).where("pos > h").join(short, "c", "left")
    own = own.select("c", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("depth"), F.col("c").alias("conv"), "pos", "n_words", "h1", "h2")
    rebuilt = borrowed.unionByName(own)
    lengths = known.join(turns.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n_own")), "c")
    return trie(lengths.select("c", (F.col("n_lent") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("length")), rebuilt, texts)


_SQL_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""
OP12_SQL = f"""
WITH turns AS MATERIALIZED (SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS pos,
    {{'role': coalesce(role, ''), 'text': coalesce("text", '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
listed AS MATERIALIZED (SELECT c, list(said ORDER BY pos) AS own FROM turns GROUP BY c),
rebuilt AS MATERIALIZED (
  SELECT a.c, list_concat(CASE WHEN b.own IS NULL OR a.h = 0 THEN [] ELSE b.own[1:a.h] END, a.own[a.h + 1:]) AS path
  FROM (SELECT *, {_SQL_CRC32} % 4 AS h FROM listed) a LEFT JOIN listed b ON b.c = a.c - a.c % 20),
steps AS MATERIALIZED (SELECT c, path, d FROM rebuilt, unnest(range(0, len(path) + 1)) AS u(d)),
groups AS MATERIALIZED (SELECT CAST(d AS BIGINT) AS depth, CASE WHEN d = 0 THEN [] ELSE path[1:d] END AS prefix, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(path) = d), '') AS ends FROM steps GROUP BY 1, 2),
nodes AS MATERIALIZED (SELECT g.*, p.conv_id AS parent_conv_id, CASE WHEN g.depth = 0 THEN 0 ELSE (g.n_convs - 1) * len(regexp_extract_all(g.prefix[-1].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM groups g LEFT JOIN groups p ON p.depth = g.depth - 1 AND p.prefix = CASE WHEN g.depth <= 1 THEN [] ELSE g.prefix[1:g.depth - 1] END),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS MATERIALIZED (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (conv_id, depth)),
below AS (SELECT a.prefix, a.depth, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM counted a JOIN counted b ON b.depth >= a.depth AND CASE WHEN a.depth = 0 THEN [] ELSE b.prefix[1:a.depth] END = a.prefix GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM counted JOIN below USING (prefix, depth)
"""
