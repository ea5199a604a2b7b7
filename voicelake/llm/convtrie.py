"""The prefix trie of conversations, its subtree totals by parallel tree contraction.

A conversation's turns are put in order, and its prefixes named, by running
counts and running XORs over ranges of the sorted turns: a range is summed up
once, and the ranges before it add one value. So no task holds a conversation.
The name of a prefix is the XOR of 128-bit hashes of its turns and their
places; that equal names mean equal parents and equal last turns is checked
over all rows, from which it follows that they mean equal prefixes.

Subtree totals come from contraction. Each round rakes the leaves, whose
totals are final and go to their parents, then compresses chains: a node with
one child leaves when its priority of the round is above its parent's and its
child's, so no two neighbours leave together; its child moves up, and its
weight goes to its parent. A node keeps its number of children and the XOR of
their ids, which is the child's id once one is left. The tree shrinks by a part
each round until its root is left. Re-expansion gives a compressed node what it
held and its child's total, by pointer doubling over the removed nodes.

Defined results: rows with a null conversation id belong to no conversation;
null turns come first, equal turns go by role, then by a digest of role and
text, and repeated rows are repeated turns; ``%`` keeps the sign of a negative
id; an empty table has no root and gives no rows; other columns are not read.
The ids that end in one node are hashed as a stream, a chunk of ids a row, in
one task a node, as SHA-256 demands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.llm.scratch import Scratch

#: Conversations take turns from the first of STRIDE, up to SPAN - 1 of them.
STRIDE, SPAN = 5, 9
#: Turns of one conversation that meet in one key of a join.
BLOCK = 100_000
#: Parents of more than this part of all nodes are looked up by broadcast; there are fewer than HOT_PARTS of them.
HOT_PARTS, HOT_LEAST = 100_000, 1000

NAME = ["depth", "k1", "k2"]


def running(rows: DataFrame, key: str, order: list[Column], measures: dict[str, tuple[Callable, Column, Callable]], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with running aggregates (function, value, how two parts join) a key in ``order``, of which 0 is the neutral value.

    Ranges of the sorted rows are summed up on their own, so a key of any size spreads over tasks; a range
    takes what its first key had before it from a table of at most two rows a range.
    """
    ranged = scratch.table(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()), f"{name}-ranged")
    ends = ranged.groupBy("_range").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("k")).select("_range", F.explode("k").alias(key))
    cut = ranged.join(F.broadcast(ends), ["_range", key], "left_semi")
    parts = cut.groupBy("_range", key).agg(*[fn(value).alias(out) for out, (fn, value, _) in measures.items()])
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = scratch.table(parts.select("_range", key, *[fn(out).over(before).alias(f"_{out}") for out, (fn, _, _) in measures.items()]), f"{name}-carried")
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({out: fn(value).over(inside) for out, (fn, value, _) in measures.items()}).join(F.broadcast(carried), ["_range", key], "left")
    joined = {out: how(F.col(out), F.coalesce(f"_{out}", F.lit(0))) for out, (_, _, how) in measures.items()}
    return summed.withColumns(joined).drop("_range", *[f"_{out}" for out in measures])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos from 1, a 120-bit digest of role and text (t1, t2) and the text's bytes."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(whole("role")).cast("string"), F.lit(":"), whole("role"), whole("text")), 256)
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", whole("role").alias("role"), digest.alias("digest"), F.octet_length(whole("text")).cast("long").alias("bytes"))
    turns = turns.select("conv_id", "turn", "role", part(1).alias("t1"), part(16).alias("t2"), "bytes")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")]
    return scratch.table(running(turns, "conv_id", order, {"pos": (F.sum, F.lit(1), lambda a, b: a + b)}, scratch, "turns").select("conv_id", "pos", "t1", "t2", "bytes"), "turns")


def rebuilt_turns(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: (conv_id, depth, t1, t2, bytes, last), and (conv_id, total) of all."""
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SPAN
    convs = scratch.table(turns.groupBy("conv_id").agg(F.max("pos").alias("len")).withColumn("h", borrowed).withColumn("lender", F.col("conv_id") - F.col("conv_id") % STRIDE), "lengths")
    lens = convs.select(F.col("conv_id").alias("lender"), F.col("len").alias("lent"))
    taken = F.least("h", F.coalesce("lent", F.lit(0)))
    plan = convs.join(lens, "lender", "left").select("conv_id", "len", "h", "lender", taken.alias("taken"), (taken + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total"))
    plan = scratch.table(plan, "plan")
    heads = turns.filter((F.col("pos") < SPAN) & (F.col("conv_id") % STRIDE == 0)).withColumnRenamed("conv_id", "lender")
    first = heads.join(plan, "lender").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "bytes", F.expr("pos = taken AND len <= h").alias("last"))
    blocks = plan.filter("len > h").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("len") / BLOCK))))
    own = turns.filter(F.col("pos") > borrowed).withColumn("_block", F.floor(F.col("pos") / BLOCK)).join(blocks, ["conv_id", "_block"])
    return first.unionByName(own.select("conv_id", F.expr("taken + pos - h").alias("depth"), "t1", "t2", "bytes", F.expr("pos = len").alias("last"))), plan.select("conv_id", "total")


def _named(rebuilt: DataFrame, scratch: Scratch) -> DataFrame:
    """Each turn with the names of its prefix (k1, k2) and of the prefix before (p1, p2)."""
    own = [F.xxhash64("depth", "t1", "t2"), F.xxhash64(F.lit(17), "t2", "depth", "t1")]
    rows = running(rebuilt, "conv_id", [F.col("depth")], {"k1": (F.bit_xor, own[0], _xor), "k2": (F.bit_xor, own[1], _xor)}, scratch, "rebuilt")
    return scratch.table(rows.select("*", _xor(F.col("k1"), own[0]).alias("p1"), _xor(F.col("k2"), own[1]).alias("p2")), "members")


def _nodes(members: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, name, parent's name, conv_id, n_convs and bytes of every node."""
    came = F.struct("p1", "p2", "t1", "t2")
    found = members.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.min(came).alias("came"), F.max(came).alias("other"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("bytes"), F.lit(None).cast(found.schema["came"].dataType).alias("came"), F.lit(None).cast(found.schema["came"].dataType).alias("other"))
    nodes = scratch.table(found.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    if not nodes.filter("came <> other").isEmpty():
        raise RuntimeError("two prefixes have one name")
    return nodes.select("id", *NAME, F.col("came.p1").alias("p1"), F.col("came.p2").alias("p2"), (F.col("depth") - 1).alias("above"), "conv_id", "n_convs", "bytes")


def _with_parents(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes with parent, parent_conv_id, n_children and the XOR of their children's ids."""
    key = ["above", "p1", "p2"]
    kids = scratch.table(nodes.filter("depth > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"), F.bit_xor("id").alias("x")), "kids")
    parents = nodes.select(F.col("depth").alias("above"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hot = kids.filter(F.col("n_children") > max(HOT_LEAST, nodes.count() // HOT_PARTS)).select(*key)
    answered = parents.join(F.broadcast(hot), key, "left_semi").withColumnRenamed("parent", "_parent").withColumnRenamed("parent_conv_id", "_parent_conv_id")
    marked = nodes.join(F.broadcast(answered), key, "left")
    columns = ["id", *NAME, "conv_id", "n_convs", "bytes"]
    some = marked.filter("_parent IS NOT NULL").select(*columns, F.col("_parent").alias("parent"), F.col("_parent_conv_id").alias("parent_conv_id"))
    rest = marked.filter("_parent IS NULL").join(parents, key, "left").select(*columns, "parent", "parent_conv_id")
    below = kids.select(F.col("above").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", "x")
    tree = some.unionByName(rest).join(below, NAME, "left").fillna(0, ["n_children", "x"])
    return scratch.table(tree, "tree")


def _leaves(tree: DataFrame) -> DataFrame:
    return tree.filter("n = 0 AND parent IS NOT NULL")


def _leaving(step: int) -> Column:
    """Whether a node leaves its chain in a round."""
    above = lambda c: F.xxhash64("id", F.lit(step)) > F.xxhash64(c, F.lit(step))
    return (F.col("n") == 1) & F.col("parent").isNotNull() & above("parent") & above("x")


def subtree_totals(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, parent, n children, x, w1, w2) -> (id, s1, s2): the sums of both weights over each subtree."""
    done, removed, step = [], [], 0
    while tree.count() > 1:
        step += 1
        done.append(_leaves(tree))
        gained = _leaves(tree).groupBy(F.col("parent").alias("id")).agg(F.sum("w1").alias("g1"), F.sum("w2").alias("g2"), F.count(F.lit(1)).alias("gone"), F.bit_xor("id").alias("gx"))
        kept = tree.filter("n > 0 OR parent IS NULL").join(gained, "id", "left").fillna(0, ["g1", "g2", "gone", "gx"])
        kept = kept.select("id", "parent", (F.col("n") - F.col("gone")).alias("n"), _xor(F.col("x"), F.col("gx")).alias("x"), (F.col("w1") + F.col("g1")).alias("w1"), (F.col("w2") + F.col("g2")).alias("w2"))
        raked = scratch.table(kept, f"raked-{step}")
        leaving = raked.filter(_leaving(step))
        removed.append(leaving.select("id", F.col("x").alias("next"), "w1", "w2"))
        none = F.lit(0).cast("long")
        up = leaving.select(F.col("x").alias("id"), F.col("parent").alias("to"), none.alias("flip"), none.alias("g1"), none.alias("g2"))
        down = leaving.select(F.col("parent").alias("id"), F.lit(None).cast("long").alias("to"), _xor(F.col("id"), F.col("x")).alias("flip"), F.col("w1").alias("g1"), F.col("w2").alias("g2"))
        moved = up.unionByName(down).groupBy("id").agg(F.max("to").alias("to"), F.bit_xor("flip").alias("flip"), F.sum("g1").alias("g1"), F.sum("g2").alias("g2"))
        stays = raked.filter(~F.coalesce(_leaving(step), F.lit(False))).join(moved, "id", "left").fillna(0, ["flip", "g1", "g2"])
        stays = stays.select("id", F.coalesce("to", "parent").alias("parent"), "n", _xor(F.col("x"), F.col("flip")).alias("x"), (F.col("w1") + F.col("g1")).alias("w1"), (F.col("w2") + F.col("g2")).alias("w2"))
        tree = scratch.table(stays, f"compressed-{step}")
    done = [df.select("id", F.col("w1").alias("s1"), F.col("w2").alias("s2")) for df in (*done, tree)]
    known = scratch.table(reduce(DataFrame.unionByName, done), "known-0")
    if not removed:
        return known
    open_, step = scratch.table(reduce(DataFrame.unionByName, removed), "open-0"), 0
    totals = [known]
    while not open_.isEmpty():
        step += 1
        ahead = open_.select(F.col("id").alias("next"), F.col("w1").alias("s1"), F.col("w2").alias("s2"), F.col("next").alias("further"))
        for part in totals:
            ahead = ahead.unionByName(part.select(F.col("id").alias("next"), "s1", "s2", F.lit(None).cast("long").alias("further")))
        looked = open_.join(ahead, "next").select("id", F.col("further").alias("next"), (F.col("w1") + F.col("s1")).alias("w1"), (F.col("w2") + F.col("s2")).alias("w2"))
        looked = scratch.table(looked, f"open-{step}")
        totals.append(looked.filter("next IS NULL").select("id", F.col("w1").alias("s1"), F.col("w2").alias("s2")))
        open_ = looked.filter("next IS NOT NULL")
    return reduce(DataFrame.unionByName, totals)


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) rows as one comma-joined text a name and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in NAME])
        starts = np.concatenate(([0], np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1))
        ids = batch.column("conv_id").to_numpy()
        texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[starts]) for k in keys], pa.array(ids[starts]), pa.array(texts)], names=[*NAME, "first", "ids"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each name's chunks, which come in order."""
    current, digest = None, None
    emit = lambda rows: pa.RecordBatch.from_arrays([*[pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)], pa.array([r[1] for r in rows], pa.string())], names=[*NAME, "ends_sha256"])
    for batch in batches:
        out = []
        for *name, text in zip(*[batch.column(c).to_pylist() for c in (*NAME, "ids")], strict=True):
            if name != current:
                if current:
                    out.append((current, digest.hexdigest()))
                current, digest = name, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if out:
            yield emit(out)
    if current:
        yield emit([(current, digest.hexdigest())])


def _ends(members: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The digest of the conversations that end in each node."""
    zero = F.lit(0).cast("long")
    rows = members.filter("last").select(*NAME, "conv_id").unionByName(convs.filter("total = 0").select(*[zero.alias(c) for c in NAME], "conv_id"))
    laid = rows.repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id")
    kinds = ", ".join(f"{c} long" for c in NAME)
    chunks = scratch.table(laid.mapInArrow(_id_chunks, f"{kinds}, first long, ids string"), "ends")
    return chunks.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(_streamed, f"{kinds}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    scratch = Scratch(conversations.sparkSession, "trie")
    rebuilt, convs = rebuilt_turns(ordered_turns(conversations, scratch), scratch)
    members = _named(rebuilt, scratch)
    tree = _with_parents(_nodes(members, convs, scratch), scratch)
    weights = tree.select("id", "parent", F.col("n_children").alias("n"), "x", (F.col("n_children") == 0).cast("long").alias("w1"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("w2"))
    totals = subtree_totals(weights, scratch)
    full = tree.join(totals, "id").join(_ends(members, convs, scratch), NAME, "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    out = scratch.table(full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("s1").alias("n_leaves"), F.col("s2").alias("saved_tokens"), ends), "trie")
    scratch.drop_all(keep="trie")
    return out


def op12_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 with the reflected polynomial 0xEDB88320, a byte a step, a bit a step inside.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295)"
OP12_SQL = rf"""WITH turns AS (
  SELECT conv_id, strlen(text) AS bytes, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS pos FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, count(*) AS len, {_CRC} % {SPAN} AS h, conv_id - conv_id % {STRIDE} AS lender FROM turns GROUP BY conv_id),
plan AS (SELECT c.*, least(c.h, coalesce(b.len, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.lender),
rebuilt AS (
  SELECT p.conv_id, t.pos AS depth, t.digest, t.bytes FROM plan p JOIN turns t ON t.conv_id = p.lender WHERE t.pos <= p.h
  UNION ALL SELECT p.conv_id, p.taken + t.pos - p.h, t.digest, t.bytes FROM plan p JOIN turns t ON t.conv_id = p.conv_id WHERE t.pos > p.h),
members AS (
  SELECT conv_id, depth, bytes, md5(array_to_string(list(digest) OVER (PARTITION BY conv_id ORDER BY depth), ',')) AS name FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM members GROUP BY depth, name),
tree AS (SELECT n.*, q.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN nodes q ON q.depth = m.depth AND q.name = m.name),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM tree WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT t.*, coalesce(k.n, 0) AS n_children FROM tree t LEFT JOIN kids k USING (conv_id, depth)),
totals AS (
  SELECT a.conv_id, a.depth, count(CASE WHEN d.n_children = 0 THEN 1 END) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved_tokens
  FROM counted d JOIN members m ON m.conv_id = d.conv_id AND m.depth <= d.depth JOIN nodes a ON a.depth = m.depth AND a.name = m.name GROUP BY ALL),
ends AS (
  SELECT n.conv_id, n.depth, sha256(string_agg(l.conv_id::VARCHAR, ',' ORDER BY l.conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id) l JOIN members m USING (conv_id, depth) JOIN nodes n USING (depth, name) GROUP BY ALL)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens,
  coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM counted c JOIN totals t USING (conv_id, depth) LEFT JOIN ends e USING (conv_id, depth)"""
