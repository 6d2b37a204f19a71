"""The prefix trie of conversations, by prefix-doubling naming.

1. Turns are numbered within their conversation. A turn is known by a digest of role and text from then on.
2. Blocks. Distinct turns get dense numbers as names. A block of 2^(k+1) turns that begins at a multiple of its length is the pair
   of two blocks of 2^k; distinct pairs get dense names in turn. Equal names mean equal turns. There are as many rounds as
   the longest conversation's length has bits.
3. Prefixes. A prefix of d turns is the prefix without d's lowest set bit, 2^k, and the block of 2^k turns behind it. From the highest k
   to 0 all prefixes of one lowest bit are named, distinct pairs getting the next dense numbers: these are the nodes.
4. Nodes. A group-by gives each node's members: their number and the smallest. Along a conversation the smallest member, once it is
   the conversation itself, stays that, so every node belongs to one conversation, and a conversation owns a chain of nodes. What a
   subtree adds up is then the sum, over the node's members, of what their chains add up, less what the node's own chain has above
   it: one more group-by, not a walk over levels.

Names are joined to their rows by counted keys (join_counted): frequent ones go to every task, so a turn, block or conversation that
many rows share is no hot key. Numbers and sums along a conversation are worked out over ranges of (conversation, place), with the
sums of whole ranges added afterwards, so neither a long conversation nor a node with many members is held by one task. Digests of
a node's ending members are made from pieces of sorted ids, packed range by range.

Defined cases: rows without conv_id belong to no conversation and are left out; null turns come first, null role and text are
empty; rows of one turn number follow the digests of their content; a repeated row is a turn of its own; a table without
rows has no node, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import join_counted, only, scratch, unknown

#: Conversations c to c + GROUP - 1 begin with turns of c, a multiple of GROUP; with how many, below SHARED, says a hash.
GROUP = 100
SHARED = 6
#: Bytes of ids that are packed into one row.
PIECE = 1_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- sums along a group


def running(df: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """df (a table) with the sum of value over the rows before it in its group, in order; no task needs a whole group."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns)
    fields = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, part = None, 0, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column(by).to_numpy(zero_copy_only=False), b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            new = np.append(True, ids[1:] != ids[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
            local = before - before[start]
            if ids[0] == last:
                local[start == 0] += held
            last, held = ids[-1], int(local[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64()), pa.array(np.full(len(v), part), pa.int32())], [*fields, "_local", "_part"])

    local = scratch(df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).mapInArrow(run, f"{kinds}, _local bigint, _part int"), "trie-running")
    # only groups that reach over several ranges need the sums of earlier ranges: two a range at most
    sums = local.groupBy(by, "_part").agg(F.sum(value).alias("_sum")).withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(by))).filter("_parts > 1")
    above = F.sum("_sum").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(by, "_part", F.coalesce(above, F.lit(0)).alias("_above"))
    return local.join(F.broadcast(offsets), [by, "_part"], "left").withColumn(name, F.col("_local") + F.coalesce("_above", F.lit(0))).drop("_local", "_part", "_above")


# --- turns


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, i, digest, chars: turn i (from 0 on) of each conversation, and the code points of its text."""
    unknown(df, [conv, turn, role, text])
    own = only(df, conv, turn, role, text).toDF("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    role_, text_ = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"), 256))
    slim = own.select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.length(text_).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    return scratch(running(scratch(slim, "trie-slim"), "conv_id", ["turn", "digest"], "one", "i").select("conv_id", "i", "digest", "chars"), "trie-turns")


def shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("long")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each begins with the first turns of its group's: conv_id, i, digest, chars and conv_id, n_turns.

    Conversation c takes the first shared_turns(c) of conversation c - c % GROUP, as many as there are, before its own ones
    after its first shared_turns(c).
    """
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = scratch(own.filter((F.col("conv_id") % GROUP == 0) & (F.col("i") < SHARED - 1)).select(F.col("conv_id").alias("base"), "i", "digest", "chars"), "trie-heads")
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).withColumns({"h": shared_turns(F.col("conv_id")), "base": first})
    there = heads.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    taken = F.least(F.col("h"), F.coalesce("there", F.lit(0)))
    convs = scratch(convs.join(there, "base", "left").withColumn("taken", taken).select("conv_id", "_n", "h", "base", "taken", (F.col("taken") + F.greatest(F.col("_n") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-conversations")
    begun = convs.filter("taken > 0").join(heads, "base").filter("i < h").select("conv_id", "i", "digest", "chars")
    rest = join_counted(own, convs.select("conv_id", "_n", "h", "taken"), "conv_id").filter("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "digest", "chars")
    return scratch(begun.unionByName(rest), "trie-rebuilt"), convs.select("conv_id", "n_turns")


def as_they_are(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of the turns alone."""
    return own, own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


# --- names


def dense(keys: DataFrame, start: int) -> DataFrame:
    """keys (distinct rows) with name: start, start + 1, ... Only the numbers of rows of the partitions are summed up."""
    fields = keys.columns
    kinds = ", ".join(f"`{c}` {keys.schema[c].dataType.simpleString()}" for c in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows), pa.int64()), pa.array(np.full(b.num_rows, part), pa.int32())], [*fields, "_place", "_part"])
            n += b.num_rows

    placed = scratch(keys.mapInArrow(run, f"{kinds}, _place bigint, _part int"), "trie-names")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", (before + F.lit(start)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(*fields, (F.col("_place") + F.col("_before")).alias("name"))


def named(rows: DataFrame, keys: list[str], start: int = 1) -> tuple[DataFrame, int]:
    """rows (a table) with the name of their keys in place of these, and the next number that is free."""
    names = scratch(dense(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), start), "trie-dense")
    return join_counted(rows, names, keys).drop(*keys), start + names.count()


def blocks(turns_: DataFrame, longest: int) -> list[DataFrame]:
    """For k = 0, 1, ...: conv_id, j, name of the blocks of 2^k turns from turn j * 2^k on."""
    out = [scratch(named(turns_.select("conv_id", F.col("i").alias("j"), "digest"), ["digest"])[0], "trie-blocks")]
    while 2 ** len(out) <= longest:
        side = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name")))
        pairs = out[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(side(0).alias("l"), side(1).alias("r")).filter("r IS NOT NULL")
        out.append(scratch(named(scratch(pairs, "trie-pairs"), ["l", "r"])[0], "trie-blocks"))
    return out


def prefixes(turns_: DataFrame, longest: int) -> DataFrame:
    """conv_id, depth, node for every prefix of at least one turn; equal prefixes are one node, and nodes are numbered from 1 on."""
    of = blocks(turns_, longest)
    done, free = None, 1
    for k in reversed(range(len(of))):
        ends = of[k].filter("j % 2 = 0").select("conv_id", (F.col("j") * 2**k).alias("m"), F.col("name").alias("r"))
        if done is None:
            rows = ends.withColumn("l", F.lit(0).cast("long"))
        else:
            rows = ends.join(done.select("conv_id", F.col("depth").alias("m"), F.col("node").alias("l")), ["conv_id", "m"], "left").withColumn("l", F.coalesce("l", F.lit(0).cast("long")))
        found, free = named(scratch(rows, "trie-prefixes"), ["l", "r"], free)
        new = scratch(found.select("conv_id", (F.col("m") + 2**k).alias("depth"), F.col("name").alias("node")), "trie-named")
        done = new if done is None else done.unionByName(new)
    return done


# --- nodes


def sha_of_ids(ends: DataFrame) -> DataFrame:
    """node, sha: SHA-256 of the ids of each node of ends (node, conv_id; a table), ascending, joined by commas.

    Ranges of (node, conv_id) make the digests of the nodes that they hold whole, and pieces of text of those at their ends; a
    node's pieces then go through one digest as a stream.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, ids, size, whole, first = None, [], 0, False, None

        def close(end: bool) -> None:
            if ids:
                text = ",".join(ids)
                whole_here = whole and not end
                rows.append((now, first, None if whole_here else text, hashlib.sha256(text.encode()).hexdigest() if whole_here else None))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["node", "first", "piece", "sha"])

        for b in batches:
            rows = []
            for node, c in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if node != now:
                    close(False)
                    # the first node of a range may have begun in the one before it
                    whole, now, ids, size, first = now is not None, node, [], 0, c
                elif size > PIECE:
                    whole = False
                    close(False)
                    ids, size, first = [], 0, c
                text = str(c)
                ids.append(text)
                size += len(text) + 1
            yield batch()
        rows = []
        close(True)
        yield batch()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["node", "sha"])
        for b in batches:
            for node, piece in zip(b.column("node").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if node != now:
                    if digest:
                        yield one()
                    now, digest = node, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
        if digest:
            yield one()

    packed = scratch(ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pack, "node bigint, first bigint, piece string, sha string"), "trie-ends")
    open_ = packed.filter("sha IS NULL").select("node", "first", "piece").repartition("node").sortWithinPartitions("node", "first")
    return packed.filter("sha IS NOT NULL").select("node", "sha").unionByName(open_.mapInArrow(stream, "node bigint, sha string"))


def trie(turns_: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the conversations.

    turns_ (conv_id, i, digest, chars) is a table, convs (conv_id, n_turns) has those without turns too.
    """
    convs = scratch(convs.select("conv_id", "n_turns"), "trie-convs")
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    if longest:
        chars = turns_.select("conv_id", (F.col("i") + 1).alias("depth"), "chars")
        member = scratch(prefixes(turns_, longest).join(chars, ["conv_id", "depth"]), "trie-members")
    else:
        member = convs.limit(0).select("conv_id", F.col("n_turns").alias("depth"), F.col("n_turns").alias("node"), F.col("n_turns").alias("chars"))
    # members of a node have one depth and one last text
    grouped = member.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("depth").alias("depth"), F.max("chars").alias("chars"))
    above = member.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    # a node's parent is found along its smallest member; the root is 0
    placed = scratch(grouped.join(above, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(0).cast("long"))), "trie-placed")
    kids = placed.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own_saved = (F.col("n_convs") - 1) * F.col("chars")
    nodes = scratch(placed.join(kids, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "own": own_saved}), "trie-nodes")
    chain = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    chain = scratch(chain.join(convs.withColumnRenamed("n_turns", "_n"), "conv_id"), "trie-chains")
    sums = join_counted(member.select("conv_id", "node"), chain, "conv_id").groupBy("node").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
    # a node of one member saves nothing, nor does what is below it
    shared = scratch(nodes.filter("n_convs > 1").select("node", "conv_id", "depth", "own"), "trie-shared")
    over = running(shared, "conv_id", ["depth"], "own", "over").select("node", "over")
    last = member.select("conv_id", F.col("depth").alias("n_turns"), "node")
    ends = scratch(convs.join(last, ["conv_id", "n_turns"], "left").select(F.coalesce("node", F.lit(0).cast("long")).alias("node"), "conv_id"), "trie-ending")
    sha = scratch(sha_of_ids(ends), "trie-sha")

    total = chain.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"))
    first = kids.filter("node = 0").agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").crossJoin(total).crossJoin(first)
    null = F.lit(None).cast("long")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves"))
    root = scratch(root.select(F.lit(0).cast("long").alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), null.alias("parent_conv_id"), "n_convs", "n_children", leaves.cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "trie-root")

    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    parents = parents.unionByName(root.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n")))
    below = join_counted(nodes, scratch(parents, "trie-parents"), "parent").join(sums, "node").join(over, "node", "left")
    saved = F.when(F.col("n_convs") > 1, F.col("saved") - F.col("over")).otherwise(F.lit(0))
    below = below.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.cast("long").alias("saved_tokens"))
    every = below.unionByName(root).join(sha, "node", "left").drop("node")
    return every.withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA))).drop("sha")


def report(df: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations."""
    return trie(*rebuilt(turns(df)))
