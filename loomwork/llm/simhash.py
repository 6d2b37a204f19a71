"""SimHash near-dedup by a self-join of binary tries.

Fingerprints. A text's words (A-Z lower-cased) give shingles of three words; a bit of the 64-bit fingerprint is set where
it is set in over half of the shingles' XXH64 values.

Join. Fingerprints that differ in at most BUDGET bits agree on at least one of BUDGET + 1 equal blocks of bits. For each
block a trie is rooted at the block's bits: in it the block has no error left to spend, so only the subtree below one
value of the block is joined with itself. The join walks pairs of nodes together, level by level. A pair of nodes has the
number of bits in which their prefixes differ; its children are the pairs of their children, with one more difference
where they go apart, and a pair is dropped as soon as the differences exceed the budget. A pair is dropped too when all
fingerprints below both nodes are already known to be in one component. What is left at the last level is a link.
A node is a range of a sorted array of fingerprints, so a walk is a few array operations a level.

A subtree with more than NODE_ROWS fingerprints isn't joined in one task: it is cut by its next bits into children, and
each pair of children within the budget is a task of its own.

Components. Every task gives a spanning forest of its links (never all pairs within a group); large-star and small-star
steps over these edges give each fingerprint the least fingerprint that it can reach. Exact copies have met before that,
in the group-by on the fingerprint.

Defined cases: null or empty texts and texts of white space have fingerprint zero, which is linked like any other; fewer
than three words are one shingle; repeated rows and ids stay, each with its component; a null doc_id never names a
component unless all its members have none; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import drop_scratch, fresh, join_counted, only, scratch, slices, unknown

BUDGET = 3
BITS = 64
BLOCK = BITS // (BUDGET + 1)
SEED = 42
SHINGLE = 3
#: Fingerprints of one subtree that a task may hold; larger subtrees are cut.
NODE_ROWS = 500_000
#: Fingerprints, each counted once for each block, behind a task, which holds them in memory (about 100 bytes each).
TASK_ROWS = 1_000_000
#: Edges from which on the joins of a round are salted, and over how many tasks a node's edges then go.
SALT_FROM, SALTS = 2_000_000, 32
#: Node pairs that are walked at once.
FRONT = 400_000
#: A-Z to a-z; no byte of a longer UTF-8 sequence is among them.
LOWER = bytes(range(256)).lower()


# --- fingerprints


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of `shingle` words of a text in UTF-8."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - shingle)].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes; runs begin at starts and none is empty."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    n = np.diff(np.append(starts, len(hashes)))
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").reshape(-1).view("<u8")


def fingerprint_batch(batch: list[bytes], most: int = 300_000) -> np.ndarray:
    """Fingerprints of texts; the bits of at most `most` hashes are spread out at a time, of a longer text too."""
    out = np.zeros(len(batch), np.uint64)
    held: list[np.ndarray] = []
    names: list[int] = []
    n = 0

    def flush() -> None:
        nonlocal n
        if held:
            sizes = np.array([len(x) for x in held])
            out[names] = majority(np.concatenate(held), np.append(0, np.cumsum(sizes)[:-1]))
        held.clear()
        names.clear()
        n = 0

    for i, text in enumerate(batch):
        h = shingle_hashes(text)
        if len(h) > most:
            counts = sum(np.unpackbits(h[a : a + most].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for a in range(0, len(h), most))
            out[i] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
        elif len(h):
            if n + len(h) > most:
                flush()
            held.append(h)
            names.append(i)
            n += len(h)
    flush()
    return out


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """keep columns, fp (or another name): the fingerprint as a signed long."""
    unknown(df, [*keep, "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                raw = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fingerprint_batch(raw).view(np.int64))], [*keep, name])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return only(df, *dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, `{name}` bigint")


# --- the join of tries within a task


class Forest:
    """Components of the places 0..n-1 under links, kept flat: root[i] is the least place of i's component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up

    def changes(self) -> np.ndarray:
        """Running count of places whose component differs from the one before: a range without a change is in one component."""
        return np.cumsum(np.append(False, self.root[1:] != self.root[:-1]))


def walk(keys: np.ndarray, pairs: np.ndarray, depth: int, forest: Forest, budget: int = BUDGET, front: int = FRONT) -> None:
    """Link all leaves that the node pairs lead to.

    keys: distinct within a subtree and sorted, so that a node at some depth is a range. pairs: columns a.start, a.end,
    b.start, b.end, differences so far; both nodes of a pair are at the given depth. Work is taken from a stack in parts
    of at most `front` pairs, which bounds the memory whatever the fan-out.
    """
    ones = {}

    def ones_before(level: int) -> np.ndarray:
        if level not in ones:
            ones[level] = np.append(0, np.cumsum((keys >> np.uint64(BITS - 1 - level)) & np.uint64(1)).astype(np.int64))
        return ones[level]

    stack = [(depth, pairs)]
    while stack:
        depth, p = stack.pop()
        if not len(p):
            continue
        if len(p) > front:
            half = len(p) // 2
            stack += [(depth, p[half:]), (depth, p[:half])]
            continue
        a0, a1, b0, b1, _ = p.T
        ch, root = forest.changes(), forest.root
        known = (ch[a1 - 1] == ch[a0]) & (ch[b1 - 1] == ch[b0]) & (root[a0] == root[b0])
        p = p[~known]
        if not len(p):
            continue
        if depth == BITS:
            forest.link(p[:, 0], p[:, 2])
            continue
        a0, a1, b0, b1, err = p.T
        n = ones_before(depth)
        am, bm = a1 - (n[a1] - n[a0]), b1 - (n[b1] - n[b0])
        same = a0 == b0
        part = lambda *c: np.stack(np.broadcast_arrays(*c), axis=1)
        crossed = part(am, a1, b0, bm, err + 1)[~same]  # of a pair of a node with itself, it mirrors the one before
        new = np.concatenate([part(a0, am, b0, bm, err), part(am, a1, bm, b1, err), part(a0, am, bm, b1, err + 1), crossed])
        new = new[(new[:, 0] < new[:, 1]) & (new[:, 2] < new[:, 3]) & (new[:, 4] <= budget)]
        alone = (new[:, 0] == new[:, 2]) & (new[:, 1] - new[:, 0] == 1)
        stack.append((depth + 1, new[~alone]))


def turn(fp: np.ndarray, block: np.ndarray) -> np.ndarray:
    """fp with the bits of a block first and the rest after them in a circle."""
    by = (block * BLOCK).astype(np.uint64)
    back = (np.uint64(BITS) - by) % np.uint64(BITS)
    return (fp << by) | np.where(back > 0, fp >> back, np.uint64(0))


def forest_of_tasks(block: np.ndarray, value: np.ndarray, depth: np.ndarray, left: np.ndarray, right: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, root) of the spanning forests of the subtree pairs that the rows describe.

    Rows with equal block, value, depth, left and right are one task: the children left and right, at `depth` bits below
    the block's, of the subtree of `value`.
    """
    keys = turn(fp, block)
    order = np.lexsort((keys, right, left, depth, value, block))
    block, value, depth, left, right, fp, keys = (x[order] for x in (block, value, depth, left, right, fp, keys))
    new = np.zeros(len(fp), bool)
    if len(fp):
        new[0] = True
    for x in (block, value, depth, left, right):
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(fp))
    forest = Forest(len(fp))
    at = depth[starts]
    for d in np.unique(at):
        s, e = starts[at == d], ends[at == d]
        twin = left[s] == right[s]
        own = np.stack([s[twin], e[twin], s[twin], e[twin], np.zeros(twin.sum(), np.int64)], axis=1)
        two_s, two_e = s[~twin], e[~twin]
        child = ((keys >> np.uint64(BITS - BLOCK - int(d))) & np.uint64((1 << int(d)) - 1)).astype(np.int64)
        before = np.append(0, np.cumsum(child == left))
        mid = two_s + before[two_e] - before[two_s]
        spent = np.bitwise_count(left[two_s] ^ right[two_s]).astype(np.int64)
        two = np.stack([two_s, mid, mid, two_e, spent], axis=1)
        pairs = np.concatenate([own, two[(two_s < mid) & (mid < two_e)]])
        pairs = pairs[(pairs[:, 0] != pairs[:, 2]) | (pairs[:, 1] - pairs[:, 0] > 1)]
        walk(keys, pairs, BLOCK + int(d), forest)
    # keys of different tasks never link, so a component lies within one task
    linked = forest.root != np.arange(len(fp))
    return fp[linked], fp[forest.root[linked]]


# --- the join over the cluster


def block_value(fp: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.call_function("shiftleft", fp, (block * BLOCK).cast("int")), F.lit(BITS - BLOCK)).cast("long")


def child_value(fp: Column, block: Column, depth: Column) -> Column:
    """The `depth` bits that follow the block's in the turned fingerprint."""
    turned = F.call_function("shiftleft", fp, (block * BLOCK).cast("int")).bitwiseOR(F.when(block > 0, F.call_function("shiftrightunsigned", fp, (F.lit(BITS) - block * BLOCK).cast("int"))).otherwise(F.lit(0)))
    below = F.call_function("shiftleft", turned, F.lit(BLOCK))
    return F.when(depth > 0, F.call_function("shiftrightunsigned", below, (F.lit(BITS) - depth).cast("int"))).otherwise(F.lit(0)).cast("long")


def masks(depth: int, budget: int = BUDGET) -> list[int]:
    """All numbers of `depth` bits with at most `budget` ones."""
    found = {0}
    for _ in range(budget):
        found |= {m | 1 << i for m in found for i in range(depth)}
    return sorted(found)


def link_tasks(fps: DataFrame, node_rows: int = NODE_ROWS) -> tuple[DataFrame, int]:
    """block, value, depth, lo, hi, fp: each distinct fingerprint in every subtree or pair of children it belongs to; and in
    how many that is about, at most (those cut more than once are few)."""
    blocks = F.explode(F.array(*(F.lit(i) for i in range(BUDGET + 1))))
    rows = fps.select("fp", blocks.alias("block")).withColumn("value", block_value(F.col("fp"), F.col("block")))
    sizes = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
    large = scratch(sizes.filter(F.col("n") > node_rows).select("block", "value"), "trie-large")
    flat = lambda df: df.select("block", "value", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "fp")
    if not large.head(1):
        drop_scratch(large)
        return flat(rows), BUDGET + 1
    # At most (BUDGET + 1) * rows / node_rows subtrees are large. They are cut four bits deeper at a time.
    parts = [flat(rows.join(large, ["block", "value"], "left_anti"))]
    rest, depth = scratch(rows.join(large, ["block", "value"], "left_semi"), "trie-rest"), 0
    todo = large
    while todo is not None:
        depth += 4
        child = rest.withColumn("child", child_value(F.col("fp"), F.col("block"), F.lit(depth)))
        most = child.groupBy("block", "value", "child").agg(F.count(F.lit(1)).alias("n")).groupBy("block", "value").agg(F.max("n").alias("n"))
        more = scratch(most.filter(F.col("n") > node_rows).select("block", "value"), "trie-large")
        done = child.join(more, ["block", "value"], "left_anti")
        masked = F.split(F.lit(",".join(map(str, masks(depth)))), ",").cast("array<bigint>")
        pairs = done.withColumn("mask", F.explode(masked)).withColumn("other", F.col("child").bitwiseXOR(F.col("mask")))
        parts.append(pairs.select("block", "value", F.lit(depth).alias("depth"), F.least("child", "other").alias("lo"), F.greatest("child", "other").alias("hi"), "fp"))
        if depth + 4 > BITS - BLOCK or not more.head(1):
            todo = None
        else:
            rest, todo = scratch(rest.join(more, ["block", "value"], "left_semi"), "trie-rest"), more
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, (BUDGET + 1) * len(masks(4))


def links(fps: DataFrame, rows: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """u, v (u > v unsigned-blind, as longs): a spanning forest of the links between distinct fingerprints, at most `rows` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for b in batches:
            for c, x in zip(cols, b.columns, strict=True):
                c.append(x.to_numpy())
        if not cols[0]:
            return
        block, value, depth, lo, hi, fp = (np.concatenate(c) for c in cols)
        u, v = forest_of_tasks(block.astype(np.int64), value, depth.astype(np.int64), lo, hi, fp.view(np.uint64))
        u, v = u.view(np.int64), v.view(np.int64)
        for a in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)[a : a + 100_000]), pa.array(np.minimum(u, v)[a : a + 100_000])], ["u", "v"])

    tasks, times = link_tasks(fps, node_rows)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * times // TASK_ROWS))
    return tasks.repartition(parts, "block", "value", "lo", "hi").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (u > v) but the roots: the least node it can reach.

    A round lets each node tell its larger neighbours, then its smaller ones, of the least node that it knows (large-star
    and small-star). Groups are only reduced by min, before and after the shuffle, and joined to their edges, which Spark
    may split; the edges of a round are a table in the shared folder. Edges that haven't settled in most_rounds rounds
    are an error.
    """
    now = scratch(edges.distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = of_node(both.filter(F.col("v") > F.col("u")), least, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        told = of_node(large, down, state[0]).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch(told.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_scratch(now)
        now = new
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def of_node(edges: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The n edges joined to what is known of their node u. A node may hold a large part of many edges, so these are salted."""
    if n < SALT_FROM:
        return edges.join(known, "u")
    salts = F.explode(F.array(*(F.lit(i) for i in range(SALTS))))
    spread = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return spread.join(known.withColumn("_salt", salts), ["u", "_salt"]).drop("_salt")


def grouped(fps: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """fp, root, component_id, n of each distinct fingerprint of (doc_id, fp); root is the least fingerprint it can reach, n how many
    rows have it."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    labels = components(links(least.select("fp"), fps.count(), node_rows))
    named = scratch(least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "named")
    # a giant component is a hot root
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    return join_counted(named, scratch(of_root, "roots"), "root").select("fp", "root", "component_id", "n")


def near_duplicates(df: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row for each row of df."""
    fps = scratch(fingerprints(df), "fingerprints")
    groups = scratch(grouped(fps, node_rows).select("fp", "component_id", F.col("n").alias("_n")), "components")
    return join_counted(fps, groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """df less near duplicates: of each component the document with the least doc_id stays.

    Rows that share a doc_id are one document and one of them stays. A component whose rows all lack a doc_id keeps one.
    """
    fps = scratch(fingerprints(df), "fingerprints")
    groups = scratch(grouped(fps, node_rows), "components")
    mine, fp, root = fresh(df, "_id", "_fp", "_root")
    ids = groups.filter(F.col("component_id").isNotNull()).select(F.col("component_id").alias(mine))
    named = df.join(ids, F.col("doc_id") == F.col(mine), "left_semi").dropDuplicates(["doc_id"])
    nameless = fingerprints(df.filter(F.col("doc_id").isNull()), tuple(df.columns), fp)
    alone = groups.filter(F.col("component_id").isNull()).select(F.col("fp").alias(fp), F.col("root").alias(root))
    return named.unionByName(nameless.join(alone, fp).dropDuplicates([root]).select(*(F.col(f"`{c}`") for c in df.columns)))
