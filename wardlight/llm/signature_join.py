"""Exact self-join of documents on the Jaccard similarity of their word shingles, with signature trees.

1. Every text becomes the set of hashes of its shingles.  Texts with the same words are one class.
2. Hashes are in ascending order.  Of two linked sets each has several common shingles early in this order (see
   ``operators.shingle_sets``), so a class is dropped unless so many of its early shingles occur early in other classes.  Only the early
   ones are moved, as 32-bit remainders within buckets; classes that stay are read again in full.
3. Shingles are ordered by the number of classes that hold them.  A class with fewer shared ones than a link needs
   is dropped; the rest (``shared_prefixes``) enter a bucket for each shared shingle in their prefix of this order.  Buckets with the same
   members are one bucket.
4. Every member of a bucket is held against the bucket's least member, which joins large groups of near copies in time
   linear in their size.  Buckets within one component need no more.
5. In the others, blocks of members form signature trees: a node holds the OR of its members' shingle bitmaps and their
   size range.  A dual traversal of two trees drops pairs of nodes whose largest possible overlap is too small, or that
   are connected already, and verifies the pairs of leaves that are left on their whole sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import written
from wardlight.llm.components import components
from wardlight.operators.shingle_sets import (
    CREDITS_A_PART, PERCENT, credits, least_common, read_documents, shared_prefixes, whole_sets,
)
from wardlight.session import small_side

BLOCK = 256  # members of one tree
TASK_ROWS = 2_000  # members that one task holds at a time, on average
FAN_OUT = 4


def buckets(prefixed: DataFrame) -> DataFrame:
    """h, leader, v, n: members of every bucket, each set of members once."""
    rows = prefixed.select("v", "n", F.explode("prefix").alias("h"))
    sums = rows.groupBy("h").agg(
        F.count(F.lit(1)).alias("size"), F.min("v").alias("leader"), F.max("v").alias("last"),
        F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y"),
    ).where("size > 1")
    first = sums.groupBy("size", "leader", "last", "x", "y").agg(F.min("h").alias("h")).select("h", "leader")
    return rows.join(written(first, "buckets"), "h").select("h", "leader", "v", "n")


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    sets = members.select("v", "n", "hashes")
    left = sets.select(F.col("v").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    right = sets.select(F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    return both.where(100 * common >= PERCENT * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


# --- signature trees ----------------------------------------------------------------------------------------------

class Node:
    """OR of the bitmaps below, their size range, how many shingles share a bit with another one at most, and the
    component if there is only one."""

    __slots__ = ("bits", "low", "high", "excess", "component", "children", "member")

    def __init__(self, children: list[Node] | None, member: int, bits: int, low: int, high: int, excess: int, component):
        self.children, self.member, self.bits, self.low, self.high = children, member, bits, low, high
        self.excess, self.component = excess, component


def leaf(member: int, hashes: np.ndarray, width: int, component) -> Node:
    marks = np.zeros(width, "u1")
    marks[hashes & (width - 1)] = 1
    bits = int.from_bytes(np.packbits(marks).tobytes(), "big")
    n = len(hashes)
    return Node(None, member, bits, n, n, n - bits.bit_count(), component)


def tree(leaves: list[Node]) -> Node:
    level = sorted(leaves, key=lambda x: (x.low, x.component, x.member))
    while len(level) > 1:
        groups = [level[i : i + FAN_OUT] for i in range(0, len(level), FAN_OUT)]
        level = []
        for g in groups:
            bits = 0
            for x in g:
                bits |= x.bits
            same = g[0].component if all(x.component == g[0].component for x in g) else None
            level.append(Node(g, -1, bits, min(x.low for x in g), max(x.high for x in g), max(x.excess for x in g), same))
    return level[0]


def possible(a: Node, b: Node) -> bool:
    """Whether any pair below the two nodes can be similar enough and is not connected yet."""
    if a.component is not None and a.component == b.component:
        return False
    if 100 * a.high < PERCENT * b.low or 100 * b.high < PERCENT * a.low:
        return False
    most = (a.bits & b.bits).bit_count() + min(a.excess, b.excess)
    return (100 + PERCENT) * most >= PERCENT * (a.low + b.low)


def tree_links(members: list[int], sets: list[np.ndarray], labels: list, sides: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is not connected yet, between side 0 and side 1, or within side 0 if there is no other."""
    width = 1 << max(8, (4 * max(map(len, sets))).bit_length())
    width = min(width, 1 << 16)
    leaves = [leaf(i, s, width, c) for i, (s, c) in enumerate(zip(sets, labels))]
    roots = [tree([x for x, s in zip(leaves, sides) if s == side]) for side in sorted(set(sides))]
    parent = {c: c for c in labels}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    stack = [(roots[0], roots[-1])]
    while stack:
        a, b = stack.pop()
        if a is b:
            if a.children and a.component is None:
                stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
            continue
        if not possible(a, b):
            continue
        if a.children is None and b.children is None:
            x, y = root(labels[a.member]), root(labels[b.member])
            if x != y:
                common = len(np.intersect1d(sets[a.member], sets[b.member], assume_unique=True))
                if 100 * common >= PERCENT * (a.low + b.low - common):
                    parent[max(x, y)] = min(x, y)
                    links.append((members[a.member], members[b.member]))
        elif b.children is None or (a.children is not None and a.high - a.low >= b.high - b.low):
            stack += [(x, b) for x in a.children]
        else:
            stack += [(a, y) for y in b.children]
    return links


def tree_task(rows: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple[int, int]] = []
    hashes = dict(zip(sets["w"].tolist(), sets["hashes"]))
    for _, pair in rows.groupby("pair", sort=False):
        members = pair["v"].tolist()
        out += tree_links(members, [hashes[v] for v in members], pair["component"].tolist(), pair["side"].tolist())
    return pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype("int64")


def tree_join(open_rows: DataFrame, members: DataFrame) -> DataFrame:
    """Links between different components within the buckets of ``open_rows`` (h, low, v, n, component), low being the
    least component of the bucket."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")
    banded = open_rows.withColumn("band", band)
    own = banded.groupBy("h", "band", "component").agg(F.count(F.lit(1)).alias("size"))
    # a large component has blocks of its own, so that pairs of its blocks fall away; small ones share blocks
    own = own.withColumn("apart", F.when(F.col("size") >= BLOCK // 2, F.col("component")).otherwise(F.lit(-1)))
    blocks = own.groupBy("h", "band", "apart").agg(F.sum("size").alias("size")).withColumn(
        "n_blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = banded.join(own.select("h", "band", "component", "apart"), ["h", "band", "component"]).join(
        blocks.select("h", "band", "apart", "n_blocks"), ["h", "band", "apart"])
    placed = written(placed.withColumn("block", F.struct(
        "band", "apart", F.pmod(F.xxhash64("v"), F.col("n_blocks")).cast("int").alias("no")
    )).select("h", "low", "v", "component", "block"), "blocks")
    there = placed.select("h", "block").distinct()
    one, two = there.withColumnRenamed("block", "one"), there.withColumnRenamed("block", "two")
    pairs = one.join(two, "h").where(
        ((F.col("one.band") == F.col("two.band")) & (F.col("one") <= F.col("two"))
         | (F.col("one.band") + 1 == F.col("two.band")))
        & ((F.col("one.apart") == -1) | (F.col("one.apart") != F.col("two.apart")))
    )
    pairs = written(pairs, "block_pairs")
    first = placed.join(pairs, (placed["h"] == pairs["h"]) & (placed["block"] == pairs["one"])).select(
        placed["h"], "low", "v", "component", "one", "two", F.lit(0).alias("side"))
    second = placed.join(pairs, (placed["h"] == pairs["h"]) & (placed["block"] == pairs["two"])).where("one != two").select(
        placed["h"], "low", "v", "component", "one", "two", F.lit(1).alias("side"))
    name = F.concat_ws(":", "h", *[f"{side}.{part}" for side in ("one", "two") for part in ("band", "apart", "no")])
    rows = written(first.unionByName(second).select("low", "v", "component", "side", name.alias("pair")), "tree_rows")
    # Buckets with the same least component have many members in common: they go to one task, which gets each set once,
    # or to several where they have more members than a task should hold.
    parts = small_side(rows.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).alias("parts")).where("parts > 1"))
    tasks = max(1, rows.count() // TASK_ROWS)
    part = F.pmod(F.xxhash64("pair"), F.coalesce("parts", F.lit(1)))
    placed_rows = written(rows.join(parts, "low", "left").select(
        F.pmod(F.xxhash64("low", part), F.lit(tasks)).alias("task"), "pair", "v", "component", "side"), "task_rows")
    asked = placed_rows.select(F.col("task").alias("t"), F.col("v").alias("w")).distinct()
    sets = asked.join(members.select(F.col("v").alias("w"), "hashes"), "w")
    return placed_rows.groupBy("task").cogroup(sets.groupBy("t")).applyInPandas(tree_task, "a bigint, b bigint")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the least key reachable by links, itself included) of every row.

    A set holds the distinct five-word shingles of a text, words being stretches without ASCII white space with A-Z
    lower-cased; a text of fewer words has its whole sequence as one shingle.  Null texts count as empty; texts without
    words have no shingles and no links, and their component is their own key.  Rows link from a Jaccard similarity of
    75 % on, so rows with the same words always do.  Repeated rows are kept.  Null keys have no part in the minimum: a
    component with null keys only has a null id.  An empty table gives an empty result.
    """
    read = written(read_documents(df, key, text), "read")
    documents = read.where("bucket is null").select("key", "class", "x", "n")
    classes = written(documents.where("class is not null").groupBy("class", "x", "n").agg(F.min("key").alias("key")), "classes")
    parts = max(1, classes.count() // CREDITS_A_PART)
    alive = credits(read, parts).join(classes, "x").where(F.col("credit") >= least_common(F.col("n")))
    wanted = written(alive.select("class", "key"), "wanted")
    members = whole_sets(df, key, text, wanted)
    rows = written(buckets(written(shared_prefixes(members), "shared_prefixes")), "bucket_rows")
    stars = rows.where("v != leader").select(F.col("v").alias("a"), F.col("leader").alias("b")).distinct()
    links = written(verified(stars, members), "star_links")
    joined = written(components(links), "star_components")
    labelled = rows.join(joined, "v", "left").withColumn("component", F.coalesce("component", "v")).select("h", "v", "n", "component")
    several = labelled.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    open_rows = written(labelled.join(written(several.select("h", "low"), "open_buckets"), "h"), "open_rows")
    more = written(tree_join(open_rows, members), "tree_links")
    final = components(joined.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = members.select("v", "class").join(classes, "class")
    in_component = written(final.join(named, "v").select("component", "class", "key"), "members_named")
    least = in_component.groupBy("component").agg(F.min("key").alias("component_id"))
    linked = written(in_component.join(least, "component").select("class", "component_id"), "linked")
    alone = classes.join(linked, "class", "left_anti").select("class", F.col("key").alias("component_id"))
    ids = written(linked.unionByName(alone), "component_ids")
    out = documents.join(ids, "class", "left").select(
        "key", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumnRenamed("key", key)
