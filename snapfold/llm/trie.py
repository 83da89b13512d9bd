"""Prefix trie of conversations: ternary search trees per range shard, merged at the nodes that cross shards.

Conversations are sorted by their turns' codes and their id and cut into ranges. A shard numbers its distinct turns,
inserts its distinct conversations into a ternary search tree, the median first, and sums up its nodes from the leaves.
All conversations of a node stand together in that order, so only prefixes of a shard's first and last conversation can
go on in another shard. These are merged by groups of neighbouring shards, in rounds; a round keeps the nodes that can
still go on beyond its group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapfold.llm.common import WORD, cut, prepare

#: Shards whose crossing nodes are merged at once.
FAN = 64
ROOT = b"\0" * 16
NOTHING = hashlib.sha256(b"").hexdigest()

#: key and parent are set for nodes that can cross shards, and parent for their children; left and right tell whether a
#: node begins the shard's first or last conversation; n_children, n_leaves and saved of these count complete children.
NODE = pa.schema(
    [
        ("key", pa.binary()),
        ("parent", pa.binary()),
        ("shard", pa.int64()),
        ("left", pa.bool_()),
        ("right", pa.bool_()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("words", pa.int64()),
        ("ends", pa.string()),
    ]
)
SPARK_NODE = (
    "key binary, parent binary, shard bigint, left boolean, right boolean, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends string"
)


class Tree:
    """A ternary search tree over turn numbers; node 0 is the root, and every node comes after its parent."""

    def __init__(self):
        self.code, self.parent, self.depth = [-1], [-1], [0]
        self.low, self.high, self.down = [-1], [-1], [-1]

    def _new(self, code: int, parent: int) -> int:
        self.code.append(code)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for x in (self.low, self.high, self.down):
            x.append(-1)
        return len(self.code) - 1

    def insert(self, path: list[int]) -> list[int]:
        """The nodes of a path, from the first turn on."""
        at, made = 0, []
        for code in path:
            child = self.down[at]
            if child < 0:
                child = self.down[at] = self._new(code, at)
            while self.code[child] != code:
                side = self.low if code < self.code[child] else self.high
                if side[child] < 0:
                    side[child] = self._new(code, at)
                child = side[child]
            made.append(child)
            at = child
        return made


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the median of a range before those of its halves."""
    open_ranges = [(0, n)]
    while open_ranges:
        a, b = open_ranges.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            open_ranges += [(a, middle), (middle + 1, b)]


def shard_nodes(convs: list[int], paths: list[list[bytes]], words: list[list[int]], shard: int) -> list[dict]:
    """The nodes of one shard, whose conversations come sorted by path and id."""
    codes = {x: i for i, x in enumerate(sorted({x for p in paths for x in p}))}
    begins = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]]
    ends = [*begins[1:], len(paths)]
    tree, at, weight = Tree(), {}, {0: 0}
    for i in medians(len(begins)):
        a = begins[i]
        nodes = tree.insert([codes[x] for x in paths[a]])
        at[nodes[-1] if nodes else 0] = (a, ends[i])
        weight.update(zip(nodes, words[a], strict=True))
        if i in (0, len(begins) - 1):
            edge = [0, *nodes]
            if i == 0:
                first = edge
            if i == len(begins) - 1:
                last = edge
    n = len(tree.code)
    members, least = [0] * n, [None] * n
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    left, right = set(first), set(last)
    keys, turns = {0: ROOT}, {v: k for k, v in codes.items()}
    for x in sorted(left | right):
        if x:
            keys[x] = hashlib.sha256(keys[tree.parent[x]] + turns[tree.code[x]]).digest()[:16]
    made = []
    for x in range(n - 1, -1, -1):
        a, b = at.get(x, (0, 0))
        members[x] += b - a
        if b > a and (least[x] is None or convs[a] < least[x]):
            least[x] = convs[a]
        up = tree.parent[x]
        if up >= 0:
            members[up] += members[x]
            if least[up] is None or least[x] < least[up]:
                least[up] = least[x]
            if x not in keys:
                children[up] += 1
                leaves[x] = leaves[x] or 1
                saved[x] += (members[x] - 1) * weight[x]
                leaves[up] += leaves[x]
                saved[up] += saved[x]
    for x in range(n):
        a, b = at.get(x, (0, 0))
        listed = ",".join(map(str, convs[a:b]))
        up = tree.parent[x]
        made.append(
            {
                "key": keys.get(x),
                "parent": keys.get(up),
                "shard": shard,
                "left": x in left,
                "right": x in right,
                "conv_id": least[x],
                "depth": tree.depth[x],
                "parent_conv_id": least[up] if up >= 0 else None,
                "n_convs": members[x],
                "n_children": children[x],
                "n_leaves": leaves[x],
                "saved_tokens": saved[x],
                "words": weight[x],
                "ends": listed if x in keys else hashlib.sha256(listed.encode()).hexdigest() if listed else NOTHING,
            }
        )
    return made


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs, paths, words = [], [], []
    for batch in batches:
        convs += batch.column(0).to_pylist()
        paths += batch.column(1).to_pylist()
        words += batch.column(2).to_pylist()
    if convs:
        made = shard_nodes(convs, paths, words, TaskContext.get().partitionId())
        for i in range(0, len(made), 4096):
            yield pa.RecordBatch.from_pylist(made[i : i + 4096], NODE)


def merge_nodes(rows: list[dict], last: bool) -> list[dict]:
    """Merge the crossing nodes of neighbouring shards.

    What begins neither the first nor the last conversation of all of them (or everything, if last) is complete; it
    comes without a side. The others come as nodes of one larger shard.
    """
    low, high = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        left, right = r["left"] and r["shard"] == low, r["right"] and r["shard"] == high
        x = nodes.get(r["key"])
        if x is None:
            nodes[r["key"]] = {**r, "left": left, "right": right}
            continue
        x["left"], x["right"] = x["left"] or left, x["right"] or right
        x["conv_id"] = min(x["conv_id"], r["conv_id"])
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            x[name] += r[name]
    for x in sorted(nodes.values(), key=lambda x: -x["depth"]):
        x["shard"] = low // FAN
        if last or not (x["left"] or x["right"]):
            x["left"] = x["right"] = False
            x["n_leaves"] = x["n_leaves"] or 1
            x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
            if up := nodes.get(x["parent"]):
                up["n_children"] += 1
                up["n_leaves"] += x["n_leaves"]
                up["saved_tokens"] += x["saved_tokens"]
    return list(nodes.values())


def _merger(last: bool) -> Callable[[pa.Table], pa.Table]:
    def merge(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(merge_nodes(group.to_pylist(), last), NODE)

    return merge


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash over the pieces of each key, which come sorted by key and place."""
    held, digest = None, None
    for batch in batches:
        keys, made = [], []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != held:
                if held is not None:
                    keys.append(held)
                    made.append(digest.hexdigest())
                held, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made, pa.string())], ["key", "sha"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([digest.hexdigest()])], ["key", "sha"])


def turn_code(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def conversations_of_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words) of each conversation in ``turns`` (conv_id, turn, role, text): codes and words of its turns.

    Turns are in order of turn (null first), then role and text; repeated rows are turns of their own. A null role or
    text is empty. Rows without a conv_id belong to no conversation and take no part. A conversation is one row, so
    the 24 bytes a turn that are kept of it have to fit one.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    clean = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        turn_code(role, text).alias("code"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = clean.select("conv_id", F.struct(F.row_number().over(order).alias("at"), "code", "words").alias("t"))
    listed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.col("t.code").alias("path"), F.col("t.words").alias("words"))


def shared_openings(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations with their first h turns replaced by those of conversation ``conv_id - conv_id % every``.

    h is crc32 of the decimal conv_id modulo ``most``. A shorter opening conversation gives all its turns, an absent one
    none. At most ``every`` conversations share a base, so no group is large.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    same = Window.partitionBy("base")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    out = convs.withColumn("base", base).withColumn("h", h)
    for name in ("path", "words"):
        opening = F.when(F.col("conv_id") == F.col("base"), F.slice(name, 1, most - 1))
        out = out.withColumn(f"base_{name}", F.coalesce(F.max(opening).over(same), F.array().cast(dict(convs.dtypes)[name])))
    rest = F.greatest(F.size("path") - F.col("h"), F.lit(0))
    both = [F.concat(F.slice(f"base_{x}", F.lit(1), F.col("h")), F.slice(x, F.col("h") + 1, rest)).alias(x) for x in ("path", "words")]
    return out.select("conv_id", *both)


def trie(convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the paths in ``convs`` (conv_id, path, words), distinct by conv_id.

    Columns: conv_id (the smallest member's), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over
    the subtree, words of the last turn times members but one) and ends_sha256 (of the ids of members that end here,
    ascending, comma-joined). The textless root has depth 0 and no parent. No conversations give no rows.

    A shard holds its range of the conversations in memory, and its rows are sorted on disk; copies of a conversation are
    dealt out by their id. What is merged is at most two paths a shard. The ids that end at a crossing node come as
    one piece a shard, and one task streams them through the hash.
    """
    spark = prepare(convs.sparkSession)
    dealt = convs.select("conv_id", "path", "words").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    made = cut(dealt.mapInArrow(_shards, SPARK_NODE))
    edges = made.where("left OR right")
    shards = made.agg(F.max("shard")).first()[0]
    if shards is None:
        return _named(made)
    final, open_nodes, groups = [], edges, shards + 1
    while True:
        last = groups <= FAN
        slim = open_nodes.withColumn("ends", F.lit(None).cast("string"))
        merged = cut(slim.groupBy(F.floor(F.col("shard") / FAN)).applyInArrow(_merger(last), SPARK_NODE))
        final.append(merged.where("NOT left AND NOT right"))
        if last:
            break
        open_nodes, groups = merged.where("left OR right"), -(-groups // FAN)
    crossing = final[0]
    for more in final[1:]:
        crossing = crossing.union(more)
    pieces = edges.where("ends != ''").repartition("key").sortWithinPartitions("key", "shard").select("key", "ends")
    shas = pieces.mapInArrow(_hashed, "key binary, sha string")
    smallest = crossing.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
    crossing = crossing.join(shas, "key", "left").join(smallest, "parent", "left")
    crossing = crossing.withColumn("parent_conv_id", F.col("up")).withColumn("ends", F.coalesce("sha", F.lit(NOTHING)))
    # children of a crossing node find it by their shard as well, so that no node's children meet in one task
    known = edges.select("shard", F.col("key").alias("parent")).join(smallest, "parent")
    inner = made.where("NOT left AND NOT right")
    below = inner.where("parent IS NOT NULL").join(known, ["shard", "parent"]).withColumn("parent_conv_id", F.col("up"))
    return _named(inner.where("parent IS NULL")).union(_named(below)).union(_named(crossing))


def _named(nodes: DataFrame) -> DataFrame:
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes.select(*names, F.col("ends").alias("ends_sha256"))
