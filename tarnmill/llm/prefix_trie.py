"""Conversation prefix trie (12): succinct level-order tries of prefix shards, their heavy upper levels merged apart.

Every turn of a conversation is named by the prefix that ends with it: a digest of the running sums of 128 bits of turn
hashes, placed by position, so that a conversation of any length is named by ranges and not in one task. A conversation is
then cut into blocks of `levels` turns; a block is a path of names that hangs from its anchor, the name before it. Equal
paths are folded first, so copies cost nothing further on.

An anchor with more than `most` different paths is heavy: its children are merged by Spark and become anchors of what is
left of the paths, again and again while there are heavy ones. The rest is dealt into shards of whole anchors. For a shard
numpy builds a LOUDS bitvector and the labels in level order, and reverse breadth-first order adds up members, children,
leaves and saved tokens by add.at. What hangs below a block's last level is another anchor's sum: the anchors form a tree
of their own, whose sums double their reach in each round, and a second pass puts them into the shards.

Turns are taken by turn (null first), then role, then text; rows that occur twice are two turns. Null roles and texts count
as empty. Rows without a conv_id belong to no conversation. c % 5 has the sign of c. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import running, staged

LEVELS, MOST = 64, 1 << 16
ROOT = hashlib.md5(b"root").digest()
PARTS = [f"s{i}" for i in range(4)]


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, d, depth, role, text), d from 1 and depth the conversation's length, and all (conv_id, depth).

    Conversation c takes the first h turns of c - c % 5 and its own after its first h, h being the crc32 of c's digits mod 9.
    """
    plain = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    placed = staged(running(plain, "conv_id", ["turn", "role", "text"], {}).select("conv_id", "number", "role", "text"), "turns")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5})
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("in_base")), "base", "left")
    taken = F.least("h", F.coalesce("in_base", F.lit(0)))
    convs = staged(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("depth")), "conversations")
    heads = placed.filter("number <= 8").withColumnRenamed("conv_id", "base").join(convs, "base").filter("number <= taken").select("conv_id", F.col("number").alias("d"), "depth", "role", "text")
    tails = placed.join(convs, "conv_id").filter("number > h").select("conv_id", (F.col("number") - F.col("h") + F.col("taken")).alias("d"), "depth", "role", "text")
    return heads.unionByName(tails), convs.select("conv_id", "depth")


def paths(turns: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(conv_id, anchor, path, last, stops) of each block of turns(conv_id, d, depth, role, text): path has (key, bytes) for each level."""
    hashes = [F.xxhash64(F.lit(seed), "d", "role", "text") for seed in (11, 12)]
    halves = [half for x in hashes for half in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    named = running(turns.select("conv_id", "d", "depth", "role", "text", F.octet_length("text").cast("long").alias("bytes")).withColumns({f"own{i}": c for i, c in enumerate(halves)}).drop("role", "text"), "conv_id", ["d"], {p: F.col(f"own{i}") for i, p in enumerate(PARTS)})
    name = lambda d, sums: F.unhex(F.md5(F.concat_ws(",", d.cast("string"), *[s.cast("string") for s in sums])))
    before = F.when(F.col("d") == 1, F.lit(ROOT)).otherwise(name(F.col("d") - 1, [F.col(p) - F.col(f"own{i}") for i, p in enumerate(PARTS)]))
    keyed = named.select("conv_id", "d", "depth", "bytes", name(F.col("d"), [F.col(p) for p in PARTS]).alias("key"), before.alias("before"))
    block = F.floor((F.col("d") - 1) / levels)
    steps = F.array_sort(F.collect_list(F.struct("d", "key", "bytes", "before")))
    found = keyed.groupBy("conv_id", block.alias("block")).agg(steps.alias("steps"), F.max("depth").alias("depth"))
    path = F.transform("steps", lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes")))
    last = F.element_at("steps", -1)
    return found.select("conv_id", F.col("steps")[0]["before"].alias("anchor"), path.alias("path"), last["key"].alias("last"), (last["d"] == F.col("depth")).alias("stops"), F.col("block") * levels)


def lifted(units: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame]:
    """The nodes under heavy anchors, merged (key, parent, depth, bytes, n, low, ends), and the units that hang from light anchors."""
    upper = None
    while True:
        heavy = units.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("anchor")
        if heavy.isEmpty():
            return upper, units
        split = units.join(heavy, "anchor", "left_semi")
        top = F.col("path")[0]
        nodes = split.groupBy(top["key"].alias("key"), F.col("anchor").alias("parent"), (F.col("above") + 1).alias("depth"), top["bytes"].alias("bytes")).agg(F.sum("n").alias("n"), F.min("low").alias("low"))
        upper = staged(nodes, "upper") if upper is None else upper.unionByName(staged(nodes, "upper"))
        rest = split.filter(F.size("path") > 1).withColumns({"anchor": top["key"], "above": F.col("above") + 1, "path": F.slice("path", 2, F.size("path") - 1)})
        units = staged(units.join(heavy, "anchor", "left_anti").unionByName(rest.select(*units.columns)), "units")


NODES = "key binary, parent binary, depth long, n_convs long, low long, n_children long, n_leaves long, saved long"


def louds(parent: np.ndarray) -> np.ndarray:
    """The bits of a trie in level order, for each node a one for each child and then a zero, before them those of a super-root."""
    degrees = np.bincount(parent + 1, minlength=len(parent) + 1)
    bits = np.ones(int(degrees.sum()) + len(degrees), bool)
    bits[np.cumsum(degrees + 1) - 1] = False
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """Each node's parent in level order, -1 for children of the super-root: the zeros before the node's own one, less one."""
    return np.cumsum(~bits)[bits] - 1


def rolled_up(table: pa.Table) -> pa.Table:
    """The nodes of one shard's anchors from its units(anchor, above, path, n, low, goes_on, leaves, saved, children).

    Anchors come out too, with depth -1, as what their tries hold in all. leaves, saved and children are those of the trie
    that hangs from a path's last node, zero where there is none.
    """
    path, long = table.column("path").combine_chunks(), lambda c: table.column(c).to_numpy()
    sizes = np.diff(path.offsets.to_numpy())
    begin = np.cumsum(sizes) - sizes
    items = path.flatten()
    codes = pa.chunked_array([table.column("anchor").combine_chunks(), items.field("key")]).combine_chunks().dictionary_encode()
    names, code = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
    anchors, label, size_of = code[: table.num_rows], code[table.num_rows :], items.field("bytes").to_numpy()
    # Level by level: a node is its parent's place and its label; a unit's place on a level leads on to the next.
    labels, first_row = np.unique(anchors, return_index=True)
    at = np.searchsorted(labels, anchors)
    level_of, parent, tokens, depth = [labels], [np.full(len(labels), -1)], [np.zeros(len(labels), np.int64)], [np.full(len(labels), -1)]
    base, end = 0, at.copy()
    for k in range(int(sizes.max())):
        rows = np.flatnonzero(sizes > k)
        both = at[rows] * len(names) + label[begin[rows] + k]
        nodes, example, inverse = np.unique(both, return_index=True, return_inverse=True)
        base += len(level_of[-1])
        level_of.append(nodes % len(names))
        parent.append(nodes // len(names))
        tokens.append(size_of[begin[rows[example]] + k])
        depth.append(long("above")[rows[example]] + k + 1)
        at[rows] = base + inverse
        end[rows] = at[rows]
    bits = louds(np.concatenate(parent))
    up, n = parents(bits), len(np.concatenate(parent))
    children = np.bincount(up[up >= 0], minlength=n)
    members, low, leaves, saved = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(members, end, long("n"))
    np.minimum.at(low, end, long("low"))
    last = np.flatnonzero(long("goes_on"))
    children[end[last]] += long("children")[last]  # a path that goes on is its last node's only one here
    leaves[end[last]] = long("leaves")[last]
    saved[end[last]] = long("saved")[last]
    goes_on = np.zeros(n, bool)
    goes_on[end[last]] = True
    leaves[(np.diff(np.flatnonzero(~bits)) == 1) & ~goes_on] = 1  # no one between two zeros: no child
    tokens, ends = np.concatenate(tokens), np.cumsum([len(x) for x in level_of])
    for k in range(len(level_of) - 1, -1, -1):
        level = np.arange(ends[k] - len(level_of[k]), ends[k])
        saved[level] += (members[level] - 1) * tokens[level]
        if k:
            for total in (members, leaves, saved):
                np.add.at(total, up[level], total[level])
            np.minimum.at(low, up[level], low[level])
    key, above = names.take(pa.array(np.concatenate(level_of))), pa.array(up, mask=up < 0)
    return pa.table({"key": key, "parent": names.take(pa.array(np.concatenate(level_of))).take(above), "depth": np.concatenate(depth), "n_convs": members, "low": low, "n_children": children, "n_leaves": leaves, "saved": saved})


def pass_over(units: DataFrame, below: DataFrame | None, most: int, total: int) -> DataFrame:
    """NODES of the units' shards; below(last, leaves, saved, children) has what hangs from paths that go on."""
    if below is None:
        units = units.withColumns({k: F.lit(0).cast("long") for k in ("leaves", "saved", "children")})
    else:
        units = units.join(below, "last", "left").withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in ("leaves", "saved", "children")})
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // most))))
    return units.select(shard.alias("shard"), "anchor", "above", "path", "n", "low", "goes_on", "leaves", "saved", "children").groupBy("shard").applyInArrow(lambda rows: rolled_up(rows.drop(["shard"])), NODES)


def subtree_sums(tree: DataFrame) -> DataFrame:
    """(anchor, leaves, saved, children) with the sums of everything below, for tree(anchor, up, leaves, saved, children).

    After round k a row has the sums of what is less than 2^k steps below it, and `up` leads 2^k steps up.
    """
    while not tree.filter("up is not null").isEmpty():
        given = tree.filter("up is not null").groupBy(F.col("up").alias("anchor")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("most"))
        next_up = tree.select(F.col("anchor").alias("up"), F.col("up").alias("up2"))
        tree = staged(tree.join(given, "anchor", "left").join(next_up, "up", "left").select("anchor", F.col("up2").alias("up"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("most", F.lit(0))).alias("saved"), "children"), "anchors")
    return tree.drop("up")


def id_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of each key's conv_ids, ascending, joined by commas.

    SHA-256 is sequential, so a key's ids pass one task, as a stream of numbers of which none is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, hashlib.sha256(), []
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if not keys:
                continue
            ids = batch.column("conv_id").to_numpy()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                text = ",".join(map(str, ids[a:b].tolist())).encode()
                if keys[a] == now:
                    digest.update(b"," + text)
                    continue
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = keys[a], hashlib.sha256(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], ["key", "ends_sha256"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def trie(turns: DataFrame, levels: int = LEVELS, most: int = MOST) -> DataFrame:
    """One row per node of the trie of turns(conv_id, turn, role, text), whose conversations are rebuilt by `spliced`.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rebuilt, convs = spliced(turns)
    blocks = staged(paths(rebuilt, levels).toDF("conv_id", "anchor", "path", "last", "stops", "above"), "blocks")
    first = F.first("path").alias("path")  # a last name names the whole path
    units = staged(blocks.groupBy("last", "anchor", "above").agg(first, F.count("*").alias("n"), F.min("conv_id").alias("low"), (~F.bool_and("stops")).alias("goes_on")), "units")
    goes_on = units.filter("goes_on").select(F.col("last").alias("anchor"))
    upper, light = lifted(units, most)
    total = light.count()
    sums = pass_over(light, None, most, total).filter("depth < 0").select(F.col("key").alias("anchor"), F.col("n_leaves").alias("leaves"), "saved", F.col("n_children").alias("children"))
    up = light.filter("goes_on").select(F.col("last").alias("anchor"), F.col("anchor").alias("up"))
    if upper is not None:
        held = sums.select("anchor").unionByName(upper.select(F.col("parent").alias("anchor")))
        alone = upper.join(held, upper.key == held.anchor, "left_anti").select("key").withColumn("leaf", F.lit(1))
        own = upper.join(alone, "key", "left").groupBy(F.col("parent").alias("anchor")).agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.sum((F.col("n") - 1) * F.col("bytes")).alias("saved"), F.count("*").alias("children"))
        sums = sums.unionByName(own)
        up = up.unionByName(upper.select(F.col("key").alias("anchor"), F.col("parent").alias("up")))
    anchors = subtree_sums(staged(sums.join(up, "anchor", "left").select("anchor", "up", "leaves", "saved", "children"), "anchors"))
    below = anchors.withColumnRenamed("anchor", "last").join(goes_on.select(F.col("anchor").alias("last")), "last", "left_semi")
    nodes = pass_over(light, below, most, total).filter("depth > 0")
    hanging = anchors.withColumnRenamed("anchor", "key")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    if upper is not None:
        merged = upper.join(hanging, "key", "left").select("key", "parent", "depth", F.col("n").alias("n_convs"), "low", zero("children").alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes") + zero("saved")).alias("saved"))
        nodes = nodes.unionByName(merged)
    everyone = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("low")).filter("n_convs > 0").withColumn("key", F.lit(ROOT))
    root = everyone.join(hanging, "key", "left").select("key", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "low", zero("children").alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), zero("saved").alias("saved"))
    nodes = staged(nodes.unionByName(root), "nodes")
    ends = blocks.filter("stops").select(F.col("last").alias("key"), "conv_id").unionByName(convs.filter("depth = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    above = nodes.select(F.col("key").alias("parent"), F.col("low").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").join(id_digests(ends), "key", "left").select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 9 AS h, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, list_concat(coalesce(list_slice(d.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS path FROM c LEFT JOIN c d ON d.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path FROM b),
n AS (SELECT depth, list_slice(path, 1, depth) AS node, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(path) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY ALL),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND list_slice(m.node, 1, n.depth) = n.node) AS n_children FROM n)
SELECT a.conv_id, a.depth, any_value(up.conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children, count(*) FILTER (d.n_children = 0) AS n_leaves,
  CAST(sum(CASE WHEN d.depth = 0 THEN 0 ELSE (d.n_convs - 1) * strlen(d.node[d.depth].x) END) AS BIGINT) AS saved_tokens, sha256(coalesce(any_value(a.ends), '')) AS ends_sha256
FROM k a JOIN k d ON d.depth >= a.depth AND list_slice(d.node, 1, a.depth) = a.node LEFT JOIN k up ON up.depth = a.depth - 1 AND list_slice(a.node, 1, up.depth) = up.node
GROUP BY a.conv_id, a.depth, a.node
"""
