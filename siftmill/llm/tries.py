"""Prefix tries of conversations: double arrays over dense turn ids, one for each shard of prefixes.

Turns get dense numbers, conversations become sequences of these, and equal sequences are one class that counts.  The classes
are sorted and dealt to ranges, the shards.  Each shard packs its sequences into a double array (``DoubleArray``) and walks it
for the nodes and their aggregates.  Two shards share only nodes on the path to the sequences where their ranges meet; which
these are follows from the lengths of a few common prefixes, so a shared node has the same id in all shards, and what shards
found for it is merged.  Every aggregate is a sum or a least value: a node counts as new only in the first shard that has it.

Long conversations are cut into segments of ``segment`` turns.  The segments of one depth are a level; a level's sequences
begin with the node at which the conversation's segment before ended, so no row holds a conversation of any length.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.operators.running import running_sum

from .common import materialise

#: Turns that a shard holds, about; a level has as many shards as its turns fill.
SHARD = 1 << 14
WORD = "[^\\x20\\x09-\\x0D]+"
NONE = hashlib.sha256(b"").hexdigest()
SHARED = 1 << 62


class DoubleArray:
    """A trie in two arrays: the child of node s by code c is t = base[s] + c, if check[t] == s.  Node 0 is the root."""

    def __init__(self):
        self.base, self.check = np.zeros(256, np.int64), np.full(256, -1, np.int64)
        self.check[0], self.low = np.iinfo(np.int64).max, 1  # the root is taken and nobody's child

    def _reach(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _fit(self, codes: np.ndarray) -> int:
        """The lowest free place of the first code at which all codes (ascending) have free places."""
        at, step = self.low, max(1, min(1024, (1 << 20) // len(codes)))  # places looked at together
        while True:
            self._reach(at + step + int(codes[-1] - codes[0]) + 1)
            places = at + np.flatnonzero(self.check[at : at + step] < 0)
            fits = places[(self.check[places[:, None] + (codes - codes[0])] < 0).all(axis=1)]
            if len(fits):
                return int(fits[0])
            at += step

    def add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places of new children, given by parent and ascending code; a parent gets all its children in one call."""
        out = np.zeros(len(codes), np.int64)
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        many = np.diff(np.concatenate([first, [len(parents)]]))
        for a, n in zip(first[many > 1].tolist(), many[many > 1].tolist(), strict=True):
            own = codes[a : a + n]
            self.base[parents[a]] = base = self._fit(own) - own[0]
            out[a : a + n] = base + own
            self.check[base + own] = parents[a]
        single = first[many == 1]
        if len(single):  # any free place will do
            free = self.low + np.flatnonzero(self.check[self.low :] < 0)
            if len(free) < len(single):
                self._reach(len(self.check) + len(single))
                free = self.low + np.flatnonzero(self.check[self.low :] < 0)
            out[single] = free[: len(single)]
            self.base[parents[single]] = out[single] - codes[single]
            self.check[out[single]] = parents[single]
        free = np.flatnonzero(self.check[self.low :] < 0)
        self.low += int(free[0]) if len(free) else len(self.check) - self.low
        return out

    def children(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by each code, -1 where there is none."""
        at = self.base[nodes] + codes
        inside = (at >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == nodes), at, -1)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Places at which any of the keys differs from the place before."""
    changed = np.zeros(len(keys[0]), dtype=bool)
    changed[:1] = True
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


def pack(start: np.ndarray, length: np.ndarray, flat: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of sorted distinct sequences (slices of ``flat``) and the code of each element; codes follow the order in which breadth-first building meets the values, so that siblings have near ones."""
    values, local = np.unique(flat, return_inverse=True)
    code, used, trie = np.full(len(values), -1, np.int64), 0, DoubleArray()
    at = np.zeros(len(start), np.int64)
    for d in range(int(length.max(initial=0))):
        act = np.flatnonzero(length > d)
        value, parent = local[start[act] + d], at[act]
        heads = _firsts(parent, value)
        new = value[heads][code[value[heads]] < 0]
        new = new[np.sort(np.unique(new, return_index=True)[1])]
        code[new] = used + np.arange(len(new))
        used += len(new)
        p, c = parent[heads], code[value[heads]]
        group = np.cumsum(np.concatenate([[0], p[1:] != p[:-1]])) if len(p) else p
        order = np.lexsort((c, group))
        places = np.zeros(len(heads), np.int64)
        places[order] = trie.add(p[order], c[order])
        at[act] = np.repeat(places, np.diff(np.concatenate([heads, [len(act)]])))
    return trie, code[local]


def _paths(limits: list[tuple[int, int]], shard: int, depths: np.ndarray) -> np.ndarray:
    """The first shard that has the path of the shard's first sequence to each depth."""
    owner = np.full(len(depths), shard, np.int64)
    for upto, first in limits:  # the depths fall, the shards too
        owner[depths <= upto] = first
    return owner


def walk(table: pa.Table, level: int, ties: dict[int, tuple[int, int, list[tuple[int, int]], bool]]) -> pa.Table:
    """Nodes of one shard with what it knows of them, and for each class the id of the node at its end.

    ``ties``: of a shard, the common prefix with the shard before and after, the owners of the first sequence's prefixes, and
    whether the shard after begins with a longer sequence that has the last one as its prefix."""
    shard = table.column("shard")[0].as_py()
    before, after, limits, extended = ties[shard]
    seqs = [np.concatenate([[r], t]).astype(np.int64) for r, t in zip(table.column("root").to_pylist(), table.column("tids").to_pylist(), strict=True)]
    order = sorted(range(len(seqs)), key=lambda k: seqs[k].tolist())
    seqs = [seqs[k] for k in order]
    pick = lambda c: table.column(c).to_numpy()[order]
    n, conv, on, cid = pick("n"), pick("conv"), pick("on"), pick("cid")
    length = np.array([len(s) for s in seqs], np.int64)
    start = np.cumsum(length) - length
    flat = np.concatenate(seqs)
    own_words = table.column("words").to_pylist()
    words = np.concatenate([np.array([0, *own_words[k]], np.int64) for k in order])
    total = np.concatenate([[0], np.cumsum(words)])
    trie, codes = pack(start, length, flat)

    size = len(trie.check)
    made = {k: np.zeros(size, np.int64) for k in ("n", "conv", "depth", "words", "new", "leaves", "saved", "children")}
    gid = (np.int64(level) << 52) | (np.int64(shard) << 32) | np.arange(size, dtype=np.int64)
    shared = np.zeros(size, dtype=bool)
    prefix = np.zeros(len(seqs), bool)  # sequences that the next one extends
    prefix[:-1] = [len(a) < len(b) and (b[: len(a)] == a).all() for a, b in zip(seqs, seqs[1:], strict=False)]
    prefix[-1] = extended
    at, levels = np.zeros(len(seqs), np.int64), []
    for d in range(int(length.max())):
        act = np.flatnonzero(length > d)
        nodes = trie.children(at[act], codes[start[act] + d])
        heads = _firsts(nodes)
        own = nodes[heads]
        at[act] = nodes
        made["n"][own] = np.add.reduceat(n[act], heads)
        made["conv"][own] = np.minimum.reduceat(conv[act], heads)
        made["depth"][own], made["words"][own], made["new"][own] = d, words[start[act[heads]] + d], 1
        if d == 0:
            gid[own] = flat[start[act[heads]]]
        elif d < before:
            made["new"][own[0]] = 0
        ends = act[length[act] == d + 1]
        made["leaves"][at[ends]] += (~prefix[ends] & (on[ends] == 0)).astype(np.int64)
        # of the members through a node, the words from it on
        made["saved"][own] = np.add.reduceat(n[act] * words[start[act] + d], heads)
        levels.append(own)
    depths = np.arange(int(max(length[0], length[-1])), dtype=np.int64)
    for k, most, limit in ((len(seqs) - 1, after, []), (0, before, limits)):
        node = np.int64(0)
        same = 0  # how far the path is also that of the shard's first sequence
        while same < min(length[0], length[k]) and seqs[0][same] == seqs[k][same]:
            same += 1
        for d in range(int(min(most, length[k]))):
            node = trie.children(np.array([node]), codes[start[k] + d : start[k] + d + 1])[0]
            if d:
                owner = int(_paths(limits, shard, depths[d : d + 1] + 1)[0]) if d < same and d < before else shard
                gid[node] = SHARED | (np.int64(level) << 52) | (np.int64(owner) << 32) | np.int64(d)
                shared[node] = True
    made["saved"] -= made["new"] * made["words"]
    for own in reversed(levels[1:]):
        up = trie.check[own]
        for k in ("leaves", "saved"):
            np.add.at(made[k], up, made[k][own])
        np.add.at(made["children"], up, made["new"][own])
    nodes = np.concatenate(levels[1:])
    full = np.flatnonzero(on > 0)
    paths = [[] for _ in seqs]
    for k in full.tolist():
        node = np.int64(0)
        for d in range(int(length[k])):
            node = trie.children(np.array([node]), codes[start[k] + d : start[k] + d + 1])[0]
            if d:
                paths[k].append(int(gid[node]))
    cols = {
        "gid": np.concatenate([gid[nodes], gid[at]]), "parent": np.concatenate([gid[trie.check[nodes]], np.full(len(at), -1)]), "cid": np.concatenate([np.full(len(nodes), -1), cid]),
        "shared": np.concatenate([shared[nodes], np.zeros(len(at), bool)]),
    } | {k: np.concatenate([v[nodes], np.zeros(len(at), np.int64)]) for k, v in made.items() if k not in ("new", "words")}
    arrays = {k: pa.array(v) for k, v in cols.items()} | {"path": pa.array([[]] * len(nodes) + paths, pa.list_(pa.int64()))}
    return pa.table(arrays)


def _walker(level: int, ties: dict):
    def walked(table: pa.Table) -> pa.Table:
        return walk(table, level, ties)

    return walked


FOUND = "gid long, parent long, cid long, shared boolean, n long, conv long, depth long, leaves long, saved long, children long, path array<long>"


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays without nulls."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def _ties(classes: DataFrame) -> dict[int, tuple[int, int, list[tuple[int, int]], bool]]:
    """What ``walk`` needs to know of each shard's neighbours; a few numbers a shard reach the driver."""
    path = F.concat(F.array("root"), "tids")
    ends = classes.groupBy("shard").agg(F.min(path).alias("a"), F.max(path).alias("z"))
    last = F.lag("z").over(W.orderBy("shard"))
    told = ends.withColumn("y", F.coalesce(last, F.array().cast("array<long>"))).select("shard", _common(F.col("a"), F.col("y")).alias("before"), _common(F.col("a"), F.col("z")).alias("within"), F.size("y").alias("size_y"), F.size("a").alias("size_a"))
    out, known = {}, told.orderBy("shard").collect()
    for k, r in enumerate(known):
        limits, limit, j = [], r["before"], k
        while j and limit > 1:  # the first element is the root, which all levels know
            j -= 1
            limits.append((limit, known[j]["shard"]))
            limit = min(limit, known[j]["within"], known[j]["before"])
        after = known[k + 1] if k + 1 < len(known) else None
        out[r["shard"]] = (r["before"], after["before"] if after else 0, limits, bool(after and after["before"] == after["size_y"] and after["size_a"] > after["size_y"]))
    return out


def _dense(turns: DataFrame) -> DataFrame:
    """The different digests of turns with numbers from 0 on: places in the written parts, after the sizes of the parts before (one number a part is collected)."""
    different = materialise(turns.groupBy("digest").agg(F.first("words").alias("words")).withColumn("place", F.monotonically_increasing_id()), "turn-ids")
    part = F.shiftrightunsigned("place", 33)
    sizes = sorted((r["part"], r["count"]) for r in different.groupBy(part.alias("part")).count().collect())
    spark, offsets, at = turns.sparkSession, [], 0
    for p, size in sizes:
        offsets.append((p, at))
        at += size
    first = spark.createDataFrame(offsets, "part long, first long")
    return different.join(F.broadcast(first), part == F.col("part")).select("digest", (F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("tid"))


def rebuilt(conversations: DataFrame, borrow: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, pos, digest, words) of the rebuilt conversations, pos from 0, and all conversations (conv_id).

    ``borrow`` gives for a conversation ``c`` how many turns of conversation ``base`` stand for as many of its own, ``most`` at most."""
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = running_sum(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], F.lit(1), "pos").withColumn("pos", F.col("pos") - 1).drop("turn")
    turns = materialise(turns, "turns")
    sizes = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("size")), "conversations")
    c = sizes.withColumnRenamed("conv_id", "c").select("c", borrow.cast("long").alias("h"), base.cast("long").alias("base"))
    c = c.join(sizes.select(F.col("conv_id").alias("base"), "size"), "base", "left").select("c", "h", "base", F.least("h", F.coalesce("size", F.lit(0))).alias("m"))
    own = turns.join(c, F.col("conv_id") == F.col("c")).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "words")
    head = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = head.join(c.where("m > 0"), "base").where("pos < m").select(F.col("c").alias("conv_id"), "pos", "digest", "words")
    return own.union(lent), sizes


def _digests(ends: DataFrame) -> DataFrame:
    """For each node (gid) the SHA-256 of the decimal ids of the conversations that end there, ascending and comma-joined.

    Ids are joined in runs of neighbouring ids, and the runs of a node go through one running hash: memory holds a run."""
    runs = ends.groupBy("gid", F.shiftright("conv_id", 9).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select("gid", "run", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")).repartition("gid").sortWithinPartitions("gid", "run")

    def hashed(batches):
        last, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for gid, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if gid != last:
                    if state:
                        done.append((last, state.hexdigest()))
                    last, state = gid, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["gid", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([state.hexdigest()])], names=["gid", "ends_sha256"])

    return runs.mapInArrow(hashed, "gid long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, borrow: Column | None = None, base: Column | None = None, most: int = 0, segment: int = 1024, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, and those of one turn number by the SHA-256 of role, newline and text.  Null roles
    and texts are empty ones; rows without a conv_id are left out; repeated rows are turns each.  ``borrow`` and ``base`` are
    columns over ``c``, a conversation's id: its first ``borrow`` turns (``most`` at most) come from conversation ``base``; by
    default none do.  A conversation that this leaves without turns is a member of the root alone.  Other columns are ignored;
    a table without conversations gives no rows, not even a root."""
    rows, convs = rebuilt(conversations, F.lit(0) if borrow is None else borrow, F.col("c") if base is None else base, most)
    shards = shards or max(1, math.ceil((convs.agg(F.sum("size")).first()[0] or 0) / SHARD))
    rows = rows.join(_dense(rows), "digest").select("conv_id", "pos", "tid", "words")
    part = F.array_sort(F.collect_list(F.struct("pos", "tid", "words")))
    segments = rows.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("level")).agg(part.alias("part"))
    segments = segments.select("conv_id", "level", F.col("part.tid").alias("tids"), F.col("part.words").alias("words"))
    segments = materialise(segments.withColumn("key", F.sha2(F.array_join("tids", ","), 256)), "segments")
    last = materialise(segments.groupBy("conv_id").agg(F.max("level").alias("last")), "last")
    levels = (last.agg(F.max("last")).first()[0] or 0) + 1 if not last.isEmpty() else 0

    roots, levels_found, ends = convs.select("conv_id", F.lit(0).cast("long").alias("root")), [], []
    for level in range(levels):
        own = segments.where(F.col("level") == level).join(roots, "conv_id").join(last, "conv_id").withColumn("on", (F.col("last") > level).cast("int"))
        classes = own.groupBy("root", "key").agg(F.first("tids").alias("tids"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.max("on").alias("on"))
        dealt = classes.repartitionByRange(shards, "root", "tids").withColumn("shard", F.spark_partition_id())
        classes = materialise(dealt.withColumn("cid", F.monotonically_increasing_id()), "classes")
        ties = _ties(classes)

        found = materialise(classes.drop("key").groupBy("shard").applyInArrow(_walker(level, ties), FOUND), "nodes")
        at = classes.select("root", "key", "cid").join(found.where("cid >= 0").select("cid", "gid"), "cid").drop("cid")
        own = materialise(own.join(at, ["root", "key"]).select("conv_id", "gid", "on"), "at")
        roots = own.where("on = 1").select("conv_id", F.col("gid").alias("root"))
        ends.append(own.where("on = 0").select("conv_id", "gid"))
        sums = [F.sum(k).alias(k) for k in ("n", "leaves", "saved", "children")]
        nodes = found.where("cid < 0 and not shared").select("gid", "parent", "depth", "conv", "n", "leaves", "saved", "children")
        merged = found.where("cid < 0 and shared").groupBy("gid", "parent", "depth").agg(F.min("conv").alias("conv"), *sums)
        levels_found.append((materialise(nodes.union(merged.select(nodes.columns)).withColumn("depth", F.col("depth") + level * segment), "level"), found.where("size(path) > 0").select("gid", "path")))

    # what the roots of deeper levels found goes to all nodes above them
    whole, below = None, None
    for nodes, paths in reversed(levels_found):
        if below is not None:
            over = paths.join(below, "gid").select("gid", F.explode("path").alias("node"), "leaves", "saved", "children")
            more = over.groupBy("node").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.sum(F.when(F.col("gid") == F.col("node"), F.col("children"))).alias("c"))
            more = {"leaves": "l", "saved": "s", "children": "c"}, more
            nodes = nodes.join(more[1], F.col("gid") == F.col("node"), "left").select("gid", "parent", "depth", "conv", "n", *[(F.col(k) + F.coalesce(v, F.lit(0))).alias(k) for k, v in more[0].items()])
            nodes = materialise(nodes, "level")
        below = materialise(nodes.where(nodes["parent"] >= 0).groupBy(F.col("parent").alias("gid")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children")), "below")
        whole = nodes if whole is None else whole.union(nodes)
    top = convs.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n")).where("n > 0").withColumn("gid", F.lit(0).cast("long"))
    if below is None:
        below = convs.limit(0).select(F.lit(0).cast("long").alias("gid"), *[F.lit(0).cast("long").alias(k) for k in ("leaves", "saved", "children")])
    zero = F.lit(0).cast("long")
    top = top.join(below, "gid", "left").select("gid", F.lit(None).cast("long").alias("parent"), zero.alias("depth"), "conv", "n", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", zero).alias("saved"), F.coalesce("children", zero).alias("children"))
    whole = materialise(top if whole is None else top.union(whole), "trie")

    without = convs.join(last, "conv_id", "left_anti").select("conv_id", zero.alias("gid"))
    for e in ends:
        without = without.union(e)
    told = whole.join(_digests(without), "gid", "left").join(whole.select(F.col("gid").alias("up"), F.col("conv").alias("parent_conv_id")), F.col("parent") == F.col("up"), "left")
    return told.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
