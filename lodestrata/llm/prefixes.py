"""A trie of conversation prefixes, in shards of succinct level-order tries.

Every turn is two hashes of its role and text, chained from the first turn on,
so that a hash names a whole prefix. Equal conversations become one path with
their number. Paths are dealt to shards by the first of their prefixes that
few turns lie under; prefixes with more are the upper levels, which are found
level by level and merged by themselves. Every shard is one trie in numpy: its
nodes stand in level order, the degrees are a LOUDS bit vector (a one for each
child, then a zero), the labels an array beside it. A node's place gives its
children by selecting zeros, and its parent by ranking ones; members, leaves
and saved tokens are added up level by level in reverse.

What ends at a node is one digest over the sorted ids of all conversations that
end there. Ids are sorted over all machines, written into pieces where they
lie, and a node's pieces go through the digest one after the other.

Defined results: rows without a conv_id belong to no conversation and are left
out; turns are ordered by turn (null first), ties by role and text; null roles
and texts are empty; repeated rows are turns of their own; other columns are
not read. An empty table has no nodes, not even the root, which would have no
member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import Scratch
from lodestrata.llm.shingles import U, _powers, mixed

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of different paths in one shard, about; a prefix with more, in several paths, belongs to the upper levels.
SHARD_TURNS = 1 << 19
#: Ids in one piece of a digest.
PIECE = 4096
ROOT = 0  # both hashes of the root
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "a long, b long, depth long, pa long, pb long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
PATH = "array<struct<a: long, b: long, w: long>>"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (a, b, w)): two hashes of each turn and its words, in order."""
    filled = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = filled.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    turn = F.struct("at", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("turn"), "text", "role").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("w"))
    listed = ordered.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["w"].alias("w"))).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation with its first h turns taken from the first
    conversation of its group; h is its id's crc32 modulo ``most``."""
    base = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int")
    met = convs.withColumn("h", h).withColumn("base_id", F.col("conv_id") - F.col("conv_id") % group).join(base, "base_id", "left")
    head = F.slice(F.coalesce("head", F.array().cast(PATH)), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns' hashes summed up under powers of a base, so that each names
    the prefix that ends there."""
    for batch in batches:
        turns = batch.column("turns")
        edges, flat = np.asarray(turns.offsets).astype(np.int64), turns.flatten()
        edges -= edges[0]
        start = np.repeat(edges[:-1], np.diff(edges))
        up, down = _powers(1 << max(20, len(flat).bit_length()))
        names = []
        for c in ("a", "b"):
            total = np.cumsum(mixed(np.asarray(flat.field(c)).view(U)) * up[: len(flat)], dtype=U)
            before = np.concatenate([np.zeros(1, U), total])[start]
            names.append(pa.array(mixed((total - before) * down[start]).view(np.int64)))
        path = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([*names, flat.field("w")], ["a", "b", "w"]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), path], ["conv_id", "path"])


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of keys: where each distinct row stands first, in order, and each row's number among them."""
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def louds(parent: np.ndarray, tops: int) -> np.ndarray:
    """The bit vector of a forest in level order: of each node's children, the
    tops being children of one node above, a one each and then a zero.
    ``parent`` counts from 0, and is -1 for tops."""
    degree = np.bincount(parent[parent >= 0], minlength=len(parent))
    size = np.concatenate([[tops], degree]) + 1
    bits = np.ones(int(size.sum()), bool)
    bits[np.cumsum(size) - 1] = False
    return bits


class LevelTrie:
    """Paths with their numbers as a forest in level order. ``edges`` are the
    borders of the paths in ``a``, ``b`` and ``w``."""

    def __init__(self, edges: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, n: np.ndarray, least: np.ndarray, depth: np.ndarray):
        names, words, parents, levels, members, lowest, deep = [], [], [], [], [], [], []
        size, row, up, begun = np.diff(edges), np.arange(len(n)), np.full(len(n), -1), 0
        d = 0
        while len(row := row[size[row] > d]):
            at = edges[row] + d
            first, node = _numbered(up[row], a[at], b[at])
            names.append(at[first])
            parents.append(up[row][first])
            words.append(w[at[first]])
            deep.append(depth[row][first] + d)
            count, low = np.zeros(len(first), np.int64), np.full(len(first), np.iinfo(np.int64).max)
            np.add.at(count, node, n[row])
            np.minimum.at(low, node, least[row])
            members.append(count)
            lowest.append(low)
            levels.append((begun, begun + len(first)))
            up[row] = begun + node
            begun += len(first)
            d += 1
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.label, parent, self.words, self.members, self.least, self.depth = join(names), join(parents), join(words), join(members), join(lowest), join(deep)
        self.levels = levels
        self.bits = louds(parent, levels[0][1] if levels else 0)
        self.zeros = np.flatnonzero(~self.bits)  # select of zeros

    def degrees(self) -> np.ndarray:
        """Children of every node: the ones between two zeros."""
        return np.diff(self.zeros) - 1

    def parents(self) -> np.ndarray:
        """The k-th one stands in the block of the k-th node's parent, -1 for tops."""
        ones = np.flatnonzero(self.bits)
        return np.searchsorted(self.zeros, ones) - 1

    def rollups(self, leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over every subtree, added to the parents level by level in reverse."""
        parent, leaves, saved = self.parents(), leaves.copy(), saved.copy()
        for first, last in reversed(self.levels[1:]):
            np.add.at(leaves, parent[first:last], leaves[first:last])
            np.add.at(saved, parent[first:last], saved[first:last])
        return leaves, saved


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of a shard; ``cut`` is how many prefixes of a path lie above it."""
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [_no_paths()])
    if not table.num_rows:
        return
    paths = table.column("path").combine_chunks()
    edges = np.asarray(paths.offsets).astype(np.int64)
    edges -= edges[0]
    a, b, w = (np.asarray(paths.flatten().field(c)) for c in ("a", "b", "w"))
    n, least, cut, pa_, pb = (np.asarray(table.column(c).combine_chunks()) for c in ("n", "conv_id", "cut", "pa", "pb"))
    trie = LevelTrie(edges, a, b, w, n, least, cut + 1)
    degree, parent, at = trie.degrees(), trie.parents(), trie.label
    leaves, saved = trie.rollups((degree == 0).astype(np.int64), (trie.members - 1) * trie.words)
    inner, top = parent >= 0, parent < 0
    up_a, up_b = np.where(inner, a[at[parent]], 0), np.where(inner, b[at[parent]], 0)
    row = np.searchsorted(edges, at[top], "right") - 1  # the tops' own paths know what lies above
    up_a[top], up_b[top] = pa_[row], pb[row]
    columns = [a[at], b[at], trie.depth, up_a, up_b, trie.least, trie.members, degree, leaves, saved]
    names = [c.split()[0] for c in NODE.split(", ")]
    above = pa.array(np.where(inner, trie.least[parent], 0), mask=top)
    whole = pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns] + [above, pa.array(top)], [*names, "parent_conv_id", "top"])
    for k in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(k, 1 << 16)


def _no_paths() -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())]))
    return pa.RecordBatch.from_pydict({"path": pa.array([], kind)} | {c: pa.array([], pa.int64()) for c in ("n", "conv_id", "cut", "pa", "pb")})


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper levels, of the root and the prefixes with many turns, each with
    what lies directly under it in shards; one task, as they are few."""
    table = pa.Table.from_batches([b for b in batches if b.num_rows])
    col = {c: np.asarray(table.column(c).combine_chunks()) for c in table.column_names}
    order = np.argsort(col["depth"], kind="stable")
    col = {c: v[order] for c, v in col.items()}
    place = {(x, y): i for i, (x, y) in enumerate(zip(col["a"].tolist(), col["b"].tolist(), strict=True))}
    parent = np.array([place.get(k, -1) for k in zip(col["pa"].tolist(), col["pb"].tolist(), strict=True)])
    parent[0] = -1  # the root
    own = col["children"].copy()
    np.add.at(own, parent[1:], 1)
    leaves, saved = col["leaves"] + (own == 0), col["saved"] + (col["n_convs"] - 1) * col["w"]
    border = [*(np.flatnonzero(np.diff(col["depth"])) + 1), len(parent)]
    for first, last in reversed([*zip(border[:-1], border[1:], strict=True)]):
        np.add.at(leaves, parent[first:last], leaves[first:last])
        np.add.at(saved, parent[first:last], saved[first:last])
    columns = [col["a"], col["b"], col["depth"], col["pa"], col["pb"], col["conv_id"], col["n_convs"], own, leaves, saved]
    above = pa.array(np.where(parent >= 0, col["conv_id"][parent], 0), mask=parent < 0)
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns] + [above], [*[c.split()[0] for c in NODE.split(", ")], "parent_conv_id"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ids sorted by node, (node, first id, ids joined by commas) of PIECE ids at most."""
    for batch in batches:
        a, b, conv = (np.asarray(batch.column(c)) for c in ("a", "b", "conv_id"))
        border = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        runs = np.unique(np.concatenate([[0], border, np.arange(0, len(a), PIECE)])) if len(a) else np.zeros(0, np.int64)
        text = [",".join(map(str, conv[x:y].tolist())) for x, y in zip(runs, [*runs[1:], len(a)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a[runs]), pa.array(b[runs]), pa.array(conv[runs]), pa.array(text, pa.string())], ["a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every node from its pieces in order, holding one at a time."""
    now, digest = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for a, b, ids in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (a, b) == now:
                digest.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, digest.hexdigest()))
            now, digest = (a, b), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_pydict({"a": [now[0]], "b": [now[1]], "ends_sha256": [digest.hexdigest()]})


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, conv_id)."""
    pieces = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_pieces, "a long, b long, first long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every prefix of conversations (conv_id, turns) with its members:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), conv_id being the smallest member."""
    scratch = Scratch(convs.sparkSession)
    paths = scratch.keep(convs.select("conv_id", "turns").mapInArrow(_chained, f"conv_id long, path {PATH}"))
    last = F.get("path", F.size("path") - 1)
    root = F.lit(ROOT).cast("long")
    ends = scratch.keep(end_digests(paths.select(F.coalesce(last["a"], root).alias("a"), F.coalesce(last["b"], root).alias("b"), "conv_id")))
    each = scratch.keep(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")))
    scratch.drop(paths)

    # the upper levels: prefixes that many turns lie under, from the root down
    seen = each.agg(F.sum("n"), F.min("conv_id"), F.sum(F.size("path"))).first()
    upper = convs.sparkSession.createDataFrame([(ROOT, ROOT, 0, ROOT, ROOT, 0, *seen[:2])] if seen[0] else [], "a long, b long, depth long, pa long, pb long, w long, n_convs long, conv_id long")
    rest, dealt, depth = each.select("path", "n", "conv_id", root.alias("pa"), root.alias("pb")), [], 0
    while seen[0]:
        here = F.get("path", F.lit(depth))
        named = rest.where(F.size("path") > depth).select("*", here["a"].alias("a"), here["b"].alias("b"), here["w"].alias("w"))
        heavy = named.groupBy("a", "b", "pa", "pb", "w").agg(F.sum(F.size("path") - depth).alias("turns"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("paths")).where((F.col("turns") > shard_turns) & (F.col("paths") > 1))
        heavy = scratch.keep(heavy.select("a", "b", F.lit(depth + 1).cast("long").alias("depth"), "pa", "pb", "w", "n_convs", F.col("least").alias("conv_id")))
        if heavy.isEmpty():
            dealt.append(named.select("path", "n", "conv_id", F.lit(depth).cast("long").alias("cut"), "pa", "pb", "a", "b"))
            break
        # at most all turns / shard_turns prefixes of a level are heavy
        mark = F.broadcast(heavy.select("a", "b", F.lit(True).alias("heavy")))
        met = named.join(mark, ["a", "b"], "left")
        dealt.append(met.where("heavy is null").select("path", "n", "conv_id", F.lit(depth).cast("long").alias("cut"), "pa", "pb", "a", "b"))
        rest = scratch.keep(met.where("heavy").select("path", "n", "conv_id", F.col("a").alias("pa"), F.col("b").alias("pb")))
        upper = upper.unionByName(heavy)
        depth += 1

    names = [c.split()[0] for c in NODE.split(", ")]
    if dealt:
        light = dealt[0]
        for d in dealt[1:]:
            light = light.unionByName(d)
        shards = max(1, -(-(seen[2] or 0) // shard_turns))
        light = light.select(F.slice("path", F.col("cut").cast("int") + 1, F.size("path")).alias("path"), "n", "conv_id", "cut", "pa", "pb", "a", "b")
        nodes = scratch.keep(light.repartition(shards, "a", "b").mapInArrow(_shards, f"{NODE}, parent_conv_id long, top boolean"))
        under = nodes.where("top").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        tops = upper.join(under, ["a", "b"], "left").select("a", "b", "depth", "pa", "pb", "w", "n_convs", "conv_id", zero("children"), zero("leaves"), zero("saved"))
        tops = scratch.keep(tops.repartition(1).mapInArrow(_upper, f"{NODE}, parent_conv_id long"))
        named = tops.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
        inner = nodes.where("not top").select(*names, "parent_conv_id")
        outer = nodes.where("top").drop("parent_conv_id").join(named, ["pa", "pb"]).select(*names, F.col("above").alias("parent_conv_id"))
        nodes = inner.unionByName(outer).unionByName(tops)
    else:
        nodes = convs.sparkSession.createDataFrame([], f"{NODE}, parent_conv_id long")
    out = nodes.join(ends, ["a", "b"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return scratch.only(out)
