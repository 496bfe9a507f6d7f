"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its ``nearest`` closest reference points, in
order. Reference points are a bounded sample: of each vector length about twice
the square root of the number of vectors, within ``PIVOT_BYTES``, those that lie
first by a hash. Inverted lists hold, per reference point, the vectors that have
it among their closest; two vectors that share ``shared`` points or more are
candidates, and a candidate pair is verified by its cosine in double precision.

Points are numbered from the rarest on. Two vectors that share s of k points
meet at one of the first k - s + 1 of either, so the lists of the others are not
needed; a pair counts in the list of its first shared point only. Where lists
grow too long, they are kept per pair of points instead: the first two shared
points are among the first k - s + 2, and a pair counts in the list of these
two. Lists longer than ``block`` vectors are cut into blocks, and pairs of blocks
are dealt to separate groups: a group holds at most about two blocks, whatever
the size of a list, and no pair is dropped.

Equal vectors are one candidate with a weight. A list's block sends back, per
vector, its number of links and the smallest vector that its links reach there
(a spanning forest), never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components, and rows with a null id, link with nothing; vectors of
different length do not link; repeated rows are vectors of their own; rows of
one id with different vectors share a component; an empty table gives no rows;
other columns are left out, whatever their names. Very long vectors have fewer
reference points, by ``PIVOT_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.graph import components
from lodestrata.llm.scratch import Scratch, partitions

MIN_PIVOTS, PIVOT_BYTES = 32, 1 << 26
NEAREST, SHARED, BLOCK = 10, 4, 4096
#: Bits of a point's number in the key of a pair of points.
KEY_BITS = 24
#: Cosines computed at once.
AT_ONCE = 1 << 22


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision and without overflow."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists of numbers as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def forest(pairs_a: np.ndarray, pairs_b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each vector reaches through the pairs."""
    low = ids.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[pairs_a], low[pairs_b])
        np.minimum.at(low, pairs_a, least)
        np.minimum.at(low, pairs_b, least)
        if (low == before).all():
            return low


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            near: list = [None] * len(batch)
            for dim in np.unique(sizes):
                points = pivots[int(dim)].T
                k, every = min(nearest, points.shape[1]), np.flatnonzero(sizes == dim)
                step = max(1, AT_ONCE // points.shape[1])
                for at in (every[i : i + step] for i in range(0, len(every), step)):
                    cosines = unit(matrix(batch.column(2).take(pa.array(at)))) @ points
                    top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(cosines, top, 1), axis=1, kind="stable"), 1)
                    for i, row in zip(at, top.tolist(), strict=True):
                        near[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(near, pa.list_(pa.int32()))], ["rep", "weight", "e", "k1", "near"])

    return run


def _keyed(order: dict[int, np.ndarray], shared: int, together: int, whole: bool):
    """Each vector under its keys: the first of its points from the rarest on,
    or pairs of them. ``near`` becomes the points' numbers in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                near = np.sort(order[int(dim)][matrix(own.column(1))], axis=1)
                k = near.shape[1]
                sets = [*combinations(range(min(k, k - min(shared, k) + together)), min(together, k))]
                for places in sets:
                    key = near[:, places[0]].astype(np.int64)
                    for p in places[1:]:
                        key = (key << KEY_BITS) | near[:, p]
                    if not whole:
                        yield pa.RecordBatch.from_arrays([own.column(0), pa.array(key)], ["dim", "key"])
                        continue
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(key), pa.array([*near.astype(np.int32)], pa.list_(pa.int32())), *own.columns[2:]], ["dim", "key", "near", "rep", "weight", "e", "k1"])

    return run


def _links_of(least: float, shared: int, together: int):
    def run(table: pa.Table) -> pa.Table:
        """Links among the vectors of one block, or between two."""
        ids, weights = table["rep"].to_numpy(), table["weight"].to_numpy()
        side = table["side"].to_numpy()
        v, near, key = unit(matrix(table["e"])), matrix(table["near"]), table["key"][0].as_py()
        one_block = table["i"][0].as_py() == table["j"][0].as_py()
        known, slots = np.unique(near, return_inverse=True)
        slots = slots.reshape(near.shape)
        marks = np.zeros((len(ids), len(known)), np.float32)
        np.put_along_axis(marks, slots, 1, 1)
        mine = np.array([key >> KEY_BITS, key & ((1 << KEY_BITS) - 1)] if min(together, near.shape[1]) == 2 else [key])
        lower = marks[:, (known < mine[-1]) & ~np.isin(known, mine)]
        need = min(shared, near.shape[1])
        rows = np.arange(len(ids)) if one_block else np.flatnonzero(side == 0)
        cols = rows if one_block else np.flatnonzero(side == 1)
        found_a, found_b = [], []
        for at in range(0, len(rows), 512):
            r = rows[at : at + 512]
            hits = (marks[r] @ marks[cols].T >= need) & (lower[r] @ lower[cols].T == 0)
            a, b = np.nonzero(hits)
            a, b = r[a], cols[b]
            if one_block:
                a, b = a[a < b], b[a < b]
            for cut in range(0, len(a), 100_000):
                x, y = a[cut : cut + 100_000], b[cut : cut + 100_000]
                ok = np.einsum("ij,ij->i", v[x], v[y]) >= least
                found_a.append(x[ok])
                found_b.append(y[ok])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, weights[b])
        np.add.at(links, b, weights[a])
        hit = np.flatnonzero(links)
        return pa.table({"rep": ids[hit], "k1": table["k1"].to_numpy()[hit], "links": links[hit], "low": forest(a, b, ids)[hit]})

    return run


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK, together: int | None = None) -> DataFrame:
    """Per vector: (vec_id, n_links, component_id, kept). ``together`` is the
    number of points in a key, 1 or 2; by default what copies vectors less."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    e = F.col("e")
    usable = F.col("vec_id").isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.select("vec_id", "e", "usable", F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(1), "e").alias("k2"))
    reps = scratch.keep(rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("e").alias("e")))

    chosen = F.lit(False)
    for dim, n in reps.groupBy(F.size("e")).count().collect():
        points = min(max(MIN_PIVOTS, int(2 * n**0.5)), max(MIN_PIVOTS, PIVOT_BYTES // (8 * dim)))
        bound = min((1 << 63) - 1, points * (1 << 64) // n - (1 << 63))
        chosen = chosen | ((F.size("e") == dim) & (F.xxhash64("k1", F.lit(1)) <= F.lit(bound)))
    sample: dict[int, list] = {}
    for r in sorted(reps.where(chosen).select("e", "k1", "k2").collect(), key=lambda r: (r.k1, r.k2)):
        sample.setdefault(len(r.e), []).append(list(r.e))
    pivots = {d: unit(np.array(p)) for d, p in sample.items()}

    kind = reps.schema["e"].dataType.simpleString()
    described = reps.select("rep", "weight", "e", "k1").repartition(partitions(spark), "rep").mapInArrow(_describe(pivots, nearest), f"rep long, weight long, e {kind}, k1 long, near array<int>")
    described = scratch.keep(described.select(F.size("e").alias("dim"), "near", "rep", "weight", "e", "k1"))
    # one count for each reference point
    order, copies, total = {d: np.zeros(len(p), np.int64) for d, p in pivots.items()}, 0, 0
    for dim, pivot, n in described.select("dim", F.explode("near").alias("pivot")).groupBy("dim", "pivot").count().collect():
        order[dim][pivot] = n
        copies += n * -(-n // block)
        total += n
    order = {d: np.argsort(np.lexsort((np.arange(len(n)), n))) for d, n in order.items()}
    if together is None:
        together = 1 if copies * (nearest - shared + 1) <= total * comb(nearest - shared + 2, 2) else 2
    counts = described.select("dim", "near").mapInArrow(_keyed(order, shared, together, False), "dim int, key long").groupBy("dim", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n"))
    long = scratch.keep(counts.where("n > 1"))
    keyed = described.mapInArrow(_keyed(order, shared, together, True), f"dim int, key long, near array<int>, rep long, weight long, e {kind}, k1 long")
    if long.isEmpty():
        dealt = keyed.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    else:
        dealt = keyed.join(long, ["dim", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "weight"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("n", "own", "other")
    links = scratch.keep(dealt.groupBy("dim", "key", "i", "j").applyInArrow(_links_of(least, shared, together), "rep long, k1 long, links long, low long"))
    scratch.drop(described, long)

    counts = links.groupBy("rep", "k1").agg(F.sum("links").alias("links"))
    comps = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")), scratch)
    known = scratch.only(
        reps.select("k1", "k2", "rep", "weight")
        .join(counts, ["rep", "k1"], "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    joined = rows.drop("e").join(known, (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")) & F.col("usable"), "left")
    out = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
