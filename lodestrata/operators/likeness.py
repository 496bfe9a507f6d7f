"""Names within a few edits of each other, and quotes that a source holds word for word."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Characters of a run by which a quote meets its source.
GRAM = 6
#: Characters of a block of names, of each side, and pairs found in it that are held at once.
BLOCK_CHARS, BLOCK_PAIRS = 1 << 21, 1 << 23
#: Parts to which the names of a key are dealt where they learn the number of its blocks.
PARTS = 16


def _weights(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _spelled(names: list[str], size: int) -> np.ndarray:
    """The code points of names of one length, a row for each place."""
    if not size:
        return np.zeros((0, len(names)), dtype=np.uint64)
    return np.ascontiguousarray(np.array(names, dtype=f"U{size}").view(np.uint32).reshape(len(names), size).T.astype(np.uint64)) + np.uint64(1)


def _rests(spelled: np.ndarray, gone: tuple[int, ...], blank: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
    """A hash of what is left of each name without the places ``gone``, those at ``blank`` of the rest not looked at."""
    kept = np.delete(np.arange(len(spelled)), gone)
    total = np.zeros(spelled.shape[1], dtype=np.uint64)
    for at, place in enumerate(kept):
        if at not in blank:
            total += spelled[place] * weights[at]
    return total


def _ways(a: int, b: int, most: int) -> list[tuple[int, int, int]]:
    """How names of a and b characters can be ``most`` edits apart: characters
    deleted of the one and of the other, and places replaced in the rest."""
    ways = []
    for both in range((most - abs(a - b)) // 2 + 1):
        x, y = max(a - b, 0) + both, max(b - a, 0) + both
        if x <= a:
            ways.append((x, y, min(most - x - y, a - x)))
    return ways


def _once(codes: list[np.ndarray]) -> np.ndarray:
    together = np.concatenate(codes)
    together.sort()
    return together[np.flatnonzero(np.diff(together, prepend=-1))]


def _met(a: np.ndarray, b: np.ndarray, same: np.ndarray, most: int, limit: int) -> np.ndarray | None:
    """i * (names of b) + j of all names i and j within ``most`` edits, but for
    j = same[i]; none if they are more than ``limit``."""
    weights, n = _weights(max(len(a), len(b))), b.shape[1]
    codes, waiting = [np.zeros(0, dtype=np.int64)], 0
    for x, y, z in _ways(len(a), len(b), most):
        held, asks = ((b, y), (a, x)) if y <= x else ((a, x), (b, y))
        for blank in combinations(range(len(a) - x), z):
            for gone in combinations(range(len(held[0])), held[1]):
                rests = _rests(held[0], gone, blank, weights)
                order = np.argsort(rests)
                rests = rests[order]
                for other in combinations(range(len(asks[0])), asks[1]):
                    asked = _rests(asks[0], other, blank, weights)
                    askers = np.argsort(asked)  # sorted questions find their answers next to each other
                    asked = asked[askers]
                    first = np.searchsorted(rests, asked)
                    hits = np.flatnonzero(rests[np.minimum(first, len(rests) - 1)] == asked)
                    first = first[hits]
                    times = np.searchsorted(rests, asked[hits], "right") - first
                    if times.sum() > limit:
                        return None
                    who = np.repeat(askers[hits], times)
                    whom = order[np.arange(len(who)) + np.repeat(first - np.cumsum(times) + times, times)]
                    i, j = (who, whom) if y <= x else (whom, who)
                    found = (i * n + j)[j != same[i]]
                    codes.append(found)
                    waiting += len(found)
                    if waiting > limit:
                        codes = [_once(codes)]
                        waiting = len(codes[0])
                        if waiting > limit // 2:
                            return None
    return _once(codes)


def _near(a: np.ndarray, b: np.ndarray, same: np.ndarray, most: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i and j that may be within ``most`` edits, each once and all that are, in pieces of ``limit``."""
    m, n = a.shape[1], b.shape[1]
    steps = sum(comb(len(a) - x, z) * comb(len(a), x) * comb(len(b), y) for x, y, z in _ways(len(a), len(b), most))
    few = m * n <= steps * (50 + (m + n) / 10)  # a step takes as long as 50 pairs, and a tenth of one for each name
    codes = None if few else _met(a, b, same, most, limit)
    if codes is not None:
        yield np.divmod(codes, n)
    elif few or m * n <= limit:
        for start in range(0, m * n, limit):
            yield np.divmod(np.arange(start, min(start + limit, m * n)), n)
    elif m >= n:
        for part in (slice(0, m // 2), slice(m // 2, m)):
            for i, j in _near(a[:, part], b, same[part], most, limit):
                yield i + part.start, j
    else:
        for part in (slice(0, n // 2), slice(n // 2, n)):
            for i, j in _near(a, b[:, part], same - part.start, most, limit):
                yield i, j + part.start


def _near_in(keys: list[str], most: int, limit: int, rows: int = 1 << 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def near_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).combine_chunks()
        sides = []
        for right in (False, True):
            names = group.column("name").filter(pc.equal(group.column("right_"), right)).combine_chunks()
            sizes = pc.utf8_length(names).to_numpy(zero_copy_only=False)
            sides.append({int(size): names.take(pa.array(np.flatnonzero(sizes == size))) for size in np.unique(sizes)})
        for size, names in sides[0].items():
            for other in range(size - most, size + most + 1):
                if other not in sides[1]:
                    continue
                others = sides[1][other]
                same = pc.index_in(names, others).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                same[same < 0] = np.iinfo(np.int64).min // 2
                for i, j in _near(_spelled(names.to_pylist(), size), _spelled(others.to_pylist(), other), same, most, limit):
                    for at in range(0, len(i), rows):
                        x, y = i[at : at + rows], j[at : at + rows]
                        key = pa.array(np.zeros(len(x), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([*(group.column(k).combine_chunks().take(key) for k in keys), names.take(pa.array(x)), others.take(pa.array(y))], [*keys, "name", "other"])

    return near_in


def near_names(left: DataFrame, right: DataFrame, keys: list[str], most: int = 1, chars: int = BLOCK_CHARS, limit: int = BLOCK_PAIRS) -> DataFrame:
    """(keys, name, other, edits): names of ``left`` within ``most`` insertions,
    deletions and replacements of a name of ``right`` (both keys, name), equal
    ones left out. Each name counts once; nulls meet nothing.

    Two such names are the same once some characters are deleted of each and some
    places of the rests are blanked, ``most`` of all together. A name has hundreds
    of such forms, so they are never rows: the names of a key are dealt to blocks
    of about ``chars`` characters, each block of one side meets each of the other
    in one task, and there the hashes of one way to delete and blank after another
    are sorted and searched. A pair is found in one task only; the distance is
    then computed."""
    own = lambda d, side: d.select(*keys, "name").where(F.col("name").isNotNull()).distinct().withColumn("right_", F.lit(side))
    names = own(left, False).unionByName(own(right, True))
    size = lambda side: F.sum(F.when(F.col("right_") == side, F.char_length("name") + 1))
    blocks = names.groupBy(*keys).agg(F.ceil(size(False) / chars).cast("int").alias("lefts_"), F.ceil(size(True) / chars).cast("int").alias("rights_")).where("lefts_ > 0 and rights_ > 0")
    # a key's names are dealt to parts, so that no task has all of them
    blocks = blocks.withColumnsRenamed({k: f"{k}_of_" for k in keys}).withColumn("part_of_", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    names = names.withColumn("part_", F.pmod(F.hash("name"), F.lit(PARTS)))
    on = F.col("part_") == F.col("part_of_")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    mine, theirs = F.when(F.col("right_"), F.col("rights_")).otherwise(F.col("lefts_")), F.when(F.col("right_"), F.col("lefts_")).otherwise(F.col("rights_"))
    dealt = names.join(blocks.hint("merge"), on).withColumn("mine_", F.pmod(F.xxhash64("name"), mine).cast("int")).withColumn("theirs_", F.explode(F.sequence(F.lit(0), theirs - 1)))
    i, j = F.when(F.col("right_"), F.col("theirs_")).otherwise(F.col("mine_")), F.when(F.col("right_"), F.col("mine_")).otherwise(F.col("theirs_"))
    dealt = dealt.select(*keys, i.alias("i_"), j.alias("j_"), "right_", "name")
    kept = [dealt.schema[k] for k in keys]
    # few blocks with much work in each: they are spread, not put together by their size
    dealt = dealt.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "i_", "j_")
    met = dealt.groupBy(*keys, "i_", "j_").applyInArrow(_near_in(keys, most, limit), StructType([*kept, StructField("name", StringType()), StructField("other", StringType())]))
    edits = F.levenshtein("name", "other", most)
    near = met.where((F.col("name") != F.col("other")) & (edits >= 0))
    return near.select(*(F.col(k).cast(left.schema[k].dataType) for k in keys), "name", "other", edits.cast("long").alias("edits"))


def plain(text: str) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def grams(rows: DataFrame, keys: list[str], text: str, k: int = GRAM) -> DataFrame:
    """(keys, at, gram): every run of k characters of a text without white space, and where it stands."""
    runs = F.regexp_extract_all(plain(text), F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    return rows.select(*keys, F.posexplode_outer(runs).alias("at", "gram")).where("gram is not null")


def held(k: int) -> Callable[..., Column]:
    """Of a text and some grams of k characters: where which of them stand in it."""

    def places(text: str, wanted: set[str]) -> list[dict]:
        return [{"s": i, "gram": text[i : i + k]} for i in range(len(text) - k + 1) if text[i : i + k] in wanted]

    @F.pandas_udf("array<struct<s: int, gram: string>>")
    def held_in(texts: pd.Series, grams: pd.Series) -> pd.Series:
        return pd.Series([places(t, set(g)) for t, g in zip(texts, grams, strict=True)], dtype=object)

    return held_in


def quote_support(quotes: DataFrame, sources: DataFrame, key: str, k: int = GRAM) -> DataFrame:
    """(quote_id, n_grams, found, longest): of each quote (quote_id, key,
    quote) how many of its runs of k characters stand in its source (key, text),
    and the longest stretch that stands there in one piece, in characters. White
    space does not count; shorter quotes are left out.

    A source meets all grams that quotes ask of it, and one pass over it gives
    the places of those only; a stretch is a run of neighbouring grams whose
    places in quote and source keep one distance. A gram that repeats in a source
    meets each of its places, as it may belong to any stretch there.
    """
    asked = grams(quotes, ["quote_id", key], "quote", k).withColumnRenamed("at", "q")
    total = asked.groupBy("quote_id").agg(F.count(F.lit(1)).alias("n_grams"))
    wanted = asked.groupBy(key).agg(F.collect_set("gram").alias("wanted_"))
    met_sources = sources.select(key, plain("text").alias("plain_")).join(wanted, key)
    index = met_sources.select(key, F.explode(held(k)("plain_", "wanted_")).alias("h")).select(key, "h.s", "h.gram")
    met = asked.join(index, [key, "gram"]).select("quote_id", "q", (F.col("s") - F.col("q")).alias("shift")).distinct()
    once = F.row_number().over(Window.partitionBy("quote_id", "q").orderBy("shift")) == 1
    step = F.row_number().over(Window.partitionBy("quote_id", "shift").orderBy("q"))
    runs = met.withColumn("once", once.cast("long")).withColumn("run", F.col("q") - step).groupBy("quote_id", "shift", "run").agg((F.count(F.lit(1)) + k - 1).alias("n"), F.sum("once").alias("once"))
    best = runs.groupBy("quote_id").agg(F.sum("once").alias("found"), F.max("n").alias("longest"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return total.join(best, "quote_id", "left").select("quote_id", "n_grams", zero("found"), zero("longest"))
