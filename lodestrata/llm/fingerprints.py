r"""Document fingerprints by invertible Bloom lookup sketches, DataFrame
functions only.

A text's paragraphs are its lines, cut into runs of ``w`` code points; ``w`` is
a power of two that follows the length of the text, so that short texts have
several paragraphs too. Each paragraph's digest, which carries a check of its
own bits, goes into three cells, one in each third of the sketch, by exclusive
or. Two sketches subtract cell by cell: equal paragraphs cancel out. Peeling
then takes digests out of cells that hold one alone until none is left, which
recovers the digests that only one side has. When cells are left over, both
sides are sketched again ``GROWTH`` times larger and with other hashes, at most
``TRIES`` times; after that the digests themselves are compared. Likeness is
shared / all paragraphs, where the shared ones are known from the two set sizes
and the recovered differences, which come back too.

A sketch is filled by sorting what goes into it by cell, so its cost is that of
a sort, whatever the number of paragraphs.

The fingerprint is the sketch of ``BASE_CELLS`` cells itself: the number of
paragraphs, their width, and the cells in base 64. Fingerprints of one width
subtract.

Defined results: a null text is empty, and two texts without paragraphs are
alike (1.0); repeated paragraphs count once; the next document is the one with
the next smaller id (equal ids by a hash of the text), of the last the first,
and a single document is followed by itself; null ids come last; an empty
table gives no rows; other columns are left out, whatever their names. Very long
texts are taken whole; their digests are an array in one row. Documents meet
their next one in buckets of neighbouring ids, each bucket with the first row of
the following one, so nothing is ordered in one task; an id that many rows share
(or null) has buckets of its own, by the hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import partitions

BASE_CELLS = 24
GROWTH = 2
TRIES = 4
ROUNDS = 60
#: Code points of a paragraph at most: the least of these that cuts a text into PARTS.
PARTS = 16
WIDTHS = (16, 32, 64, 128, 256, 512, 1024, 2048)
#: Bits of a digest that are a check of the others.
CHECK_BITS = 20
#: Bucket borders are sent to the tasks up to this number; more are met by a join.
MOST_SENT = 100_000


def width_of(chars: Column) -> Column:
    """The width for a text of so many code points."""
    out = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        out = F.when(chars <= w * PARTS, w).otherwise(out)
    return out


def _checked(high: Column) -> Column:
    """A digest: 44 bits and their check."""
    high = F.shiftleft(F.shiftrightunsigned(high, CHECK_BITS), CHECK_BITS)
    return high.bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit((1 << CHECK_BITS) - 1)))


def _holds_one(cell: Column) -> Column:
    return (cell != 0) & (_checked(cell) == cell)


def digests_of(text: Column, width: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    found = F.regexp_extract_all(text, F.concat(F.lit(r"[^\n]{1,"), width, F.lit("}")), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: _checked(F.xxhash64(p))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch_of(digests: Column, cells: Column, salt: Column) -> Column:
    """The cells, each the exclusive or of the digests that go there. What goes
    where is sorted as numbers of cell, mark and place in ``digests``; before
    those of a cell stands one without the mark."""
    return _let(F.floor(cells / 3).cast("long"), lambda third: _sketch(digests, cells, third, salt))


def _sketch(digests: Column, cells: Column, third: Column, salt: Column) -> Column:
    low = F.lit((1 << 32) - 1)
    spot = lambda h, i, j: F.shiftleft(F.pmod(F.shiftright(h, 20 * i), third) + third * i, 33).bitwiseOR(F.lit(1 << 32)).bitwiseOR(j.cast("long"))
    spots = F.transform(digests, lambda d, j: _let(F.xxhash64(d, salt), lambda h: F.array(*(spot(h, i, j) for i in range(3)))))
    borders = F.transform(F.sequence(F.lit(0).cast("long"), cells.cast("long") - 1), lambda c: F.shiftleft(c, 33))

    def filled(keys: Column, starts: Column) -> Column:
        held = lambda at, c: F.slice(keys, at + 2, F.coalesce(F.get(starts, c + 1), F.size(keys)) - at - 1)
        return F.transform(starts, lambda at, c: F.aggregate(held(at, c), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get(digests, k.bitwiseAND(low).cast("int")))))

    first = lambda keys: F.filter(F.transform(keys, lambda k, i: F.when(F.shiftright(k, 32).bitwiseAND(F.lit(1)) == 0, i)), lambda i: i.isNotNull())
    return _let(F.sort_array(F.concat(borders, F.flatten(spots))), lambda keys: _let(first(keys), lambda starts: filled(keys, starts)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def peeled(sketch: Column, cells: Column, salt: Column) -> Column:
    """(apart, done): the digests that one side alone has, and whether all
    cells came out empty. Every round takes out the digests of all cells that
    hold one alone."""
    none = F.array().cast("array<bigint>")

    def taken(state: Column, alone: Column) -> Column:
        rest = F.when(F.size(alone) == 0, state["s"]).otherwise(subtracted(state["s"], sketch_of(alone, cells, salt)))
        return F.struct(rest.alias("s"), F.concat(state["apart"], alone).alias("apart"), (F.size(alone) == 0).alias("stuck"))

    start = F.struct(sketch.alias("s"), none.alias("apart"), F.lit(False).alias("stuck"))
    step = lambda state, _: F.when(state["stuck"], state).otherwise(_let(F.array_distinct(F.filter(state["s"], _holds_one)), lambda alone: taken(state, alone)))
    end = lambda state: F.struct(state["apart"].alias("apart"), F.forall(state["s"], lambda v: v == 0).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, end)


def apart(a: Column, b: Column) -> Column:
    """The digests that only one of two arrays has, by sketches that grow until
    they peel, at last by comparison."""
    both = F.size(a) + F.size(b)
    # least digests that agree tell alike texts, whose differences need fewer cells
    alike = (F.array_min(a) == F.array_min(b)) | (F.array_max(a) == F.array_max(b))
    least = F.greatest(F.lit(BASE_CELLS), 3 * F.ceil(both * F.when(alike, 0.35).otherwise(0.65))).cast("int")

    def tried(i: Column) -> Column:
        return _let((least * F.pow(F.lit(GROWTH), i)).cast("int"), lambda cells: attempt(cells, i))

    def attempt(cells: Column, i: Column) -> Column:
        found = peeled(subtracted(sketch_of(a, cells, i), sketch_of(b, cells, i)), cells, i)
        # what was recovered must belong to the sides, each to one
        known = lambda x: F.size(F.array_intersect(x["apart"], a)) + F.size(F.array_intersect(x["apart"], b)) == F.size(x["apart"])
        return _let(found, lambda x: F.struct(x["apart"].alias("apart"), (x["done"] & known(x)).alias("done")))

    start = F.struct(F.array().cast("array<bigint>").alias("apart"), F.lit(False).alias("done"))
    step = lambda state, i: F.when(state["done"], state).otherwise(tried(i))
    compared = lambda: F.concat(F.array_except(a, b), F.array_except(b, a))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), start, step, lambda state: F.when(state["done"], state["apart"]).otherwise(compared()))


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Shared / all of two digest arrays, from the number that they do not share."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - F.size(differ)) / (both + F.size(differ)))


def fingerprint(digests: Column, width: Column) -> Column:
    sketch = sketch_of(digests, F.lit(BASE_CELLS), F.lit(0))
    cells = F.unhex(F.array_join(F.transform(sketch, lambda v: F.lpad(F.hex(v), 16, "0")), ""))
    return F.concat_ws(":", F.size(digests), width, F.base64(cells))


def with_next(docs: DataFrame, *, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): the document of the next smaller id, of the
    smallest that of the largest."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or max(16, 4 * partitions(spark))
    # bucket borders follow the session's partitions; an id that is several borders has as many buckets
    seen = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    found = sorted(seen.q or [])
    cuts = sorted(set(found))
    copies = [found.count(c) if len(cuts) < len(found) else 1 for c in cuts]
    # two steps find the bucket: the group of borders, then the border
    side = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    longs = lambda x: F.array(*[F.lit(c).cast("long") for c in x])
    below = lambda borders: F.size(F.filter(borders, lambda c: c <= F.col("doc_id")))
    place = F.lit(0)
    if cuts:
        coarse = below(longs([g[0] for g in groups]))
        place = F.when(coarse > 0, (coarse - 1) * side + below(F.get(F.array(*map(longs, groups)), coarse - 1))).otherwise(0)
    # the upper half of the hash, in order, as a share of the buckets of one id
    share = lambda m: F.shiftright(F.shiftrightunsigned("tie", 32).bitwiseXOR(F.lit(1 << 31)) * m, 32)
    keyed = rows.withColumns({"tie": F.xxhash64("text"), "place": F.when(F.col("doc_id").isNotNull(), place)})
    part = F.lit(0).cast("long")
    if len(cuts) < len(found):
        own = F.get(longs(cuts), F.col("place") - 1) == F.col("doc_id")
        part = F.when(own, 1 + share(F.get(longs(copies), F.col("place") - 1))).otherwise(0)
    nulls = max(1, -(-(seen.n - seen.known) * n // max(1, seen.n)))
    # buckets from the largest ids on; null ids come after the others
    number = F.when(F.col("place").isNull(), F.lit((len(cuts) + 1) << 24) + share(F.lit(nulls))).otherwise(F.shiftleft((len(cuts) - F.col("place")).cast("long"), 24) + part)
    keyed = keyed.withColumn("bucket", number).drop("place")
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    # the first row of each bucket, and the bucket before it: of the first, the last
    rank = F.coalesce(-F.col("doc_id"), F.lit(0))
    heads = keyed.groupBy("bucket").agg(F.max(F.col("doc_id").isNotNull()).alias("known"), F.min(F.struct(F.when(F.col("doc_id").isNotNull(), rank).alias("a"), F.col("tie").alias("b"))).alias("head"))
    ordered = Window.orderBy("bucket")
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(ordered), F.max("bucket").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = heads.select(F.col("bucket").alias("b"), "head", "before")
    marked = keyed.join(F.broadcast(heads) if len(found) + nulls <= MOST_SENT else heads, F.col("bucket") == F.col("b"))
    is_head = F.col("head.a").eqNullSafe(F.when(F.col("doc_id").isNotNull(), rank)) & (F.col("head.b") == F.col("tie"))
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("lent"))
    lent = F.struct(F.col("before").alias("b"), F.lit(True).alias("lent"))
    spread = marked.withColumn("at", F.explode(F.when(is_head, F.array(own, lent)).otherwise(F.array(own))))
    spread = spread.select("doc_id", "text", "tie", F.col("at.b").alias("bucket"), F.col("at.lent").alias("lent"))
    # a lent row stands last in the bucket that it closes; of equal first rows any closes it alike
    window = Window.partitionBy("bucket").orderBy("lent", *order)
    return spread.withColumn("next_text", F.lead("text").over(window)).where("not lent").select("doc_id", "text", "next_text")


def version_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and its edited text, their likeness, and
    the digests of the paragraphs that only one of the two versions has."""
    n = F.length("text")
    rows = with_next(docs).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 3).cast("int"))))
    # widths are columns of their own, so that each text is measured once
    lengths = {f"n_{c}": F.length(c) for c in ("text", "edited", "next_text")}
    rows = rows.withColumns(lengths)
    rows = rows.withColumns({"w": width_of(F.col("n_text")), "w_edited": width_of(F.col("n_edited")), "w_e": width_of(F.greatest("n_text", "n_edited")), "w_n": width_of(F.greatest("n_text", "n_next_text"))})
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "w", "w_edited",
        digests_of(F.col("text"), F.col("w")).alias("own"), digests_of(F.col("edited"), F.col("w_edited")).alias("changed"),
        # a pair is compared at the width of its longer side
        F.when(F.col("w") != F.col("w_e"), digests_of(F.col("text"), F.col("w_e"))).alias("own_e"),
        F.when(F.col("w_edited") != F.col("w_e"), digests_of(F.col("edited"), F.col("w_e"))).alias("changed_e"),
        F.when(F.col("w") != F.col("w_n"), digests_of(F.col("text"), F.col("w_n"))).alias("own_n"),
        digests_of(F.col("next_text"), F.col("w_n")).alias("next_n"),
    )
    # both comparisons go through one expression
    pairs = F.array(F.struct(F.coalesce("own_e", "own").alias("a"), F.coalesce("changed_e", "changed").alias("b")), F.struct(F.coalesce("own_n", "own").alias("a"), F.col("next_n").alias("b")))
    near = F.transform(pairs, lambda p: _let(apart(p["a"], p["b"]), lambda x: F.struct(x.alias("apart"), likeness(p["a"], p["b"], x).alias("near"))))
    prints = F.transform(F.array(F.struct(F.col("own").alias("d"), F.col("w").alias("w")), F.struct(F.col("changed").alias("d"), F.col("w_edited").alias("w"))), lambda x: fingerprint(x["d"], x["w"]))
    rows = rows.withColumns({"near": near, "prints": prints})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.get("prints", F.lit(0)).alias("fingerprint"), F.get("prints", F.lit(1)).alias("edited_fingerprint"),
        F.get("near.near", F.lit(0)).alias("near_edited"), F.get("near.near", F.lit(1)).alias("near_next"), F.array_sort(F.get("near.apart", F.lit(0))).alias("edited_digests"),
    )
