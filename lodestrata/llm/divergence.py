"""Which terms set a source apart within its language, and how far sources diverge.

Counts are sparse: a group (lang, source) has a row for each term that it holds.
A term that a group lacks has the group's baseline value, so that for two
sources s and t, with the baselines s0 and t0 and the loss f,

    sum of f(s, t) over all kept terms = V f(s0, t0)
        + what s's own counts add against t0, by how many terms have each count
        + the same for t
        + over the terms that both hold: f(s, t) - f(s, t0) - f(s0, t) + f(s0, t0).

The first three parts need a group's histogram of counts only; the last visits
no term that either lacks.

The leading terms of a group are found by radix selection: histograms of the
values' digits, from the highest, tell each group's k-th largest value; among
terms that have that value the histograms go on over the bytes of the term.
Only what can still be in the list is ranked.

Defined results: null text, lang and source are ''; repeated rows and rows of
one id count each; other columns are not read; a text without terms leaves its
group with baselines only; a language without kept terms gives pairs of value 0
and no terms; ties rank by UTF-8 bytes. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import Scratch

#: What each byte of a text becomes: letters and bytes of other characters stay, A-Z are lowered, all else parts terms.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAST_DOCUMENTS, SCALE, TOP = 10, 1_000_000_000, 10
#: Bits of a digit; values are below 2^30, as f(p, q) is at most |p - q|.
DIGIT, VALUE_BITS = 10, 30
#: Bytes of a term that one histogram looks at.
STEP = 2
#: A group with so many candidates or fewer is ranked at once.
FEW = 1000
#: Pairs that are held at a time, and partial sums before they are sent on.
PAIRS = 1 << 20
#: Terms that a task counts before it sends its counts on.
HELD = 1 << 18


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [*n]
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = text.as_py().translate(BYTES).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from sent()
    yield from sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the
    term; counted where the texts lie, then summed up."""
    filled = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = filled.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2), wide(total) + 2 * wide(kept))


def loss(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _own_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a group with its histogram of counts and its language's baselines: the
    sum against a group that has each baseline and no terms."""
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            hist, bases = (batch.column(c).slice(row, 1).flatten() for c in ("hist", "bases"))
            p, terms = (np.asarray(hist.field(c)) for c in ("p", "terms"))
            other, own = np.asarray(bases), np.int64(batch.column("p0")[row].as_py())
            sums = np.zeros(len(other), np.int64)
            wide = max(1, PAIRS // max(1, len(p)))
            for a in range(0, len(other), wide):
                q = other[a : a + wide]
                sums[a : a + wide] = ((_f(p[:, None], q) - _f(own, q)) * terms[:, None]).sum(0)
            out.append(sums + np.int64(batch.column("v")[row].as_py()) * _f(own, other))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("sid"), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], ["lang", "sid", "sums"])


def _pairs(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within lists of these sizes that follow one another,
    so many at a time."""
    ends = np.repeat(np.cumsum(size), size)
    after = ends - np.arange(len(ends)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(after):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(at, stop), after[at:stop])
        yield i, i + 1 + np.arange(len(i)) - (total[i] - total[at])
        at = stop


def _shared_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For terms with the groups that hold them: corrections of pairs of groups
    (a < b). Of few groups a task holds all pairs' sums until it ends; of many
    it sends the sums of every block of pairs."""
    held: dict[str, np.ndarray] = {}

    def rows(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(value)], ["lang", "a", "b", "value"])

    for batch in batches:
        langs, lang_of = np.unique(np.asarray(batch.column("lang").to_pylist(), object), return_inverse=True)
        for k, lang in enumerate(langs):
            groups = batch.column("groups").take(pa.array(np.flatnonzero(lang_of == k)))
            size, flat = np.diff(np.asarray(groups.offsets)).astype(np.int64), groups.flatten()
            sid, p, p0 = (np.asarray(flat.field(c)).astype(np.int64) for c in ("sid", "p", "p0"))
            order = np.lexsort((sid, np.repeat(np.arange(len(size)), size)))
            sid, p, p0 = sid[order], p[order], p0[order]
            most = int(sid.max(initial=0)) + 1
            for i, j in _pairs(size):
                value = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
                if most * most > PAIRS:
                    key, at = np.unique(sid[i] << 32 | sid[j], return_inverse=True)
                    sums = np.zeros(len(key), np.int64)
                    np.add.at(sums, at, value)
                    yield rows(lang, key >> 32, key & 0xFFFFFFFF, sums)
                    continue
                mine = held.get(lang, np.zeros((0, 0), np.int64))
                if len(mine) < most:
                    held[lang] = np.pad(mine, (0, most - len(mine)))
                    mine = held[lang]
                np.add.at(mine, (sid[i], sid[j]), value)
    for lang, sums in held.items():
        a, b = np.nonzero(sums)
        yield rows(lang, a, b, sums[a, b])


def pair_divergences(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language. ``counts``
    has (lang, sid, term, n, p, p0), ``groups`` (lang, sid, source, p0, v)."""
    hist = counts.groupBy("lang", "sid", "p").agg(F.count(F.lit(1)).alias("terms")).groupBy("lang", "sid").agg(F.collect_list(F.struct("p", "terms")).alias("hist"))
    bases = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", "p0"))), lambda x: x["p0"]).alias("bases"))
    none = F.array().cast("array<struct<p: long, terms: long>>")
    own = groups.join(hist, ["lang", "sid"], "left").join(bases, "lang").select("lang", "sid", "p0", "v", F.coalesce("hist", none).alias("hist"), "bases")
    sums = own.mapInArrow(_own_parts, "lang string, sid int, sums array<long>").select("lang", F.col("sid").alias("a"), F.posexplode("sums").alias("b", "own")).where("a != b")
    shared = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("groups")).where(F.size("groups") > 1)
    shared = shared.select("lang", "groups").mapInArrow(_shared_parts, "lang string, a long, b long, value long").select("lang", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "value")
    flipped = lambda d, *rest: d.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), *rest)
    # V f(s0, t0) is in both own parts, and so is taken out of one
    parts = sums.select("lang", "a", "b", F.col("own").alias("value")).unionByName(flipped(sums, F.col("own").alias("value"))).unionByName(shared).unionByName(flipped(shared, "value"))
    base = lambda name: groups.select("lang", F.col("sid").alias(name), F.col("source").alias(f"{name}_source"), F.col("p0").alias(f"{name}_p"), "v" if name == "a" else F.lit(1))
    total = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = total.join(base("a"), ["lang", "a"]).join(base("b"), ["lang", "b"])
    return named.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), (F.col("value") - F.col("v") * loss(F.col("a_p"), F.col("b_p"))).alias("value"))


def _narrowed(rows: DataFrame, digit: Column, state: DataFrame, keys: list[str], few: int) -> DataFrame:
    """One histogram: of every group still open (keys, need, open), how many rows
    lie above the digit that holds the last one needed, and which digit that is."""
    seen = rows.groupBy(*keys, digit.alias("d")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys).orderBy("d")
    upto = seen.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    met = upto.join(state, keys).where("upto >= need and upto - c < need")
    return met.select(*keys, F.col("d").alias("bound"), (F.col("need") - F.col("upto") + F.col("c")).alias("need"), (F.col("c") > few).alias("open"))


def radix_select(values: DataFrame, keys: list[str], scratch: Scratch, top: int = TOP, few: int = FEW) -> DataFrame:
    """Rows (keys, item, value) that can be among the ``top`` of their group by
    value descending, then by the bytes of item: whole lists of ``few`` or less,
    all others cut down digit by digit."""
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    state = scratch.keep(sizes.where(F.col("c") > few).select(*keys, F.lit(top).cast("long").alias("need")))
    sure = values.join(sizes.where(F.col("c") <= few).select(*keys), keys, "left_semi")
    rest = values.join(state.select(*keys), keys, "left_semi")
    byte = 1
    shift = VALUE_BITS - DIGIT
    while not state.isEmpty():
        if shift >= 0:
            digit = (F.lit((1 << DIGIT) - 1) - F.shiftright("value", shift).bitwiseAND((1 << DIGIT) - 1)).cast("string")
            digit = F.lpad(digit, 4, "0")
            shift -= DIGIT
        else:
            digit = F.hex(F.substring(F.encode("item", "UTF-8"), byte, STEP))
            byte += STEP
        rest = scratch.keep(rest)
        bounds = scratch.keep(_narrowed(rest, digit, state, keys, few))
        marked = rest.join(bounds, keys).withColumn("d", digit)
        sure = sure.unionByName(marked.where("d < bound or (d = bound and not open)").select(*keys, "item", "value"))
        rest = marked.where("d = bound and open").select(*keys, "item", "value")
        state = bounds.where("open").select(*keys, "need")
    return sure


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, few: int = FEW) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the
    language by its divergence (part ``pair``), and the ``top`` terms of which a
    source has more than its language (part ``term``)."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(term_counts(docs))
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).select("lang", "term", "lang_n")
    counts = scratch.keep(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    scratch.drop(found)
    names = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    langs = counts.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", zero("v").alias("v"), zero("lang_total").alias("lang_total"), zero("total").alias("total"))
    sid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = scratch.keep(groups.withColumn("p0", F.when(F.col("v") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(F.lit(1).cast("long"))).withColumn("sid", sid))
    own = groups.select("lang", "source", "sid", "v", "total", "lang_total", "p0")
    known = scratch.keep(counts.join(own, ["lang", "source"]).select("lang", "source", "sid", "term", "p0", probability(F.col("n"), F.col("total"), F.col("v")).alias("p"), probability(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")))
    pairs = scratch.keep(pair_divergences(known, groups))
    over = known.where("p > q").select("lang", "source", F.col("term").alias("item"), loss(F.col("p"), F.col("q")).alias("value"))
    terms = radix_select(over, ["lang", "source"], scratch, top, few)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return scratch.only(ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top)))
