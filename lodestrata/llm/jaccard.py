r"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles; two link when their Jaccard similarity is
``percent`` or more. All documents order their shingles alike, rare ones first,
by an estimate of each shingle's document frequency. Two sets whose overlap
must be t share at least l shingles among the first n - t + l of either, for
every l. A document takes the l of least expected cost from the frequencies of
its own prefix: common prefixes are lengthened and must match more often. Pairs
are verified on their whole sets.

1. Frequencies: one pass counts all shingles of all documents in 2**bits
   counters by hash; tasks send their counters compressed, and their sum has a
   fixed size (``bits``, from 2**22 counters to 2**24 by the number of rows),
   which bounds what is broadcast. Counters are kept on a scale of logarithms,
   so none is ever full. Counters that several shingles share only blur the
   order, never the result.
2. Prefixes: a second pass writes each document's set size, set hash and prefix.
   Equal sets become one representative there, so copies form no pairs.
3. Candidates: prefixes join on shingle, with bounds on size, position and
   count. Lists of more than ``long_list`` sets are taken first, in blocks of
   ``list_block`` sets: within blocks, then between components that are not
   connected yet; a pair belongs to the list of its first shared shingle, and
   only a spanning forest of its links leaves a block. Pairs from the short
   lists are then formed between different components.
4. Verification: bit signatures rule pairs out that cannot link; then the sets
   of the others are computed again from their texts, and compared in blocks of
   the components that the pairs make.

Defined results: a null text, or one without words, has an empty set and links
with nothing; a null id links with nothing and has no component; repeated rows
are copies; rows of one id with different texts share a component; an empty
table gives no rows; other columns are left out, whatever their names; texts of
any length are taken whole. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.graph import components
from lodestrata.llm.neighbours import forest
from lodestrata.llm.scratch import Scratch
from lodestrata.llm.shingles import U, mixed, shingle_sets
from lodestrata.llm.workers import batches_of, release, trim

BITS = 22
PIECE = 1 << 16
MOST_MATCHES = 12
VERIFY_COST = 16.0
LONG_LIST = 24
LIST_BLOCK = 512
SIGNATURE_BITS = 2048
#: Counters are doubled up to this power of two as documents grow.
MOST_BITS = 24
#: Shingles that are added to the counters at once.
ADDED = 1 << 18
#: Of texts or sets that reach a worker at once.
BATCH = "4m"
#: Steps of a counter's value for each doubling of the count.
STEPS = 2048
#: Primes; ids are told apart by their residues where texts are passed over.
ID_BITS = (16_777_213, 134_217_689)


def _count(words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts, held, size = np.zeros(1 << bits, np.uint32), [], 0

        def add() -> None:
            nonlocal size
            if held:
                # not bincount, which makes a second table of all counters
                np.add.at(counts, np.concatenate(held), np.uint32(1))
                held.clear()
                size = 0

        for batch in batches:
            for one in shingle_sets(batch.column(0), words):
                held.append((one >> U(64 - bits)).astype(np.int64))
                size += len(one)
                if size > ADDED:
                    add()
        add()
        pieces = [(i, zlib.compress(counts[i * PIECE : (i + 1) * PIECE].tobytes(), 1)) for i in range(-(-(1 << bits) // PIECE)) if counts[i * PIECE : (i + 1) * PIECE].any()]
        del counts
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int32()), pa.array([p[1] for p in pieces], pa.binary())], ["piece", "counts"])
        trim()

    return run


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(PIECE, np.uint64)
    for packed in table["counts"]:
        part = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
        total[: len(part)] += part
    return pa.table({"piece": table["piece"][:1].combine_chunks(), "counts": pa.array([np.minimum(np.log2(total.astype(np.float64) + 1) * STEPS, 65535).astype(np.uint16).tobytes()], pa.binary())})


def shingle_frequencies(texts: DataFrame, words: int, bits: int = BITS) -> np.ndarray:
    """Documents counted per counter of the one text column, as STEPS times the
    logarithm of one more; counts up to some thousands have values of their own."""
    parts = texts.mapInArrow(_count(words, bits), "piece int, counts binary").groupBy("piece").applyInArrow(_sum, "piece int, counts binary").collect()
    out = np.zeros(max(PIECE, 1 << bits), np.uint16)
    for p in parts:
        out[p.piece * PIECE : (p.piece + 1) * PIECE] = np.frombuffer(p.counts, np.uint16)
    return out[: 1 << bits]


def chosen_matches(costs: np.ndarray, base: int, most: int) -> int:
    """How many matches to ask for: the l whose prefix, of base + l - 1
    shingles, costs least to look up and verify."""
    running = np.cumsum(costs[: base + most - 1])
    ways = np.arange(1, most + 1)
    looked_up = running[np.minimum(base + ways - 1, len(running)) - 1]
    return int(np.argmin(looked_up * (1 + VERIFY_COST / ways))) + 1


def _prefixes(sent, words: int, percent: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        frequency = np.frombuffer(sent.value, np.uint16)
        counted = lambda values: np.exp2(values / STEPS) - 1
        usual = sum(float(counted(frequency[i : i + PIECE].astype(np.float32)).sum(dtype=np.float64)) for i in range(0, len(frequency), PIECE)) / len(frequency)
        for batch in batches:
            out = []
            for one in shingle_sets(batch.column(1), words):
                n = len(one)
                if not n:
                    out.append((0, 0, 0, 0, []))
                    continue
                rank = frequency[one >> U(64 - bits)]
                need = -(-percent * n // 100)
                base = n - need + 1
                order = np.argsort((rank.astype(U) << U(48)) | (one >> U(16)), kind="stable")[: base + MOST_MATCHES - 1]
                costs = np.maximum(counted(rank[order]) - 1.5 * usual - 2, 0)
                ell = chosen_matches(costs, base, max(1, min(MOST_MATCHES, need)))
                sums = (int(mixed(one).sum(dtype=U)), int(np.bitwise_xor.reduce(mixed(one * U(0xD6E8FEB86659FD93)))))
                out.append((n, *(s - (1 << 64) if s >> 63 else s for s in sums), ell, one[order[: base + ell - 1]].view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "s1", "s2", "ell", "prefix"])
        trim()

    return run


def _wanted(pairs: DataFrame) -> bytes:
    """A bit for each residue of the ids of ``pairs`` modulo one of ID_BITS: two
    megabytes, or sixteen where there are many pairs, whatever their number."""
    modulus = ID_BITS[pairs.count() > ID_BITS[0] // 16]
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).select((F.pmod("id", F.lit(modulus)) + 1).alias("b"))
    rows = ids.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = bytearray((modulus // 32768 + 2) * 4096)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = bytes(r["bits"])
    return bytes(out)


def _sets(words: int, sent, signatures: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(sent.value, np.uint8)
        modulus = next(m for m in ID_BITS if (m // 32768 + 2) * 4096 == len(wanted))
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            bit = np.mod(ids, modulus)
            at = np.flatnonzero(((wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            batch = batch.take(pa.array(at))
            sets = list(shingle_sets(batch.column(1), words))
            if not signatures:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one.view(np.int64) for one in sets], pa.list_(pa.int64()))], ["rep", "shingles"])
                continue
            marks = np.zeros((len(sets), SIGNATURE_BITS), np.uint8)
            for row, one in zip(marks, sets, strict=True):
                row[(one % U(SIGNATURE_BITS)).astype(np.int64)] = 1
            packed_ = [*np.packbits(marks, axis=1).view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(one) for one in sets], pa.int64()), pa.array(packed_, pa.list_(pa.int64()))], ["rep", "n", "bits"])
        trim()

    return run


def from_texts(pairs: DataFrame, texts: DataFrame, words: int, *, signatures: bool) -> DataFrame:
    """(rep, shingles), or (rep, n, bits), of the documents of ``pairs`` and of
    some others. Texts stay where they are: a bit table passes over most of
    those that no pair has, and what the results are joined with the rest."""
    sent = texts.sparkSession.sparkContext.broadcast(_wanted(pairs))
    return texts.select("doc_id", "text").mapInArrow(_sets(words, sent, signatures), "rep long, n long, bits array<long>" if signatures else "rep long, shingles array<long>")


def possible(pairs: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs that bit signatures do not rule out: a bit that only one side
    has is a shingle that only this side has, so no linking pair is lost."""
    marked = from_texts(pairs, texts, words, signatures=True)
    left = marked.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("a"))
    right = marked.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("b"))
    alone = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, k: s + k)
    both = pairs.join(left.hint("merge"), "x").join(right.hint("merge"), "y")
    most = F.least(F.col("nx") - alone("a", "b"), F.col("ny") - alone("b", "a"))
    return both.where((100 + percent) * most >= percent * (F.col("nx") + F.col("ny"))).select(*pairs.columns)


def _pair_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A spanning forest of the pairs of a group that link."""
        ids, whole = table["rep"].to_numpy(), [x.values.to_numpy() for x in table["shingles"]]
        order = np.argsort(ids, kind="stable")
        found_a, found_b = [], []
        for a, partners in enumerate(table["partners"]):
            for y in partners.values.to_numpy():
                # rows of one id can hold different texts; any of them may link
                for b in order[np.searchsorted(ids[order], y) : np.searchsorted(ids[order], y, "right")]:
                    shared = len(np.intersect1d(whole[a], whole[b], assume_unique=True))
                    if (100 + percent) * shared >= percent * (len(whole[a]) + len(whole[b])):
                        found_a.append(a)
                        found_b.append(b)
        a, b = np.array(found_a, np.int64), np.array(found_b, np.int64)
        hit = np.unique(np.concatenate([a, b]))
        return pa.table({"y": ids[hit], "x": forest(a, b, ids)[hit]})

    return run


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch, list_block: int) -> DataFrame:
    """(y, x): a spanning forest of the ``pairs`` whose whole sets link. Pairs
    of one component of candidates are dealt out by pairs of blocks of its
    documents; alike sets lie side by side, so they take little room in the shuffle."""
    part = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    sizes = part.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(list_block)).cast("int").alias("blocks"))
    named = pairs.join(part.select(F.col("node").alias("x"), "component"), "x").join(sizes, "component")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    named = named.select("component", F.least(block("x"), block("y")).alias("i"), F.greatest(block("x"), block("y")).alias("j"), "x", "y")
    none = F.lit(None).cast("long")
    sides = named.select("component", "i", "j", F.col("x").alias("rep"), F.col("y").alias("partner")).union(named.select("component", "i", "j", "y", none))
    # a set's partners in a group are no more than a block
    dealt = sides.groupBy("component", "i", "j", "rep").agg(F.collect_set("partner").alias("partners"))
    filled = dealt.hint("merge").join(from_texts(pairs, texts, words, signatures=False).hint("merge"), "rep")
    return filled.sortWithinPartitions("component", F.size("shingles")).groupBy("component", "i", "j").applyInArrow(_pair_links(percent), "y long, x long")


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every row set with every column set."""
    r, c = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (rows, cols))
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
    known = np.intersect1d(left, right)
    out = np.zeros((len(rows), len(cols)), np.float32)
    at_l, at_r = np.searchsorted(known, left), np.searchsorted(known, right)
    if not len(known):
        return out
    in_l, in_r = known[np.minimum(at_l, len(known) - 1)] == left, known[np.minimum(at_r, len(known) - 1)] == right
    for first in range(0, len(known), 4096):
        parts = []
        for row, at, inside, size in ((r, at_l, in_l, len(rows)), (c, at_r, in_r, len(cols))):
            take = inside & (at >= first) & (at < first + 4096)
            m = np.zeros((size, min(4096, len(known) - first)), np.float32)
            m[row[take], at[take] - first] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _long_list_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links among the sets of one block of a long list, or between two
        blocks: pairs of different components whose first shared prefix shingle
        is the list's, that share enough prefix shingles, and whose whole sets link."""
        ids, part, n, ell, pos, side = (table[c].to_numpy() for c in ("rep", "component", "n", "ell", "pos", "side"))
        prefix = [x.values.to_numpy() for x in table["prefix"]]
        whole = [x.values.to_numpy() for x in table["shingles"]]
        one_block = table["i"][0].as_py() == table["j"][0].as_py()
        rows = np.arange(len(ids)) if one_block else np.flatnonzero(side == 0)
        cols = rows if one_block else np.flatnonzero(side == 1)
        base = n - -(-percent * n // 100) + 1
        cut = lambda which, ends: [prefix[k][: ends[k]] for k in which]
        ok = overlaps(cut(rows, pos), cut(cols, pos)) == 0
        ok &= (percent * np.maximum(n[rows][:, None], n[cols][None, :])) <= 100 * np.minimum(n[rows][:, None], n[cols][None, :])
        ok &= part[rows][:, None] != part[cols][None, :]
        if one_block:
            ok &= np.arange(len(rows))[:, None] < np.arange(len(cols))[None, :]
        least = np.minimum(ell[rows][:, None], ell[cols][None, :])
        for k in np.unique(least[ok]):
            ends = base + k - 1
            ok &= (least != k) | (overlaps(cut(rows, ends), cut(cols, ends)) >= k)
        a, b = np.nonzero(ok)
        if len(a) < 2000:
            shared = np.array([len(np.intersect1d(whole[rows[x]], whole[cols[y]], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
        else:
            some_a, at_a = np.unique(a, return_inverse=True)
            some_b, at_b = np.unique(b, return_inverse=True)
            shared = overlaps([whole[k] for k in rows[some_a]], [whole[k] for k in cols[some_b]])[at_a, at_b].astype(np.int64)
        a, b = rows[a], cols[b]
        link = (100 + percent) * shared >= percent * (n[a] + n[b])
        a, b = a[link], b[link]
        low = forest(a, b, ids)
        hit = np.unique(np.concatenate([a, b]))
        return pa.table({"y": ids[hit], "x": low[hit]})

    return run


def _own(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), blocks).cast("int")


def _in_pairs(lists: DataFrame) -> DataFrame:
    """Every set of (token, rep, pos, component, blocks) in each pair of blocks that its own is of."""
    dealt = lists.withColumn("own", _own(F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.select("token", "rep", "pos", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def long_list_links(lists: DataFrame, whole: DataFrame, sets: DataFrame, percent: int, list_block: int, scratch: Scratch) -> DataFrame:
    """(a, b): a spanning forest of the links that long lists hold. ``lists``
    has (token, size, rep, pos). What the links connect already need not be
    compared, so a list of copies costs little more than one look at each:

    1. a list's sets are compared within their own blocks;
    2. one set of each component that a list has now with those of the others;
    3. in lists that still have several components, all pairs between different
       ones: the sets of the largest component with those of the others, and
       these among each other.

    In 2 and 3 blocks meet in pairs, so a group holds about two blocks at most."""
    kind = "y long, x long"
    filled = lambda dealt: dealt.join(whole.select("rep", "n", "ell", "prefix").hint("merge"), "rep").join(sets.hint("merge"), "rep")
    # alike sets side by side take less room in the shuffle
    met = lambda dealt: filled(dealt).sortWithinPartitions("token", "n").groupBy("token", "i", "j").applyInArrow(_long_list_links(percent), kind).select(F.col("x").alias("a"), F.col("y").alias("b"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(list_block)).cast("int")
    places = ["token", "rep", "pos", "component"]

    def tagged(links: DataFrame) -> DataFrame:
        named = components(links, scratch).select(F.col("node").alias("rep"), F.col("component"))
        return scratch.keep(lists.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep")))

    own = _own(blocks("size"))
    links = scratch.keep(met(lists.select("token", "rep", "pos", F.col("rep").alias("component"), own.alias("i"), own.alias("j"), F.lit(0).alias("side"))))

    now = tagged(links)
    first = now.groupBy("token", "component", "size").agg(F.min(F.struct("rep", "pos")).alias("s"))
    heads = first.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("heads"))
    several = scratch.keep(heads.where("heads > 1"))
    leaders = first.join(several, "token").select("token", "s.rep", "s.pos", F.col("s.rep").alias("component"), blocks("heads").alias("blocks"))
    links = scratch.keep(links.unionByName(met(_in_pairs(leaders))))

    # only lists that have sets which 2 did not compare
    left = now.join(several, "token").where("heads < size").select("token").distinct()
    now = tagged(links).join(left, "token", "left_semi")
    counts = now.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all")).where("all > most")
    largest = scratch.keep(largest.select("token", "largest", blocks("most").alias("in_largest"), F.ceil((F.col("all") - F.col("most")) / F.lit(list_block)).cast("int").alias("blocks")))
    if largest.isEmpty():
        return links
    apart = scratch.keep(now.join(largest, "token"))
    rest = apart.where("component != largest")
    one = apart.where("component = largest").withColumn("i", -1 - _own(F.col("in_largest"))).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)"))).select(*places, "i", "j", F.lit(0).alias("side"))
    other = rest.withColumn("j", _own(F.col("blocks"))).withColumn("i", F.explode(F.expr("sequence(-in_largest, -1)"))).select(*places, "i", "j", F.lit(1).alias("side"))
    return scratch.keep(links.unionByName(met(one.unionByName(other).unionByName(_in_pairs(rest)))))


def packed(n: Column, pos: Column, ell: Column) -> Column:
    """Set size, position and matches in one number."""
    return F.shiftleft(n.cast("long"), 32).bitwiseOR(F.shiftleft(pos.cast("long"), 5)).bitwiseOR(ell.cast("long"))


def _size(pack: Column) -> Column:
    return F.shiftright(pack, 32)


def _place(pack: Column) -> Column:
    return F.shiftright(pack, 5).bitwiseAND(F.lit((1 << 27) - 1))


def _base(pack: Column, percent: int) -> Column:
    n = _size(pack)
    return n - F.floor((percent * n + 99) / 100).cast("long") + 1


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """(x, y, found) that share enough prefix shingles, x the smaller set, from
    (token, rep, pack, removed, component). ``removed`` is the number of prefix
    shingles that were left out as long lists; two sets share no more of these
    than either has. component is null where it is the set itself."""
    a, b = postings.alias("a"), postings.alias("b")
    c = F.col
    na, nb, ia, ib = _size(c("a.pack")), _size(c("b.pack")), _place(c("a.pack")), _place(c("b.pack"))
    ell = F.least(c("a.pack").bitwiseAND(31), c("b.pack").bitwiseAND(31))
    apart = F.coalesce(c("a.component"), c("a.rep")) != F.coalesce(c("b.component"), c("b.rep"))
    smaller = (na < nb) | ((na == nb) & (c("a.rep") < c("b.rep")))
    near = (ia < _base(c("a.pack"), percent) + ell - 1) & (ib < _base(c("b.pack"), percent) + ell - 1)
    enough = (100 + percent) * (F.least(ia, ib) + F.least(na - ia, nb - ib)) >= percent * (na + nb)
    joined = a.join(b.hint("merge"), (c("a.token") == c("b.token")) & apart & smaller & (percent * nb <= 100 * na) & near & enough)
    # a pair whose first shared shingle is a long list's belongs to that list; any other has one here at least
    need = F.min(F.greatest(F.lit(1), ell - F.least(c("a.removed"), c("b.removed"))))
    return joined.groupBy(c("a.rep").alias("x"), c("b.rep").alias("y")).agg(F.count(F.lit(1)).alias("found"), need.alias("need")).where("found >= need").select("x", "y", "found")


def near_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bits: int | None = None, long_list: int = LONG_LIST, list_block: int = LIST_BLOCK) -> DataFrame:
    """Per document: (doc_id, n_shingles, component_id). All of it is written when this returns."""
    with batches_of(docs.sparkSession, BATCH):
        return _components(docs, id_col, text_col, words, percent, bits, long_list, list_block)


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bits: int | None, long_list: int, list_block: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = bits or min(MOST_BITS, max(BITS, rows.count().bit_length() + 2))
    sent = spark.sparkContext.broadcast(shingle_frequencies(rows.select("text"), words, bits).tobytes())
    made = scratch.keep(rows.mapInArrow(_prefixes(sent, words, percent, bits), "doc_id long, n long, s1 long, s2 long, ell int, prefix array<long>"))

    reps = made.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = scratch.keep(reps)
    # the representative's row carries the prefix of its set
    by_rep = reps.select(F.col("rep").alias("doc_id"), "s1", "s2")
    whole = scratch.keep(made.join(by_rep, ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id", "s1", "s2"]).select(F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("n"), "ell", "prefix"))
    keys = scratch.keep(made.select("doc_id", "n", "s1", "s2"))
    scratch.drop(made)
    # shingles of one prefix only make no pairs
    postings = whole.select("rep", "n", "ell", F.posexplode("prefix").alias("pos", "token")).select("token", "rep", packed(F.col("n"), F.col("pos"), F.col("ell")).alias("pack"))
    shared = scratch.keep(postings.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("size > 1"))

    # 1: links of long lists
    lists = shared.where((F.col("size") > long_list) & (_place(F.col("pack")) < _base(F.col("pack"), percent))).select("token", "size", "rep", _place(F.col("pack")).cast("int").alias("pos"))
    listed = scratch.keep(lists.select(F.col("rep").alias("x"), F.col("rep").alias("y")).distinct())
    hot = scratch.keep(whole.join(listed.select(F.col("x").alias("rep")), "rep", "left_semi"))
    scratch.drop(whole)
    sets = scratch.keep(from_texts(listed, rows, words, signatures=False).join(listed.select(F.col("x").alias("rep")), "rep", "left_semi"))
    lists = scratch.keep(lists)
    first = long_list_links(lists, hot, sets, percent, list_block, scratch)
    scratch.drop(sets, hot, lists)
    # 2: pairs of what is not connected yet
    early = components(first, scratch).select(F.col("node").alias("rep"), "component")
    removed = shared.where(F.col("size") > long_list).groupBy("rep").agg(F.count(F.lit(1)).alias("removed"))
    short = shared.where(F.col("size") <= long_list).join(early, "rep", "left").join(removed, "rep", "left")
    pairs = scratch.keep(_candidates(short.select("token", "rep", "pack", F.coalesce("removed", F.lit(0)).alias("removed"), F.nullif("component", "rep").alias("component")), percent))
    scratch.drop(shared)
    pairs = scratch.keep(possible(pairs, rows, words, percent, scratch).select("x", "y"))
    second = verified(pairs, rows, words, percent, scratch, list_block).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(first.unionByName(second), scratch)

    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = keys.join(named, ["n", "s1", "s2"], "left")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return scratch.only(out.select("doc_id", F.col("n").alias("n_shingles"), known.alias("component_id")))


def keep_one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each group of near copies: the first by
    id, of equal ids the first by text. Rows without an id stay. Different
    texts of one id are documents of their own. Rows are told apart by two
    hashes where one of each is kept."""
    own = docs.where("doc_id is not null").withColumn("node_", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    near = near_documents(own, id_col="node_", words=words, percent=percent).select(F.col("doc_id").alias("node_"), F.col("component_id").alias("component_")).distinct()
    scratch = Scratch(docs.sparkSession)
    ids = scratch.keep(own.select("node_", "doc_id").distinct().join(near, "node_"))
    least = ids.groupBy("component_").agg(F.min("doc_id").alias("doc_id"))
    first = scratch.keep(ids.join(least, ["component_", "doc_id"]))
    # texts are compared only where several of a group have its least id
    each = first.groupBy("component_").agg(F.min("node_").alias("node_"), F.count(F.lit(1)).alias("n_"))
    tied = first.join(each.where("n_ > 1").select("component_"), "component_").select("node_", "component_")
    broken = own.select("node_", "text").join(tied, "node_").groupBy("component_").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "node_"))["node_"].alias("node_"))
    kept = scratch.only(each.where("n_ = 1").select("node_").union(broken.select("node_")))
    return docs.where("doc_id is null").unionByName(own.join(kept, "node_", "left_semi").withColumn("other_", F.xxhash64(F.lit("other"), "text", "doc_id")).dropDuplicates(["node_", "other_"]).drop("node_", "other_"))
