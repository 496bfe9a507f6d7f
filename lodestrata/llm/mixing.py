"""Mixing sources to target weights, with DataFrame functions only.

Every source's words, its documents laid end to end, are cut into blocks of
``block_words``; a target of ``t`` words is ``t / block_words`` slots. The mix is
written in shards of ``shard_blocks`` slots, and every slot of every shard draws
its source by a seeded hash, with the targets as weights: a shard's counts are a
multinomial draw. What a source was drawn in all is its number of slots, held
within ``DRIFT`` of the target: draws beyond that stay empty, and what is lacking
comes in correction shards at the end. A source's slots, numbered from shard to
shard, run through a seeded pseudorandom permutation of its blocks, once more for
each pass over the source, and blocks are joined by index.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; documents of size 0 take nothing; repeated rows are documents of
their own, laid out one after the other; an empty table gives an empty mix;
other columns are left out by ``mix_sources``, whatever their names, and kept by
``mixed_documents``. Texts of any length are cut into as many blocks as they
fill. Offsets come from sums over fixed hash buckets, and running sums over
sources from ranges of sources, so nothing is ordered in one task, however large
a source or however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import Scratch, partitions

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it, and what ends the text.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\z)?"
BUCKETS = 2048
CAP = 3
#: How far a source's drawn slots may lie from its target, as a share of it.
DRIFT = 0.005


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over the rows before it in
    ``order``, by ranges: each range is ordered alone, and only the sums of
    ranges, of which there are as many as shuffle partitions, meet."""
    ranged = scratch.keep(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("range_", F.spark_partition_id()))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    each = ranged.groupBy("range_").agg(*(F.sum(c).alias(f"{k}_") for k, c in sums.items()))
    ahead = each.select("range_", *(F.sum(f"{k}_").over(before).alias(f"{k}_") for k in sums))
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(ahead), "range_")
    return joined.select(*rows.columns, *((F.coalesce(f"{k}_", F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in sums.items()))


def source_targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Targets from (source, source_size): weights 1, 2, 3 repeating over the
    sources by code point (null last), capped at ``CAP`` times a source's size,
    the excess reshared by weight. The cap binds for the sources whose ratio
    of cap to weight lies under the water level, found from running sums.
    """
    numbered = with_sums_before(sizes, [F.col("source").asc_nulls_last()], {"src": F.lit(1)}, scratch)
    weighed = (
        numbered.withColumn("src", F.col("src").cast("long"))
        .withColumn("weight", (F.col("src") % 3 + 1).cast("double"))
        .withColumn("cap", F.lit(float(CAP)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    filled = scratch.keep(with_sums_before(weighed, [F.col("ratio"), F.col("src")], {"caps": F.col("cap"), "weights": F.col("weight")}, scratch))
    total, weights = filled.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    here = (F.lit(total) - F.col("caps")) / (F.lit(weights) - F.col("weights"))
    level = filled.where(F.col("ratio") > here).agg(F.max(here)).first()[0]
    target = F.when(F.col("ratio") <= here, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return filled.select("source", "src", "source_size", target.cast("double").alias("target"))


def permuted(index: Column, n: Column, key: Column, seed: int) -> Column:
    """A bijection of [0, n): a Feistel network on a near-square domain of at
    least n points, walked on where it leaves the range (at most the square
    root of n points lie outside, so few steps are ever needed).
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n / a), F.lit(1)).cast("long")

    def once(x: Column) -> Column:
        left, right = x % a, F.floor(x / a).cast("long")
        for turn in range(2):
            left = (left + F.pmod(F.xxhash64(right, key, F.lit(seed + 2 * turn)), a)) % a
            right = (right + F.pmod(F.xxhash64(left, key, F.lit(seed + 2 * turn + 1)), b)) % b
        return right * a + left

    first = once(index)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(80)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walked)


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    """One row a document: its size and the offset of its first word in its source."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"), *more,
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS)).cast("int"))
    # a key without nulls, so that window and join deal the rows out alike, once
    rows = rows.withColumn("key", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce(F.col("source").cast("string"), F.lit(""))))
    inside = Window.partitionBy("key", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("held")).withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0).cast("long")))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    joined = rows.join(sums.select("key", "bucket", "ahead"), ["key", "bucket"])
    return joined.withColumn("start", F.col("ahead") + F.col("inside")).drop("key", "bucket", "ahead", "inside", "tie")


def source_plan(placed: DataFrame, block_words: int, scratch: Scratch) -> DataFrame:
    """Per source: its target in words, blocks, slots and the words of its last slot."""
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    want = F.floor(F.col("target") + 0.5).cast("long")
    b = F.lit(block_words).cast("long")
    return scratch.keep(
        source_targets(sizes, scratch)
        .withColumn("want", F.when(F.col("source_size") > 0, F.least(want, CAP * F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("whole", F.floor(F.col("source_size") / b).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / b).cast("long"))
        .withColumn("rest", F.when(F.col("source_size") > 0, F.col("want") % F.col("source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b).cast("long"))
        .withColumn("trim", F.when(F.col("rest") > 0, (F.col("rest") - 1) % b + 1).otherwise(b))
    )


def shard_draws(plan: DataFrame, shard_blocks: int, seed: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(shard, src, drawn): how often each shard drew each source, and the number of shards."""
    spark = plan.sparkSession
    own = plan.where("slots > 0").select("src", "slots")
    total, sources = own.agg(F.sum("slots"), F.count(F.lit(1))).first()
    if not total:
        return scratch.keep(spark.createDataFrame([], "shard long, src long, drawn long")), 0
    # a draw is a number below the total, and each source owns a range of them; ranges are met in bins
    width = -(-total // sources)
    owned = with_sums_before(own, [F.col("src")], {"low": F.col("slots")}, scratch).withColumn("high", F.col("low") + F.col("slots"))
    owned = scratch.keep(owned.select("src", "low", "high", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("bin")))
    tasks = max(partitions(spark), -(-total // (1 << 20)))
    draws = spark.range(0, total, 1, tasks).select(F.expr(f"id div {shard_blocks}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("drawn"))
    draws = draws.withColumn("bin", F.expr(f"drawn div {width}"))
    met = draws.join(owned, "bin").where("drawn >= low and drawn < high")
    return scratch.keep(met.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("drawn"))), -(-total // shard_blocks)


def slot_runs(plan: DataFrame, shard_blocks: int, seed: int, scratch: Scratch) -> DataFrame:
    """(src, shard, first, n, slots, whole, blocks, trim): the slots that each
    shard has of each source, numbered from ``first``; ``trim`` is the words of
    the source's last slot, null where it is a whole one."""
    draws, shards = shard_draws(plan, shard_blocks, seed, scratch)
    spare = F.floor(F.col("slots") * DRIFT).cast("long")
    got = draws.groupBy("src").agg(F.sum("drawn").alias("got"))
    ends = plan.where("slots > 0").join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long")))
    ends = ends.withColumn("end", F.least(F.greatest("got", F.col("slots") - spare), F.col("slots") + spare, CAP * F.col("blocks")))
    ends = ends.select("src", "got", "end", "whole", "blocks", F.when(F.col("end") == F.col("slots"), F.col("trim")).alias("trim"))
    ends = scratch.keep(with_sums_before(ends, [F.col("src")], {"lacking": F.greatest(F.col("end") - F.col("got"), F.lit(0))}, scratch))
    # shards before a shard: by groups of shards, then in the group
    grouped = draws.withColumn("group", F.expr("shard div 1024"))
    ahead = grouped.groupBy("src", "group").agg(F.sum("drawn").alias("held"))
    ahead = ahead.select("src", "group", (F.sum("held").over(Window.partitionBy("src").orderBy("group")) - F.col("held")).alias("ahead"))
    inside = F.sum("drawn").over(Window.partitionBy("src", "group").orderBy("shard")) - F.col("drawn")
    drawn = grouped.withColumn("inside", inside).join(ahead, ["src", "group"]).withColumn("first", F.col("ahead") + F.col("inside"))
    drawn = drawn.join(ends, "src").withColumn("n", F.least("drawn", F.col("end") - F.col("first"))).where("n > 0")
    # what the draws lack, packed into shards of its own
    added = ends.where("end > got").withColumn("k", F.explode(F.expr(f"sequence(lacking div {shard_blocks}, (lacking + end - got - 1) div {shard_blocks})")))
    added = added.withColumn("first", F.greatest(F.col("got"), F.col("got") + F.col("k") * shard_blocks - F.col("lacking")))
    added = added.withColumn("n", F.least(F.col("end"), F.col("got") + (F.col("k") + 1) * shard_blocks - F.col("lacking")) - F.col("first")).withColumn("shard", shards + F.col("k"))
    columns = ["src", "shard", "first", "n", "end", "whole", "blocks", "trim"]
    return drawn.select(columns).unionByName(added.select(columns))


def slot_table(plan: DataFrame, block_words: int, shard_blocks: int, seed: int, scratch: Scratch) -> DataFrame:
    """One row a slot: (src, slot, shard, block, words). A run, which is listed
    in one task, has at most ``shard_blocks`` slots."""
    runs = slot_runs(plan, shard_blocks, seed, scratch).repartition(partitions(plan.sparkSession), F.col("src"), F.col("shard"))
    at = F.col("slot") % F.col("blocks")
    return (
        runs.withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
        .withColumn("block", F.when(at < F.col("whole"), permuted(at, F.col("whole"), F.xxhash64(F.col("src"), F.floor(F.col("slot") / F.col("blocks"))), seed)).otherwise(at))
        .withColumn("words", F.when(F.col("slot") == F.col("end") - 1, F.coalesce("trim", F.lit(block_words))).otherwise(F.lit(block_words)))
        .select("src", "slot", "shard", "block", F.col("words").cast("long").alias("words"))
    )


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 128, shard_blocks: int = 4096, seed: int = 8
) -> DataFrame:
    """Per document: (doc_id, source, size, source_size, target, taken), taken
    being the words that the mix draws from it, repeats counted."""
    scratch = Scratch(docs.sparkSession)
    placed = scratch.keep(_placed(docs, id_col, text_col, source_col, seed))
    plan = source_plan(placed, block_words, scratch)
    uses = (
        slot_table(plan, block_words, shard_blocks, seed, scratch)
        .groupBy("src", "block")
        .agg(F.sum(F.when(F.col("words") == block_words, 1).otherwise(0)).alias("full"), F.coalesce(F.max(F.when(F.col("words") < block_words, F.col("words"))), F.lit(0)).alias("part"))
    )
    # the listed slots outgrow what the planner expects of the plan, so their side is never broadcast
    uses = uses.hint("merge")
    rows = placed.join(plan.select(F.col("source").alias("source_"), "src", "source_size", "target"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    pieces = rows.withColumn("block", F.explode_outer(F.expr(f"if(size > 0, sequence(start div {block_words}, (start + size - 1) div {block_words}), cast(null as array<bigint>))")))
    low = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    got = F.col("full") * (high - low) + F.greatest(F.least(high, F.col("part")) - low, F.lit(0))
    joined = pieces.join(uses.withColumnsRenamed({"src": "src_", "block": "block_"}), (F.col("src") == F.col("src_")) & (F.col("block") == F.col("block_")), "left")
    return (
        joined.groupBy("src", "start", "doc_id", "source", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("taken_all"), F.count(F.lit(1)).alias("rows_here"))
        # rows of size 0 may share all of these values: each is given back
        .withColumn("copy", F.explode(F.expr("if(size > 0, array(1L), sequence(1L, rows_here))")))
        .select("doc_id", "source", "size", "source_size", "target", F.col("taken_all").alias("taken"))
    )


def _pieces(rows: DataFrame, plan: DataFrame, block_words: int, pattern: str) -> DataFrame:
    """``rows`` with words cut at the blocks' borders: (src, block, low, high,
    w, ...), the words from ``low`` to ``high`` of the block."""
    named = rows.where("size > 0").join(plan.select(F.col("source").alias("source_"), "src"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    begin = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    cut = (
        named.withColumn("all", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
        .withColumn("w", F.slice("all", (begin + 1).cast("int"), (end - begin).cast("int")))
        .withColumn("low", F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)))
    )
    return cut.withColumn("high", F.col("low") + F.size("w")).drop("all", "text")


def mixed_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 128, shard_blocks: int = 4096, seed: int = 8) -> DataFrame:
    """The mix itself: (shard, src, slot, text), a row a slot, its block's words
    joined by single spaces (the last slot of a source trimmed to the target)."""
    scratch = Scratch(docs.sparkSession)
    placed = scratch.keep(_placed(docs, id_col, text_col, source_col, seed, F.col(text_col).alias("text")))
    plan = source_plan(placed, block_words, scratch)
    # a block has at most block_words pieces
    blocks = _pieces(placed, plan, block_words, WORD).groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("low", "w"))).alias("parts")).select("src", "block", F.flatten(F.col("parts.w")).alias("w"))
    slots = slot_table(plan, block_words, shard_blocks, seed, scratch).hint("merge")
    return slots.join(blocks, ["src", "block"]).select("shard", "src", "slot", F.array_join(F.slice("w", F.lit(1), F.col("words").cast("int")), " ").alias("text"))


def mixed_documents(docs: DataFrame, *, block_words: int = 128, shard_blocks: int = 4096, seed: int = 8) -> DataFrame:
    """The mix in the columns given: a row for each document in each block that
    a slot holds, its text what lies of it there, white space kept, n_chars
    that text's. Documents without words stay as they are."""
    scratch = Scratch(docs.sparkSession)
    rest = F.struct(*(F.col(c) for c in docs.columns if c != "text"))
    plan = source_plan(scratch.keep(_placed(docs, "doc_id", "text", "source", seed)), block_words, scratch)
    slots = slot_table(plan, block_words, shard_blocks, seed, scratch)
    pieces = _pieces(_placed(docs, "doc_id", "text", "source", seed, F.col("text").alias("text"), rest.alias("row")), plan, block_words, SPACED_WORD)
    # text takes less room than its words; only a source's last slot is cut again
    pieces = pieces.select("src", "block", "low", "high", F.array_join("w", "").alias("piece"), "row")
    took = slots.hint("merge").join(pieces.hint("merge"), ["src", "block"]).where("words > low")
    cut = F.slice(F.regexp_extract_all("piece", F.lit(SPACED_WORD), F.lit(0)), F.lit(1), (F.col("words") - F.col("low")).cast("int"))
    text = F.when(F.col("words") >= F.col("high"), F.col("piece")).otherwise(F.array_join(cut, ""))
    mixed = took.select("row", text.alias("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    mixed = mixed.select(*(own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns))
    return docs.where(word_count(F.col("text")) == 0).unionByName(mixed)
