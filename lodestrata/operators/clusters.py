"""Entities that share names: clusters, cumulative merging and decrees.

A row joins the first cluster that one of its strong names has come to. That
depends on the order of rows, but only among rows that names connect. So names
are linked first, as an edge table; what is not connected is decided in
parallel. Where one name stands in all rows of a component, the first row is
everybody's home; only the other components are walked through in order, in a
task each, which holds the names met so far and no rows. All that a cluster
says of itself is aggregated afterwards.

Defined results: rows of equal order keep any fixed order; null names, hints
and categories are empty; rows without any name are left out of clusters; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import CLAUSE, is_weak_key, merge_hints, strip_description, trim
from lodestrata.operators.components import components, hub_edges, listed, meet, numbered
from lodestrata.shared import Steps

CLUSTER = ("ord", "canonical", "variants", "hint", "files", "public_figure", "suspect", "category", "cross_file")
MERGED = ("ord", "canonical", "variants", "hint", "category", "cross_file")
LOCKED = ("ord", "canonical", "writings", "hint", "locked", "note", "conflict", "source_ord")


def empty() -> Column:
    return F.array().cast("array<string>")


def text(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def names(canonical: str = "canonical", variants: str = "variants") -> Column:
    return F.concat(F.array(text(canonical)), F.coalesce(variants, empty()))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by component and order: (rid, home)."""
    now, owner, begun = None, {}, 0
    for batch in batches:
        out = []
        for comp, rid, strong, joins in zip(*(batch.column(c).to_pylist() for c in ("comp", "rid", "strong", "joins")), strict=True):
            if comp != now:
                now, owner = comp, {}
            met = [owner[s] for s in strong if s in owner] if joins else []
            begun += not met
            home = min(met, default=(begun, rid))  # clusters are ordered by when they began
            for s in strong:
                owner[s] = min(owner.get(s, home), home)
            out.append((rid, home[1]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["rid", "home"])


def first_homes(rows: DataFrame, keys: list[str], order: list[str], steps: Steps) -> DataFrame:
    """(rid, home) of rows (keys, rid, strong, joins, order): the row that began
    the first cluster which shares a strong name, or the row itself."""
    named = rows.select(*keys, "rid", F.explode("strong").alias("name"))
    comp = components(hub_edges(named, [*keys, "name"], "rid"), steps).select(F.col("node").alias("rid"), F.col("component").alias("comp"))
    known = steps.keep(rows.select("rid", "strong", "joins", F.struct(*order, "rid").alias("seq")).join(comp, "rid", "left").withColumn("comp", F.coalesce("comp", "rid")))
    most = known.select("comp", F.explode("strong").alias("name")).groupBy("comp", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("comp").agg(F.max("n").alias("n"))
    size = known.groupBy("comp").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("seq"))
    kind = size.join(most, "comp", "left").select("comp", (F.col("rows") == F.coalesce("n", F.lit(1))).alias("easy"), F.col("seq.rid").alias("first"))
    marked = steps.keep(known.join(kind, "comp"))
    easy = marked.where("easy").select("rid", F.when(F.col("joins"), F.col("first")).otherwise(F.col("rid")).alias("home"))
    hard = marked.where("not easy").repartition("comp").sortWithinPartitions("comp", "seq").select("comp", "rid", "strong", "joins")
    return easy.unionByName(hard.mapInArrow(_walk, "rid long, home long"))


def _with_rids(rows: DataFrame, steps: Steps) -> DataFrame:
    return steps.keep(rows.withColumn("rid", F.monotonically_increasing_id()))


def _strong(of: Column) -> Column:
    return F.array_distinct(F.filter(of, lambda n: (n != "") & ~is_weak_key(n)))


def _members(rows: DataFrame, homes: DataFrame, order: list[str], steps: Steps) -> DataFrame:
    return steps.keep(rows.join(homes, "rid").withColumn("seq", F.struct(*order, "rid")))


def _hints(members: DataFrame) -> DataFrame:
    said = listed(members.where(text("hint") != ""), "home", "hint", F.col("seq"), "hints")
    return said.select("home", merge_hints(F.array_join("hints", CLAUSE)).alias("hint"))


def _voted(members: DataFrame) -> DataFrame:
    """A1: (home, canonical): the most frequent name; then the longest in UTF-16,
    names that read as array indexes in numeric order, and the one met first."""
    name = trim(text("canonical"))
    votes = members.where(name != "").groupBy("home", name.alias("canonical")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    number = F.when(F.col("canonical").rlike(r"\A(0|[1-9][0-9]{0,9})\z"), F.expr("try_cast(canonical as long)"))
    index = F.when(number < 2**32 - 1, number)
    rank = F.struct(-F.col("n"), -F.octet_length(F.encode("canonical", "UTF-16LE")), index.isNull(), F.coalesce(index, F.lit(0)), F.col("seq"))
    return votes.groupBy("home").agg(F.min_by("canonical", rank).alias("canonical"))


def cluster_entities(mentions: DataFrame, key: str = "topic") -> DataFrame:
    """Mentions (key, kind, ord, file, canonical, variants, hint,
    public_figure, suspect, category) -> entities with their order."""
    steps = Steps(mentions.sparkSession)
    trimmed = F.filter(F.transform(names(), trim), lambda n: n != "")
    mentions = mentions.select(key, "kind", "ord", "file", "canonical", "variants", "hint", "public_figure", "suspect", "category")
    rows = _with_rids(mentions.withColumn("names", trimmed).where(F.size("names") > 0).withColumn("strong", _strong(F.col("names"))).withColumn("joins", F.lit(True)), steps)
    members = _members(rows, first_homes(rows, [key, "kind"], ["ord"], steps), ["ord"], steps)
    on = lambda c: F.bool_or(F.coalesce(c, F.lit(False))).alias(c)
    facts = members.groupBy("home", key, "kind").agg(F.min("seq").alias("seq"), on("public_figure"), on("suspect"), F.min_by(F.when(text("category") != "", F.col("category")), F.when(text("category") != "", F.col("seq"))).alias("category"))
    each = members.select("home", "seq", F.posexplode("names").alias("at", "name"))
    known = listed(each, "home", "name", F.struct("seq", "at"), "names")
    files = listed(members, "home", "file", F.col("seq"), "files")
    out = facts.join(known, "home").join(files, "home").join(_voted(members), "home", "left").join(_hints(members), "home", "left")
    canonical = F.coalesce("canonical", F.get("names", F.lit(0)))
    out = out.select(key, "kind", "seq", canonical.alias("canonical"), F.filter("names", lambda n: n != canonical).alias("variants"), text("hint").alias("hint"), "files", "public_figure", "suspect", text("category").alias("category"), (F.size("files") > 1).alias("cross_file"))
    return steps.last(numbered(out, [key, "kind"], ["seq"], "ord", steps).select(key, "kind", *CLUSTER))


def merge_entities(entities: DataFrame, key: str = "topic") -> DataFrame:
    """Prior and fresh entities (key, kind, is_fresh, ord, canonical,
    variants, hint, category) -> the merged list; fresh rows join the first row
    of the growing list that shares a strong name, else are appended."""
    steps = Steps(entities.sparkSession)
    order = ["is_fresh", "ord"]
    bare = F.transform(names(), strip_description)
    entities = entities.select(key, "kind", "is_fresh", "ord", "canonical", "variants", "hint", "category")
    rows = _with_rids(entities.withColumn("strong", _strong(bare)).withColumn("joins", F.col("is_fresh")), steps)
    members = _members(rows, first_homes(rows, [key, "kind"], order, steps), order, steps)
    own = members.where("rid = home").select("home", key, "kind", "seq", text("canonical").alias("canonical"), F.coalesce("variants", empty()).alias("own"), text("hint").alias("own_hint"))
    more = members.groupBy("home").agg((F.count(F.lit(1)) > 1).alias("cross_file"), F.min_by("category", F.when(text("category") != "", F.col("seq"))).alias("category"))
    # the list so far goes before the names of the row that joins
    said = F.when(F.col("rid") == F.col("home"), F.coalesce("variants", empty())).otherwise(names())
    each = members.select("home", "seq", F.posexplode(said).alias("at", "name")).where("name != ''")
    known = listed(each, "home", "name", F.struct("seq", "at"), "names")
    out = own.join(more, "home").join(known, "home", "left").join(_hints(members), "home", "left")
    joined = F.filter(F.coalesce("names", empty()), lambda n: n != F.col("canonical"))
    out = out.select(key, "kind", "seq", "canonical", F.when(F.col("cross_file"), joined).otherwise(F.col("own")).alias("variants"), F.when(F.col("cross_file"), text("hint")).otherwise(F.col("own_hint")).alias("hint"), text("category").alias("category"), "cross_file")
    return steps.last(numbered(out, [key, "kind"], ["seq"], "ord", steps).select(key, "kind", *MERGED))


def apply_decrees(entities: DataFrame, decrees: DataFrame, key: str = "topic") -> DataFrame:
    """Decrees (key, ord, canonical, variants, note) lock the clusters
    that they name; decrees that share a canonical or a cluster act as one, under
    the name of the first. (key, ord, canonical, writings, hint, locked, note,
    conflict, source_ord); clusters that nothing names stay as they are, and
    decrees that name none come last."""
    steps = Steps(entities.sparkSession)
    bare = lambda: F.filter(F.transform(names(), strip_description), lambda n: n != "")
    rows = _with_rids(entities.select(key, "ord", "canonical", "variants", "hint").withColumn("bare", F.array_distinct(bare())), steps)
    orders = _with_rids(decrees.select(key, "ord", "canonical", "variants", "note").withColumn("own", strip_description(F.col("canonical"))).where("own != ''").withColumn("bare", bare()), steps)
    written = orders.select(key, F.col("rid").alias("d"), F.explode(F.array_distinct("bare")).alias("name"))
    # decrees that write a name which some row has are linked with the first of them, and rows hit that one only
    named = rows.select(key, "rid", F.explode("bare").alias("name"))
    used = steps.keep(meet(written, named.select(key, "name").distinct(), [key, "name"]))
    hits = steps.keep(meet(named, used.groupBy(key, "name").agg(F.min("d").alias("d")), [key, "name"]).select("rid", "d").distinct())
    edges = hub_edges(orders.select(key, "own", "rid"), [key, "own"], "rid").unionByName(hub_edges(used, [key, "name"], "d")).unionByName(hub_edges(hits, ["rid"], "d"))
    comp = components(edges, steps).select(F.col("node").alias("rid"), F.col("component").alias("home"))
    led = steps.keep(orders.join(comp, "rid", "left").withColumn("home", F.coalesce("home", "rid")).withColumn("seq", F.struct(F.lit(0).alias("part"), "ord", "rid")))
    first_hit = hits.groupBy("rid").agg(F.min("d").alias("d")).join(led.select(F.col("rid").alias("d"), "home"), "d").select("rid", "home")
    rows = steps.keep(rows.join(first_hit, "rid", "left"))
    eaten = rows.where("home is not null").withColumn("seq", F.struct(F.lit(1).alias("part"), "ord", "rid"))
    said = led.select("home", "seq", F.posexplode("bare").alias("at", "name")).unionByName(eaten.select("home", "seq", F.posexplode(names()).alias("at", "name"))).where("name != ''")
    note = F.when(text("note") != "", F.col("seq"))
    heads = led.groupBy("home", key).agg(F.min_by("own", "seq").alias("canonical"), F.min("seq").alias("seq"), F.min_by("note", note).alias("note"), (F.min("own") != F.max("own")).alias("several"))
    sources = eaten.groupBy("home").agg(F.min("ord").alias("source_ord"), F.min("seq").alias("at"))
    out = heads.join(listed(said, "home", "name", F.struct("seq", "at"), "names"), "home").join(sources, "home", "left").join(_hints(eaten), "home", "left")
    # by place: rows and what replaces their first row, then the decrees without rows
    last = F.col("source_ord").isNull()
    out = out.select(key, "canonical", F.filter("names", lambda n: n != F.col("canonical")).alias("writings"), text("hint").alias("hint"), F.lit(True).alias("locked"), text("note").alias("note"), (~last & F.col("several")).alias("conflict"), F.coalesce("source_ord", F.lit(-1).cast("long")).alias("source_ord"), F.struct(last.alias("last"), F.coalesce("at.ord", "seq.ord").alias("o"), F.coalesce("at.rid", "seq.rid").alias("r")).alias("place"))
    free = rows.where("home is null").select(key, "canonical", F.coalesce("variants", empty()).alias("writings"), text("hint").alias("hint"), F.lit(False).alias("locked"), F.lit("").alias("note"), F.lit(False).alias("conflict"), F.col("ord").alias("source_ord"), F.struct(F.lit(False).alias("last"), F.col("ord").alias("o"), F.col("rid").alias("r")).alias("place"))
    return steps.last(numbered(free.unionByName(out), [key], ["place"], "ord", steps).select(key, *LOCKED))
