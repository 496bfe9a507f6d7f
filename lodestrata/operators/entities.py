"""Entities: verification state, contradictions and registries, as joins and
aggregates on exploded names. Clusters, merging and decrees are in ``clusters``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import CUT_MARK, MOST_NOTES, SPACES, WARNING, is_concrete_source, is_weak_key, merge_hints, strip_description
from lodestrata.operators.clusters import apply_decrees, cluster_entities, merge_entities  # noqa: F401  # part of this module's interface

def joined_hints(hints: list[str]) -> str:
    """A5 over a list, in order."""
    clauses = dict.fromkeys(c for h in hints if h for c in (p.strip(SPACES) for p in h.split("；")) if c)
    plain = [c for c in clauses if WARNING not in c]
    warned = [c for c in clauses if WARNING in c and c != CUT_MARK]
    return "；".join(plain[:MOST_NOTES] + warned + ([CUT_MARK] if CUT_MARK in clauses or len(plain) > MOST_NOTES else []))


def names_of(canonical: Column, variants: Column) -> Column:
    return F.concat(F.array(canonical), F.coalesce(variants, F.array().cast("array<string>")))


def strong_names(canonical: Column, variants: Column) -> Column:
    """Names that are no weak key, remarks stripped."""
    return F.filter(F.transform(names_of(canonical, variants), strip_description), lambda n: (n != "") & ~is_weak_key(n))


def exclude_settled(entities: DataFrame, settled: DataFrame) -> DataFrame:
    """Entities none of whose stripped names is settled (key, name)."""
    named = entities.select("key", "ord", F.explode(names_of(F.col("canonical"), F.col("variants"))).alias("n")).withColumn("name", strip_description(F.col("n")))
    gone = named.join(settled.select("key", strip_description(F.col("name")).alias("name")).where("name != ''"), ["key", "name"], "left_semi").select("key", "ord").distinct()
    return entities.join(gone, ["key", "ord"], "left_anti")


def first_hit(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """The conclusion of the first of an entity's names that has one; of
    resolved (key, query, canonical as hit_canonical, identity, source, two_key)."""
    named = entities.select("key", "ord", F.posexplode(names_of(F.col("canonical"), F.col("variants"))).alias("pos", "query"))
    hits = named.join(resolved, ["key", "query"]).groupBy("key", "ord").agg(F.min_by(F.struct("hit_canonical", "identity", "source", "two_key"), "pos").alias("hit"))
    return entities.join(hits, ["key", "ord"], "left")


def applied_conclusions(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entities (key, ord, kind, canonical, variants, hint, locked,
    confidence, confidence_date) with the conclusions that they may take, and
    the confidence mark that follows."""
    e = first_hit(entities, resolved)
    new, bare = F.col("hit.hit_canonical"), strip_description(F.col("hit.hit_canonical"))
    strong = strong_names(F.col("canonical"), F.col("variants"))
    fixed = F.coalesce(F.col("locked"), F.lit(False)) | (F.col("confidence") == "user")
    hit = F.col("hit").isNotNull() & ~fixed
    contested = (F.col("confidence") == "contested") & (bare != strip_description(F.col("canonical"))) & ~F.coalesce(F.col("hit.two_key"), F.lit(False))
    stranger = (F.col("kind") == "person") & (F.size(strong) > 0) & ~is_weak_key(bare) & ~F.array_contains(strong, bare)
    e = e.withColumn("rejected", hit & (contested | stranger)).withColumn("applied", hit & ~F.col("rejected"))
    old = F.array_except(F.array_distinct(names_of(F.col("canonical"), F.col("variants"))), F.array(new))
    tag = F.col("hit.identity")
    tagged = F.when(F.coalesce(tag, F.lit("")) == "", F.col("hint")).when(F.contains(F.coalesce("hint", F.lit("")), tag), F.col("hint")).otherwise(F.concat_ws("；", tag, F.nullif(F.col("hint"), F.lit(""))))
    verified = F.lit("verified")
    mark = (
        F.when(fixed, "user")
        .when(F.col("confidence") == "contested", F.when(F.col("applied") & F.coalesce(F.col("hit.two_key"), F.lit(False)), verified).otherwise("contested"))
        .when(F.col("applied") & is_concrete_source(F.col("hit.source")), verified)
        .when(F.col("hit").isNotNull(), "recheck")
        .when(F.col("confidence").isin("verified", "recheck"), F.col("confidence"))
        .otherwise("unknown")
    )
    return e.select("key", "ord", F.when(F.col("applied"), new).otherwise(F.col("canonical")).alias("canonical"), F.when(F.col("applied"), old).otherwise(F.col("variants")).alias("variants"), F.when(F.col("applied"), tagged).otherwise(F.col("hint")).alias("hint"), "applied", "rejected", mark.alias("confidence"))


def contradictions(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Verified prior rows with the first fresh row that shares a strong name and brings one more."""
    a = prior.where("confidence = 'verified'").select("key", "ord", "canonical", strong_names(F.col("canonical"), F.col("variants")).alias("s"))
    b = fresh.select("key", F.col("ord").alias("fresh_ord"), strong_names(F.col("canonical"), F.col("variants")).alias("t"))
    named = lambda d, c: d.withColumn("name", F.explode(F.array_distinct(c)))
    met = named(a, "s").join(named(b, "t"), ["key", "name"]).where(F.size(F.array_except("t", "s")) > 0).select("key", "ord", "canonical", "fresh_ord", F.array_except("t", "s").alias("writings"))
    return met.groupBy("key", "ord", "canonical").agg(F.min_by("writings", "fresh_ord").alias("writings"))


def weak_duplicates(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of weak names only that meet on the stripped canonical."""
    weak = lambda d: d.where(F.size(strong_names(F.col("canonical"), F.col("variants"))) == 0).select("key", "ord", strip_description(F.col("canonical")).alias("name"))
    first = weak(prior).groupBy("key", "name").agg(F.min("ord").alias("prior_ord"))
    return weak(fresh).join(first, ["key", "name"]).select("key", "name", "ord", "prior_ord")


def glossary_conflicts(prior: DataFrame, resolved: DataFrame) -> DataFrame:
    """Conclusions that disagree with the first prior row that has their query."""
    named = prior.select("key", "ord", "canonical", "variants", F.explode(names_of(F.col("canonical"), F.col("variants"))).alias("query"))
    first = named.groupBy("key", "query").agg(F.min_by(F.struct("canonical", "variants"), "ord").alias("p"))
    met = resolved.join(first, ["key", "query"])
    return met.where((F.col("hit_canonical") != F.col("p.canonical")) & ~F.array_contains("p.variants", F.col("hit_canonical")) & ~is_weak_key(F.col("p.canonical"))).select("key", "query", "hit_canonical", F.col("p.canonical").alias("prior_canonical"))


def unverified_suspects(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """J9."""
    named = entities.where("suspect").select("key", "ord", F.explode(names_of(F.col("canonical"), F.col("variants"))).alias("query"))
    known = named.join(resolved.select("key", "query"), ["key", "query"], "left_semi").select("key", "ord").distinct()
    return entities.where("suspect").join(known, ["key", "ord"], "left_anti")


def conclusions(rows: DataFrame) -> DataFrame:
    """One row a query: resolved before contested before unresolved, fresh before prior."""
    rank = F.when(F.col("kind") == "resolved", 0).when(F.col("kind") == "contested", 1).otherwise(2)
    w = Window.partitionBy("query").orderBy(rank, F.desc("is_fresh"), "ord")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def speaker_registry(speakers: DataFrame) -> DataFrame:
    """Labels that recur in two files or more, of (file, ord, label, role, identity)."""
    got = speakers.groupBy("label").agg(F.min_by("role", "ord").alias("role"), F.min_by("identity", F.when(F.coalesce("identity", F.lit("")) != "", F.col("ord"))).alias("identity"), F.count_distinct("file").alias("n_files"))
    return got.where("n_files >= 2")


def clean_suspects(suspects: DataFrame) -> DataFrame:
    """Groups of two distinct members or more, and what is done with them."""
    distinct = F.size(F.array_distinct(F.transform("members", strip_description))) >= 2
    kept = suspects.where(distinct & ~F.coalesce(F.col("why").rlike("撤回|不适用|不适合|不属于|仅供参考"), F.lit(False)))
    acts = F.col("kind").isin("term", "brand") & F.array_contains("members", F.col("preferred"))
    return kept.withColumn("route", F.when(F.coalesce(acts, F.lit(False)), "directive").otherwise("flag"))


def merged_suspects(suspects: DataFrame) -> DataFrame:
    """A10: one row a set of stripped members and kind: the last row, at the first place."""
    key = F.concat(F.array_join(F.array_sort(F.transform("members", strip_description)), "|"), F.lit("#"), F.col("kind"))
    return suspects.withColumn("sig", key).groupBy("sig").agg(F.max_by(F.struct("members", "kind", "why", "preferred"), "ord").alias("s"), F.min("ord").alias("ord")).select("ord", "sig", "s.*")


def vote(mentions: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """A1 as a relation: each group's most frequent name, longer names first on
    ties, then the one met first."""
    counted = mentions.where(F.trim(name) != "").groupBy(*keys, F.trim(name).alias("canonical")).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), F.desc(F.length("canonical")), "first")
    return counted.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "first")


#: The tag of a contested clause, and what stands for missing parts.
CONTESTED_TAG, NO_TIER, NO_CORRECTION = "⚠ 同指两解：", "级别未标", "待定"


def contested_of(entities: DataFrame, contested: DataFrame) -> DataFrame:
    """J2's lookup: (key, ord, literal, literal_tier, correction,
    correction_tier) of the entities that a contested conclusion (key, query,
    ...) names; the first of an entity's names that one has decides."""
    named = entities.select("key", "ord", "canonical", F.posexplode(names_of(F.col("canonical"), F.col("variants"))).alias("at", "query"))
    met = named.join(contested.dropDuplicates(["key", "query"]), ["key", "query"])
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    info = F.struct(filled("literal", F.col("canonical")).alias("literal"), filled("literal_tier", F.lit(NO_TIER)).alias("literal_tier"), filled("correction", F.lit(NO_CORRECTION)).alias("correction"), filled("correction_tier", F.lit(NO_TIER)).alias("correction_tier"))
    return met.groupBy("key", "ord").agg(F.min_by(info, "at").alias("info")).select("key", "ord", "info.*")


def apply_contested(entities: DataFrame, contested: DataFrame, clause) -> DataFrame:
    """Both readings as a clause of the hint (``clause`` of the four parts);
    entities whose hint has one already are left as they are."""
    info = contested_of(entities, contested)
    said = clause(F.col("literal"), F.col("literal_tier"), F.col("correction"), F.col("correction_tier"))
    hint = F.coalesce("hint", F.lit(""))
    new = F.when(F.col("literal").isNull() | F.contains(hint, F.lit(CONTESTED_TAG)), F.col("hint")).otherwise(merge_hints(hint, said))
    return entities.join(info, ["key", "ord"], "left").withColumn("hint", new).select(*entities.columns)


def reopened_writings(*checks: DataFrame) -> DataFrame:
    """(key, name) of every check, each once."""
    out = checks[0].select("key", "name")
    for c in checks[1:]:
        out = out.unionByName(c.select("key", "name"))
    return out.distinct()


def tagged_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (file_ord, section, ord, text) with their file's label,
    as one list: notes carry the label in front."""
    met = findings.join(files.select(F.col("ord").alias("file_ord"), "label"), "file_ord")
    return met.select("section", "file_ord", "ord", "label", F.when(F.col("section") == "notes", F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("text"))).otherwise(F.col("text")).alias("text"))
