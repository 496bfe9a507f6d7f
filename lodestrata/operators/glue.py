"""Small operators between the stages: lines, lookups, guards and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import HAN, WS, occurrences, strip_description
from lodestrata.operators.entities import names_of

#: Stages that can be asked for, and those that need refined text.
SCOPES = ("scout", "verify", "refine", "logic", "summary", "timeline")
NEED_REFINED = ("logic", "summary", "timeline")
DANGEROUS = ("engine", "__engine", "command", "shell", "env")
LEAST_CHUNK = 2000


def contested_clause(literal: Column, literal_tier: Column, correction: Column, correction_tier: Column) -> Column:
    """both readings of a contested name as one clause."""
    return F.format_string("⚠ 同指两解：字面「%s」（%s）／改写「%s」（%s）", literal, literal_tier, correction, correction_tier)


def parse_contested(clause: Column) -> Column:
    """F22 undone."""
    shape = "同指两解：字面「([^」]*)」（([^）]*)）／改写「([^」]*)」（([^）]*)）"
    return F.struct(*[F.regexp_extract(clause, shape, i + 1).alias(k) for i, k in enumerate(("literal", "literal_tier", "correction", "correction_tier"))])


def list_line(canonical: Column, variants: Column, hint: Column, public: Column, suspect: Column) -> Column:
    """one entity of a list that a stage is given."""
    shown = F.when(F.size(variants) > 0, F.array_join(variants, " / ")).otherwise("（无变体）")
    return F.concat(F.lit("- "), canonical, F.lit(" ← "), shown, F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit(" ｜ "), hint)).otherwise(""), F.when(public, " ｜ 公众人物").otherwise(""), F.when(suspect, " ｜ ⚠ 疑误写").otherwise(""))


def coverage_ratio(entities: DataFrame, prior_names: DataFrame, floor: float = 0.10) -> DataFrame:
    """(key, unknown, total, skip): the share of entities that no prior
    row (key, name) names, and whether that is too small for another pass."""
    named = entities.select("key", "ord", F.explode(names_of(F.col("canonical"), F.col("variants"))).alias("n")).withColumn("name", strip_description(F.col("n")))
    known = named.join(prior_names.select("key", strip_description(F.col("name")).alias("name")).distinct(), ["key", "name"], "left_semi").select("key", "ord").distinct().withColumn("known", F.lit(1))
    got = entities.join(known, ["key", "ord"], "left").groupBy("key").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.count(F.lit(1)).alias("total"))
    return got.withColumn("skip", F.col("unknown") <= floor * F.col("total"))


def preserved(lines_: DataFrame) -> DataFrame:
    """Lines (key, title, ord, line) distinct in order, per title."""
    first = lines_.groupBy("key", "title", "line").agg(F.min("ord").alias("ord"))
    return first.groupBy("key", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("lines"))


def issue_counts(items: DataFrame, key: str) -> DataFrame:
    """Title -> number, as a map."""
    n = items.groupBy(key, "title").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("title", "n")))).alias("issues"))


def category_warnings(decrees: DataFrame, entities: DataFrame) -> DataFrame:
    """Decrees (ord, category, name) that miss their category but meet
    another one: persons before brands before terms."""
    rank = F.when(F.col("kind") == "person", 0).when(F.col("kind") == "brand", 1).otherwise(2)
    named = entities.select("kind", F.explode(names_of(F.col("canonical"), F.col("variants"))).alias("name")).distinct()
    hits = decrees.join(named, "name").groupBy("ord", "category", "name").agg(F.bool_or(F.col("kind") == F.col("category")).alias("right"), F.min_by("kind", rank).alias("found"))
    return hits.where("not right").drop("right")


def trusted(entities: DataFrame, speakers: DataFrame) -> DataFrame:
    """Suspects are trusted when a form of theirs is a speaker's label with Han letters."""
    labels = speakers.where(F.col("label").rlike(HAN)).select(strip_description(F.col("label")).alias("name")).distinct()
    named = entities.select("ord", F.explode(names_of(F.col("canonical"), F.col("variants"))).alias("n")).withColumn("name", strip_description(F.col("n")))
    ok = named.join(labels, "name", "left_semi").select("ord").distinct().withColumn("trusted", F.lit(True))
    return entities.join(ok, "ord", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def heading_orders(threads: DataFrame, headings: DataFrame, id_col: str) -> DataFrame:
    """A section's explicit order if given, else the place of its title."""
    place = headings.select(id_col, "title", F.col("line_no").alias("place"))
    return threads.join(place, [id_col, "title"], "left").withColumn("order", F.coalesce("source_order", "place")).drop("place")


def exact_edit(text: Column, old: Column, new: Column, every: Column) -> Column:
    """K7: (text, error): the old string must be there once unless every place is meant."""
    n = occurrences(text, old)
    error = F.when(F.coalesce(old, F.lit("")) == "", "empty").when(n == 0, "missing").when((n > 1) & ~every, "ambiguous")
    return F.struct(F.when(error.isNull(), F.replace(text, old, new)).otherwise(text).alias("text"), error.alias("error"))


def inside(path: Column, roots: list[str]) -> Column:
    """K8: lexical containment in a root; parent steps are refused."""
    held = [(path == r.rstrip("/")) | F.startswith(path, F.lit(r.rstrip("/") + "/")) for r in roots]
    out = held[0]
    for h in held[1:]:
        out = out | h
    return out & ~path.rlike(r"(\A|/)\.\.(/|\z)")


def scope_error(scope: list[str], files: int) -> str | None:
    """What is wrong with a run's scope."""
    if not files:
        return "no files"
    if unknown := [s for s in scope if s not in SCOPES]:
        return f"unknown: {', '.join(unknown)}"
    if "refine" not in scope and (asked := [s for s in scope if s in NEED_REFINED]):
        return f"needs refine: {', '.join(asked)}"
    return None


def chunk_size(value: str) -> int | None:
    """A whole number of LEAST_CHUNK or more, else nothing."""
    return int(value) if value.isascii() and value.isdigit() and int(value) >= LEAST_CHUNK else None


def chunk_sizes(value: Column) -> Column:
    """P17 over a column: a whole number of LEAST_CHUNK or more, else null."""
    n = F.when(value.rlike(r"\A[0-9]{1,18}\z"), value.cast("long"))
    return F.when(n >= LEAST_CHUNK, n)


def scope_errors(scope: Column, files: Column) -> Column:
    """P13 over columns: what is wrong with a run's scope (an array), null if nothing."""
    unknown = F.array_except(scope, F.array(*map(F.lit, SCOPES)))
    asked = F.filter(scope, lambda s: s.isin(*NEED_REFINED))
    return (
        F.when(F.coalesce(files, F.lit(0)) == 0, "no files")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ", ")))
        .when(~F.array_contains(scope, "refine") & (F.size(asked) > 0), F.concat(F.lit("needs refine: "), F.array_join(asked, ", ")))
    )


def safe_params(params: DataFrame) -> DataFrame:
    """P14."""
    return params.drop(*DANGEROUS)


def complete_rows(resolved: DataFrame) -> DataFrame:
    """Rows with a query and a canonical."""
    full = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    return resolved.where(full("query") & full("canonical"))


def unlocked(entities: DataFrame) -> DataFrame:
    """P10."""
    return entities.where(~F.coalesce("locked", F.lit(False)))


def prior_text(inline: Column, stored: Column, fresh: Column) -> Column:
    """The text at hand, else the stored one; a fresh run has none."""
    return F.when(~F.coalesce(fresh, F.lit(False)), F.coalesce(F.nullif(inline, F.lit("")), stored))


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order in which they are first met."""
    return rows.groupBy(value).agg(F.min(order).alias("first"))


def seams(parts: DataFrame, key: str) -> DataFrame:
    """Places where a part begins with the line that the last one ended with."""
    last = F.element_at(F.split(F.regexp_replace("text", rf"{WS}+\z", ""), "\n"), -1)
    w = Window.partitionBy(key).orderBy("idx")
    return parts.withColumn("before", F.lag(last).over(w)).where(F.get(F.split("text", "\n"), F.lit(0)) == F.col("before")).select(key, "idx", F.col("before").alias("line"))


def union_less(names: Column, more: Column, canonical: Column) -> Column:
    """Distinct names of both, in order, without the canonical."""
    return F.array_except(F.array_distinct(F.concat(names, more)), F.array(canonical))


def settled(resolved: DataFrame, prior: DataFrame, reopened: DataFrame) -> DataFrame:
    """Names that are settled: resolved queries and canonicals, names of
    verified and user rows, less those for recheck, contested or reopened."""
    done = resolved.select(F.col("query").alias("name")).union(resolved.select("canonical"))
    of = lambda *levels: prior.where(F.col("confidence").isin(*levels)).select(F.explode(names_of(F.col("canonical"), F.col("variants"))).alias("name"))
    bare = lambda df: df.select(strip_description(F.col("name")).alias("name")).where("name != ''")
    return bare(done.union(of("verified", "user"))).distinct().join(bare(of("recheck", "contested").union(reopened.select("name"))).distinct(), "name", "left_anti")


def plan_verdict(threads: Column, missing: Column, repeated: Column, ratio: Column, n: Column) -> Column:
    """Whether a reordering plan holds: three to seven threads, nothing
    missing or repeated, and, of eight sections or more, a real change of order."""
    return (F.size(threads) >= 3) & (F.size(threads) <= 7) & (missing == 0) & (repeated == 0) & ~((n >= 8) & (ratio > 0.85))


def provenance(refined_size: Column, logic_size: Column, same_order: Column, has_source: Column) -> Column:
    """Findings on a reordered draft: longer than its text, in the same
    order, or without its sources."""
    return F.array_compact(F.array(F.when(logic_size > 1.10 * refined_size, "longer"), F.when(same_order > 0.85, "same_order"), F.when(~has_source, "no_provenance")))


#: How much effort each stage is given where nothing else is asked for.
EFFORTS = {"scout": "low", "verify": "high", "dedup": "high", "refine": "high", "stitch": "low", "logic": "high", "summary": "high", "timeline": "high"}


def effort(stage: Column, asked: Column) -> Column:
    """what was asked for (a map by stage), else the stage's own; an empty
    string that was asked for counts."""
    own = F.create_map(*(F.lit(x) for pair in EFFORTS.items() for x in pair))
    return F.coalesce(F.element_at(asked, stage), F.element_at(own, stage))


def suspect_question(members: Column, kind: Column, why: Column) -> Column:
    """the question that a flagged group of names leaves open."""
    return F.concat(F.lit("疑似同指（"), kind, F.lit("）："), F.array_join(members, " ／ "), F.lit(" 是否指同一对象？（"), why, F.lit("）——脚本未自动合并，请确认"))


def contested_question(spoken: Column, literal: Column, literal_tier: Column, correction: Column, correction_tier: Column) -> Column:
    """both readings of a contested name, for someone to decide."""
    return F.concat(F.lit("〔同指两解〕"), spoken, F.lit("：A="), literal, F.lit("（"), literal_tier, F.lit("）；B="), correction, F.lit("（"), correction_tier, F.lit("）——正文已保留口播形并标注，请定夺"))
