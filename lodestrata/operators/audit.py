"""Fidelity audit of a refined text against its source.

Rules are columns or joins on shingles; every rule gives findings of one
shape (id, name, severity, n), which are unioned. Thresholds that the
behaviour does not fix are constants here.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestrata.functions.text import HAN, WS, content_length, occurrences
from lodestrata.operators.names import name_hits
from lodestrata.operators.turns import inside, islands, lines

COMPRESSION_FLOOR = 0.55
GAP_CHARS, GAP_TURNS = 400, 3
SHINGLE, MATCHED = 3, 0.5
LONG_PARAGRAPH = 900
IDENTICAL_LINE = 25
MOST_CONFLICTS = 10

#: Fixed patterns: what refined prose should not hold (name, pattern, severity).
CLEAN_RULES = (
    ("confirmation_repeat", "(对对对|是是是|嗯嗯|好好好)", "hard"),
    ("filler", "(^|[，。])(嗯|呃|啊)[，。]", "hard"),
    ("phrase_repeat", "([一-龥]{2,6})[，、]?\\1[，、]?\\1", "hard"),
    ("stutter", "(?<!可)(就就|我我|他他|你你|这这|那那|是是)", "hard"),
    ("repeated_year", "((?:19|20)[0-9]{2}年)[，、]?\\1", "hard"),
    ("broken_start", "(?m)^[，。、；]", "hard"),
    ("modal", "[吧呢嘛][。，]", "soft"),
    ("empty_phrase", "(这个|那个|就是说|然后呢)", "soft"),
)
#: What one of must stand in a text for a rule to be met there: looked for first, as that takes far less than the pattern.
NEEDED = {
    "confirmation_repeat": ("对对对", "是是是", "嗯嗯", "好好好"), "filler": ("嗯", "呃", "啊"), "stutter": ("就就", "我我", "他他", "你你", "这这", "那那", "是是"), "repeated_year": ("年",),
    "broken_start": ("，", "。", "、", "；"), "modal": ("吧", "呢", "嘛"), "empty_phrase": ("这个", "那个", "就是说", "然后呢"),
    "model_marker": ("（", "[略]", "[省略]", "[omitted]", "<!--"), "quote_style": ('"', "「", "」", "『", "』"), "empty_words": ("就是说", "这个", "那个", "然后呢", "的话", "对吧", "嗯", "呃"),
}
MODEL_MARKS = r"（(此处|以下|略|省略|内容)[^）]*）|\[(略|省略|omitted)\]|<!-- *(omitted|gap)"
#: Empty words of which a refined text should keep few, and how many must be there to tell.
EMPTY_WORDS = "(就是说|这个|那个|然后呢|的话|对吧|嗯|呃)"
EMPTY_LEAST, EMPTY_REDUCTION = 4, 0.25
#: Rules that fail a pair; the others are reported.
GATES = ("content_gap", "quote_style", "compression", "under_refined", "ending_missing")
HEDGES = "(我觉得|可能|大概|也许|应该|好像|似乎|据说|估计|差不多|左右)"


def prose(text: Column) -> Column:
    """Lines that are no heading, quotation or comment."""
    kept = F.filter(F.split(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), "\n", -1), lambda x: ~x.rlike(r"\A(#|>)"))
    return F.array_join(kept, "\n")


def counted(text: Column, rule: str, pattern: str, searched: Column | None = None) -> Column:
    """How often ``pattern`` is met in a text (or in ``searched``, what is left
    of it), which is searched only if it holds what the rule needs."""
    n = F.regexp_count(text if searched is None else searched, F.lit(pattern))
    if rule not in NEEDED:
        return n
    return F.when(reduce(or_, (F.contains(text, F.lit(x)) for x in NEEDED[rule])), n).otherwise(0)


def met_rules(counts: dict[str, tuple[Column, str]]) -> Column:
    """The findings (name, severity, n) of a row, as an array."""
    items = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(s).alias("severity"), n.cast("long").alias("n")) for k, (n, s) in counts.items()])
    return F.filter(items, lambda x: x["n"] > 0)


def findings(pairs: DataFrame, id_col: str, counts: dict[str, tuple[Column, str]]) -> DataFrame:
    """One row for each rule that is met, in one pass."""
    return pairs.select(id_col, F.explode(met_rules(counts)).alias("f")).select(id_col, "f.*")


def cleanliness(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """D3, D4."""
    body = prose(F.col(text_col))
    rules = {name: (counted(F.col("body"), name, pattern), severity) for name, pattern, severity in CLEAN_RULES}
    rules["long_paragraph"] = (F.size(F.filter(F.split("body", "\n", -1), lambda p: F.length(p) > LONG_PARAGRAPH)), "hard")
    return findings(docs.withColumn("body", body), id_col, rules)


def quote_style(text: Column) -> dict[str, tuple[Column, str]]:
    """Straight quotes beside Han characters, and corner brackets, outside code and links."""
    masked = F.regexp_replace(text, r"(?s)```.*?```|`[^`]*`|https?://[^\s)]+|\]\([^)]*\)", "")
    return {"quote_style": (counted(text, "quote_style", f'{HAN}"|"{HAN}|[「」『』]', masked), "hard")}


def label_style(text: Column) -> dict[str, tuple[Column, str]]:
    """Bold and plain speaker labels mixed."""
    bold = F.regexp_count(text, F.lit(r"(?m)^\*\*[^*\n]{1,12}(\*\*[：:]|[：:]\*\*)"))
    plain = F.regexp_count(text, F.lit(r"(?m)^[一-龥A-Za-z0-9·]{1,12}[：:]"))
    return {"label_style": (F.when((bold >= 3) & (plain >= 3), F.least(bold, plain)).otherwise(0), "soft")}


def pair_ratios(source: Column, refined: Column, summary: bool = False, sizes: tuple[Column, Column] | None = None) -> dict[str, tuple[Column, str]]:
    """Compression below the floor, and marks that a model leaves.
    ``sizes`` are the content lengths of both texts where they are known."""
    of_source, of_refined = sizes or (content_length(source), content_length(refined))
    ratio = of_refined / F.greatest(of_source, F.lit(1))
    low = F.when(ratio < COMPRESSION_FLOOR, 1).otherwise(0)
    return {"compression": (F.lit(0) if summary else low, "hard"), "model_marker": (counted(refined, "model_marker", MODEL_MARKS), "soft")}


def ghost_names(docs: DataFrame, glossary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Variants (canonical, variant) that stand in a text outside their canonical."""
    hits = name_hits(docs, [id_col], text_col, glossary.where(F.col("variant") != F.col("canonical")).select("canonical", "variant"), "variant")
    met = hits.join(docs.select(id_col, text_col), id_col)
    left = occurrences(F.replace(F.col(text_col), F.col("canonical"), F.lit("")), F.col("variant"))
    return met.select(id_col, "canonical", "variant", left.alias("n")).where("n > 0")


def hedges(text: Column) -> Column:
    """D17."""
    return F.regexp_count(text, F.lit(HEDGES)).cast("long")


def shingled(rows: DataFrame, keys: list[str], text_col: str, words: bool, k: int = SHINGLE) -> DataFrame:
    """(keys, shingle) distinct: runs of k words, or of k Han characters and letters."""
    parts = F.filter(F.split(F.lower(text_col), rf"{WS}+", -1), lambda w: w != "") if words else F.split(F.regexp_replace(text_col, "[^一-龥A-Za-z0-9]", ""), "")
    sh = F.transform(F.sequence(F.lit(0), F.greatest(F.size("parts") - k, F.lit(0))), lambda i: F.array_join(F.slice(F.col("parts"), i + 1, k), " "))
    return rows.withColumn("parts", parts).select(*keys, F.explode(F.array_distinct(sh)).alias("shingle"))


def matched_turns(turns: DataFrame, refined: DataFrame, id_col: str, words: bool) -> DataFrame:
    """(id, turn_no, matched): the share of a turn's shingles that the
    refined text holds. ``turns`` has (id, turn_no, text), ``refined`` (id, text).
    Both sides meet in one aggregate by (id, shingle): a shingle's row says
    whether the refined text has it and which turns do."""
    mine = shingled(turns, [id_col, "turn_no"], "text", words)
    have = shingled(refined, [id_col], "text", words).select(id_col, F.lit(None).cast(mine.schema["turn_no"].dataType).alias("turn_no"), "shingle")
    met = mine.unionByName(have).groupBy(id_col, "shingle").agg(F.bool_or(F.col("turn_no").isNull()).alias("found"), F.collect_set("turn_no").alias("turns"))
    each = met.select(id_col, F.explode("turns").alias("turn_no"), F.col("found").cast("int").alias("found"))
    return each.groupBy(id_col, "turn_no").agg((F.sum("found") / F.count(F.lit(1))).alias("matched"))


def coverage_gaps(turns: DataFrame, refined: DataFrame, id_col: str, words: bool) -> DataFrame:
    """Runs of lost turns (id, first, last, turns, chars, severity)."""
    share = matched_turns(turns, refined, id_col, words)
    sized = turns.select(id_col, "turn_no", F.length("text").alias("chars"))
    marked = sized.join(share, [id_col, "turn_no"]).withColumn("lost", F.col("matched") < MATCHED)
    runs = islands(marked, [id_col], "turn_no", "lost").where("lost").select(id_col, "first", "last")
    chars = inside(marked, "turn_no", runs, "first", "last", [id_col])
    out = chars.groupBy(id_col, "first", "last").agg(F.count(F.lit(1)).alias("turns"), F.sum("chars").alias("chars"))
    return out.withColumn("severity", F.when((F.col("chars") >= GAP_CHARS) & (F.col("turns") >= GAP_TURNS), "hard").otherwise("soft"))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, least: int = IDENTICAL_LINE) -> DataFrame:
    """Lines of some length that stand in a text more than once."""
    long = lines(docs, id_col, text_col).where(F.length("line") >= least)
    return long.groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def numeric_conflicts(observed: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo, hi) whose intervals do not all meet: some
    two are apart exactly when the largest low lies above the smallest high."""
    return observed.groupBy(*keys).agg(F.max("lo").alias("max_lo"), F.min("hi").alias("min_hi"), F.count(F.lit(1)).alias("n")).where("max_lo > min_hi")


def cross_file_conflicts(observed: DataFrame, file: str, *keys: str) -> DataFrame:
    """Conflicts between different files: each file's own extremes are
    compared with those of the others."""
    per = observed.groupBy(*keys, file).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    # only the two largest lows and the two smallest highs of a key can tell
    w = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = per.withColumns({"top": w(F.desc("lo"), file), "low": w("hi", file)})
    two = lambda c, at: F.collect_list(F.when(F.col(at) <= 2, F.struct(c, file)))
    ends = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), two("lo", "top").alias("tops"), two("hi", "low").alias("lows"))
    apart = F.exists("tops", lambda t: F.exists("lows", lambda u: (t[file] != u[file]) & (t["lo"] > u["hi"])))
    return ends.where(apart).select(*keys, "n_files")


def most_conflicts(conflicts: DataFrame, key: str, order: str, n: int = MOST_CONFLICTS) -> DataFrame:
    """The first conflicts of each document, so that a list stays readable."""
    return conflicts.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rn") <= n).drop("rn")


def unmatched_figures(derived: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, value) of a derived text that the corpus (value) does not hold."""
    return derived.join(corpus.select("value").distinct(), "value", "left_anti")


def plan_coverage(headings: DataFrame, threads: DataFrame, id_col: str) -> DataFrame:
    """Headings (id, title) and what threads (id, sections) make
    of them: how often each is covered."""
    used = threads.select(id_col, F.explode("sections").alias("title")).withColumn("title", F.trim("title")).groupBy(id_col, "title").agg(F.count(F.lit(1)).alias("covered"))
    return headings.withColumn("title", F.trim("title")).join(used, [id_col, "title"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def displaced(order: Column) -> Column:
    """Places at which an order differs from the sorted one."""
    return F.size(F.filter(F.zip_with(order, F.array_sort(order), lambda a, b: a != b), lambda x: x)).cast("long")


def glossary_lint(entities: DataFrame, *keys: str) -> DataFrame:
    """Glossaries that are thin, or poor in hints or variants."""
    n = F.count(F.lit(1))
    share = lambda c: F.count_if(c) / n
    hint, variant = share(F.coalesce("hint", F.lit("")) != ""), share(F.size("variants") > 0)
    return entities.groupBy(*keys).agg(n.alias("n"), F.when(n < 3, "thin").when(hint < 0.5, "few_hints").when(variant < 0.3, "few_variants").otherwise("ok").alias("lint"))


def common_order(a: list, b: list) -> int:
    """Length of the longest common subsequence, repeats included. A row of the
    table of lengths is one integer, whose zero bits are the places where the
    length grows, so that an item of ``a`` costs a few operations on len(b) bits."""
    places: dict = {}
    for j, v in enumerate(b):
        places[v] = places.get(v, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for v in a:
        if met := row & places.get(v, 0):
            row = (row + met | row - met) & full
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def order_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence over that of the longer
    order; null orders are empty, two empty ones have 0."""
    orders = ((x if x is not None else [], y if y is not None else []) for x, y in zip(a, b, strict=True))
    return pd.Series([common_order(list(x), list(y)) / max(len(x), len(y), 1) for x, y in orders], dtype="float64")


def under_refined(source: Column, refined: Column, sizes: tuple[Column, Column] | None = None) -> dict[str, tuple[Column, str]]:
    """The length is kept, and so are nearly all the empty words."""
    before, after = (counted(c, "empty_words", EMPTY_WORDS) for c in (source, refined))
    of_source, of_refined = sizes or (content_length(source), content_length(refined))
    kept = of_refined >= COMPRESSION_FLOOR * of_source
    return {"under_refined": (F.when(kept & (before >= EMPTY_LEAST) & ((before - after) / before < EMPTY_REDUCTION), 1).otherwise(0), "hard")}


def turn_ratio(source_turns: DataFrame, refined_turns: DataFrame, id_col: str) -> DataFrame:
    """(id, source_turns, refined_turns, ratio): reported, never a gate."""
    n = lambda t, name: t.groupBy(id_col).agg(F.count(F.lit(1)).alias(name))
    both = n(source_turns, "source_turns").join(n(refined_turns, "refined_turns"), id_col, "left").withColumn("refined_turns", F.coalesce("refined_turns", F.lit(0).cast("long")))
    return both.withColumn("ratio", F.col("refined_turns") / F.col("source_turns"))


def pair_audit(pairs: DataFrame, id_col: str, more: DataFrame | None = None, summary: bool = False) -> DataFrame:
    """(id, status, failed, findings) of pairs (id, source, refined): the
    rules of a pair and of its refined text, and findings made elsewhere (id,
    name, severity, n) such as gaps and missing endings, in one list. A summary
    passes no gates."""
    source, refined = F.col("source"), F.col("refined")
    sizes = F.col("source_size_"), F.col("refined_size_")
    rules = pair_ratios(source, refined, summary, sizes) | ({} if summary else under_refined(source, refined, sizes)) | quote_style(refined) | label_style(refined)
    body = pairs.withColumns({"refined_body": prose(refined), "source_size_": content_length(source), "refined_size_": content_length(refined)})
    clean = {name: (counted(F.col("refined_body"), name, pattern), severity) for name, pattern, severity in CLEAN_RULES}
    gate = lambda f: F.lit(False) if summary else (f["severity"] == "hard") & f["name"].isin(*GATES, *(n for n, _, s in CLEAN_RULES if s == "hard"))
    if more is None:  # a pair's findings stay in its row
        out = body.select(id_col, met_rules(rules | clean).alias("findings"))
        out = out.withColumn("failed", F.array_sort(F.transform(F.filter("findings", gate), lambda f: f["name"])))
    else:
        found = findings(body, id_col, rules | clean).unionByName(more.select(id_col, "name", "severity", F.col("n").cast("long").alias("n")))
        found = found.select(id_col, F.struct("name", "severity", "n").alias("f"))
        per = found.groupBy(id_col).agg(F.array_sort(F.collect_set(F.when(gate(F.col("f")), F.col("f.name")))).alias("failed"), F.array_sort(F.collect_list("f")).alias("findings"))
        out = pairs.select(id_col).join(per, id_col, "left")
    failed = F.coalesce("failed", F.array().cast("array<string>"))
    return out.select(id_col, F.when(F.size(failed) > 0, "fail").otherwise("ok").alias("status"), failed.alias("failed"), F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_findings"))


def repair_plan(first: DataFrame, second: DataFrame, id_col: str) -> DataFrame:
    """(id, repaired, annotated, run_failed): a pair that fails is repaired
    once and audited again; what fails then is annotated, and the run has failed."""
    again = second.select(id_col, F.col("status").alias("status2"))
    both = first.join(again, id_col, "left")
    repaired = F.col("status") == "fail"
    still = repaired & (F.coalesce("status2", F.lit("fail")) == "fail")
    return both.select(id_col, repaired.alias("repaired"), still.alias("annotated"), still.alias("run_failed"))


def line_runs(docs: DataFrame, id_col: str, text_col: str, kept: str = HAN) -> DataFrame:
    """D2 for texts of any length: (id, line_no, first, last): the places, from
    0, that the characters of one kind on a line take when a text's remarks and
    all other characters are left out. One row a line, by running sums; lines
    without such characters have none."""
    bare = docs.select(id_col, F.regexp_replace(F.coalesce(text_col, F.lit("")), r"(?s)<!--.*?-->", "").alias("bare_"))
    rows = lines(bare, id_col, "bare_").select(id_col, "line_no", F.regexp_count("line", F.lit(kept)).cast("long").alias("n_"))
    ends = F.sum("n_").over(Window.partitionBy(id_col).orderBy("line_no"))
    return rows.where("n_ > 0").withColumn("last", ends - 1).select(id_col, "line_no", (F.col("last") - F.col("n_") + 1).alias("first"), "last")


def line_map(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, norm, line_of): a text's Han characters, remarks left out, and
    the line of each of them."""
    kept = F.regexp_replace(text_col, r"(?s)<!--.*?-->", "")
    rows = docs.select(id_col, F.posexplode(F.split(kept, "\n", -1)).alias("line_no", "line"))
    chars = rows.withColumn("h", F.regexp_extract_all("line", F.lit(HAN), F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "h")))
    got = chars.groupBy(id_col).agg(ordered.alias("l"))
    lines_of = F.flatten(F.transform("l", lambda x: F.array_repeat(x["line_no"].cast("long") + 1, F.size(x["h"]))))
    return got.select(id_col, F.array_join(F.flatten(F.col("l.h")), "").alias("norm"), lines_of.alias("line_of"))


#: Labels of where a derived figure comes from, and units that are of a size.
INTERVIEW, PUBLIC = "【[^】]*访谈[^】]*】", "【[^】]*公开[^】]*】"
DATE_UNITS = ("年", "月", "日")


def derivative_attribution(corpus: DataFrame, derived: DataFrame, id_col: str) -> DataFrame:
    """(id, line_no, value, unit, tier): figures of derived lines that no
    corpus figure of the same unit covers. Corpus has (id, lo, hi, unit),
    derived (id, line_no, line, lo, hi, unit, value). A figure labelled as said
    in the interview fails, a public one is for the reporter, one without label
    or unit is for review; dates are never flagged, and a figure counts once a line."""
    said = corpus.select(id_col, "unit", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi")).distinct()
    figures = derived.where(~F.coalesce("unit", F.lit("")).isin(*DATE_UNITS))
    covered = figures.join(said, [id_col, "unit"]).where("lo >= c_lo and hi <= c_hi").select(id_col, "line_no", "value", "unit").distinct()
    lacking = figures.join(covered, [id_col, "line_no", "value", "unit"], "left_anti")
    public, interview = F.col("line").rlike(PUBLIC), F.col("line").rlike(INTERVIEW)
    tier = F.when(F.col("unit") == "", "review").when(public, "reporter").when(interview, "hard").otherwise("review")
    return lacking.select(id_col, "line_no", "value", "unit", tier.alias("tier")).distinct()
