"""The glossary document: entity tables to Markdown lines and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import strip_confidence, trim, trim_hint
from lodestrata.operators.turns import lines

#: The tables' titles, and the words of confidence marks.
TABLES = {"person": "人名（写法 → 统一）", "brand": "品牌 / 公司 / 产品（写法 → 统一）", "term": "术语 / 专名（写法 → 统一）"}
MARKS = {"user": "用户钦定", "recheck": "待复核", "verified": "核实", "contested": "同指两解"}
SHARED = "多份互证"
NONE = "—"


def entity_line(condensed: bool = False):
    """K1, K2: one entity as a line: name, variants, notes, marks."""
    hint = trim_hint(F.col("hint")) if condensed else F.col("hint")
    mark = F.coalesce(*[F.when(F.col("confidence") == k, F.concat(F.lit(f" 〔{word}"), F.when((F.lit(k) == "verified") & (F.coalesce("confidence_date", F.lit("")) != ""), F.concat(F.lit("·"), F.col("confidence_date"))).otherwise(""), F.lit("〕"))) for k, word in MARKS.items()], F.lit(""))
    variants = F.when(F.size("variants") > 0, F.array_join("variants", " / ")).otherwise(NONE)
    notes = F.concat(F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit(" ｜ "), hint)).otherwise(""), F.when(F.col("cross_file"), f" ｜ {SHARED}").otherwise(""))
    return F.concat(F.lit("- **"), F.col("canonical"), F.lit("** ← "), variants, notes, mark)


def render(entities: DataFrame, key: str, condensed: bool = False) -> DataFrame:
    """(key, text) of entities (key, kind, ord, canonical, variants, hint,
    cross_file, confidence, confidence_date). A glossary is one document."""
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(TABLES)], F.lit(9))
    title = F.coalesce(*[F.when(F.col("kind") == k, t) for k, t in TABLES.items()], F.col("kind"))
    rows = entities.select(key, order.alias("section"), "ord", title.alias("title"), entity_line(condensed).alias("line"))
    tables = rows.groupBy(key, "section", "title").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    whole = tables.select(key, "section", F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.array_join(F.col("l.line"), "\n")).alias("t"))
    return whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "t"))).alias("t")).select(key, F.array_join(F.col("t.t"), "\n\n").alias("text"))


def parse(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Entity lines back to rows; rows under other headings count as terms.
    The order of a kind is the order of its lines."""
    all_lines = lines(docs, key, text_col)
    heading = F.when(F.col("line").rlike(r"\A##\s"), F.regexp_replace("line", r"\A##\s+", ""))
    w = Window.partitionBy(key).orderBy("line_no")
    placed = all_lines.withColumn("title", F.last(heading, ignorenulls=True).over(w))
    shape = r"\A-\s+\*\*(.+?)\*\*\s*←\s*(.*)\z"
    rows = placed.where(F.col("line").rlike(shape)).withColumn("right", strip_confidence(F.regexp_extract("line", shape, 2)))
    kind = F.coalesce(*[F.when(F.col("title") == t, k) for k, t in TABLES.items()], F.lit("term"))
    parts = F.split(F.col("right.text"), " ｜ ", -1)
    first = trim(F.get(parts, F.lit(0)))
    rest = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), trim), lambda p: p != "")
    variants = F.when(first == NONE, F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(first, " / ", -1), trim), lambda v: v != ""))
    out = rows.select(key, kind.alias("kind"), "line_no", F.regexp_extract("line", shape, 1).alias("canonical"), variants.alias("variants"), F.array_join(F.array_remove(rest, SHARED), " ｜ ").alias("hint"), F.array_contains(rest, SHARED).alias("cross_file"), F.col("right.confidence").alias("confidence"), F.col("right.date").alias("confidence_date"))
    return out.withColumn("ord", F.row_number().over(Window.partitionBy(key, "kind").orderBy("line_no")).cast("long") - 1).drop("line_no")


def lint_flags(entities: DataFrame) -> DataFrame:
    """Whether a row cites the outside, or says where it comes from."""
    hint = F.coalesce("hint", F.lit(""))
    return entities.withColumn("cites_external", hint.rlike("官网|百科|报道|新闻|年报|https?://")).withColumn("label", F.regexp_extract(hint, "〔?(采访|公开)〕?", 1))

