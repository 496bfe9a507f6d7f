"""The whole glossary document: every section as lines, and back.

A document's parts are tables with the document's key and an order. Each part
becomes lines of its section, and a document is its lines in order; reading back
is the same grammar line by line, so both are projections and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import merge_hints, trim, trim_hint
from lodestrata.operators.glossary import TABLES, entity_line, parse
from lodestrata.operators.turns import lines

#: Titles of the sections, in the order in which they are written.
TITLES = {
    "background": "采访背景",
    "speakers": "发言人统一标注",
    "registry": "发言人登记（跨访谈）",
    "person": TABLES["person"],
    "brand": TABLES["brand"],
    "term": TABLES["term"],
    "errors": "需特别处理的转写错误",
    "notes": "各份特别提醒",
    "reopened": "本轮重新入队复核（往批核实遇新写法证据）",
    "conclusions": "联网核实结论（已采纳的已应用到上表正文；标 ⚠ 的与正文强名冲突、未采纳，待人工确认）",
    "directives": "写法统一（精校请初次落笔即套用，勿事后逐字回改）",
    "flags": "疑似同指（待人工确认，未自动合并）",
    "distinct": "确认不同指（勿合并）",
}
#: Titles of the condensed document's sections.
SHORT_TITLES = {"speakers": "发言人", "person": "人名", "brand": "品牌 / 公司 / 产品", "term": "术语 / 专名", "contested": "同指两解（口播形存疑·务必保留原形、勿替换）", "directives": "写法统一（初次落笔即写对，勿事后回改）", "flags": "疑似同指（勿自动合并）", "distinct": "确认不同指（勿合并）"}
#: Phrases of conclusions, and the mark of rows that stood under no known title.
UNSETTLED = "未能核实，保留（音）"
TRUSTED = "公开核实不足；按发言人信息使用"
BY = "依据："
REJECTED = "与部分条目强名不符、疑似张冠李戴，请人工确认"
STRAY = "⚠ 原校对表此行缺少分类标题、已按术语暂存——请人工归类"
MOST_EXAMPLES = 6
ALSO = " ／ "


def _if(value: Column, before: str, after: str = "") -> Column:
    """The value between two strings, nothing where it is empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after))).otherwise("")


def speaker_line(short: bool = False) -> Column:
    """A speaker: label, role and identity."""
    return F.concat(F.lit("- "), F.col("label"), F.lit(" → "), F.coalesce(F.nullif("role", F.lit("")), F.lit("?")), _if(F.col("identity"), "（", "）"))


#: What a section's rows are written as; each takes the columns named in ``COLUMNS``.
LINES = {
    "background": lambda: F.col("text"),
    "speakers": lambda: F.when(F.col("label").isNull(), F.concat(F.lit("**"), F.col("file"), F.lit("**"))).otherwise(speaker_line()),
    "registry": lambda: F.concat(F.lit("- "), F.col("label"), F.lit("（"), F.col("role"), F.lit("）"), _if(F.col("identity"), " ｜ "), F.lit(" ｜ 出现："), F.array_join("files", "、")),
    "person": entity_line,
    "brand": entity_line,
    "term": entity_line,
    "errors": lambda: F.concat(F.lit("- ["), F.col("file"), F.lit("] "), F.col("kind"), F.lit("："), F.array_join(F.slice("examples", 1, MOST_EXAMPLES), "；")),
    "notes": lambda: F.concat(F.lit("- "), F.col("note")),
    "reopened": lambda: F.concat(F.lit("- "), F.col("note")),
    "conclusions": lambda: F.when(
        F.col("canonical").isNotNull(),
        F.concat(F.lit("- "), F.when(F.col("rejected"), "⚠ ").otherwise(""), F.col("query"), F.lit(" → **"), F.col("canonical"), F.lit("**"), _if(F.col("identity"), "（", "）"), F.when(F.col("rejected"), f" ｜ {REJECTED}").otherwise(""), F.lit(f" ｜ {BY}"), F.coalesce("source", F.lit(""))),
    ).otherwise(F.concat(F.lit("- "), F.col("query"), F.when(F.col("trusted"), f"：{TRUSTED}").otherwise(f"：{UNSETTLED}"), _if(F.col("note"), " ｜ "))),
    "directives": lambda: F.concat(F.lit("- "), F.array_join(F.array_remove("members", F.col("preferred")), " / "), F.lit(" → 统一写 **"), F.col("preferred"), F.lit("**（"), F.col("why"), F.lit("）")),
    "flags": lambda: F.concat(F.lit("- "), F.array_join("members", ALSO), F.lit("（"), F.col("kind"), F.lit("）："), F.col("why")),
    "distinct": lambda: F.concat(F.lit("- "), F.array_join("members", ALSO)),
}
#: The condensed document's lines, where they differ.
SHORT_LINES = LINES | {
    "speakers": speaker_line,
    "person": lambda: short_entity(),
    "brand": lambda: short_entity(),
    "term": lambda: short_entity(),
    "contested": lambda: F.concat(F.lit("- "), F.col("spoken"), F.lit(" ｜ 保留原形，首次出现标注（音，存疑：或为 "), F.col("correction"), F.lit("）——绝不写成 "), F.col("correction")),
    "directives": lambda: F.concat(F.lit("- "), F.array_join(F.array_remove("members", F.col("preferred")), " / "), F.lit(" → **"), F.col("preferred"), F.lit("**")),
    "flags": lambda: F.concat(F.lit("- "), F.array_join("members", ALSO), F.lit("（"), F.col("kind"), F.lit("）")),
}


def short_entity() -> Column:
    """An entity with its first note and its warnings only."""
    shown = F.when(F.size("variants") > 0, F.array_join("variants", " / ")).otherwise("—")
    return F.concat(F.lit("- **"), F.col("canonical"), F.lit("** ← "), shown, _if(trim_hint(F.col("hint")), " ｜ "))


def render(heads: DataFrame, parts: dict[str, DataFrame], key: str, condensed: bool = False) -> DataFrame:
    """K1, K2: (key, text) of ``heads`` (key, topic, date) and parts by section,
    each with the key and ``ord``. Sections without rows are left out; lines that
    were kept as they are ("preserved": title, ord, line) close the document
    under their own titles."""
    titles, writings = (SHORT_TITLES, SHORT_LINES) if condensed else (TITLES, LINES)
    first = F.concat(F.lit("# "), F.col("topic"), F.lit(" 写法对照（精校用·摘自校对表）")) if condensed else F.concat(F.lit("# "), F.col("topic"), F.lit(" 统一校对表（采访时间 "), F.col("date"), F.lit("）"))
    rows = heads.select(key, F.lit(-1).alias("section"), F.lit("").alias("title"), F.lit(0).cast("long").alias("ord"), first.alias("line"))
    for i, (name, title) in enumerate(titles.items()):
        if name in parts:
            rows = rows.unionByName(parts[name].select(key, F.lit(i).alias("section"), F.lit(title).alias("title"), F.col("ord").cast("long").alias("ord"), writings[name]().alias("line")))
    if "preserved" in parts and not condensed:
        rows = rows.unionByName(parts["preserved"].select(key, F.lit(len(titles)).alias("section"), "title", F.col("ord").cast("long").alias("ord"), "line"))
    blocks = rows.groupBy(key, "section", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    written = F.when(F.col("section") < 0, F.col("body")).otherwise(F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.col("body")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "title", written.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def titled_lines(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, title, line_no, line): a document's lines under their headings;
    the title is empty before the first."""
    heading = F.when(F.col("line").rlike(r"\A##\s"), F.regexp_replace("line", r"\A##\s+", ""))
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines(docs, key, text_col).withColumn("heading", heading)
    return rows.withColumn("title", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit(""))).where("heading is null").select(key, "title", "line_no", "line")


def _under(rows: DataFrame, name: str) -> DataFrame:
    """The lines of every block of a section, by the words before its bracket."""
    return rows.where(F.startswith("title", F.lit(TITLES[name].split("（")[0])))


#: Grammars of lines, and the names of their parts.
SHAPES = {
    "errors": (r"\A- \[(.+?)\]\s*(.+?)：(.*)\z", ("file", "kind", "examples")),
    "notes": (r"\A- (.+)\z", ("note",)),
    "directives": (r"\A- (.+?) → 统一写 \*\*(.+?)\*\*(?:（(.*)）)?\s*\z", ("members", "preferred", "why")),
    "flags": (r"\A- (.+?)（(.+?)）：(.*)\z", ("members", "kind", "why")),
    "distinct": (r"\A- (.+ ／ .+)\z", ("members",)),
}
RESOLVED = rf"\A- (⚠ )?(.+?) → \*\*(.+?)\*\*(?:（(.+?)）)?(?:\s*｜\s*(?!{BY}).*?)?\s*｜\s*{BY}(.*)\z"
UNRESOLVED = rf"\A- (.+?)：(?:{UNSETTLED}|{TRUSTED})(?:\s*｜\s*(.*))?\z"


def read_part(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One section's rows from ``titled_lines``: (key, line_no, its columns);
    lists are cut at their separators."""
    shape, names = SHAPES[name]
    found = _under(rows, name).where(F.col("line").rlike(shape))
    cut = {"members": lambda c: F.filter(F.transform(F.split(c, r" / | ／ "), trim), lambda x: x != ""), "examples": lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "；"))}
    parts = [cut.get(n, lambda c: c)(F.regexp_extract("line", shape, i + 1)).alias(n) for i, n in enumerate(names)]
    out = found.select(key, "line_no", *parts)
    return out.withColumn("members", F.array_union("members", F.array("preferred"))) if name == "directives" else out


def read_background(rows: DataFrame, key: str) -> DataFrame:
    """(key, text) of the background's blocks."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return _under(rows, "background").groupBy(key).agg(trim(body).alias("text"))


def read_speakers(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, file, label, role, identity) below each file's line."""
    shape, group = r"\A- (.+?) → (.+?)(?:（(.+)）)?\z", r"\A\*\*(.+?)\*\*\s*\z"
    w = Window.partitionBy(key).orderBy("line_no")
    placed = _under(rows, "speakers").withColumn("file", F.last(F.when(F.col("line").rlike(group), F.regexp_extract("line", group, 1)), ignorenulls=True).over(w))
    return placed.where(F.col("line").rlike(shape) & F.col("file").isNotNull()).select(key, "line_no", "file", *(F.regexp_extract("line", shape, i).alias(n) for i, n in ((1, "label"), (2, "role"), (3, "identity"))))


def read_conclusions(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, query, canonical, identity, source, rejected, note);
    canonical is null where nothing was settled."""
    part = rows.where(F.startswith("title", F.lit("联网核实结论")) | F.startswith("title", F.lit("补核结论")))
    settled, open_ = F.col("line").rlike(RESOLVED), F.col("line").rlike(UNRESOLVED)
    at = lambda shape, i, when: F.when(when, F.regexp_extract("line", shape, i))
    return part.where(settled | open_).select(
        key, "line_no", F.coalesce(at(UNRESOLVED, 1, open_), at(RESOLVED, 2, settled)).alias("query"), *(at(RESOLVED, i, settled & ~open_).alias(n) for i, n in ((3, "canonical"), (4, "identity"), (5, "source"))),
        (settled & ~open_ & (F.regexp_extract("line", RESOLVED, 1) != "")).alias("rejected"), at(UNRESOLVED, 2, open_).alias("note"),
    )


def known_title() -> Column:
    return F.exists(F.array(*(F.lit(t.split("（")[0]) for t in TITLES.values()), F.lit("补核结论")), lambda t: F.startswith("title", t))


def read_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Entity rows of all tables; those under titles that no section has
    count as terms, and are marked."""
    stray = titled_lines(docs, key, text_col).where(~known_title() & F.col("line").rlike(r"\A-\s+\*\*(.+?)\*\*\s*←")).select(key, F.regexp_extract("line", r"\A-\s+\*\*(.+?)\*\*", 1).alias("canonical")).distinct().withColumn("stray", F.lit(True))
    found = parse(docs, key, text_col).join(stray, [key, "canonical"], "left")
    return found.withColumn("hint", F.when(F.col("stray") & (F.col("kind") == "term"), merge_hints(F.col("hint"), F.lit(STRAY))).otherwise(F.col("hint"))).drop("stray")


def read_preserved(rows: DataFrame, key: str) -> DataFrame:
    """(key, title, line) of titles that no section has, each line once,
    but for entity rows, which are rescued."""
    other = rows.where(~known_title() & (F.col("title") != "") & (trim(F.col("line")) != "") & ~F.col("line").rlike(r"\A-\s+\*\*(.+?)\*\*\s*←"))
    return other.groupBy(key, "title", "line").agg(F.min("line_no").alias("line_no"))


def lite(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, canonical, variants, unverified) for the audit; only flagged
    persons count as unverified, and rows of Markdown tables are no entities."""
    rows = parse(docs, key, text_col)
    flagged = F.col("confidence").isin("recheck", "unknown") | F.col("hint").contains("⚠")
    return rows.select(key, "canonical", "variants", ((F.col("kind") == "person") & flagged & F.col("hint").contains("⚠")).alias("unverified"))


def merged_speakers(prior: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Groups of speakers by label, the prior one before the fresh one."""
    both = prior.withColumn("from_", F.lit(0)).unionByName(fresh.withColumn("from_", F.lit(1)))
    best = Window.partitionBy(key, "label").orderBy("from_", "ord")
    return both.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn", "from_")


def merged_notes(prior: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Distinct notes in the order in which they are first met, prior ones first."""
    both = prior.withColumn("from_", F.lit(0)).unionByName(fresh.withColumn("from_", F.lit(1)))
    return both.groupBy(key, "note").agg(F.min(F.struct("from_", "ord")).alias("at")).withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("at")).cast("long") - 1).drop("at")
