"""Run reports: stage reports merged, review queue, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import longest_han_run, trim

GARBLED_RUN = 16
NETWORK = r"(?i)网络故障|网络错误|连接|超时|断路|熔断|中断|检索失败|检索报错|timed? ?out|network|connection"
#: A provider's keys that are secret, and the one that only names a variable.
SECRET_KEYS, OPEN_KEY = "(?i)key|secret|token|authorization", "keyVar"
#: The review queue's sections in order: name, title, priority.
SECTIONS = (
    ("error", "流水线未执行", "high"),
    ("audit_unavailable", "审计未能运行——本次运行失败，产物未经审计（不可采信，请人工核验）", "high"),
    ("failed", "未完成，需要补做", "high"),
    ("incomplete", "疑似中途截断，需要检查结尾", "high"),
    ("unchecked", "结尾完整性未核，需要人工抽查", "high"),
    ("audit", "成稿质量抽查未过（内容缺口/压缩/欠精校/残留口癖/超长段）", "high"),
    ("cross_file", "跨文件互证（同一实体在不同文件里数值冲突，每份内部都合规——请对照录音确认）", "high"),
    ("derivative_hard", "派生件溯源：时间线/总结把公开或臆造数字标成【访谈】（源文无对应，疑炮制——须改标注或删除）", "high"),
    ("derivative_reporter", "派生件待核：时间线/总结的公开来源数字（待记者核实）与未标注/复核数字", "medium"),
    ("numbers", "文档内数值自相矛盾（同一量在同一文件里出现两个不同数值——请对照录音确认哪个是对的）", "medium"),
    ("sections", "逐节复核清单（存疑数字/语气弱化/未核实名——请逐节对照录音）", "medium"),
    ("annotations", "已在成稿中插入内容缺口标记（总结/时间线/逻辑稿基于插标前文本，补回内容后需重出）", "medium"),
    ("scout", "侦察疑似损坏，校对表该份不可靠", "medium"),
    ("lint", "校对表偏薄，建议人工复核（条目数/身份线索/变体比例）", "medium"),
    ("sources", "校对表来源标注（公开/外部事实勿当访谈亲述；未标来源的行请补标【访谈】或【公开·待记者核实】）", "medium"),
    ("headings", "源文件已带小标题，需决定保留或重做", "medium"),
    ("suspects", "疑似同指，待人工确认", "medium"),
    ("network", "因网络故障未核实，可网络恢复后补查", "medium"),
    ("logic_failed", "逻辑顺序稿失败", "medium"),
    ("logic_gaps", "逻辑顺序稿疑漏小标题", "medium"),
    ("questions", "收尾待问", "medium"),
    ("auto_chunk", "已自动分段精校（文件超出该模型忠实处理长度，已按发言轮边界切分——仅告知，无需处理）", "low"),
    ("warnings", "预检提示", "low"),
)
NOTHING = "当前没有需要人工处理的提醒。"


def garbled(names: Column, speakers: Column) -> Column:
    """No speakers, or a name with an unbroken run of Han letters."""
    return (F.size(speakers) == 0) | F.exists(names, lambda n: longest_han_run(n) >= GARBLED_RUN)


def network_unverified(note: Column) -> Column:
    """P8."""
    return F.coalesce(note.rlike(NETWORK), F.lit(False))


def heading_conflict(policy: Column, text: Column) -> Column:
    """P11."""
    return (policy == "none") & text.rlike(r"(?m)^#{1,6} ")


def merged_parts(parts: DataFrame, key: str) -> DataFrame:
    """Parts (key, ord, speakers array<struct<label,role>>, notes,
    headings, anchor_line, anchor_text, n_lines): speakers and notes distinct
    in order, headings by or, the ending anchor of the largest line (the last
    on ties) unless it lies before nine tenths of the file."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"])
    first = F.aggregate("all_speakers", F.array().cast("array<struct<label:string,role:string>>"), lambda acc, s: F.when(F.exists(acc, lambda a: a["label"] == s["label"]), acc).otherwise(F.concat(acc, F.array(s))))
    got = parts.groupBy(key).agg(F.flatten(ordered("speakers")).alias("all_speakers"), F.flatten(ordered("notes")).alias("all_notes"), F.bool_or("headings").alias("headings"), F.max_by(F.struct("anchor_line", "anchor_text"), F.when(F.col("anchor_line").isNotNull(), F.struct("anchor_line", "ord"))).alias("anchor"), F.max("n_lines").alias("n_lines"))
    near = F.col("anchor.anchor_line") >= 0.9 * F.col("n_lines")
    return got.select(key, first.alias("speakers"), F.array_distinct(F.filter(F.transform("all_notes", trim), lambda n: n != "")).alias("notes"), "headings", F.when(near, F.col("anchor.anchor_text")).alias("ending"))


def review_queue(items: DataFrame, key: str, runs: DataFrame | None = None) -> DataFrame:
    """K3: items (key, section, ord, text) as one Markdown text a run: how many
    there are, then the sections in their fixed order, empty ones and empty
    items left out. Runs (key, summary) without items say that there are none;
    a summary, such as a scorecard's lines, stands first."""
    at = F.coalesce(*[F.when(F.col("section") == s, i) for i, (s, _, _) in enumerate(SECTIONS)])
    title = F.element_at(F.array(*[F.lit(t) for _, t, _ in SECTIONS]), F.col("at") + 1)
    rows = items.where(F.coalesce("text", F.lit("")) != "").withColumn("at", at).where("at is not null")
    parts = rows.groupBy(key, "at").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    body = F.concat(F.lit("## "), title, F.lit("\n"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["text"])), "\n"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", body.alias("body")))).alias("b"), F.sum(F.size("t")).alias("n"))
    text = F.concat(F.lit("共有 "), F.col("n").cast("string"), F.lit(" 个待处理项。\n\n"), F.array_join(F.col("b.body"), "\n\n"))
    if runs is None:
        return whole.select(key, text.alias("text"))
    return runs.join(whole.select(key, text.alias("body")), key, "left").select(key, F.concat_ws("\n\n", F.nullif("summary", F.lit("")), F.coalesce("body", F.lit(NOTHING))).alias("text"))


def priorities(items: DataFrame, key: str) -> DataFrame:
    """K3: (key, high, medium, low): items by their section's priority."""
    of = lambda p: F.count_if(F.col("section").isin(*(s for s, _, q in SECTIONS if q == p)))
    return items.where(F.coalesce("text", F.lit("")) != "").groupBy(key).agg(*(of(p).alias(p) for p in ("high", "medium", "low")))


#: An item's text by its section, of the columns that the section's findings have.
FORMATS = {
    "audit": lambda: F.concat("label", F.lit(" — "), F.array_join("rules", "、")),
    "cross_file": lambda: F.concat("name", F.lit("："), F.array_join("values", " / "), F.lit("（"), F.array_join("files", "、"), F.lit("）")),
    "numbers": lambda: F.concat("label", F.lit(" — "), "name", F.lit("："), F.array_join("values", " / ")),
    "sections": lambda: F.concat("label", F.lit(" › "), "title", F.lit("："), F.array_join("flags", "、")),
    "suspects": lambda: F.concat(F.array_join("members", " ／ "), F.lit("（"), "kind", F.lit("）："), "why"),
    "network": lambda: F.concat("name", F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" — "), "note")).otherwise("")),
    "logic_gaps": lambda: F.concat("label", F.lit(" — "), F.array_join(first_titles(F.col("titles")), "、")),
    "auto_chunk": lambda: F.concat("label", F.lit("："), F.col("parts").cast("string"), F.lit(" 段")),
    "derivative_hard": lambda: F.concat("label", F.lit(" L"), F.col("line_no").cast("string"), F.lit("："), "value", F.coalesce("unit", F.lit(""))),
}


def formatted(findings: DataFrame, section: str, key: str, order: str) -> DataFrame:
    """findings of a section as items of the review queue."""
    return findings.select(key, F.lit(section).alias("section"), F.col(order).cast("long").alias("ord"), FORMATS[section]().alias("text"))


def first_titles(titles: Column, n: int = 8) -> Column:
    """The first titles, and how many there are where that is more."""
    more = F.when(F.size(titles) > n, F.array(F.concat(F.lit("等 "), F.size(titles).cast("string"), F.lit(" 个")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(titles, 1, n), more)


def manifest(runs: DataFrame, key: str, provider: str) -> DataFrame:
    """K4: one JSON text a run: all columns, nulls kept, the provider's secret keys left out."""
    kept = F.map_filter(F.col(provider), lambda k, v: ~k.rlike(SECRET_KEYS) | (k == OPEN_KEY))
    columns = [F.lit(1).alias("schemaVersion")] + [kept.alias(c) if c == provider else F.col(c) for c in runs.columns]
    return runs.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def paired(sources: DataFrame, refined: DataFrame) -> DataFrame:
    """Sources and refined texts on one normal path, both there."""
    normal = lambda c: F.regexp_replace(F.regexp_replace(c, r"/\./|//+", "/"), r"[^/]+/\.\./", "")
    a = sources.withColumn("path", normal(F.col("path")))
    b = refined.withColumn("path", normal(F.col("path")))
    return a.join(b, "path")


def report_for(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Each file's first report, met by label or by any of its paths; a
    union of equi-joins."""
    keys = reports.select("ord", "report", F.explode(F.array("label", "path", "original", "out")).alias("k")).where("k is not null and k != ''").distinct()
    wanted = files.select("file", F.explode("candidates").alias("k")).distinct()
    return wanted.join(keys, "k").groupBy("file").agg(F.min_by("report", "ord").alias("report"))


def case_results(cases: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with their results, and the cases without."""
    return cases.join(results, "id"), cases.join(results, "id", "left_anti")


def top_known(entities: DataFrame, keys: list[str], n: int = 40, variants: int = 3) -> DataFrame:
    """The first n entities of each group, with a few variants."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return entities.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).withColumn("variants", F.slice("variants", 1, variants)).drop("rn")


def open_questions(*sources: DataFrame) -> DataFrame:
    """Questions of all sources in a fixed order, repeats kept."""
    out = None
    for i, s in enumerate(sources):
        row = s.select(F.lit(i).cast("long").alias("source"), "ord", "question")
        out = row if out is None else out.unionByName(row)
    return out


def manifest_files(files: DataFrame, text_col: str = "text") -> DataFrame:
    """K4: a run's source files: lines, bytes and SHA-256 of their texts."""
    text = F.col(text_col)
    return files.withColumns({"lines": F.size(F.split(text, r"\r\n|\r|\n", -1)).cast("long"), "bytes": F.octet_length(text).cast("long"), "sha256": F.sha2(text, 256)}).drop(text_col)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """K5: artifacts (run, kind, name, text) as Parquet by run and kind; a run
    that is written again replaces its own files only."""
    artifacts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "kind").parquet(path)


def retrieval_summary(scores: DataFrame) -> DataFrame:
    """A scorecard (grp, provider, all_groups, expect_hit, ...) as lines, by
    provider and group; the line of all groups comes last."""
    part = lambda hit, total: F.concat(F.col(hit).cast("string"), F.lit("/"), F.col(total).cast("string"))
    line = F.concat(F.lit("- "), "provider", F.lit(" · "), F.when(F.col("all_groups") == 1, "all").otherwise(F.coalesce("grp", F.lit("?"))), F.lit(": "), part("expect_hit", "expect_total"), F.lit(", traps "), part("trap_hit", "trap_total"), F.lit(", failures "), F.col("failures").cast("string"))
    return scores.select("provider", "all_groups", F.coalesce("grp", F.lit("?")).alias("grp"), line.alias("line")).groupBy("provider").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("all_groups", "grp", "line"))), lambda x: x["line"]), "\n").alias("text"))
