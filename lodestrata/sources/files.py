"""Sources: subtitles, environment files, uploads, cases and recorded searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import trim
from lodestrata.operators.turns import islands

#: Where each recorded search service keeps its results, and their title, link and text.
SEARCH_FIELDS = {
    "organic": ("$.organic", "title", "link", "snippet"),
    "results": ("$.results", "title", "url", "content"),
    "webpages": ("$.data.webPages.value", "name", "url", "summary"),
    "reader": ("$.data", "title", "url", "description"),
    "web": ("$.web.results", "title", "url", "description"),
    "neural": ("$.results", "title", "url", "text"),
}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def subtitle_turns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cue blocks to speaker turns: (id, speaker, text, ts, first, last).
    Numbers and times are no prose; the next cue of the same speaker is joined
    without a space, under the first cue's time."""
    blocks = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), r"\n[ \t]*\n+")).alias("cue", "block"))
    time = r"([0-9:]+)[,.][0-9]+ *--> *([0-9:]+)"
    body = F.regexp_replace(F.regexp_replace("block", r"(?m)^[0-9]+\s*\n(?=[0-9:,.]+ *-->)", ""), r"(?m)^[0-9:,.]+ *--> *[0-9:,.]+.*\n?", "")
    cues = blocks.withColumn("ts", F.regexp_extract("block", time, 1)).where("ts != ''").withColumn("body", trim(body))
    speaker = F.regexp_extract("body", r"\A([^：:\n]{1,12})[：:]", 1)
    cues = cues.withColumn("speaker", speaker).withColumn("text", F.regexp_replace("body", r"\A[^：:\n]{1,12}[：:]\s*", ""))
    runs = islands(cues, [id_col], "cue", "speaker").select(F.col(id_col).alias("r_id"), "first", "last", F.col("speaker").alias("who"))
    met = cues.join(runs, (F.col(id_col) == F.col("r_id")) & F.col("cue").between(F.col("first"), F.col("last")))
    ordered = F.array_sort(F.collect_list(F.struct("cue", "text", "ts")))
    return met.groupBy(id_col, "who", "first", "last").agg(ordered.alias("c")).select(id_col, F.col("who").alias("speaker"), F.array_join(F.col("c.text"), "").alias("text"), F.get("c.ts", F.lit(0)).alias("ts"), "first", "last")


def environment(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Lines (line_no, line) of KEY=VALUE; quotes and remarks taken off,
    known keys (key) win; lines of another shape come back without a key."""
    shape = r"\A\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)\z"
    value = F.trim(F.regexp_extract("line", shape, 2))
    plain = F.when(value.rlike(r"\A(\"[^\"]*\"|'[^']*')"), F.regexp_extract(value, r"\A[\"']([^\"']*)[\"']", 1)).otherwise(F.trim(F.regexp_replace(value, r"\s+#.*\z", "")))
    parsed = rows.where(~F.col("line").rlike(r"\A\s*(#.*)?\z")).select("line_no", F.nullif(F.regexp_extract("line", shape, 1), F.lit("")).alias("key"), plain.alias("value"))
    return parsed.join(known.select("key"), "key", "left_anti")


def upload(body: Column) -> Column:
    """S5."""
    return F.unbase64(body)


def search_results(reply: Column, service: str, k: int = 5) -> Column:
    """A recorded reply's first k results as (title, url, snippet)."""
    path, title, url, text = SEARCH_FIELDS[service]
    items = F.from_json(F.get_json_object(reply, path), "array<map<string,string>>")
    return F.slice(F.transform(F.coalesce(items, F.array().cast("array<map<string,string>>")), lambda x: F.struct(F.coalesce(x[title], F.lit("")).alias("title"), F.coalesce(x[url], F.lit("")).alias("url"), F.coalesce(x[text], F.lit("")).alias("snippet"))), 1, k)


def checked_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases of a known kind and a group, and the rest."""
    good = F.coalesce(F.col("kind").isin("expect", "trap", "unverifiable") & F.col("group").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    return cases.where(good), cases.where(~good)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, permissive, every field nullable."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def search_outcome(recorded: DataFrame, k: int = 5) -> DataFrame:
    """Recorded calls (service, status, latency_ms, reply) with their
    results and what went wrong: an error where the status is not 200, a shape
    error where a good reply holds no list in its service's place."""
    listed = F.coalesce(*[F.when(F.col("service") == s, F.get_json_object("reply", path).rlike(r"\A\s*\[")) for s, (path, *_) in SEARCH_FIELDS.items()], F.lit(False))
    results = F.coalesce(*[F.when(F.col("service") == s, search_results(F.col("reply"), s, k)) for s in SEARCH_FIELDS])
    good = F.col("status") == 200
    return recorded.withColumns({"results": results, "error": F.when(~good, F.concat(F.lit("HTTP "), F.col("status").cast("string"))), "shape_error": good & ~listed})


def known_rows(rows: DataFrame, known: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows whose id is known, and the others, of which one is warned."""
    ids = known.select(id_col).distinct()
    return rows.join(ids, id_col, "left_semi"), rows.join(ids, id_col, "left_anti")


#: What a stage report holds; every list may be missing.
ENTITIES = "array<struct<canonical:string,variants:array<string>,hint:string>>"
REPORT = {"people": ENTITIES, "brands": ENTITIES, "terms": ENTITIES, "speakers": "array<struct<label:string,role:string,identity:string>>", "special_notes": "array<string>"}


def stage_report(reply: Column) -> Column:
    """A report's JSON text as its lists, empty where one is missing, is of
    another shape or cannot be read; entities without a canonical are left out."""
    read = F.from_json(reply, ", ".join(f"{k} {v}" for k, v in REPORT.items()))
    listed = {k: F.coalesce(read[k], F.array().cast(v)) for k, v in REPORT.items()}
    named = {k: F.filter(c, lambda e: F.coalesce(e["canonical"], F.lit("")) != "") if REPORT[k] == ENTITIES else c for k, c in listed.items()}
    return F.struct(*(c.alias(k) for k, c in named.items()))
