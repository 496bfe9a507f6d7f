"""Queries of documents, reviews and audits over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import anchors, archive, atoms, audit, entities, glossary, glue, report, scoring, turns
from lodestrata.plans.queries import literal, query, read
from lodestrata.sources import files
from lodestrata.streaming import runlog


def given(columns: str, rows: list[tuple]) -> str:
    """Rows of input as SQL."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") g({columns}))"


# ---- the glossary document ---------------------------------------------------
#: Persons are customers, brands parts, speakers suppliers, of each nation.
PEOPLE = """people AS (SELECT c_nationkey k, c_custkey ord, c_name canonical, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE [c_name || 'a', c_name || 'b'] END::VARCHAR[] variants, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '；x' ELSE '' END hint, c_custkey % 5 = 0 cross_file, ['unknown', 'verified', 'recheck', 'user', 'contested'][c_custkey % 5 + 1] confidence FROM customer)"""
MARK = "CASE confidence WHEN 'verified' THEN ' 〔核实·2024-01〕' WHEN 'recheck' THEN ' 〔待复核〕' WHEN 'user' THEN ' 〔用户钦定〕' WHEN 'contested' THEN ' 〔同指两解〕' ELSE '' END"
VARIANTS = "CASE WHEN len(variants) = 0 THEN '—' ELSE array_to_string(variants, ' / ') END"
SPEAKERS = "speakers AS (SELECT s_nationkey k, s_suppkey ord, s_name label, CASE WHEN s_suppkey % 2 = 0 THEN 'guest' ELSE '' END \"role\", CASE WHEN s_suppkey % 3 = 0 THEN 'id' || s_suppkey ELSE '' END identity FROM supplier)"


def _people(spark, d):
    n, name = F.col("c_custkey"), F.col("c_name")
    return read(spark, d, "customer").select(
        F.col("c_nationkey").alias("k"), n.alias("ord"), F.lit("person").alias("kind"), name.alias("canonical"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(name, F.lit("a")), F.concat(name, F.lit("b")))).alias("variants"),
        F.when(n % 2 == 0, F.concat("c_mktsegment", F.lit("；x"))).otherwise("").alias("hint"), (n % 5 == 0).alias("cross_file"),
        F.element_at(F.array(*map(F.lit, ("unknown", "verified", "recheck", "user", "contested"))), (n % 5 + 1).cast("int")).alias("confidence"), F.lit("2024-01").alias("confidence_date"),
    )


def _speakers(spark, d):
    n = F.col("s_suppkey")
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), n.alias("ord"), F.lit("f").alias("file"), F.col("s_name").alias("label"), F.when(n % 2 == 0, "guest").otherwise("").alias("role"), F.when(n % 3 == 0, F.concat(F.lit("id"), n.cast("string"))).otherwise("").alias("identity"))


def _parts(spark, d):
    p = read(spark, d, "part").select((F.col("p_partkey") % 25).cast("int").alias("k"), F.col("p_partkey").alias("ord"), "p_name", "p_brand", "p_type", "p_size")
    speakers = _speakers(spark, d)
    heads = speakers.groupBy("k").agg(F.lit(0).cast("long").alias("ord")).withColumn("file", F.lit("f")).withColumns({c: F.lit(None).cast("string") for c in ("label", "role", "identity")})
    return {
        "speakers": speakers.withColumn("ord", F.col("ord") + 1).unionByName(heads),
        "person": _people(spark, d),
        "errors": p.where("p_size % 4 = 0").select("k", "ord", F.col("p_brand").alias("file"), F.col("p_type").alias("kind"), F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: i.cast("string")).alias("examples")),
        "notes": p.where("p_size % 4 = 1").select("k", "ord", F.col("p_name").alias("note")),
        "directives": p.where("p_size % 4 = 2").select("k", "ord", F.array("p_name", "p_brand").alias("members"), F.col("p_brand").alias("preferred"), F.col("p_type").alias("why")),
        "flags": p.where("p_size % 4 = 3").select("k", "ord", F.array("p_name", "p_brand").alias("members"), F.lit("term").alias("kind"), F.col("p_type").alias("why")),
    }


def _heads(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("topic"), F.lit("2024-05").alias("date"))


def _sections(titles: dict[str, str], rows: dict[str, str], head: str) -> str:
    """SQL of documents: sections in order, their rows in order, blank lines between."""
    names = [*titles]
    parts = [f"SELECT k, {names.index(n)} s, '## {titles[n]}' || chr(10) || string_agg(line, chr(10) ORDER BY ord) body FROM ({sql}) GROUP BY 1" for n, sql in rows.items()]
    return f"doc AS (SELECT n_nationkey k, -1 s, {head} body FROM nation UNION ALL {' UNION ALL '.join(parts)}) SELECT k, string_agg(body, chr(10) || chr(10) ORDER BY s) AS \"text\" FROM doc GROUP BY k"


PART = "p AS (SELECT (p_partkey % 25)::INTEGER k, p_partkey ord, p_name, p_brand, p_type, p_size FROM part)"
SPEAKER = "'- ' || label || ' → ' || CASE WHEN \"role\" = '' THEN '?' ELSE \"role\" END || CASE WHEN identity = '' THEN '' ELSE '（' || identity || '）' END"
FULL_ROWS = {
    "speakers": f"SELECT k, ord + 1 ord, {SPEAKER} line FROM speakers UNION ALL SELECT DISTINCT k, 0, '**f**' FROM speakers",
    "person": f"SELECT k, ord, '- **' || canonical || '** ← ' || {VARIANTS} || CASE WHEN hint = '' THEN '' ELSE ' ｜ ' || hint END || CASE WHEN cross_file THEN ' ｜ 多份互证' ELSE '' END || {MARK} line FROM people",
    "errors": "SELECT k, ord, '- [' || p_brand || '] ' || p_type || '：' || array_to_string(list_transform(range(1, least(p_size, 6) + 1), lambda i: i::VARCHAR), '；') line FROM p WHERE p_size % 4 = 0",
    "notes": "SELECT k, ord, '- ' || p_name line FROM p WHERE p_size % 4 = 1",
    "directives": "SELECT k, ord, '- ' || p_name || ' → 统一写 **' || p_brand || '**（' || p_type || '）' line FROM p WHERE p_size % 4 = 2",
    "flags": "SELECT k, ord, '- ' || p_name || ' ／ ' || p_brand || '（term）：' || p_type line FROM p WHERE p_size % 4 = 3",
}


@query(f"WITH {PEOPLE}, {SPEAKERS}, {PART}, " + _sections(archive.TITLES, FULL_ROWS, "'# ' || n_name || ' 统一校对表（采访时间 2024-05）'"))
def glossary_document(spark, d):
    return archive.render(_heads(spark, d), _parts(spark, d), "k")


SHORT_ROWS = {
    "speakers": f"SELECT k, ord, {SPEAKER} line FROM speakers",
    "person": f"SELECT k, ord, '- **' || canonical || '** ← ' || {VARIANTS} || CASE WHEN hint = '' THEN '' ELSE ' ｜ ' || string_split(hint, '；')[1] END line FROM people",
    "directives": "SELECT k, ord, '- ' || p_name || ' → **' || p_brand || '**' line FROM p WHERE p_size % 4 = 2",
    "flags": "SELECT k, ord, '- ' || p_name || ' ／ ' || p_brand || '（term）' line FROM p WHERE p_size % 4 = 3",
}


@query(f"WITH {PEOPLE}, {SPEAKERS}, {PART}, " + _sections(archive.SHORT_TITLES, SHORT_ROWS, "'# ' || n_name || ' 写法对照（精校用·摘自校对表）'"))
def condensed_glossary(spark, d):
    parts = _parts(spark, d)
    parts["speakers"] = _speakers(spark, d)
    return archive.render(_heads(spark, d), {k: v for k, v in parts.items() if k in archive.SHORT_TITLES}, "k", condensed=True)


@query(f"WITH {PEOPLE} SELECT k, row_number() OVER (PARTITION BY k ORDER BY ord) - 1 ord, canonical, variants, hint, cross_file, confidence FROM people")
def glossary_entities_read(spark, d):
    return archive.read_entities(glossary_document(spark, d), "k").where("kind = 'person'").select("k", "ord", "canonical", "variants", "hint", "cross_file", "confidence")


@query(f"""WITH {PART}, {SPEAKERS} SELECT k, 'speakers' AS what, label a, CASE WHEN "role" = '' THEN '?' ELSE "role" END b, identity c FROM speakers UNION ALL SELECT k, 'errors', p_brand, p_type, array_to_string(list_transform(range(1, least(p_size, 6) + 1), lambda i: i::VARCHAR), '|') FROM p WHERE p_size % 4 = 0
UNION ALL SELECT k, 'notes', p_name, '', '' FROM p WHERE p_size % 4 = 1 UNION ALL SELECT k, 'directives', p_name || '|' || p_brand, p_brand, p_type FROM p WHERE p_size % 4 = 2 UNION ALL SELECT k, 'flags', p_name || '|' || p_brand, 'term', p_type FROM p WHERE p_size % 4 = 3""")
def glossary_sections_read(spark, d):
    rows = archive.titled_lines(glossary_document(spark, d), "k")
    part = lambda name: archive.read_part(rows, "k", name)
    pick = lambda df, what, a, b, c: df.select("k", F.lit(what).alias("what"), a.alias("a"), b.alias("b"), c.alias("c"))
    joined, none = lambda c: F.array_join(c, "|"), F.lit("")
    out = pick(archive.read_speakers(rows, "k"), "speakers", F.col("label"), F.col("role"), F.col("identity"))
    out = out.unionByName(pick(part("errors"), "errors", F.col("file"), F.col("kind"), joined("examples"))).unionByName(pick(part("notes"), "notes", F.col("note"), none, none))
    return out.unionByName(pick(part("directives"), "directives", joined("members"), F.col("preferred"), F.col("why"))).unionByName(pick(part("flags"), "flags", joined("members"), F.col("kind"), F.col("why")))


@query("""SELECT c_custkey id, c_name query, CASE WHEN c_custkey % 4 < 2 THEN c_mktsegment END canonical, CASE WHEN c_custkey % 4 = 0 THEN 'who' WHEN c_custkey % 4 = 1 THEN '' END identity, CASE WHEN c_custkey % 4 < 2 THEN 'www.a.com' END source, c_custkey % 4 = 1 rejected, CASE WHEN c_custkey % 4 >= 2 THEN CASE WHEN c_custkey % 8 >= 4 THEN 'n' ELSE '' END END note FROM customer""")
def glossary_conclusions_read(spark, d):
    n = F.col("c_custkey")
    rows = read(spark, d, "customer").select(
        n.alias("id"), n.alias("ord"), F.col("c_name").alias("query"), F.when(n % 4 < 2, F.col("c_mktsegment")).alias("canonical"), F.when(n % 4 == 0, "who").otherwise("").alias("identity"), F.lit("www.a.com").alias("source"),
        (n % 4 == 1).alias("rejected"), (n % 4 == 3).alias("trusted"), F.when(n % 8 >= 4, "n").otherwise("").alias("note"),
    )
    heads = rows.select("id", F.col("query").alias("topic"), F.lit("d").alias("date"))
    docs = archive.render(heads, {"conclusions": rows}, "id")
    return archive.read_conclusions(archive.titled_lines(docs, "id"), "id").select("id", "query", "canonical", "identity", "source", "rejected", "note")


@query("SELECT n_nationkey::BIGINT conv_id, n_name title, 'free text of ' || n_name line, 3::BIGINT line_no FROM nation")
def glossary_preserved_lines(spark, d):
    """Lines under titles that no section has."""
    docs = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("conv_id"), F.concat(F.lit("# t\n## "), "n_name", F.lit("\nfree text of "), "n_name", F.lit("\nfree text of "), "n_name", F.lit("\n- **x** ← y\n## 各份特别提醒\n- n")).alias("text"))
    return archive.read_preserved(archive.titled_lines(docs, "conv_id"), "conv_id").select("conv_id", "title", "line", F.col("line_no").cast("long").alias("line_no"))


@query("""SELECT n_nationkey k, 'x' canonical, '⚠ 原校对表此行缺少分类标题、已按术语暂存——请人工归类' hint FROM nation UNION ALL SELECT n_nationkey, n_name, '' FROM nation""")
def glossary_stray_rows(spark, d):
    docs = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("# t\n## odd\n- **x** ← y\n## 人名（写法 → 统一）\n- **"), "n_name", F.lit("** ← —")).alias("text"))
    return archive.read_entities(docs, "k").select("k", "canonical", "hint")


@query(f"WITH {PEOPLE} SELECT k, canonical, variants, false unverified FROM people UNION ALL SELECT n_nationkey, 'p', ['q'], true FROM nation")
def glossary_lite(spark, d):
    marked = _people(spark, d).unionByName(read(spark, d, "nation").selectExpr("n_nationkey as k", "1000000000L as ord", "'person' as kind", "'p' as canonical", "array('q') as variants", "'⚠ doubt' as hint", "false as cross_file", "'unknown' as confidence", "'' as confidence_date"))
    return archive.lite(glossary.render(marked, "k"), "k")


@query("""SELECT label, "role", src FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY src, ord) rn FROM (SELECT role label, 'r' || conv_id "role", 0 src, conv_id * 1000 + turn ord FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT role, 'r' || conv_id, 1, conv_id * 1000 + turn FROM conversations)) WHERE rn = 1""")
def merged_speakers(spark, d):
    c = read(spark, d, "conversations").select(F.lit(1).alias("k"), F.col("role").alias("label"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("role"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "conv_id")
    prior, fresh = c.where("conv_id % 3 = 0").withColumn("src", F.lit(0)), c.withColumn("src", F.lit(1))
    return archive.merged_speakers(prior, fresh, "k").select("label", "role", "src")


@query("""SELECT o_custkey, note, row_number() OVER (PARTITION BY o_custkey ORDER BY f, o) - 1 ord FROM (SELECT o_custkey, note, min(f) f, arg_min(o, (f, o)) o FROM (SELECT o_custkey, o_orderpriority note, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END f, o_orderkey o FROM orders) GROUP BY 1, 2)""")
def merged_notes(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    return archive.merged_notes(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus != 'F'").drop("o_orderstatus"), "o_custkey").select("o_custkey", "note", "ord")


# ---- contested names, questions, findings -------------------------------------
CONTESTED = """c AS (SELECT c_nationkey k, c_custkey ord, c_name canonical, CASE WHEN c_custkey % 7 = 0 THEN '⚠ 同指两解：旧' ELSE c_mktsegment END hint FROM customer)"""


@query(f"""WITH {CONTESTED} SELECT k, ord, CASE WHEN s_name IS NULL OR hint LIKE '⚠%' THEN hint ELSE hint || '；⚠ 同指两解：字面「' || canonical || '」（级别未标）／改写「' || s_suppkey || '」（高）' END hint FROM c LEFT JOIN supplier ON s_nationkey = k AND replace(s_name, 'Supplier', 'Customer') = canonical""")
def contested_applied(spark, d):
    e = read(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("canonical"), F.array().cast("array<string>").alias("variants"), F.when(F.col("c_custkey") % 7 == 0, "⚠ 同指两解：旧").otherwise(F.col("c_mktsegment")).alias("hint"))
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("query"), F.lit("").alias("literal"), F.lit(None).cast("string").alias("literal_tier"), F.col("s_suppkey").cast("string").alias("correction"), F.lit("高").alias("correction_tier"))
    once = entities.apply_contested(e, s, glue.contested_clause)
    return entities.apply_contested(once, s, glue.contested_clause).select(F.col("key").alias("k"), "ord", "hint")


@query("""SELECT p_partkey, '疑似同指（term）：' || p_name || ' ／ ' || p_brand || ' 是否指同一对象？（' || p_type || '）——脚本未自动合并，请确认' question FROM part UNION ALL SELECT -p_partkey, '〔同指两解〕' || p_name || '：A=' || p_brand || '（高）；B=' || p_type || '（低）——正文已保留口播形并标注，请定夺' FROM part""")
def question_lines(spark, d):
    p = read(spark, d, "part")
    a = p.select("p_partkey", glue.suspect_question(F.array("p_name", "p_brand"), F.lit("term"), F.col("p_type")).alias("question"))
    return a.unionByName(p.select((-F.col("p_partkey")).alias("p_partkey"), glue.contested_question(F.col("p_name"), F.col("p_brand"), F.lit("高"), F.col("p_type"), F.lit("低")).alias("question")))


@query("""SELECT o_orderstatus section, o_custkey file_ord, o_orderkey ord, c_name label, o_orderpriority AS "text" FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' UNION ALL SELECT 'notes', o_custkey, o_orderkey, c_name, '[' || c_name || '] ' || o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def tagged_findings(spark, d):
    o = read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "notes").otherwise(F.col("o_orderstatus")).alias("section"), F.col("o_custkey").alias("file_ord"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("text"))
    return entities.tagged_findings(o, read(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("label")))


@query("SELECT DISTINCT key, name FROM (SELECT c_nationkey AS key, c_mktsegment name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier)")
def reopened_writings(spark, d):
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("name"))
    return entities.reopened_writings(a, read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name")))


# ---- reports ------------------------------------------------------------------
ITEMS = "items AS (SELECT user_id, event_id ord, event_id % 24 s, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || event_id END t FROM events)"
TITLED = "titles AS (SELECT * FROM " + given("s, title, priority", [(i, t, p) for i, (_, t, p) in enumerate(report.SECTIONS)]) + ")"


def _items(spark, d):
    name = F.get(F.array(*(F.lit(s) for s, _, _ in report.SECTIONS)), (F.col("event_id") % 24).cast("int"))
    return read(spark, d, "events").select("user_id", name.alias("section"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat_ws(" ", "event_type", "event_id")).alias("text"))


@query(f"""WITH {ITEMS}, {TITLED}, b AS (SELECT user_id, s, count(*) n, '## ' || any_value(title) || chr(10) || string_agg('- ' || t, chr(10) ORDER BY ord) body FROM items JOIN titles USING (s) WHERE t <> '' GROUP BY 1, 2),
w AS (SELECT user_id, '共有 ' || sum(n)::BIGINT || ' 个待处理项。' || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY s) body FROM b GROUP BY 1)
SELECT user_id, 'state ' || user_id || chr(10) || chr(10) || coalesce(body, '{report.NOTHING}') AS "text" FROM (SELECT DISTINCT user_id FROM events UNION ALL SELECT -1) LEFT JOIN w USING (user_id)""")
def review_document(spark, d):
    runs = read(spark, d, "events").select("user_id").distinct().union(spark.sql("select -1L")).withColumn("summary", F.concat(F.lit("state "), F.col("user_id").cast("string")))
    return report.review_queue(_items(spark, d), "user_id", runs)


@query(f"""WITH {ITEMS}, {TITLED} SELECT user_id, count(*) FILTER (priority = 'high') high, count(*) FILTER (priority = 'medium') "medium", count(*) FILTER (priority = 'low') low FROM items LEFT JOIN titles USING (s) WHERE t <> '' GROUP BY 1""")
def review_priorities(spark, d):
    return report.priorities(_items(spark, d), "user_id")


@query("""SELECT p_partkey k, 'numbers' section, p_name || ' — ' || p_brand || '：' || p_size || ' / ' || p_type AS "text" FROM part UNION ALL SELECT p_partkey, 'suspects', p_name || ' ／ ' || p_brand || '（term）：' || p_type FROM part UNION ALL SELECT p_partkey, 'network', p_name || CASE WHEN p_size % 2 = 0 THEN ' — ' || p_type ELSE '' END FROM part
UNION ALL SELECT p_partkey, 'logic_gaps', p_name || ' — ' || array_to_string(list_transform(range(1, least(p_size, 8) + 1), lambda i: i::VARCHAR), '、') || CASE WHEN p_size > 8 THEN '、等 ' || p_size || ' 个' ELSE '' END FROM part UNION ALL SELECT p_partkey, 'audit', p_name || ' — ' || p_brand FROM part UNION ALL SELECT p_partkey, 'auto_chunk', p_name || '：' || p_size || ' 段' FROM part
UNION ALL SELECT p_partkey, 'cross_file', p_name || '：' || p_size || '（' || p_brand || '）' FROM part UNION ALL SELECT p_partkey, 'sections', p_name || ' › ' || p_type || '：' || p_brand FROM part UNION ALL SELECT p_partkey, 'derivative_hard', p_name || ' L' || p_size || '：' || p_size || '元' FROM part""")
def review_lines(spark, d):
    p, size = read(spark, d, "part"), F.col("p_size").cast("string")
    rows = p.select(
        F.col("p_partkey").alias("k"), F.col("p_partkey").alias("o"), F.col("p_name").alias("label"), F.col("p_name").alias("name"), F.array(size, "p_type").alias("values"), F.array("p_name", "p_brand").alias("members"), F.lit("term").alias("kind"), F.col("p_type").alias("why"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("note"),
        F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: i.cast("string")).alias("titles"), F.array("p_brand").alias("rules"), F.array("p_brand").alias("files"), F.array("p_brand").alias("flags"), F.col("p_type").alias("title"), F.col("p_size").alias("parts"), F.col("p_size").alias("line_no"), size.alias("value"), F.lit("元").alias("unit"), F.col("p_brand"),
    )
    shown = {"numbers": rows.withColumn("name", F.col("p_brand")), "cross_file": rows.withColumn("values", F.array("value"))}
    out = None
    for name in ("numbers", "suspects", "network", "logic_gaps", "audit", "auto_chunk", "cross_file", "sections", "derivative_hard"):
        row = report.formatted(shown.get(name, rows), name, "k", "o").drop("ord")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT doc_id, len(regexp_split_to_array(text, '\\r\\n|\\r|\\n'))::BIGINT AS "lines", octet_length(encode(text))::BIGINT bytes, sha256(text) sha256 FROM documents""")
def manifest_files(spark, d):
    return report.manifest_files(read(spark, d, "documents").select("doc_id", "text"))


@query("""SELECT c_custkey, '{"schemaVersion":1,"c_custkey":' || c_custkey || ',"topic":null,"provider":{"name":"' || c_name || '","keyVar":"v"}}' AS "json" FROM customer""")
def manifest_without_secrets(spark, d):
    hidden = [x for k in ("client_secret", "access_token", "apiKey", "KEY", "Authorization") for x in (F.lit(k), F.lit("s"))]
    runs = read(spark, d, "customer").select("c_custkey", F.lit(None).cast("string").alias("topic"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("keyVar"), F.lit("v"), *hidden).alias("provider"))
    return report.manifest(runs, "c_custkey", "provider")


@query("""WITH s AS (SELECT coalesce(lang, '?') grp, source provider, count(*) FILTER (doc_id % 3 = 0 AND quality = 1) eh, count(*) FILTER (doc_id % 3 = 0) et, count(*) FILTER (doc_id % 3 = 1 AND quality = 1) th, count(*) FILTER (doc_id % 3 = 1) tt, count(*) FILTER (toxic = 1) f, grouping(lang) g FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, source), (source)))
SELECT provider, string_agg('- ' || provider || ' · ' || CASE WHEN g = 1 THEN 'all' ELSE grp END || ': ' || eh || '/' || et || ', traps ' || th || '/' || tt || ', failures ' || f, chr(10) ORDER BY g, grp) AS "text" FROM s WHERE provider IS NOT NULL GROUP BY 1""")
def retrieval_summary(spark, d):
    rows = read(spark, d, "documents").where("source is not null").join(read(spark, d, "labels"), "doc_id")
    kind = F.when(F.col("doc_id") % 3 == 0, "expect").when(F.col("doc_id") % 3 == 1, "trap").otherwise("unverifiable")
    return report.retrieval_summary(scoring.scorecard(rows.select(F.col("lang").alias("grp"), F.col("source").alias("provider"), kind.alias("kind"), (F.col("quality") == 1).alias("hit"), (F.col("toxic") == 1).alias("failed"), F.lit(1).cast("long").alias("latency_ms")), "grp", "provider"))


EFFORT_ROWS = [(k, v) for k, v in glue.EFFORTS.items()]


@query("SELECT user_id, stage, coalesce(CASE WHEN user_id % 3 = 0 AND stage = 'scout' THEN 'max' WHEN user_id % 3 = 1 AND stage = 'logic' THEN '' END, own) effort FROM (SELECT DISTINCT user_id FROM events), " + given("stage, own", EFFORT_ROWS))
def stage_efforts(spark, d):
    asked = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("scout"), F.lit("max"))).when(F.col("user_id") % 3 == 1, F.create_map(F.lit("logic"), F.lit("")))
    users = read(spark, d, "events").select("user_id").distinct().withColumn("asked", asked)
    return users.withColumn("stage", F.explode(F.array(*map(F.lit, glue.EFFORTS)))).select("user_id", "stage", glue.effort(F.col("stage"), F.col("asked")).alias("effort"))


# ---- audit --------------------------------------------------------------------
HAN_SIXTY = "".join(chr(0x5000 + 3 * i) for i in range(60))
EMPTY = "这个甲就是说乙这个丙那个丁"
HAN_PAIRS = [(1, EMPTY + HAN_SIXTY[:6], EMPTY + HAN_SIXTY[:6]), (2, EMPTY + HAN_SIXTY[:6], HAN_SIXTY[:12]), (3, HAN_SIXTY, HAN_SIXTY[:20]), (4, "这个甲那个乙这个丙那个丁", "这个甲乙" + HAN_SIXTY[:6]), (5, "嗯" + HAN_SIXTY[:3], HAN_SIXTY[:3])]
CONTENT = "len(regexp_extract_all({0}, '[一-龥]')) + len(regexp_extract_all({0}, '[A-Za-z0-9]+'))"
EMPTIES = "len(regexp_extract_all({0}, '" + audit.EMPTY_WORDS + "'))"
UNDER = f"({CONTENT.format('refined')} >= {audit.COMPRESSION_FLOOR} * ({CONTENT.format('source')}) AND {EMPTIES.format('source')} >= {audit.EMPTY_LEAST} AND ({EMPTIES.format('source')} - {EMPTIES.format('refined')}) / {EMPTIES.format('source')} < {audit.EMPTY_REDUCTION})"


def _pairs(spark):
    return spark.createDataFrame(HAN_PAIRS, "id long, source string, refined string")


@query(f"SELECT id, 'under_refined' AS name, 'hard' severity, 1::BIGINT n FROM {given('id, source, refined', HAN_PAIRS)} WHERE {UNDER}")
def under_refined(spark, d):
    return audit.findings(_pairs(spark), "id", audit.under_refined(F.col("source"), F.col("refined")))


@query(f"""WITH p AS (SELECT *, {UNDER} u, ({CONTENT.format('refined')}) / greatest({CONTENT.format('source')}, 1) < {audit.COMPRESSION_FLOOR} c, len(regexp_extract_all(refined, '(这个|那个|就是说|然后呢)')) e FROM {given('id, source, refined', HAN_PAIRS)}), g AS (SELECT * FROM {given('id, n', [(2, 3)])})
SELECT p.id, CASE WHEN u OR c OR g.id IS NOT NULL THEN 'fail' ELSE 'ok' END status, list_filter([CASE WHEN c THEN 'compression' END, CASE WHEN g.id IS NOT NULL THEN 'content_gap' END, CASE WHEN u THEN 'under_refined' END], lambda x: x IS NOT NULL) failed, (u::INT + c::INT + (g.id IS NOT NULL)::INT + (e > 0)::INT)::BIGINT n_findings FROM p LEFT JOIN g ON p.id = g.id""")
def pair_audit(spark, d):
    more = spark.createDataFrame([(2, "content_gap", "hard", 3)], "id long, name string, severity string, n long")
    return audit.pair_audit(_pairs(spark), "id", more)


@query(f"SELECT id, 'ok' status, []::VARCHAR[] failed, (len(regexp_extract_all(refined, '(这个|那个|就是说|然后呢)')) > 0)::BIGINT n_findings FROM {given('id, source, refined', HAN_PAIRS)}")
def summary_audit(spark, d):
    return audit.pair_audit(_pairs(spark), "id", summary=True)


@query("""SELECT conv_id, count(*) source_turns, count(*) FILTER (role <> 'user') refined_turns, count(*) FILTER (role <> 'user') / count(*) ratio FROM conversations GROUP BY 1""")
def turn_ratio(spark, d):
    c = read(spark, d, "conversations")
    return audit.turn_ratio(c, c.where("role <> 'user'"), "conv_id")


@query("""SELECT c_custkey, c_acctbal < 0 repaired, c_acctbal < -500 annotated, c_acctbal < -500 run_failed FROM customer""")
def repair_plan(spark, d):
    status = lambda limit: F.when(F.col("c_acctbal") < limit, "fail").otherwise("ok").alias("status")
    c = read(spark, d, "customer")
    return audit.repair_plan(c.select("c_custkey", status(0)), c.where("c_acctbal < 0").select("c_custkey", status(-500)), "c_custkey")


MAPPED = [(1, "甲a乙\n<!-- 丙\n丁 -->\n戊己"), (2, ""), (3, "\n\n庚")]


@query("SELECT * FROM " + given("id, norm, line_of", [(1, "甲乙戊己", [1, 1, 3, 3]), (2, "", []), (3, "庚", [3])]).replace("[]::VARCHAR[]", "[]::BIGINT[]"))
def line_map(spark, d):
    return audit.line_map(spark.createDataFrame(MAPPED, "id long, text string"), "id", "text")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders) WHERE rn <= 10""")
def most_conflicts(spark, d):
    return audit.most_conflicts(read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""WITH c AS (SELECT l_orderkey k, l_linestatus unit, l_quantity lo, l_quantity + 1 hi FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT l_orderkey k, l_linenumber line_no, l_linestatus unit, l_quantity v FROM lineitem WHERE l_returnflag <> 'A')
SELECT DISTINCT k, line_no::BIGINT line_no, v::VARCHAR "value", unit, CASE WHEN line_no % 3 = 0 THEN 'reporter' WHEN line_no % 3 = 1 THEN 'hard' ELSE 'review' END tier FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = f.k AND c.unit = f.unit AND f.v BETWEEN c.lo AND c.hi)""")
def derivative_attribution(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line_no"), F.col("l_linestatus").alias("unit"), F.col("l_quantity").alias("lo"), F.col("l_quantity").alias("hi"), F.col("l_quantity").cast("string").alias("value"), "l_returnflag")
    label = F.when(F.col("line_no") % 3 == 0, "【公开·待记者核实】x").when(F.col("line_no") % 3 == 1, "【访谈】x").otherwise("x")
    corpus = rows.where("l_returnflag = 'A'").select("k", "lo", (F.col("hi") + 1).alias("hi"), "unit")
    return audit.derivative_attribution(corpus, rows.where("l_returnflag <> 'A'").withColumn("line", label), "k")


DERIVED = [(1, 2, "- 【访谈】主力车型载重 6 吨。"), (1, 3, "- 【访谈】单程配送半径 88 公里。"), (1, 4, "- 【公开·待记者核实】估值约 500 亿元。"), (1, 5, "- 毛利率 45%。"), (1, 6, "- 【访谈】本轮融资 2亿元，账上 4000 元，2021 年。"), (1, 7, "- 【访谈】耗时 3 个月。")]


@query("SELECT * FROM " + given('id, line_no, "value", unit, tier', [(1, 3, "88", "公里", "hard"), (1, 4, "500", "亿", "reporter"), (1, 5, "45", "%", "review"), (1, 7, "3", "个月", "hard")]))
def derived_figures(spark, d):
    figures = lambda df, *keys: df.select("*", F.explode(atoms.number_atoms("line")).alias("a")).select(*keys, "a.value", "a.lo", "a.hi", "a.unit")
    corpus = spark.createDataFrame([(1, "载重 6 吨，融资 2 亿元，账上只剩4000块。3 月启动。")], "id long, line string")
    derived = spark.createDataFrame(DERIVED, "id long, line_no long, line string")
    return audit.derivative_attribution(figures(corpus, "id"), figures(derived, "id", "line_no", "line"), "id")


@query("""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 1 END two, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END three FROM documents) SELECT doc_id, CASE WHEN two < 3 AND three > two THEN 3 ELSE 2 END::BIGINT AS "level" FROM h""")
def heading_levels(spark, d):
    n = F.col("doc_id")
    text = F.concat(F.repeat(F.lit("## a\nx\n"), F.when(n % 3 == 0, 4).otherwise(1)), F.repeat(F.lit("### b\n"), F.when(n % 2 == 0, 3).otherwise(1)), F.lit("###x\n# y"))
    return anchors.heading_level(read(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query("""SELECT doc_id, name, ((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT n FROM documents, (SELECT unnest(['the', 'and', 'zzzz', 'é', 'un', 'der ', 'a']) name) WHERE contains(text, name)""")
def names_in_texts(spark, d):
    from lodestrata.operators.names import name_hits

    docs = read(spark, d, "documents").select("doc_id", "text")
    names = spark.createDataFrame([(x,) for x in ("the", "and", "zzzz", "é", "un", "der ", "a", "")], "name string")
    return name_hits(docs, ["doc_id"], "text", names, "name").join(docs, "doc_id").select("doc_id", "name", T.occurrences(F.col("text"), F.col("name")).alias("n"))


@query("""SELECT doc_id, canonical, variant, ((length(t) - length(replace(t, variant, ''))) // length(variant))::BIGINT n FROM (SELECT doc_id, canonical, variant, replace(text, canonical, '') t FROM documents, (VALUES ('there', 'the'), ('and', 'an'), ('zz', 'zzz')) g(canonical, variant)) WHERE contains(t, variant)""")
def ghost_names_in_texts(spark, d):
    names = spark.createDataFrame([("there", "the"), ("and", "an"), ("zz", "zzz")], "canonical string, variant string")
    return audit.ghost_names(read(spark, d, "documents").select("doc_id", "text"), names, "doc_id", "text")


@query("""SELECT conv_id, name, (k - 1 + off)::BIGINT line_no FROM (SELECT conv_id, turn, 1 off, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k FROM conversations WHERE turn = 1), (SELECT unnest(['the', 'you']) name) WHERE contains(line, name) AND NOT contains(line, '（音）')""")
def doubtful_names_in_texts(spark, d):
    docs = read(spark, d, "conversations").where("turn = 1").select("conv_id", "text")
    return anchors.missing_marks(docs, spark.createDataFrame([("the",), ("you",)], "name string"), "conv_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


@query("""WITH a AS (SELECT conv_id, text s FROM conversations WHERE turn = 0), p AS (SELECT conv_id, s, replace(s, f, t) r, f, t FROM a, (VALUES ('the', 'those'), ('you', 'we'), ('a-b', 'ab')) g(f, t)), n AS (SELECT conv_id, f, t, (length(s) - length(replace(s, f, ''))) // length(f) sf, (length(s) - length(replace(s, t, ''))) // length(t) st FROM p WHERE contains(s, f))
SELECT conv_id, f "from", t "to", sf::BIGINT source_from, st::BIGINT source_to, st >= 2 independent FROM n WHERE t <> 'ab'""")
def merge_review_of_texts(spark, d):
    c = read(spark, d, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("source"))
    g = spark.createDataFrame([("those", "the"), ("we", "you"), ("ab", "a-b")], "canonical string, variant string")
    # each name is replaced in a text of its own, so that all of them are replaced throughout
    out = None
    for canonical, variant in (("those", "the"), ("we", "you"), ("ab", "a-b")):
        row = anchors.merge_review(c.withColumn("refined", F.replace(F.replace("source", F.lit(variant), F.lit("\x00")), F.lit("\x00"), F.lit(canonical + canonical if variant in canonical else canonical))), g.where(F.col("variant") == variant), "conv_id")
        out = row if out is None else out.unionByName(row)
    return out.select("conv_id", "from", "to", "source_from", "source_to", "independent")


# ---- sources ------------------------------------------------------------------
@query("""SELECT event_id, service, CASE WHEN status = 200 AND service <> 'none' AND event_id % 3 <> 2 THEN least(event_id % 7, 5) ELSE 0 END::BIGINT n, CASE WHEN status <> 200 THEN 'HTTP ' || status END error, status = 200 AND event_id % 3 = 2 shape_error FROM (SELECT event_id, ['organic', 'results', 'webpages'][event_id % 3 + 1] service, CASE WHEN event_id % 10 = 9 THEN 503 ELSE 200 END status FROM events)""")
def search_outcomes(spark, d):
    n = F.col("event_id")
    service = F.element_at(F.array(F.lit("organic"), F.lit("results"), F.lit("webpages")), (n % 3 + 1).cast("int"))
    items = F.concat(F.lit("["), F.array_join(F.transform(F.when(n % 7 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (n % 7).cast("int"))), lambda i: F.concat(F.lit('{"title":"t'), i.cast("string"), F.lit('"}'))), ","), F.lit("]"))
    status = F.when(n % 10 == 9, 503).otherwise(200)
    reply = F.when(status != 200, "{}").when(n % 3 == 0, F.concat(F.lit('{"organic":'), items, F.lit("}"))).when(n % 3 == 1, F.concat(F.lit('{"results":'), items, F.lit("}"))).otherwise('{"data":{"webPages":{}}}')
    rows = read(spark, d, "events").select("event_id", service.alias("service"), status.alias("status"), F.lit(5).alias("latency_ms"), reply.alias("reply"))
    return files.search_outcome(rows).select("event_id", "service", F.size("results").cast("long").alias("n"), "error", "shape_error")


@query("""SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) known FROM documents""")
def known_rows(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    known, other = files.known_rows(rows, read(spark, d, "labels").select(F.col("doc_id").alias("id")))
    return known.withColumn("known", F.lit(True)).unionByName(other.withColumn("known", F.lit(False))).withColumnRenamed("id", "doc_id")


@query("""SELECT doc_id id, kind, grp IS NOT NULL AND kind <> 'other' good FROM (SELECT doc_id, ['expect', 'trap', 'unverifiable', 'other'][doc_id % 4 + 1] kind, CASE WHEN doc_id % 5 > 0 THEN 'g' END grp FROM documents)""")
def checked_cases(spark, d):
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("expect", "trap", "unverifiable", "other"))), (n % 4 + 1).cast("int"))
    good, bad = files.checked_cases(read(spark, d, "documents").select(n.alias("id"), kind.alias("kind"), F.when(n % 5 > 0, "g").alias("group")))
    return good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False))).select("id", "kind", "good")


@query("SELECT item_id, text AS body FROM benchmark")
def uploads(spark, d):
    sent = read(spark, d, "benchmark").select("item_id", F.base64(F.encode("text", "utf-8")).alias("sent"))
    return sent.select("item_id", F.decode(files.upload(F.col("sent")), "utf-8").alias("body"))


@query("""SELECT c_nationkey, batch::BIGINT batch, section_ord, list(c_name ORDER BY rn) AS names FROM (SELECT *, (rn - 1) // 12 batch FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY worth DESC, section_ord, c_custkey) rn FROM (SELECT c_nationkey, c_custkey, c_name, CASE WHEN c_acctbal > 5000 THEN 4 ELSE 0 END worth, c_custkey % 3 section_ord FROM customer)) WHERE rn <= 144) GROUP BY 1, 2, 3""")
def verify_lists(spark, d):
    e = read(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 5000, 4).otherwise(0).alias("worth"), (F.col("c_custkey") % 3).alias("section_ord"), F.lit(False).alias("suspect"))
    return turns.batch_lists(turns.verify_batches(e, ["c_nationkey"], True), ["c_nationkey"])


@query("""SELECT p_partkey, p_type LIKE '%O%' cites_external, CASE WHEN p_size % 2 = 0 THEN '采访' ELSE '' END AS "label" FROM part""")
def glossary_sources(spark, d):
    hint = F.concat(F.when(F.col("p_type").contains("O"), "某官网").otherwise("x"), F.when(F.col("p_size") % 2 == 0, "〔采访〕").otherwise(""))
    return glossary.lint_flags(read(spark, d, "part").select("p_partkey", hint.alias("hint"))).select("p_partkey", "cites_external", "label")


@query("""SELECT doc_id, len(regexp_extract_all(t, '(我觉得|可能|大概|也许|应该|好像|似乎|据说|估计|差不多|左右)'))::BIGINT n, doc_id % 4 >= 2 AND (doc_id % 3) * 2 < doc_id % 4 lost FROM (SELECT doc_id, repeat('可能左右', (doc_id % 4)::INTEGER) t FROM documents)""")
def hedge_loss(spark, d):
    n = F.col("doc_id")
    return read(spark, d, "documents").select("doc_id", audit.hedges(F.repeat(F.lit("可能左右"), (n % 4).cast("int"))).alias("n"), atoms.hedges_lost(n % 4, n % 3).alias("lost"))


# ---- runs ---------------------------------------------------------------------
@query("""SELECT user_id, sum(event_id % 1000)::BIGINT input, sum(event_id % 300)::BIGINT cached, sum(event_id % 77)::BIGINT output, count(*) agents, count(*) FILTER (event_type = 'click') failed FROM events GROUP BY 1""")
def usage_totals(spark, d):
    n = F.col("event_id")
    return runlog.usage(read(spark, d, "events").select("user_id", (n % 1000).alias("input"), (n % 300).alias("cached"), (n % 77).alias("output"), (F.col("event_type") == "click").alias("failed")), "user_id")


@query("""WITH m AS (SELECT user_id, event_type stage, event_id "at", event_id % 2 = 0 s FROM events) SELECT user_id, stage, min("at") FILTER (s) started, max("at") FILTER (NOT s) ended, CASE WHEN min("at") FILTER (s) IS NULL OR max("at") FILTER (NOT s) IS NULL THEN 0 ELSE greatest(0, max("at") FILTER (NOT s) - min("at") FILTER (s)) END::BIGINT ms,
'last=' || max("at") || CASE WHEN max("at") FILTER ("at" % 3 = 0) IS NULL THEN '' ELSE ',third=' || max("at") FILTER ("at" % 3 = 0) END meta FROM m GROUP BY 1, 2""")
def stage_times(spark, d):
    n = F.col("event_id")
    text = n.cast("string")
    meta = F.when(n % 3 == 0, F.create_map(F.lit("last"), text, F.lit("third"), text)).otherwise(F.create_map(F.lit("last"), text))
    marks = read(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), n.alias("at"), F.when(n % 2 == 0, "start").otherwise("done").alias("status"), meta.alias("meta"))
    return runlog.stage_times(marks, "user_id").withColumn("meta", F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END::BIGINT people, CASE WHEN p_size % 3 < 2 THEN 1 ELSE 0 END::BIGINT notes, CASE WHEN p_size % 3 = 0 THEN p_name END canonical FROM part""")
def stage_reports(spark, d):
    name, size = F.col("p_name"), F.col("p_size")
    whole = F.concat(F.lit('{"people":[{"canonical":"'), name, F.lit('","variants":["v"]},{"canonical":""},{"hint":"x"}],"special_notes":["n"],"other":1}'))
    reply = F.when(size % 3 == 0, whole).when(size % 3 == 1, '{"special_notes":["n"],"people":null}').otherwise("no report")
    rows = read(spark, d, "part").select("p_partkey", files.stage_report(reply).alias("r"))
    return rows.select("p_partkey", F.size("r.people").cast("long").alias("people"), F.size("r.special_notes").cast("long").alias("notes"), F.get("r.people.canonical", F.lit(0)).alias("canonical"))


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) rn FROM orders) WHERE rn <= 30""")
def top_speakers(spark, d):
    rows = read(spark, d, "orders").select("o_orderpriority", F.col("o_orderkey").alias("ord"), F.array("o_orderstatus").alias("variants"))
    return report.top_known(rows, ["o_orderpriority"], n=30).select("o_orderpriority", F.col("ord").alias("o_orderkey"))
