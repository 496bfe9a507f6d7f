"""Operators over the tables, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import anchors, audit, entities, glue, report, scoring, turns
from lodestrata.plans.queries import SPANS, _spans, query, question_turns, read
from lodestrata.sources import files

def none():
    """No names."""
    return F.array().cast("array<string>")


def words(n: str, *choices: str) -> str:
    """SQL: one of the words, by a number."""
    return "[" + ", ".join(f"'{c}'" for c in choices) + f"][({n}) % {len(choices)} + 1]"


def one_of(n, *choices: str):
    return F.element_at(F.array(*map(F.lit, choices)), (n % len(choices) + 1).cast("int"))


# ---- text functions: Han words joined to the tables' own -----------------------
FORMS = ("王总", "王总（董事长）", "李老师", "CEO", "欧阳娜娜总", "甲公司(注)", "")


@query(f"""SELECT p_partkey, s, coalesce(list_max(list_transform(regexp_extract_all(s, '[一-鿿]+'), lambda x: length(x))), 0)::BIGINT run, trim(regexp_replace(s, '[（(][^）)]*[）)]', '', 'g')) bare, regexp_matches(s, '^[一-龥]{{1,2}}总$|(老师|总监|经理|主管)$|^(董事长|老板|老板娘|总经理|总裁|创始人|CEO|CFO|CTO|COO|PR|嘉宾|记者|主持人|同事|领导)$') weak
FROM (SELECT p_partkey, {words('p_partkey', *FORMS)} || CASE WHEN p_size % 5 = 0 THEN p_type ELSE '' END s FROM part)""")
def names_of_parts(spark, d):
    s = F.concat(one_of(F.col("p_partkey"), *FORMS), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(""))
    rows = read(spark, d, "part").select("p_partkey", s.alias("s"))
    return rows.select("p_partkey", "s", T.longest_han_run(F.col("s")).alias("run"), T.strip_description(F.col("s")).alias("bare"), T.is_weak_key(F.col("s")).alias("weak"))


@query(f"""WITH p AS (SELECT doc_id, {words('doc_id', '据', '经网络搜索确认', 'www.', '', '公司官网')} || coalesce(substr(source, 1, (doc_id % 9)::INTEGER), '') s FROM documents)
SELECT doc_id, trim(s) <> '' AND NOT (len(list_filter([{', '.join(f"'{v}'" for v in T.VAGUE_SOURCES)}], lambda v: contains(lower(s), v))) > 0) AND (regexp_matches(s, '(?i)(^|[^A-Za-z0-9_])(https?://|www\\.|[a-z0-9-]+\\.(com|cn|org|net|gov|edu|io|co)([^A-Za-z0-9_]|$))') OR length(trim(s)) >= 6) concrete FROM p""")
def sources_of_documents(spark, d):
    n = F.col("doc_id")
    s = F.concat(one_of(n, "据", "经网络搜索确认", "www.", "", "公司官网"), F.coalesce(F.substring("source", F.lit(1), (n % 9).cast("int")), F.lit("")))
    return read(spark, d, "documents").select("doc_id", T.is_concrete_source(s).alias("concrete"))


@query(f"""WITH p AS (SELECT p_partkey, [p_name, p_brand, p_type, '⚠ ' || p_size] || CASE WHEN p_size % 2 = 0 THEN [p_brand, 'x' || p_size] ELSE [] END c FROM part), q AS (SELECT p_partkey, list_filter(c, lambda x: NOT contains(x, '⚠')) all_, c[4] w FROM p), r AS (SELECT p_partkey, w, CASE WHEN len(all_) > 3 THEN [all_[1], all_[2], all_[3]] ELSE all_ END a, len(all_) n, list_contains(all_[1:3], all_[4]) twice, all_ FROM q)
SELECT p_partkey, array_to_string(a || [w] || CASE WHEN n - twice::INT > 3 THEN ['{T.CUT_MARK}'] ELSE [] END, '；') merged, substr(all_[1], 1, 36) || '；' || w short FROM r""")
def hints_of_parts(spark, d):
    a = F.concat_ws("；", "p_name", "p_brand", F.col("p_type"))
    b = F.concat_ws("；", F.concat(F.lit("⚠ "), F.col("p_size").cast("string")), F.when(F.col("p_size") % 2 == 0, F.concat_ws("；", "p_brand", F.concat(F.lit("x"), F.col("p_size").cast("string")))))
    return read(spark, d, "part").select("p_partkey", T.merge_hints(a, b).alias("merged"), T.trim_hint(F.concat_ws("；", a, b)).alias("short"))


@query("""SELECT o_orderkey, o_orderpriority || ' / x' AS "text", CASE o_orderkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'user' WHEN 2 THEN 'recheck' WHEN 3 THEN 'contested' ELSE 'unknown' END confidence, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE '' END "date" FROM orders""")
def confidence_of_orders(spark, d):
    n = F.col("o_orderkey")
    mark = F.when(n % 5 == 0, F.concat(F.lit(" 〔核实·"), F.date_format("o_orderdate", "yyyy-MM"), F.lit("〕"))).otherwise(one_of(n, "", " 〔用户钦定〕", " 〔待复核〕", " 〔同指两解〕 ", ""))
    rows = read(spark, d, "orders").select("o_orderkey", T.strip_confidence(F.concat("o_orderpriority", F.lit(" / x"), mark)).alias("c"))
    return rows.select("o_orderkey", "c.text", "c.confidence", "c.date")


@query("""SELECT event_id, '{"prompt_cache_hit_tokens": ' || user_id || ', "k": "' || event_type || '"}' body, user_id cached FROM events""")
def replies_of_events(spark, d):
    body = F.concat(F.lit('{"prompt_cache_hit_tokens": '), F.col("user_id").cast("string"), F.lit(', "k": "'), "event_type", F.lit('"}'))
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("so: "), body, F.lit(" end")))
    out = read(spark, d, "events").select("event_id", T.json_body(reply).alias("body"))
    return out.withColumn("cached", T.cached_tokens(F.col("body")).cast("long"))


@query(r"""SELECT item_id, regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || 'end' || chr(10) AS "text" FROM benchmark""")
def stitched_items(spark, d):
    b = read(spark, d, "benchmark")
    return b.select("item_id", turns.stitched(F.array(F.concat("text", F.lit("\n \n")), F.lit(" "), F.lit("end  "))).alias("text"))


@query("""SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'DB_' || lang ELSE 'KNOWN' END], lambda k: k <> 'KNOWN')[1] AS key, coalesce(source, '') AS "value" FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL""")
def environments(spark, d):
    n = F.col("doc_id")
    line = F.concat(F.when(n % 4 == 0, "export ").otherwise(""), F.when(n % 2 == 0, F.concat(F.lit("DB_"), "lang")).otherwise("KNOWN"), F.lit(" = "), F.when(n % 4 == 0, F.concat(F.lit('"'), F.coalesce("source", F.lit("")), F.lit('" # x'))).otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit(" # remark"))))
    rows = read(spark, d, "documents").where("lang is not null").select(n.alias("line_no"), line.alias("line"))
    return files.environment(rows, spark.createDataFrame([("KNOWN",)], "key string")).withColumnRenamed("line_no", "doc_id")


# ---- turns --------------------------------------------------------------------
@query("""SELECT doc_id, ('00:00:' || lpad((doc_id % 50)::VARCHAR, 2, '0')) ts, '甲' speaker, coalesce(lang, 'x') || 'b' AS "text" FROM documents UNION ALL SELECT doc_id, '00:01:00', '乙', 'c' FROM documents""")
def subtitles_of_documents(spark, d):
    sec = F.lpad((F.col("doc_id") % 50).cast("string"), 2, "0")
    srt = F.concat(F.lit("1\n00:00:"), sec, F.lit(",000 --> 00:00:59,000\n甲："), F.coalesce("lang", F.lit("x")), F.lit("\n\n2\n00:00:59,000 --> 00:01:00,000\n甲：b\n\n3\n00:01:00,500 --> 00:01:09,000\n乙：c\n"))
    return files.subtitle_turns(read(spark, d, "documents").select("doc_id", srt.alias("t")), "doc_id", "t").select("doc_id", "ts", "speaker", "text")


@query("""WITH l AS (SELECT conv_id, string_agg('**' || role || '**：' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) t, list(role ORDER BY turn) r FROM conversations GROUP BY 1) SELECT conv_id, i::BIGINT turn_no, r[i] "label", i::BIGINT start_line, i::BIGINT end_line FROM l, range(1, len(r) + 1) x(i)""")
def labelled_turns(spark, d):
    line = F.concat(F.lit("**"), "role", F.lit("**："), F.replace("text", F.lit("\n"), F.lit(" ")))
    talk = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return anchors.speaker_turns(talk, "conv_id", "text").select("conv_id", "turn_no", F.col("speaker").alias("label"), "start_line", "end_line")


@query("""SELECT n_nationkey id, x.title, x.a::BIGINT start_line, x.b::BIGINT end_line FROM nation, (SELECT unnest([{'title': 'n', 'a': 2, 'b': 3}, {'title': '丁、戊', 'a': 4, 'b': 4}, {'title': '丁、戊', 'a': 5, 'b': 7}]) x)""")
def sections_of_nations(spark, d):
    docs = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("# "), "n_name", F.lit("\n## n\n"), "n_name", F.lit("\n## 丁、戊\n## 丁、戊\n### x\n##no")).alias("text"))
    return turns.sections(docs, "id", "text")


@query(f"""WITH RECURSIVE s AS ({SPANS}), t AS (SELECT s.conv_id, s.turn, s.start_line, s.end_line, coalesce(regexp_matches(regexp_replace(c.text, '(<!--[^>]*-->|[\\s  　﻿]|["''”’」』）)*_])+$', ''), '[?？]$'), false) q FROM s JOIN conversations c ON s.conv_id = c.conv_id AND s.turn = c.turn),
f AS (SELECT conv_id, max(end_line) n, count(*) k, list(start_line ORDER BY start_line) a, list(q ORDER BY start_line) q FROM t GROUP BY 1),
one AS (SELECT *, list_transform(range(1, k), lambda j: a[j + 1] - 1) ends, floor(n / 3.0 + 0.5) g1, floor(2 * n / 3.0 + 0.5) g2 FROM f WHERE k >= 3),
near AS (SELECT *, list_position(list_transform(ends, lambda e: abs(e - g1)), list_min(list_transform(ends, lambda e: abs(e - g1)))) m1, list_position(list_transform(ends, lambda e: abs(e - g2)), list_min(list_transform(ends, lambda e: abs(e - g2)))) m2 FROM one),
c1 AS (SELECT *, greatest(1, least(m1, k - 2)) t1 FROM near),
d1 AS (SELECT *, CASE WHEN NOT q[t1] THEN t1 ELSE coalesce(list_max(list_filter(range(1, t1), lambda j: NOT q[j])), list_min(list_filter(range(t1 + 1, k - 1), lambda j: NOT q[j])), t1) END u1 FROM c1),
c2 AS (SELECT *, greatest(u1 + 1, least(m2, k - 1)) t2 FROM d1),
d2 AS (SELECT *, CASE WHEN NOT q[t2] THEN t2 ELSE coalesce(list_max(list_filter(range(u1 + 1, t2), lambda j: NOT q[j])), list_min(list_filter(range(t2 + 1, k), lambda j: NOT q[j])), t2) END u2 FROM c2),
cuts AS (SELECT conv_id, n, [ends[u1], ends[u2], n] b FROM d2 UNION ALL SELECT conv_id, n, list_filter([ceil(n / 3)::BIGINT, 2 * ceil(n / 3)::BIGINT], lambda x: x < n) || [n] FROM f WHERE k < 3)
SELECT conv_id, i::BIGINT idx, CASE WHEN i = 1 THEN 1 ELSE b[i - 1] + 1 END::BIGINT start_line, b[i]::BIGINT end_line, i = len(b) is_last FROM cuts, range(1, 4) r(i) WHERE i <= len(b)""")
def turn_aware_chunks(spark, d):
    rows = _spans(spark, d).join(question_turns(spark, d), ["conv_id", "turn"])
    talk = rows.groupBy("conv_id").agg(F.max("end_line").alias("n_lines"), F.lit(3).cast("long").alias("parts"), F.collect_list(F.struct("start_line", "q")).alias("turns"))
    return turns.turn_chunks(talk, "conv_id")


@query("""SELECT doc_id, CASE WHEN n <= 1 THEN 1 WHEN n_chars > 1200 THEN ceil(n_chars / 1200) ELSE 1 END::BIGINT plain, CASE WHEN n <= 1 THEN 1 ELSE greatest(CASE WHEN n_chars > 18000 THEN ceil(n_chars / 18000) ELSE 1 END, CASE WHEN n_chars > 12000 THEN 2 ELSE 1 END) END::BIGINT speed, CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ceil(n_chars / 2000)) END::BIGINT chunk, 1::BIGINT off FROM (SELECT doc_id, n_chars, len(string_split(text, chr(10))) n FROM documents WHERE n_chars IS NOT NULL)""")
def chunk_counts_of_documents(spark, d):
    size, n = F.col("n_chars"), F.size(F.split("text", "\n", -1)).cast("long")
    return read(spark, d, "documents").where("n_chars is not null").select("doc_id", turns.refine_parts(size, n, None, 1200).alias("plain"), turns.refine_parts(size, n, "speed", 18000).alias("speed"), turns.refine_parts(size, n, None, 18000, 2000).alias("chunk"), turns.refine_parts(size, n, "off", 10).alias("off"))


@query("""SELECT conv_id, idx, line FROM (SELECT conv_id, turn idx, lag(list_extract(string_split(regexp_replace(t, '\\s+$', ''), chr(10)), -1)) OVER (PARTITION BY conv_id ORDER BY turn) line, string_split(t, chr(10))[1] f FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'x' || chr(10) || role || chr(10) ELSE CASE WHEN conv_id % 2 = 0 THEN 'user' ELSE role END || chr(10) || 'y' END t FROM conversations)) WHERE f = line""")
def seams_of_conversations(spark, d):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x\n"), "role", F.lit("\n"))).otherwise(F.concat(F.when(F.col("conv_id") % 2 == 0, "user").otherwise(F.col("role")), F.lit("\ny")))
    return glue.seams(read(spark, d, "conversations").select("conv_id", F.col("turn").alias("idx"), text.alias("text")), "conv_id")


# ---- entities -----------------------------------------------------------------
@query("""SELECT c_custkey, 'contradiction' AS what, s_name AS other FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey = c_custkey UNION ALL SELECT c_custkey, 'conflict', c_mktsegment FROM customer WHERE c_custkey % 4 = 0""")
def checks_of_customers(spark, d):
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    prior = c.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("canonical"), none().alias("variants"), F.lit("verified").alias("confidence"))
    fresh = s.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("ord"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("canonical"), F.array("s_name").alias("variants"))
    a = entities.contradictions(prior, fresh).select(F.col("ord").alias("c_custkey"), F.lit("contradiction").alias("what"), F.array_join("writings", ",").alias("other"))
    resolved = c.where("c_custkey % 4 < 2").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("query"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("hit_canonical"))
    number = F.regexp_extract("query", "([0-9]+)", 1).cast("long")
    return a.unionByName(entities.glossary_conflicts(prior, resolved).select(number.alias("c_custkey"), F.lit("conflict").alias("what"), F.col("hit_canonical").alias("other")))


@query("""SELECT c_custkey, c_custkey % 3 = 0 AND c_custkey % 2 = 0 trusted FROM customer""")
def trusted_customers(spark, d):
    n = F.col("c_custkey")
    e = read(spark, d, "customer").select(n.alias("ord"), F.concat(F.lit("王"), "c_name", F.lit("（嘉宾）")).alias("canonical"), none().alias("variants"), "c_name")
    labels = e.where("ord % 3 = 0").select(F.concat(F.when(F.col("ord") % 2 == 0, "王").otherwise(""), "c_name").alias("label"))
    return glue.trusted(e.drop("c_name"), labels).select(F.col("ord").alias("c_custkey"), "trusted")


@query("""SELECT c_custkey, c_mktsegment category, c_name name, CASE WHEN s_suppkey % 2 = 0 THEN 'brand' ELSE 'person' END "found" FROM customer JOIN supplier ON replace(s_name, 'Supplier', 'Customer') = c_name""")
def categories_of_customers(spark, d):
    kind = F.when(F.col("s_suppkey") % 2 == 0, "brand").otherwise("person")
    e = read(spark, d, "supplier").select(kind.alias("kind"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("canonical"), none().alias("variants"))
    decrees = read(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("name"))
    return glue.category_warnings(decrees, e).withColumnRenamed("ord", "c_custkey")


@query("""SELECT DISTINCT name FROM (SELECT c_name name FROM customer UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT p_name FROM part WHERE p_size % 4 IN (0, 1)) WHERE name NOT IN (SELECT p_name FROM part WHERE p_size % 4 IN (2, 3)) AND name NOT IN (SELECT c_name FROM customer WHERE c_acctbal < 0)""")
def settled_names_of_tables(spark, d):
    c, size = read(spark, d, "customer"), F.col("p_size")
    prior = read(spark, d, "part").select(F.col("p_name").alias("canonical"), none().alias("variants"), one_of(size, "verified", "user", "recheck", "contested").alias("confidence"))
    return glue.settled(c.select(F.col("c_name").alias("query"), F.col("c_mktsegment").alias("canonical")), prior, c.where("c_acctbal < 0").select(F.col("c_name").alias("name")))


# ---- scores -------------------------------------------------------------------
@query("""SELECT doc_id id, CASE doc_id % 3 WHEN 0 THEN contains(t, 'the') OR contains(t, 'und') WHEN 1 THEN contains(t, 'the') ELSE NOT contains(t, 'que') AND NOT contains(t, 'the') END met FROM (SELECT doc_id, regexp_replace(lower(nfc_normalize(text)), '\\s+', '', 'g') t FROM documents WHERE regexp_matches(text, '^[ -~\\n]*$'))""")
def cases_of_documents(spark, d):
    kind = one_of(F.col("doc_id"), "expect", "trap", "unverifiable")
    rows = read(spark, d, "documents").where(F.col("text").rlike(r"\A[ -~\n]*\z")).select(F.col("doc_id").alias("id"), kind.alias("kind"), F.array(F.lit("the")).alias("expect"), F.array(F.lit("que")).alias("traps"), F.array(F.lit("und")).alias("hints"), F.col("text").alias("found"))
    return scoring.case_scores(rows).select("id", "met")


@query("""WITH p AS (SELECT (NOT contains(text, 'the'))::INT + (NOT contains(text, 'zzz'))::INT gone, contains(text, 'a')::INT + contains(text, 'und')::INT kept FROM documents) SELECT sum(gone) / (2 * count(*)) cut_recall, sum(kept) / (2 * count(*)) keep_rate, (2 * count(*) - sum(kept))::BIGINT over_deletions FROM p""")
def fillers_of_documents(spark, d):
    lits = lambda *x: F.array(*map(F.lit, x))
    return scoring.filler_score(read(spark, d, "documents").select(F.col("doc_id").alias("id"), lits("the", "zzz").alias("cut"), lits("a", "und").alias("keep"), F.coalesce("text", F.lit("")).alias("out")))


@query("""SELECT doc_id id, (NOT contains(text, 'the'))::BIGINT missing, contains(text, 'que')::BIGINT forbidden, contains(text, 'the') AND NOT contains(text, 'que') passed FROM documents""")
def golden_documents(spark, d):
    return scoring.golden_score(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(F.lit("the")).alias("contain"), F.array(F.lit("que")).alias("forbid"), F.coalesce("text", F.lit("")).alias("out")))


@query("""SELECT doc_id, CASE WHEN toxic = 1 OR quality IS NULL THEN 1 WHEN doc_id % 3 = 0 AND NOT (doc_id % 2 = 0 AND n_chars > 100) THEN 1 ELSE 0 END::BIGINT code, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'rewrite' ELSE 'patch' END "action" FROM documents LEFT JOIN labels USING (doc_id)""")
def exit_codes_of_documents(spark, d):
    n = F.col("doc_id")
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    rules = F.when(n % 4 == 0, none()).when(n % 4 == 1, F.array(F.lit("stutter"), F.lit("compression"))).otherwise(F.array(F.lit("quote_style")))
    return rows.select("doc_id", scoring.exit_code(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("quality").isNull(), n % 3 == 0, n % 2 == 0, F.coalesce(F.col("n_chars") > 100, F.lit(False))).alias("code"), scoring.repair_action(rules).alias("action"))


# ---- lookups and guards ---------------------------------------------------------
@query("""SELECT user_id AS key, event_type title, list("value" ORDER BY f) AS "lines" FROM (SELECT user_id, event_type, round("value")::BIGINT::VARCHAR "value", min(event_id) f FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def preserved_values(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("title"), F.col("event_id").alias("ord"), F.round("value").cast("long").cast("string").alias("line"))
    return glue.preserved(rows)


@query("""SELECT o_custkey id, o_orderkey title, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN l END "order" FROM orders LEFT JOIN (SELECT l_orderkey, count(*) l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def orders_of_headings(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("source_order"))
    places = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("title")).agg(F.count(F.lit(1)).alias("line_no")).where("title % 3 = 1")
    return glue.heading_orders(o, places.join(o.select("id", "title"), "title"), "id").select("id", "title", "order")


@query("""SELECT doc_id, CASE WHEN e IS NULL THEN replace(t, o, 'X') ELSE t END AS "text", e AS "error" FROM (SELECT *, CASE WHEN o = '' THEN 'empty' WHEN n = 0 THEN 'missing' WHEN n > 1 AND doc_id % 2 = 1 THEN 'ambiguous' END e FROM (SELECT *, CASE WHEN o = '' THEN 0 ELSE (length(t) - length(replace(t, o, ''))) // length(o) END n FROM (SELECT doc_id, coalesce(text, '') t, ['the', 'zzzz', '', 'harbour'][doc_id % 4 + 1] o FROM documents)))""")
def edits_of_documents(spark, d):
    n = F.col("doc_id")
    rows = read(spark, d, "documents").select("doc_id", glue.exact_edit(F.coalesce("text", F.lit("")), one_of(n, "the", "zzzz", "", "harbour"), F.lit("X"), n % 2 == 0).alias("r"))
    return rows.select("doc_id", "r.*")


@query("""SELECT page_id, (path = '/a' OR starts_with(path, '/a/')) AND NOT regexp_matches(path, '(^|/)[.][.](/|$)') ok FROM (SELECT page_id, ['/a/', '/ab/', '/a/../', '/a'][page_id % 4 + 1] || CASE WHEN page_id % 4 = 3 THEN '' ELSE regexp_extract(url, '([^/]*)$', 1) END path FROM pages)""")
def paths_of_pages(spark, d):
    n = F.col("page_id")
    path = F.concat(one_of(n, "/a/", "/ab/", "/a/../", "/a"), F.when(n % 4 == 3, "").otherwise(F.regexp_extract("url", r"([^/]*)\z", 1)))
    return read(spark, d, "pages").select("page_id", glue.inside(path, ["/a/"]).alias("ok"))


@query("""SELECT c_custkey, c_acctbal < 0 OR c_custkey % 7 = 0 garbled, coalesce(c_mktsegment LIKE '%B%', false) network, c_custkey % 2 = 0 headings FROM customer""")
def stage_checks_of_customers(spark, d):
    n = F.col("c_custkey")
    names = F.array(F.concat("c_name", F.when(n % 7 == 0, F.repeat(F.lit("字"), 16)).otherwise("字")))
    speakers = F.when(F.col("c_acctbal") < 0, none()).otherwise(F.array("c_name"))
    note = F.when(F.col("c_mktsegment").contains("B"), F.concat("c_mktsegment", F.lit(" request timed out"))).otherwise("查无")
    return read(spark, d, "customer").select("c_custkey", report.garbled(names, speakers).alias("garbled"), report.network_unverified(note).alias("network"), report.heading_conflict(F.lit("none"), F.when(n % 2 == 0, F.concat(F.lit("x\n## "), "c_name")).otherwise(F.col("c_name"))).alias("headings"))


@query("""SELECT '/n/' || c_custkey || '.md' path, c_name source, s_name refined FROM customer JOIN supplier ON s_suppkey = c_custkey""")
def pairs_by_path(spark, d):
    a = read(spark, d, "customer").select(F.concat(F.lit("/n/./"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.col("c_name").alias("source"))
    return report.paired(a, read(spark, d, "supplier").select(F.concat(F.lit("/n//"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"), F.col("s_name").alias("refined")))


@query("""SELECT c_name "file", arg_min(o_orderpriority, o_orderkey) report FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def reports_of_customers(spark, d):
    wanted = read(spark, d, "customer").select(F.col("c_name").alias("file"), F.array(F.col("c_name"), F.concat(F.lit("/"), F.col("c_custkey").cast("string"))).alias("candidates"))
    path = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/"), F.col("o_custkey").cast("string")))
    name = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")))
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    reports = read(spark, d, "orders").join(names, "o_custkey").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("report"), F.when(name.isNotNull(), F.col("c_name")).alias("label"), path.alias("path"), F.lit(None).cast("string").alias("original"), F.lit("").alias("out"))
    return report.report_for(wanted, reports)


@query("""SELECT p_brand, count(*) n, CASE WHEN count(*) < 3 THEN 'thin' WHEN count(*) FILTER (p_size % 3 > 0) / count(*) < 0.5 THEN 'few_hints' WHEN count(*) FILTER (p_size % 4 = 0) / count(*) < 0.3 THEN 'few_variants' ELSE 'ok' END lint FROM part GROUP BY 1""")
def lint_of_brands(spark, d):
    size = F.col("p_size")
    return audit.glossary_lint(read(spark, d, "part").select("p_brand", F.when(size % 3 > 0, F.col("p_type")).otherwise("").alias("hint"), F.when(size % 4 == 0, F.array("p_name")).otherwise(none()).alias("variants")), "p_brand")


@query("""SELECT c_nationkey, c_name title, count(s_suppkey) covered FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND replace(s_name, 'Supplier', 'Customer') = c_name GROUP BY 1, 2""")
def coverage_of_plans(spark, d):
    heads = read(spark, d, "customer").select("c_nationkey", F.concat("c_name", F.lit(" ")).alias("title"))
    threads = read(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.array(F.concat(F.lit(" "), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))).alias("sections"))
    return audit.plan_coverage(heads, threads, "c_nationkey")


@query("""SELECT o_orderkey, n BETWEEN 3 AND 7 AND o_custkey % 5 > 0 AND o_custkey % 7 > 0 AND NOT (n >= 8 AND n / 10.0 > 0.85) AS holds FROM (SELECT o_orderkey, any_value(o_custkey) o_custkey, count(*) n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def plans_of_orders(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_custkey").agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("threads"))
    n, off = F.size("threads"), lambda m: F.when(F.col("o_custkey") % m == 0, 1).otherwise(0)
    return rows.select("o_orderkey", glue.plan_verdict(F.col("threads"), off(5), off(7), n / 10, n).alias("holds"))


@query("""SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) labels, bool_or(turn % 2 = 1) headings, max(turn)::BIGINT anchor FROM conversations GROUP BY 1""")
def parts_of_conversations(spark, d):
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.array(F.struct(F.col("role").alias("label"), F.lit("r").alias("role"))).alias("speakers"), F.array("role").alias("notes"), (F.col("turn") % 2 == 1).alias("headings"), F.lit(99).cast("long").alias("anchor_line"), F.col("turn").cast("string").alias("anchor_text"), F.lit(100).cast("long").alias("n_lines"))
    got = report.merged_parts(c, "conv_id")
    return got.select("conv_id", F.array_join(F.array_sort("speakers.label"), ",").alias("labels"), "headings", F.col("ending").cast("long").alias("anchor"))


@query("""SELECT o_orderkey, o_orderpriority query, o_orderstatus canonical, false locked FROM orders WHERE o_custkey % 3 > 0 AND o_custkey % 5 > 0""")
def guarded_orders(spark, d):
    n = F.col("o_custkey")
    rows = read(spark, d, "orders").select("o_orderkey", F.when(n % 3 > 0, F.col("o_orderpriority")).alias("query"), F.col("o_orderstatus").alias("canonical"), (n % 5 == 0).alias("locked"), F.lit("x").alias("shell"))
    return glue.safe_params(glue.unlocked(glue.complete_rows(rows)))
