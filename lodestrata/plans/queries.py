"""One query an operator, with its SQL. Han text is inline in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text as T
from lodestrata.operators import anchors, atoms, audit, entities, glossary, glue, report, scoring, turns
from lodestrata.sources import files
from lodestrata.streaming import runlog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, int):
        return f"{x}::BIGINT"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]" + ("::VARCHAR[]" if not x else "")
    return "'" + x.replace("'", "''") + "'"


def expected(columns: str, *rows: tuple) -> str:
    """SQL of rows that a query must give."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({columns})"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: White space as RE2 writes it, for the SQL.
W2 = "[" + T.SPACES.replace("'", "''") + "]"
CONTENT = "(len(regexp_extract_all(text, '[一-龥]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+')))"
N_LINES = "(len(regexp_split_to_array(text, '\\r\\n|\\r|\\n')))"


# ---- sources -------------------------------------------------------------
@query(f"SELECT doc_id, {N_LINES}::BIGINT n_lines, octet_length(encode(text))::BIGINT n_bytes, {CONTENT}::BIGINT content FROM documents")
def file_figures(spark, d):
    return read(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in T.file_figures(F.col("text")).items()])


@query("""SELECT doc_id, k::BIGINT line_no, lpad(k::VARCHAR, 6, ' ') || chr(9) || substr(line, 1, 2000) shown
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k FROM documents) WHERE k > 2 AND k <= 7""")
def paged_lines(spark, d):
    return turns.read_lines(read(spark, d, "documents"), "doc_id", "text", 2, 5)


@query(r"""SELECT page_id, substr(trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), 1, 8000) plain FROM pages""")
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", T.plain_page(F.col("html")).alias("plain"))


@query(expected("id, speaker, text, ts, first, last", (1, "甲", "你好世界", "00:00:01", 0, 1), (1, "乙", "好", "00:00:07", 2, 2)))
def subtitle_turns(spark, d):
    srt = "1\n00:00:01,000 --> 00:00:03,000\n甲：你好\n\n2\n00:00:03,000 --> 00:00:05,000\n甲：世界\n\n3\n00:00:07,000 --> 00:00:09,000\n乙：好\n"
    out = files.subtitle_turns(spark.createDataFrame([(1, srt)], "id long, text string"), "id", "text")
    return out.select("id", "speaker", "text", "ts", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(expected("line_no, key, value", (1, "A", "x y"), (2, "B", "1"), (4, None, "")))
def environment_file(spark, d):
    rows = [(1, 'A="x y" # note'), (2, "export B = 1 # one"), (3, "# only a remark"), (4, "no pair here"), (5, "KNOWN=2"), (6, "")]
    return files.environment(spark.createDataFrame(rows, "line_no long, line string"), spark.createDataFrame([("KNOWN",)], "key string"))


@query(expected("service, n, title, url, snippet", ("organic", 1, "t1", "u1", "s1"), ("reader", 0, None, None, None), ("webpages", 2, "n1", "u1", "m1")))
def search_sources(spark, d):
    rows = [("organic", '{"organic":[{"title":"t1","link":"u1","snippet":"s1"}]}'), ("webpages", '{"data":{"webPages":{"value":[{"name":"n1","url":"u1","summary":"m1"},{"name":"n2"},{"name":"n3"}]}}}'), ("reader", '{"error":1}')]
    df = spark.createDataFrame(rows, "service string, reply string")
    found = F.coalesce(*[F.when(F.col("service") == s, files.search_results(F.col("reply"), s, 2)) for s in files.SEARCH_FIELDS])
    return df.select("service", found.alias("r")).select("service", F.size("r").cast("long").alias("n"), F.get("r.title", F.lit(0)).alias("title"), F.get("r.url", F.lit(0)).alias("url"), F.get("r.snippet", F.lit(0)).alias("snippet"))


@query("SELECT doc_id, sha256(text) sha FROM documents")
def text_digests(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


# ---- scalar functions ------------------------------------------------------
@query(f"SELECT doc_id, {CONTENT}::BIGINT content FROM documents")
def content_length(spark, d):
    return read(spark, d, "documents").select("doc_id", T.content_length(F.col("text")).alias("content"))


@query("""SELECT doc_id, CASE WHEN n_chars <> 0 THEN n_chars ELSE 0 END::BIGINT by_chars, floor(octet_length(encode(text)) / 2.6 + 0.5)::BIGINT by_bytes, (len(string_split(text, chr(10))) * 14)::BIGINT by_lines FROM documents""")
def effective_size(spark, d):
    none, n = F.lit(None).cast("long"), F.size(F.split("text", "\n", -1)).cast("long")
    return read(spark, d, "documents").select("doc_id", T.effective_size(F.col("n_chars"), none, none).alias("by_chars"), T.effective_size(none, F.octet_length("text"), none).alias("by_bytes"), T.effective_size(none, none, n).alias("by_lines"))


@query("SELECT doc_id, least(96000, greatest(8000, ceil(n_chars * 2.2::DOUBLE) + 2048))::BIGINT cap FROM documents")
def token_cap(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_cap(F.col("n_chars").cast("double")).alias("cap"))


@query(expected("s, run, bare, weak, folded", ("王总", 2, "王总", True, "王总"), ("王总（示例公司董事长）", 7, "王总", False, "王总（示例公司董事长）"), ("　ＡＢ１　", 0, "ＡＢ１", False, "　AB1　"), ("李老师", 3, "李老师", True, "李老师"), ("CEO", 0, "CEO", True, "CEO"), ("欧阳娜娜总", 5, "欧阳娜娜总", False, "欧阳娜娜总"), ("", 0, "", False, "")))
def names_and_titles(spark, d):
    rows = [(s,) for s in ("王总", "王总（示例公司董事长）", "　ＡＢ１　", "李老师", "CEO", "欧阳娜娜总", "")]
    s = F.col("s")
    folded = F.translate(T.fold_width(s), "()", "（）")
    return spark.createDataFrame(rows, "s string").select("s", T.longest_han_run(s).alias("run"), T.strip_description(s).alias("bare"), T.is_weak_key(s).alias("weak"), folded.alias("folded"))


@query(expected("s, concrete", ("据36kr.com 报道", True), ("经网络搜索确认", False), ("36kr.com 2025-03 报道", True), ("搜索确认", False), ("公司官网 about 页", True), ("ｗｗｗ．ａ", True), ("WEB SEARCH results page", False), (None, False)))
def concrete_sources(spark, d):
    rows = [(s,) for s in ("据36kr.com 报道", "经网络搜索确认", "36kr.com 2025-03 报道", "搜索确认", "公司官网 about 页", "ｗｗｗ．ａ", "WEB SEARCH results page", None)]
    return spark.createDataFrame(rows, "s string").select("s", T.is_concrete_source(F.col("s")).alias("concrete"))


@query(expected("s, norm, slug", ("Ｈｅｌｌｏ　 World", "helloworld", "Hello_World"), ("ﬁne/№1", "fine/no1", "fine_No1"), ("…", "...", "..."), ("//", "//", "item")))
def compatibility_forms(spark, d):
    return spark.createDataFrame([("Ｈｅｌｌｏ　 World",), ("ﬁne/№1",), ("…",), ("//",)], "s string").select("s", T.search_norm(F.col("s")).alias("norm"), T.slug(F.col("s")).alias("slug"))


@query(r"""SELECT page_id, CASE WHEN n = '' THEN 'untitled' ELSE n END AS name FROM (SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(url, '[\\/:*?"<>|\x00-\x1F]+', ' ', 'g'), ' +', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g'), 1, 80), '^[. ]+|[. ]+$', '', 'g') n FROM pages)""")
def safe_name(spark, d):
    return read(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query(expected("s, name, n_bytes", ("字" * 90, "字" * 80, 240), ("😀" * 70, "😀" * 63, 252), (" ..a/b:c.. ", "a b c", 5), ("???", "untitled", 8)))
def safe_name_bytes(spark, d):
    out = spark.createDataFrame([("字" * 90,), ("😀" * 70,), (" ..a/b:c.. ",), ("???",)], "s string").select("s", T.safe_name(F.col("s")).alias("name"))
    return out.withColumn("n_bytes", F.octet_length("name").cast("long"))


@query(f"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', ''), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(_|{W2})+', '') title FROM pages")
def title_from_path(spark, d):
    return read(spark, d, "pages").select("page_id", T.title_from_path(F.col("url")).alias("title"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'th', ''))) // 2)::BIGINT n FROM documents")
def occurrences(spark, d):
    return read(spark, d, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("th")).alias("n"))


@query(expected("a, b, merged, short", ("甲；乙", "乙；丙", "甲；乙；丙", "甲"), ("甲；乙；丙", "⚠ 疑；丁", "甲；乙；丙；⚠ 疑；" + T.CUT_MARK, "甲"), ("⚠ 疑", None, "⚠ 疑", "⚠ 疑"), (None, "", "", "")))
def hints(spark, d):
    df = spark.createDataFrame([("甲；乙", "乙；丙"), ("甲；乙；丙", "⚠ 疑；丁"), ("⚠ 疑", None), (None, "")], "a string, b string")
    return df.select("a", "b", T.merge_hints(F.col("a"), F.col("b")).alias("merged"), T.trim_hint(F.col("a")).alias("short"))


@query(expected("s, text, confidence, date", ("甲 / 乙 〔核实·2024-05〕", "甲 / 乙", "verified", "2024-05"), ("正文核实〔核实〕", "正文核实〔核实〕", "unknown", ""), ("— ｜ 注 〔用户钦定〕 ", "— ｜ 注", "user", ""), ("〔待复核〕", "", "recheck", ""), ("a 〔同指两解〕", "a", "contested", "")))
def confidence_marks(spark, d):
    rows = [("甲 / 乙 〔核实·2024-05〕",), ("正文核实〔核实〕",), ("— ｜ 注 〔用户钦定〕 ",), ("〔待复核〕",), ("a 〔同指两解〕",)]
    return spark.createDataFrame(rows, "s string").select("s", T.strip_confidence(F.col("s")).alias("c")).select("s", "c.*")


@query(rf"""SELECT conv_id, turn, coalesce(regexp_matches(regexp_replace(text, '(<!--[^>]*-->|{W2}|["''”’」』）)*_])+$', ''), '[?？]$'), false) q FROM conversations""")
def question_turns(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.ends_with_question(F.col("text")).alias("q"))


@query(expected("reply, body, cached", ('```json\n{"a": 1}\n```', '{"a": 1}', 0), ('so: {"prompt_cache_hit_tokens": 7} end', '{"prompt_cache_hit_tokens": 7}', 7), ('{"prompt_tokens_details": {"cached_tokens": 5}}', '{"prompt_tokens_details": {"cached_tokens": 5}}', 5), ("none", None, 0)))
def json_replies(spark, d):
    rows = [('```json\n{"a": 1}\n```',), ('so: {"prompt_cache_hit_tokens": 7} end',), ('{"prompt_tokens_details": {"cached_tokens": 5}}',), ("none",)]
    out = spark.createDataFrame(rows, "reply string").withColumn("body", T.json_body(F.col("reply")))
    return out.withColumn("cached", T.cached_tokens(F.col("body")).cast("long"))


@query(expected("value, unit, label, rel, part", ("30", "%", "30%", "b/c", "3/4 (75%)"), ("5", "万元", "5 万元", "/x/y", "—"), ("7", None, "7", "b", "1/3 (33%)")))
def labels_and_paths(spark, d):
    df = spark.createDataFrame([("30", "%", "/a/b/c", 3, 4), ("5", "万元", "/x/y", 1, 0), ("7", None, "/a/b", 1, 3)], "value string, unit string, path string, hit long, total long")
    return df.select("value", "unit", T.unit_label(F.col("value"), F.col("unit")).alias("label"), T.relative_path(F.col("path"), "/a").alias("rel"), T.fraction(F.col("hit"), F.col("total")).alias("part"))


@query(expected("parts, text", (["a\n", " ", "b\n\n"], "a\n\nb\n"), (["x\n## 标题", "## 标题\n正文"], "x\n## 标题\n\n正文\n"), ([""], "")))
def stitched_parts(spark, d):
    rows = [(["a\n", " ", "b\n\n"],), (["x\n## 标题", "## 标题\n正文"],), ([""],)]
    return spark.createDataFrame(rows, "parts array<string>").select("parts", turns.stitched(F.col("parts")).alias("text"))


@query(expected("results, text", ("2", "1. t\nu\nabc\n\n2. v\nw\n"),))
def numbered_results(spark, d):
    df = spark.sql("select array(named_struct('title','t','url','u','snippet','abc'), named_struct('title','v','url','w','snippet','')) r")
    return df.select(F.size("r").cast("string").alias("results"), T.numbered_results(F.col("r")).alias("text"))


# ---- turns and chunks -----------------------------------------------------
SPANS = "SELECT conv_id, turn, start_line, coalesce(lead(start_line) OVER (PARTITION BY conv_id ORDER BY start_line) - 1, total)::BIGINT end_line FROM (SELECT conv_id, turn, (1 + sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n)::BIGINT start_line, (sum(n) OVER (PARTITION BY conv_id))::BIGINT total FROM (SELECT conv_id, turn, len(string_split(text, chr(10))) n FROM conversations))"


def _spans(spark, d):
    w = Window.partitionBy("conv_id")
    n = F.size(F.split("text", "\n", -1)).cast("long")
    rows = read(spark, d, "conversations").select("conv_id", "turn", n.alias("n")).withColumn("start_line", 1 + F.sum("n").over(w.orderBy("turn")) - F.col("n")).withColumn("total", F.sum("n").over(w))
    return turns.spans(rows, ["conv_id"], "start_line", F.col("total"))


@query(SPANS)
def turn_spans(spark, d):
    return _spans(spark, d).select("conv_id", "turn", "start_line", "end_line")


@query("""WITH p AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT n, octet_length(encode(text)) b FROM documents), q AS (SELECT *, least(600, greatest(150, floor(n * 45000 / greatest(b, 1))))::BIGINT page FROM p)
SELECT doc_id, unnest(range(0, greatest(n, 1), page))::BIGINT "offset", page "limit" FROM q""")
def line_pages(spark, d):
    n = F.size(F.split("text", "\n", -1)).cast("long")
    return read(spark, d, "documents").select("doc_id", F.explode(turns.read_plan(n, F.octet_length("text"))).alias("p")).select("doc_id", "p.*")


@query("""WITH p AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT n FROM documents), q AS (SELECT doc_id, greatest(1, 40 - 30)::BIGINT low, greatest(10, least(n, 380))::BIGINT top, least(n, 380)::BIGINT high FROM p), r AS (SELECT doc_id, unnest(generate_series(low, top, 300)) s, high FROM q)
SELECT doc_id, (s - 1)::BIGINT "offset", least(300, high - s + 1)::BIGINT "limit" FROM r""")
def range_pages(spark, d):
    n = F.size(F.split("text", "\n", -1)).cast("long")
    return read(spark, d, "documents").select("doc_id", F.explode(turns.range_plan(F.lit(40), F.lit(350), n)).alias("p")).select("doc_id", "p.*")


CHUNKS = """WITH p AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT n, n_chars size FROM documents), q AS (SELECT *, {parts} k FROM p), r AS (SELECT *, greatest(ceil(n / k), 1)::BIGINT per FROM q), s AS (SELECT *, greatest(ceil(n / per), 1)::BIGINT real FROM r), u AS (SELECT *, unnest(range(0, real)) i FROM s)
SELECT doc_id, (i + 1)::BIGINT idx, (i * per + 1)::BIGINT start_line, CASE WHEN i = real - 1 THEN greatest(n, 1) ELSE (i + 1) * per END::BIGINT end_line, i = real - 1 is_last FROM u"""


def _chunks(spark, d, parts):
    n = F.size(F.split("text", "\n", -1)).cast("long")
    rows = read(spark, d, "documents").select("doc_id", n.alias("n"), F.col("n_chars").alias("size"))
    return rows.withColumn("k", parts(F.col("size"), F.col("n"))).select("doc_id", F.explode(turns.even_chunks(F.col("n"), F.col("k"))).alias("c")).select("doc_id", "c.*")


@query(CHUNKS.format(parts="CASE WHEN n <= 1 THEN 1 WHEN size > 1800 THEN ceil(size / 1800) ELSE 1 END::BIGINT"))
def refine_chunks(spark, d):
    return _chunks(spark, d, lambda size, n: turns.refine_parts(size, n, None, 1800))


@query(CHUNKS.format(parts="CASE WHEN size > 40000 AND n > 1 THEN least(6, greatest(2, ceil(size / 20000))) ELSE 1 END::BIGINT"))
def scout_chunks(spark, d):
    return _chunks(spark, d, turns.scout_parts)


@query(expected("n, size, mode, budget, chunk, parts", (2400, 53576, "", 28000, 0, 2), (3000, 90000, "", 18000, 0, 5), (2000, 28000, "", 28000, 0, 1), (2000, 28001, "", 28000, 0, 2), (3000, 90000, "speed", 18000, 0, 5), (2000, 20000, "speed", 28000, 0, 2), (2400, 53576, "", 28000, 10000, 6), (2000, 90000, "off", 18000, 0, 1), (2000, 8000, "", 28000, 10000, 1)))
def chunk_counts(spark, d):
    out = None
    for n, size, mode, budget, chunk in ((2400, 53576, "", 28000, 0), (3000, 90000, "", 18000, 0), (2000, 28000, "", 28000, 0), (2000, 28001, "", 28000, 0), (3000, 90000, "speed", 18000, 0), (2000, 20000, "speed", 28000, 0), (2400, 53576, "", 28000, 10000), (2000, 90000, "off", 18000, 0), (2000, 8000, "", 28000, 10000)):
        row = spark.range(1).select(*[F.lit(v).cast("long").alias(k) if isinstance(v, int) else F.lit(v).alias(k) for k, v in (("n", n), ("size", size), ("mode", mode), ("budget", budget), ("chunk", chunk))])
        row = row.withColumn("parts", turns.refine_parts(F.col("size"), F.col("n"), mode or None, budget, chunk or None))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH s AS ({SPANS}), c AS (SELECT conv_id, max(end_line) n FROM s GROUP BY 1), p AS (SELECT conv_id, n, ceil(n / 3)::BIGINT per FROM c), r AS (SELECT *, greatest(ceil(n / per), 1)::BIGINT real FROM p), u AS (SELECT *, unnest(range(0, real)) i FROM r), k AS (SELECT conv_id, (i + 1)::BIGINT idx, i * per + 1 a, CASE WHEN i = real - 1 THEN n ELSE (i + 1) * per END b FROM u)
SELECT s.conv_id, s.turn, s.start_line, s.end_line, k.idx FROM s JOIN k ON s.conv_id = k.conv_id AND s.start_line BETWEEN k.a AND k.b""")
def turn_ownership(spark, d):
    spans = turn_spans(spark, d)
    files_ = spans.groupBy("conv_id").agg(F.max("end_line").alias("n"))
    chunks = files_.select("conv_id", F.explode(turns.even_chunks(F.col("n"), F.lit(3))).alias("c")).select("conv_id", "c.idx", "c.start_line", "c.end_line")
    return turns.owners(spans, chunks, "conv_id")


@query("""SELECT user_id, event_type, min(event_id) "first", max(event_id) "last", count(*) n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) g FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END c FROM events)) GROUP BY user_id, g, event_type""")
def runs_of_one_kind(spark, d):
    return turns.islands(read(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query(expected("id, title, start_line, end_line, tags", (1, "甲、乙：丙", 2, 3, ["甲", "乙", "丙"]), (1, "丁", 4, 5, ["丁"])))
def section_map(spark, d):
    docs = spark.createDataFrame([(1, "# 题\n## 甲、乙：丙\n文\n## 丁\n文")], "id long, text string")
    return turns.sections(docs, "id", "text").withColumn("tags", T.section_tags(F.col("title")))


@query(expected("id, turn_no, label, start_line, end_line, q", (1, 1, "记者", 1, 2, True), (1, 2, "王总", 3, 3, False)))
def parsed_turns(spark, d):
    return turns.parse_turns(spark.createDataFrame([(1, "记者：你好\n请问为什么？\n**王总**：因为。")], "id long, text string"), "id", "text")


# ---- entities ---------------------------------------------------------------
@query("SELECT role AS label, count(DISTINCT conv_id) n_files FROM conversations GROUP BY role HAVING count(DISTINCT conv_id) >= 2")
def speaker_registry(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.struct("conv_id", "turn").alias("ord"), F.col("role").alias("label"), "role", F.lit("").alias("identity"))
    return entities.speaker_registry(rows).select("label", "n_files")


@query("""SELECT o_custkey, canonical, votes FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, length(canonical) DESC, f) rn FROM (SELECT o_custkey, trim(o_orderpriority) canonical, count(*) votes, min(o_orderkey) f FROM orders GROUP BY 1, 2)) WHERE rn = 1""")
def canonical_vote(spark, d):
    return entities.vote(read(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


MENTIONS = "topic string, kind string, ord long, file string, canonical string, variants array<string>, hint string, public_figure boolean, suspect boolean, category string"


def _mentions(spark):
    row = lambda i, f, c, v=(), h=None, p=False, s=False, k=None: ("t", "person", i, f, c, list(v), h, p, s, k)
    rows = [row(0, "a", "王明", ["王总"], "董事长"), row(1, "b", "李华", ["王总"]), row(2, "b", "王明", ["老王"], "创办人", True), row(3, "c", "老王", ["小李"], None, False, True, "甲"), row(4, "c", "王总"), row(5, "c", "小李", ["李华"]), row(6, "d", " ", []), row(7, "d", "王明轩", ["老王"])]
    return spark.createDataFrame(rows, MENTIONS)


@query(expected("ord, canonical, variants, hint, n_files, public_figure, suspect, category, cross_file", (0, "王明", ["王总", "老王", "小李", "李华", "王明轩"], "董事长；创办人", 4, True, True, "甲", True), (1, "李华", ["王总"], "", 1, False, False, "", False), (2, "王总", [], "", 1, False, False, "", False)))
def entity_clusters(spark, d):
    out = entities.cluster_entities(_mentions(spark))
    return out.select("ord", "canonical", "variants", "hint", F.size("files").cast("long").alias("n_files"), "public_figure", "suspect", "category", "cross_file")


@query(expected("ord, canonical, variants, hint, cross_file", (0, "王明", ["王总", "王明（董事长）", "小明"], "旧；新", True), (1, "甲公司", [], "", False), (2, "乙", ["丙", "丁"], "", True)))
def entity_merge(spark, d):
    rows = [("t", "person", False, 0, "王明", ["王总"], "旧", ""), ("t", "person", False, 1, "甲公司", [], "", ""), ("t", "person", True, 0, "王明（董事长）", ["小明"], "新", "x"), ("t", "person", True, 1, "乙", ["丙"], "", ""), ("t", "person", True, 2, "丙", ["丁"], "", "")]
    df = spark.createDataFrame(rows, "topic string, kind string, is_fresh boolean, ord long, canonical string, variants array<string>, hint string, category string")
    return entities.merge_entities(df).select("ord", "canonical", "variants", "hint", "cross_file")


@query(expected("ord, canonical, writings, locked, note, conflict, source_ord", (0, "张三", ["章三", "张叁"], True, "人工", True, 0), (1, "李四", [], False, "", False, 1), (2, "钱五", ["前五"], True, "", False, -1)))
def decrees(spark, d):
    e = spark.createDataFrame([("t", 0, "章三", ["张叁"], "注"), ("t", 1, "李四", [], "")], "topic string, ord long, canonical string, variants array<string>, hint string")
    o = spark.createDataFrame([("t", 0, "张三", ["章三"], ""), ("t", 1, "张叁", [], "人工"), ("t", 2, "钱五", ["前五"], ""), ("t", 3, "", ["x"], "")], "topic string, ord long, canonical string, variants array<string>, note string")
    return entities.apply_decrees(e, o).select("ord", "canonical", "writings", "locked", "note", "conflict", "source_ord")


@query("""SELECT c_nationkey, c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND (replace(s.s_name, 'Supplier', 'Customer') = c.c_name OR s.s_name = 'none'))""")
def verify_cache_exclusion(spark, d):
    e = read(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("canonical"), F.array(F.concat(F.col("c_name"), F.lit(" variant"))).alias("variants"))
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return entities.exclude_settled(e, s).select(F.col("key").alias("c_nationkey"), F.col("ord").alias("c_custkey"))


@query("""SELECT p_partkey FROM part p WHERE p_size % 2 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)""")
def suspect_unverified(spark, d):
    e = read(spark, d, "part").select(F.lit(1).alias("key"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("canonical"), F.array(F.col("p_name")).alias("variants"), (F.col("p_size") % 2 == 0).alias("suspect"))
    r = read(spark, d, "lineitem").where("l_quantity > 45").select(F.lit(1).alias("key"), F.col("l_partkey").cast("string").alias("query")).distinct()
    return entities.unverified_suspects(e, r).select(F.col("ord").alias("p_partkey"))


@query("""SELECT o_custkey, o_orderkey, rn "rank" FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m'), o_orderkey) rn FROM orders) WHERE rn <= 2""")
def oldest_rotation(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("date"))
    return entities_oldest(rows)


def entities_oldest(rows):
    return turns.oldest(rows, ["o_custkey"], "date", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("""SELECT c_nationkey, c_custkey, worth::BIGINT worth, rn::BIGINT "rank", rn > 144 overflow, CASE WHEN rn <= 144 THEN (rn - 1) // 12 END::BIGINT batch FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY worth DESC, section_ord, c_custkey) rn FROM (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal > 5000 THEN 4 ELSE 0 END + CASE WHEN c_acctbal < 2000 THEN 2 ELSE 0 END worth, c_custkey % 3 section_ord, c_mktsegment = 'BUILDING' suspect FROM customer) WHERE worth > 0 OR suspect)""")
def verify_batches(spark, d):
    e = read(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("ord"), T.entity_worth(F.col("c_acctbal") > 5000, F.col("c_acctbal") < 2000, F.array()).alias("worth"), (F.col("c_custkey") % 3).alias("section_ord"), (F.col("c_mktsegment") == "BUILDING").alias("suspect"))
    out = turns.verify_batches(e, ["c_nationkey"], False)
    return out.select("c_nationkey", F.col("ord").alias("c_custkey"), "worth", "rank", "overflow", "batch")


@query("""SELECT user_id AS query, event_id ord, kind FROM (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'click' THEN 'contested' ELSE 'unresolved' END kind, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, CASE WHEN value > 10 THEN 0 ELSE 1 END, event_id) rn FROM events) WHERE rn = 1""")
def conclusion_precedence(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "resolved").when(F.col("event_type") == "click", "contested").otherwise("unresolved")
    rows = read(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("ord"), kind.alias("kind"), (F.col("value") > 10).alias("is_fresh"))
    return entities.conclusions(rows).select("query", "ord", "kind")


@query(expected("ord, canonical, variants, hint, applied, rejected, confidence", (0, "王鸣", ["王明"], "作家；旧", True, False, "verified"), (1, "李华", [], None, False, True, "recheck"), (2, "甲", ["乙"], None, False, True, "contested"), (3, "钱", [], None, False, False, "user"), (4, "丁", [], None, False, False, "verified"), (5, "新", ["戊"], None, True, False, "recheck")))
def applied_conclusions(spark, d):
    rows = [("t", 0, "person", "王明", ["王鸣"], "旧", False, "unknown", ""), ("t", 1, "person", "李华", [], None, False, "unknown", ""), ("t", 2, "term", "甲", ["乙"], None, False, "contested", ""), ("t", 3, "term", "钱", [], None, True, "unknown", ""), ("t", 4, "term", "丁", [], None, False, "verified", "2024-01"), ("t", 5, "term", "戊", [], None, False, "unknown", "")]
    e = spark.createDataFrame(rows, "key string, ord long, kind string, canonical string, variants array<string>, hint string, locked boolean, confidence string, confidence_date string")
    r = spark.createDataFrame([("t", "王明", "王鸣", "作家", "某出版社 2024 年目录", False), ("t", "李华", "张伟", "", "www.a.com", False), ("t", "乙", "丙", "", "www.a.com", False), ("t", "钱", "前", "", "www.a.com", True), ("t", "戊", "新", "", "网络搜索", False)], "key string, query string, hit_canonical string, identity string, source string, two_key boolean")
    return entities.applied_conclusions(e, r).select("ord", "canonical", "variants", "hint", "applied", "rejected", "confidence")


@query(expected("check_, name, other", ("contradiction", "王明", "王铭"), ("weak_duplicate", "王总", "0"), ("conflict", "王明", "王名")))
def reopen_checks(spark, d):
    schema = "key string, ord long, canonical string, variants array<string>, confidence string"
    prior = spark.createDataFrame([("t", 0, "王明", ["老王"], "verified"), ("t", 1, "王总", [], "unknown")], schema)
    fresh = spark.createDataFrame([("t", 0, "王明", ["王铭"], ""), ("t", 1, "王总（董事长）", [], "")], schema)
    resolved = spark.createDataFrame([("t", "老王", "王名"), ("t", "王明", "王明")], "key string, query string, hit_canonical string")
    a = entities.contradictions(prior, fresh).select(F.lit("contradiction").alias("check_"), F.col("canonical").alias("name"), F.array_join("writings", ",").alias("other"))
    b = entities.weak_duplicates(prior, fresh).select(F.lit("weak_duplicate").alias("check_"), "name", (F.col("prior_ord") - 1).cast("string").alias("other"))
    c = entities.glossary_conflicts(prior, resolved).select(F.lit("conflict").alias("check_"), F.col("prior_canonical").alias("name"), F.col("hit_canonical").alias("other"))
    return a.unionByName(b).unionByName(c)


@query(expected("ord, sig, why, route", (0, "优先|优鲜#term", "b", "directive"), (3, "乙|甲#person", "d", "flag")))
def suspects(spark, d):
    rows = [(0, ["优鲜", "优先"], "term", "a", None), (1, ["x", "x（注）"], "term", "c", None), (2, ["优先", "优鲜（店）"], "term", "b", "优先"), (3, ["甲", "乙"], "person", "d", "甲"), (4, ["丙", "丁"], "person", "不适用", None)]
    merged = entities.merged_suspects(spark.createDataFrame(rows, "ord long, members array<string>, kind string, why string, preferred string"))
    return entities.clean_suspects(merged).select("ord", "sig", "why", "route")


GLOSSARY = [("t", "person", 0, "王明", ["老王", "王总"], "董事长；注 ｜ 另注", True, "verified", "2024-05"), ("t", "person", 1, "李华", [], "", False, "unknown", ""), ("t", "brand", 0, "甲公司", ["甲"], "⚠ 疑", False, "recheck", ""), ("t", "term", 0, "术语", [], "", True, "contested", "")]


@query(expected("key, kind, ord, canonical, variants, hint, cross_file, confidence, confidence_date", *GLOSSARY))
def glossary_roundtrip(spark, d):
    e = spark.createDataFrame(GLOSSARY, "key string, kind string, ord long, canonical string, variants array<string>, hint string, cross_file boolean, confidence string, confidence_date string")
    return glossary.parse(glossary.render(e, "key"), "key").select(*e.columns)


# ---- scores and rollups ------------------------------------------------------
@query("""SELECT grp, provider, count(*) FILTER (kind = 'expect' AND hit) expect_hit, count(*) FILTER (kind = 'expect') expect_total, count(*) FILTER (kind = 'trap' AND hit) trap_hit, count(*) FILTER (kind = 'trap') trap_total, count(*) FILTER (kind = 'unverifiable' AND hit) unverifiable_hit, count(*) FILTER (kind = 'unverifiable') unverifiable_total, count(*) FILTER (failed) failures, round(avg(latency_ms) FILTER (latency_ms > 0))::BIGINT mean_latency_ms, grouping(grp)::BIGINT all_groups
FROM (SELECT lang grp, source provider, CASE doc_id % 3 WHEN 0 THEN 'expect' WHEN 1 THEN 'trap' ELSE 'unverifiable' END kind, quality = 1 hit, toxic = 1 failed, n_chars % 700 latency_ms FROM documents JOIN labels USING (doc_id)) GROUP BY GROUPING SETS ((grp, provider), (provider))""")
def retrieval_scorecard(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    kind = F.when(F.col("doc_id") % 3 == 0, "expect").when(F.col("doc_id") % 3 == 1, "trap").otherwise("unverifiable")
    rows = rows.select(F.col("lang").alias("grp"), F.col("source").alias("provider"), kind.alias("kind"), (F.col("quality") == 1).alias("hit"), (F.col("toxic") == 1).alias("failed"), (F.col("n_chars") % 700).alias("latency_ms"))
    return scoring.scorecard(rows, "grp", "provider")


@query(expected("id, met", (1, True), (2, False), (3, True), (4, False), (5, True)))
def case_scores(spark, d):
    rows = [(1, "expect", ["甲公司"], [], [], "这是 甲公司 官网"), (2, "trap", ["正名"], ["错名"], [], "错名"), (3, "unverifiable", [], ["错"], [], "什么都没有"), (4, "unverifiable", [], ["错"], [], "错了"), (5, "expect", ["无"], [], ["abc"], "ＡＢ Ｃ")]
    df = spark.createDataFrame(rows, "id long, kind string, expect array<string>, traps array<string>, hints array<string>, found string")
    return scoring.case_scores(df).select("id", "met")


@query(expected("cut_recall, keep_rate, over_deletions", (0.75, 0.5, 1)))
def filler_score(spark, d):
    rows = [(1, ["嗯", "呃"], ["今天"], "今天很好"), (2, ["就是说", "那个"], ["明天"], "那个后天")]
    return scoring.filler_score(spark.createDataFrame(rows, "id long, cut array<string>, keep array<string>, out string"))


@query(expected("id, missing, forbidden, passed", (1, 0, 0, True), (2, 1, 1, False)))
def golden_score(spark, d):
    rows = [(1, ["a"], ["z"], "abc"), (2, ["x"], ["b"], "abc")]
    return scoring.golden_score(spark.createDataFrame(rows, "id long, contain array<string>, forbid array<string>, out string"))


@query("""SELECT user_id, round((greatest(0, i - c) * 0.14 + c * 0.0028 + o * 0.87) / 1e6, 6) cost FROM (SELECT user_id, sum(1000 + event_id % 977)::BIGINT i, sum(event_id % 400)::BIGINT c, sum(event_id % 211)::BIGINT o FROM events GROUP BY 1)""")
def cost_estimate(spark, d):
    use = read(spark, d, "events").groupBy("user_id").agg(F.sum(1000 + F.col("event_id") % 977).alias("i"), F.sum(F.col("event_id") % 400).alias("c"), F.sum(F.col("event_id") % 211).alias("o"))
    return use.select("user_id", scoring.cost(F.col("i"), F.col("c"), F.col("o"), ["cheap", "strong"], "strong").alias("cost"))


@query(expected("i, c, o, mixed, single", (100000, 40000, 20000, 0.025912, 0.014112), (10000, 2000, 3000, 0.003736, 0.001966), (1000, 200, 500, 0.000548, 0.000253)))
def known_costs(spark, d):
    df = spark.createDataFrame([(100000, 40000, 20000), (10000, 2000, 3000), (1000, 200, 500)], "i long, c long, o long")
    use = [F.col(x) for x in "ico"]
    return df.select("i", "c", "o", scoring.cost(*use, ["cheap", "strong"], "strong").alias("mixed"), scoring.cost(*use, ["cheap"], "cheap").alias("single"))


@query("""SELECT source, count(DISTINCT CASE WHEN toxic > 0 THEN doc_id END) hard_files, sum(n_chars % 5)::BIGINT n_sections, sum(1 - quality)::BIGINT n_flagged, CASE WHEN count(DISTINCT CASE WHEN toxic > 0 THEN doc_id END) > 0 THEN 'blocked' WHEN sum(1 - quality) > 0 THEN 'review_needed' ELSE 'ready' END state FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def quality_scorecard(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    n = lambda c: c.cast("long")
    rows = rows.select("source", F.col("doc_id").alias("file"), F.col("toxic").alias("hard"), F.lit(0).alias("soft"), n(F.col("n_chars") % 5).alias("sections"), n(1 - F.col("quality")).alias("flagged"), F.lit(0).alias("open"))
    return scoring.quality(rows, "source")


@query("""SELECT date_trunc('day', ts) AS "day", event_type topic, count(*) runs, sum(event_id % 1000)::BIGINT input, sum(event_id % 300)::BIGINT output, round(sum(event_id % 90000) / 60000, 1) AS "minutes", max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT failed FROM events GROUP BY 1, 2""")
def run_log_by_day(spark, d):
    e = read(spark, d, "events")
    runs = e.select(F.col("ts").alias("finished_at"), F.col("event_type").alias("topic"), (F.col("event_id") % 1000).alias("input"), (F.col("event_id") % 300).alias("output"), (F.col("event_id") % 90000).alias("duration_ms"), F.when(F.col("event_type") == "error", "fail").otherwise("ok").alias("audit_status"))
    return runlog.daily(runs).withColumn("failed", F.col("failed").cast("long"))


@query("SELECT user_id, event_type stage, greatest(0, date_diff('millisecond', min(ts), max(ts)))::BIGINT ms FROM events GROUP BY 1, 2")
def stage_timing(spark, d):
    ms = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1000)
    return read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.greatest(F.lit(0), ms(F.max("ts")) - ms(F.min("ts"))).cast("long").alias("ms"))


@query(expected("failed, audit_failed, allowed, has_output, code, action", (True, False, False, True, 1, "none"), (False, True, False, True, 1, "patch"), (False, True, True, True, 0, "rewrite"), (False, True, True, False, 1, "patch"), (False, False, False, False, 0, "none")))
def exit_codes(spark, d):
    rows = [(True, False, False, True, []), (False, True, False, True, ["quote_style"]), (False, True, True, True, ["compression"]), (False, True, True, False, ["stutter"]), (False, False, False, False, [])]
    df = spark.createDataFrame(rows, "failed boolean, audit_failed boolean, allowed boolean, has_output boolean, rules array<string>")
    return df.select("failed", "audit_failed", "allowed", "has_output", scoring.exit_code(F.col("failed"), F.lit(False), F.col("audit_failed"), F.col("allowed"), F.col("has_output")).alias("code"), scoring.repair_action(F.col("rules")).alias("action"))


# ---- audit -------------------------------------------------------------------
SHINGLES = f"(SELECT conv_id, turn, role, unnest(list_distinct(list_transform(range(0, greatest(len(p) - 3, 0) + 1), lambda i: array_to_string(p[i + 1 : i + 3], ' ')))) sh FROM (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '{W2}+'), lambda w: w <> '') p FROM conversations))"
MATCHED = f"WITH s AS {SHINGLES}, r AS (SELECT DISTINCT conv_id, sh FROM s WHERE role <> 'user'), m AS (SELECT s.conv_id, s.turn, count(r.sh) / count(*) matched FROM s LEFT JOIN r ON s.conv_id = r.conv_id AND s.sh = r.sh GROUP BY 1, 2)"


def _source_and_refined(spark, d):
    """Conversations as sources; what is not said by users as their refined texts."""
    c = read(spark, d, "conversations")
    return c.select("conv_id", F.col("turn").alias("turn_no"), "text"), c.where("role <> 'user'").select("conv_id", "text")


@query(MATCHED + " SELECT conv_id, turn turn_no, matched FROM m")
def near_copy_coverage(spark, d):
    return audit.matched_turns(*_source_and_refined(spark, d), "conv_id", True)


@query(MATCHED + """, x AS (SELECT m.conv_id, m.turn, matched < 0.5 lost, length(c.text) chars FROM m JOIN conversations c ON m.conv_id = c.conv_id AND m.turn = c.turn), g AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) isl FROM (SELECT *, CASE WHEN lost = lag(lost) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END ch FROM x))
SELECT conv_id, min(turn) "first", max(turn) "last", count(*) turns, sum(chars)::BIGINT chars, CASE WHEN sum(chars) >= 400 AND count(*) >= 3 THEN 'hard' ELSE 'soft' END severity FROM g WHERE lost GROUP BY conv_id, isl""")
def coverage_gaps(spark, d):
    return audit.coverage_gaps(*_source_and_refined(spark, d), "conv_id", True)


@query("SELECT doc_id, line, count(*) n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents) WHERE length(line) >= 25 GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_lines(spark, d):
    return audit.repeated_lines(read(spark, d, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id, 'long_paragraph' AS name, 'hard' severity, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 900 AND NOT regexp_matches(x, '^(#|>)')))::BIGINT n FROM documents WHERE n > 0""")
def long_paragraphs(spark, d):
    return audit.cleanliness(read(spark, d, "documents"), "doc_id", "text").where("name = 'long_paragraph'")


@query(expected("id, name, severity, n", (1, "confirmation_repeat", "hard", 1), (1, "filler", "hard", 1), (2, "repeated_year", "hard", 1), (2, "modal", "soft", 1), (3, "stutter", "hard", 1), (5, "broken_start", "hard", 1)))
def cleanliness(spark, d):
    rows = [(1, "对对对，我们做。嗯，好的"), (2, "在2020年2020年开始吧。"), (3, "就就这样"), (4, "# 对对对\n> 嗯嗯\n<!-- 好好好 -->\n可能能够"), (5, "，开头")]
    return audit.cleanliness(spark.createDataFrame(rows, "id long, text string"), "id", "text")


@query(expected("id, name, severity, n", (1, "compression", "hard", 1), (2, "quote_style", "hard", 2), (3, "label_style", "soft", 3), (4, "model_marker", "soft", 1)))
def pair_findings(spark, d):
    label = "".join(f"**甲**：话\n乙：{'话' * 3}\n" for _ in range(3))
    rows = [(1, "字" * 100, "字" * 50), (2, "字", '他说"好"'), (3, "字", label), (4, "字", "文（此处省略）文字")]
    df = spark.createDataFrame(rows, "id long, source string, refined string")
    rules = audit.pair_ratios(F.col("source"), F.col("refined")) | audit.quote_style(F.col("refined")) | audit.label_style(F.col("refined"))
    return audit.findings(df, "id", rules)


@query(expected("id, canonical, variant, n", (1, "优鲜", "优先", 2), (2, "王明轩", "王明", 1)))
def ghost_names(spark, d):
    docs = spark.createDataFrame([(1, "优先和优鲜、优先"), (2, "王明轩说王明不在"), (3, "王明轩")], "id long, text string")
    names = spark.createDataFrame([("优鲜", "优先"), ("王明轩", "王明")], "canonical string, variant string")
    return audit.ghost_names(docs, names, "id", "text")


@query("SELECT l_orderkey, max(l_quantity) max_lo, min(l_quantity + 20) min_hi, count(*) n FROM lineitem GROUP BY 1 HAVING max(l_quantity) > min(l_quantity + 20)")
def numeric_conflict(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 20).alias("hi"))
    return audit.numeric_conflicts(rows, "l_orderkey")


@query("""WITH p AS (SELECT l_partkey, l_suppkey f, max(l_quantity) lo, min(l_quantity + 30) hi FROM lineitem GROUP BY 1, 2) SELECT l_partkey, count(*) n_files FROM p GROUP BY 1 HAVING l_partkey IN (SELECT a.l_partkey FROM p a JOIN p b ON a.l_partkey = b.l_partkey AND a.f <> b.f AND a.lo > b.hi)""")
def cross_file_conflict(spark, d):
    rows = read(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("f"), F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 30).alias("hi"))
    return audit.cross_file_conflicts(rows, "f", "l_partkey")


@query("""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) "value" FROM documents), c AS (SELECT unnest(regexp_extract_all(text, '[0-9]+')) "value" FROM conversations UNION ALL SELECT unnest(regexp_extract_all(text, '[0-9]+')) FROM benchmark) SELECT DISTINCT doc_id, "value" FROM f WHERE "value" NOT IN (SELECT "value" FROM c)""")
def unmatched_figures(spark, d):
    figures = lambda name, *keys: read(spark, d, name).select(*keys, F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("value"))
    return audit.unmatched_figures(figures("documents", "doc_id").distinct(), figures("conversations").union(figures("benchmark"))).select("doc_id", "value")


@query(expected("id, title, covered", (1, "甲", 2), (1, "乙", 1), (1, "丙", 0)))
def plan_coverage(spark, d):
    heads = spark.createDataFrame([(1, "甲"), (1, "乙 "), (1, "丙")], "id long, title string")
    return audit.plan_coverage(heads, spark.createDataFrame([(1, ["甲", " 乙"]), (1, ["甲"])], "id long, sections array<string>"), "id")


@query("""SELECT o_custkey, count(*) FILTER (a <> b) moved FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) b FROM orders) GROUP BY 1""")
def displaced(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    ranked = read(spark, d, "orders").select("o_custkey", "o_orderkey", rank.alias("b"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "b"))), lambda x: x["b"])
    return ranked.groupBy("o_custkey").agg(audit.displaced(order).alias("moved"))


@query(expected("id, ratio", (1, 1.0), (2, 0.75), (3, 0.25)))
def order_ratio(spark, d):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], [1, 2, 3, 4]), (2, [1, 2, 3, 4], [2, 3, 4, 1]), (3, [1, 2, 3, 4], [4, 3, 2, 1])], "id long, a array<int>, b array<int>")
    return df.select("id", audit.order_ratio("a", "b").alias("ratio"))


@query(expected("id, atoms", (1, ["8000|万"]), (2, ["30-40|家"]), (3, ["60-70|岁"]), (4, ["2023|年", "35|%"]), (5, []), (6, ["3|个月", "1500|元"])))
def number_atoms(spark, d):
    rows = [(1, "营收八千万元"), (2, "三四十家"), (3, "六七十岁"), (4, "二零二三年增长百分之三十五"), (5, "一些人，第一，12:30"), (6, "三个月赚一千五百块")]
    df = spark.createDataFrame(rows, "id long, text string")
    return df.select("id", F.transform(atoms.number_atoms("text"), lambda a: a["key"]).alias("atoms"))


@query(expected("id, turn_no, dropped, polarity_lost", (1, 2, 1, 0), (1, 3, 0, 1)))
def number_drift(spark, d):
    rows = [(1, 1, "有30家店", "共30家"), (1, 2, "花了50天和20天", "花了50天"), (1, 3, "亏损8元", "赚了8元")]
    return atoms.drift(spark.createDataFrame(rows, "id long, turn_no long, source string, refined string"), "id")


@query(expected("topic, n, lint", ("a", 2, "thin"), ("b", 3, "few_hints"), ("c", 4, "few_variants"), ("d", 3, "ok")))
def glossary_lint(spark, d):
    rows = [("a", "h", ["v"])] * 2 + [("b", "", ["v"])] * 2 + [("b", "h", ["v"])] + [("c", "h", [])] * 3 + [("c", "h", ["v"])] + [("d", "h", ["v"])] * 3
    return audit.glossary_lint(spark.createDataFrame(rows, "topic string, hint string, variants array<string>"), "topic")


# ---- anchors ---------------------------------------------------------------
TALK = "记者 00:01\n请您先介绍一下公司的业务情况和发展历程\n\n王总 00:05\n我们做传感器标定业务已经有十几年时间了，客户遍布华南地区\n\n记者 00:30\n那么去年的毛利率有没有比较明显的改善呢\n\n王总 00:40\n毛利率改善了不少，主要是规模效应摊薄了采购成本\n\n记者 01:00\n接下来海外市场有什么样的具体打算\n\n王总 01:10\n东南亚会先设立本地化的运营团队再考虑欧洲市场"
DONE = "# 实录\n\n## 业务\n\n记者：请您先介绍一下公司的业务情况和发展历程\n\n王明：我们做传感器标定业务已经有十几年时间了，客户遍布华南地区\n\n## 财务\n\n记者：去年的毛利率有没有比较明显的改善呢\n\n王明：毛利率改善了不少，主要是规模效应摊薄了采购成本\n\n## 海外\n\n记者：接下来海外市场有什么样的具体打算\n\n记者：东南亚会先设立本地化的运营团队再考虑欧洲市场"


def _talk(spark, text):
    return spark.createDataFrame([(1, text)], "id long, text string")


@query(expected("id, turn_no, speaker, ts, start_line, end_line", *[(1, i + 1, "记者" if i % 2 == 0 else "王总", t, 3 * i + 1, 3 * i + 2) for i, t in enumerate(("00:01", "00:05", "00:30", "00:40", "01:00", "01:10"))]))
def speaker_turns(spark, d):
    return anchors.speaker_turns(_talk(spark, TALK), "id", "text").drop("text")


@query(expected("id, turn_no, source_no", *[(1, i, i) for i in range(1, 7)]))
def anchored_turns(spark, d):
    return anchors.anchored(anchors.speaker_turns(_talk(spark, TALK), "id", "text"), anchors.speaker_turns(_talk(spark, DONE), "id", "text"), "id").select("id", "turn_no", "source_no")


@query(expected("id, turn_no, speaker, expected, label, tier", (1, 6, "王总", "王明", "记者", "mismatch")))
def attribution(spark, d):
    return anchors.attribution(anchors.speaker_turns(_talk(spark, TALK), "id", "text"), anchors.speaker_turns(_talk(spark, DONE), "id", "text"), "id")


@query(expected("id, title, first_line, last_line, ts", (1, "业务", 1, 5, "00:01"), (1, "财务", 7, 11, "00:30"), (1, "海外", 13, 17, "01:00")))
def section_ranges(spark, d):
    return anchors.section_ranges(anchors.speaker_turns(_talk(spark, TALK), "id", "text"), _talk(spark, DONE), "id", "text")


@query(expected("id, text", (1, DONE.replace("## 业务", "## 业务\n<!-- source: L1-5 00:01 -->").replace("## 财务", "## 财务\n<!-- source: L7-11 00:30 -->").replace("## 海外", "## 海外\n<!-- source: L13-17 01:00 -->"))))
def source_anchors(spark, d):
    ranges = section_ranges(spark, d)
    once = anchors.annotate_anchors(_talk(spark, DONE), ranges, "id", "text")
    return anchors.annotate_anchors(once, ranges, "id", "text")


@query(expected("id, text", (1, "a\n<!-- 此处可能缺失原文 L3-9 -->\nb")))
def gap_marks(spark, d):
    gaps = spark.createDataFrame([(1, 1, 3, 9, "hard"), (1, 2, 4, 5, "soft")], "id long, after_line long, first long, last long, severity string")
    once = anchors.annotate_gaps(_talk(spark, "a\nb"), gaps, "id", "text")
    return anchors.annotate_gaps(once, gaps, "id", "text")


@query(expected("id, quote", (1, "唯有坚守长期主义方能穿越周期这是信念")))
def fabricated_quotes(spark, d):
    source = _talk(spark, "硬件创业最忌讳的就是贪大求全，一定要把商业闭环跑通")
    refined = _talk(spark, "他说“硬件创业最忌讳的就是贪大求全”，又说“唯有坚守长期主义方能穿越周期这是信念”，以及“护城河”")
    return anchors.fabricated_quotes(source, refined, "id").select("id", "quote")


@query(expected("id, turn_no, canonical", (1, 1, "云洲仪器")))
def substituted_entities(spark, d):
    source = anchors.speaker_turns(_talk(spark, "甲：我们最近在跟磐石科技谈一个很大的合作项目\n甲：另外云舟仪器的老客户也在催我们赶紧发版"), "id", "text")
    refined = anchors.speaker_turns(_talk(spark, "甲：我们最近在跟云洲仪器谈一个很大的合作项目\n甲：另外云洲仪器的老客户也在催我们赶紧发版"), "id", "text")
    names = spark.createDataFrame([("云洲仪器", ["云舟仪器"]), ("磐石科技", ["盘石"])], "canonical string, variants array<string>")
    return anchors.substituted_entities(source, refined, names, "id")


@query(expected('id, "from", "to", source_from, source_to, refined_from, refined_to, independent', (1, "林传", "林川", 4, 3, 0, 7, True), (2, "云桥科技", "云桥引擎", 3, 0, 0, 3, False)))
def entity_merge_review(spark, d):
    a = "林传今天来，林传说清楚。林传补充，林传很明确。林川也在场，林川点头，林川补充"
    b = "云桥科技这个组，云桥科技投入大，云桥科技改名"
    c = "K-Frame 和 K-Frame"
    pairs = spark.createDataFrame([(1, a, a.replace("林传", "林川")), (2, b, b.replace("云桥科技", "云桥引擎")), (3, c, c.replace("-", " "))], "id long, source string, refined string")
    names = spark.createDataFrame([("林川", "林传"), ("云桥引擎", "云桥科技"), ("K Frame", "K-Frame")], "canonical string, variant string")
    return anchors.merge_review(pairs, names, "id")


@query(expected("id, name, line_no", (1, "王鸣", 2)))
def missing_marks(spark, d):
    return anchors.missing_marks(_talk(spark, "王鸣（音）来了\n王鸣又走了"), spark.createDataFrame([("王鸣",)], "name string"), "id", "text")


@query(expected("id", (2,)))
def ending_missing(spark, d):
    s = spark.createDataFrame([(1, "甲：开头的话说了很多\n乙：最后我们还是要感谢所有的合作伙伴"), (2, "甲：开头的话说了很多\n乙：最后我们还是要感谢所有的合作伙伴")], "id long, text string")
    r = spark.createDataFrame([(1, "开头的话说了很多，最后我们还是要感谢所有的合作伙伴"), (2, "开头的话说了很多")], "id long, text string")
    return anchors.ending_missing(anchors.speaker_turns(s, "id", "text"), r, "id")


# ---- reports ----------------------------------------------------------------
@query(expected("key, labels, notes, headings, ending", ("f", ["甲", "乙"], ["n1", "n2"], True, "完"), ("g", ["甲"], [], False, None)))
def merged_parts(spark, d):
    rows = [("f", 0, [("甲", "r"), ("甲", "x")], [" n1"], False, 40, "半", 100), ("f", 1, [("乙", "r")], ["n1", "n2", ""], True, 95, "完", 100), ("g", 0, [("甲", "r")], [], False, 10, "早", 100)]
    df = spark.createDataFrame(rows, "key string, ord long, speakers array<struct<label:string,role:string>>, notes array<string>, headings boolean, anchor_line long, anchor_text string, n_lines long")
    return report.merged_parts(df, "key").select("key", F.col("speakers.label").alias("labels"), "notes", "headings", "ending")


@query(expected("run, json", (1, '{"schemaVersion":1,"run":1,"topic":null,"provider":{"name":"x"}}')))
def run_manifest(spark, d):
    df = spark.createDataFrame([(1, None, {"name": "x", "apiKey": "k", "TOKEN": "t"})], "run long, topic string, provider map<string,string>")
    return report.manifest(df, "run", "provider")


@query(expected("id, garbled, network, headings", (1, True, False, False), (2, False, True, True), (3, True, False, False)))
def stage_checks(spark, d):
    rows = [(1, ["甲"], [], "查无", "none", "正文"), (2, ["乙公司"], ["乙"], "request timed out", "none", "# 题"), (3, ["字" * 16], ["乙"], None, "keep", "# 题")]
    df = spark.createDataFrame(rows, "id long, names array<string>, speakers array<string>, note string, policy string, text string")
    return df.select("id", report.garbled(F.col("names"), F.col("speakers")).alias("garbled"), report.network_unverified(F.col("note")).alias("network"), report.heading_conflict(F.col("policy"), F.col("text")).alias("headings"))


@query(expected("path, source, refined", ("/a/b.md", "s", "r")))
def audit_pairing(spark, d):
    a = spark.createDataFrame([("/a/./b.md", "s"), ("/a/c.md", "t")], "path string, source string")
    return report.paired(a, spark.createDataFrame([("/a//b.md", "r")], "path string, refined string"))


@query(expected("file, report", ("f", "r1"), ("g", "r3")))
def report_lookup(spark, d):
    files_ = spark.createDataFrame([("f", ["f", "/p"]), ("g", ["g"]), ("h", ["h"])], "file string, candidates array<string>")
    reports = spark.createDataFrame([(2, "r2", "f", None, None, None), (1, "r1", "x", "/p", None, None), (3, "r3", None, None, None, "g")], "ord long, report string, label string, path string, original string, out string")
    return report.report_for(files_, reports)


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'joined' END state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def case_results(spark, d):
    cases = read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    joined, missing = report.case_results(cases, read(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"))
    return joined.select(F.col("id").alias("doc_id"), F.lit("joined").alias("state")).unionByName(missing.select(F.col("id").alias("doc_id"), F.lit("missing").alias("state")))


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) rn FROM customer) WHERE rn <= 40""")
def top_known(spark, d):
    e = read(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("ord"), F.array("c_name", "c_mktsegment").alias("variants"))
    return report.top_known(e, ["c_nationkey"]).select("c_nationkey", F.col("ord").alias("c_custkey"))


@query("""SELECT 0::BIGINT source, o_orderkey ord, o_orderpriority question FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 1::BIGINT, c_custkey, c_name FROM customer WHERE c_acctbal < 0""")
def open_questions(spark, d):
    a = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("question"))
    b = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("question"))
    return report.open_questions(a, b)


# ---- glue ---------------------------------------------------------------------
@query(expected("clause, literal, correction", ("⚠ 同指两解：字面「甲」（高）／改写「乙」（低）", "甲", "乙")))
def contested_clauses(spark, d):
    df = spark.createDataFrame([("甲", "高", "乙", "低")], "a string, b string, c string, e string").select(glue.contested_clause(*map(F.col, "abce")).alias("clause"))
    back = glue.parse_contested(F.col("clause"))
    return df.select("clause", back["literal"].alias("literal"), back["correction"].alias("correction"))


@query(expected("line", ("- 甲 ← 乙 / 丙 ｜ 注 ｜ 公众人物",), ("- 丁 ← （无变体） ｜ ⚠ 疑误写",)))
def list_lines(spark, d):
    df = spark.createDataFrame([("甲", ["乙", "丙"], "注", True, False), ("丁", [], None, False, True)], "a string, b array<string>, c string, e boolean, f boolean")
    return df.select(glue.list_line(*map(F.col, "abcef")).alias("line"))


@query("""SELECT c_nationkey AS key, count(*) FILTER (s.s_name IS NULL) unknown, count(*) total, count(*) FILTER (s.s_name IS NULL) <= 0.10 * count(*) skip FROM customer c LEFT JOIN supplier s ON s.s_nationkey = c.c_nationkey AND replace(s.s_name, 'Supplier', 'Customer') = c.c_name GROUP BY 1""")
def coverage_ratio(spark, d):
    e = read(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("canonical"), F.array().cast("array<string>").alias("variants"))
    p = read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return glue.coverage_ratio(e, p)


@query(expected("key, title, lines", ("k", "t", ["b", "a"]), ("k", "u", ["a"])))
def preserved_lines(spark, d):
    return glue.preserved(spark.createDataFrame([("k", "t", 0, "b"), ("k", "t", 1, "a"), ("k", "t", 2, "b"), ("k", "u", 0, "a")], "key string, title string, ord long, line string"))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) issues FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1")
def issue_counts(spark, d):
    out = glue.issue_counts(read(spark, d, "events").select("user_id", F.col("event_type").alias("title")), "user_id")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("issues"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("issues"))


@query(expected("ord, category, name, found", (1, "brand", "甲", "person")))
def category_warnings(spark, d):
    e = spark.createDataFrame([("person", "甲", ["乙"]), ("term", "甲", []), ("brand", "丙", [])], "kind string, canonical string, variants array<string>")
    return glue.category_warnings(spark.createDataFrame([(0, "person", "乙"), (1, "brand", "甲"), (2, "term", "无")], "ord long, category string, name string"), e)


@query(expected("ord, trusted", (0, True), (1, False)))
def trusted_speakers(spark, d):
    e = spark.createDataFrame([(0, "王明（嘉宾）", []), (1, "Bob", [])], "ord long, canonical string, variants array<string>")
    return glue.trusted(e, spark.createDataFrame([("王明",), ("Bob",)], "label string")).select("ord", "trusted")


@query(expected('id, title, "order"', (1, "甲", 7), (1, "乙", 2), (1, "丙", None)))
def heading_orders(spark, d):
    t = spark.createDataFrame([(1, "甲", 7), (1, "乙", None), (1, "丙", None)], "id long, title string, source_order long")
    return glue.heading_orders(t, spark.createDataFrame([(1, "甲", 1), (1, "乙", 2)], "id long, title string, line_no long"), "id").select("id", "title", "order")


@query(expected("old, text, error", ("a", "xbc", None), ("z", "abc", "missing"), ("", "abc", "empty"), ("b", "aBaB", None), ("q", "qq", "ambiguous")))
def exact_edits(spark, d):
    df = spark.createDataFrame([("abc", "a", "x", False), ("abc", "z", "x", False), ("abc", "", "x", False), ("abab", "b", "B", True), ("qq", "q", "x", False)], "t string, old string, new string, every boolean")
    return df.select("old", glue.exact_edit(F.col("t"), F.col("old"), F.col("new"), F.col("every")).alias("r")).select("old", "r.*")


@query(expected("path, ok", ("/a/b", True), ("/a", True), ("/ab", False), ("/a/../c", False), ("/x/y", True)))
def access_paths(spark, d):
    return spark.createDataFrame([("/a/b",), ("/a",), ("/ab",), ("/a/../c",), ("/x/y",)], "path string").select("path", glue.inside(F.col("path"), ["/a/", "/x"]).alias("ok"))


@query(expected("name", ("甲",), ("乙",), ("丙",)))
def settled_names(spark, d):
    r = spark.createDataFrame([("甲（注）", "乙"), ("丁", "丁")], "query string, canonical string")
    p = spark.createDataFrame([("丙", ["戊"], "verified"), ("丁", [], "recheck")], "canonical string, variants array<string>, confidence string")
    return glue.settled(r, p, spark.createDataFrame([("戊",)], "name string"))


@query("SELECT event_type, min(event_id) AS \"first\" FROM events GROUP BY 1")
def first_seen(spark, d):
    return glue.first_seen(read(spark, d, "events"), "event_type", "event_id")


@query(expected("id, idx, line", (1, 2, "## 题")))
def seams(spark, d):
    return glue.seams(spark.createDataFrame([(1, 1, "文\n## 题\n"), (1, 2, "## 题\n文"), (1, 3, "别的")], "id long, idx long, text string"), "id")


@query(expected("id, text, names", (1, "now", ["乙", "丙"]), (2, "old", ["乙"]), (3, None, [])))
def state_and_unions(spark, d):
    df = spark.createDataFrame([(1, "now", "old", False, ["甲", "乙"], ["丙", "乙"]), (2, "", "old", False, ["乙"], ["甲"]), (3, "now", "old", True, [], [])], "id long, inline string, stored string, fresh boolean, a array<string>, b array<string>")
    return df.select("id", glue.prior_text(F.col("inline"), F.col("stored"), F.col("fresh")).alias("text"), glue.union_less(F.col("a"), F.col("b"), F.lit("甲")).alias("names"))


@query(expected("id, holds, findings", (1, True, []), (2, False, ["longer", "same_order"]), (3, False, ["no_provenance"])))
def plan_verdicts(spark, d):
    df = spark.createDataFrame([(1, ["a", "b", "c"], 0, 0, 0.5, 9, 100.0, 105.0, 0.5, True), (2, ["a", "b", "c"], 0, 0, 0.9, 9, 100.0, 120.0, 0.9, True), (3, ["a"], 1, 0, 0.1, 3, 100.0, 90.0, 0.1, False)], "id long, threads array<string>, missing long, repeated long, ratio double, n long, refined double, logic double, same double, has boolean")
    return df.select("id", glue.plan_verdict(*map(F.col, ("threads", "missing", "repeated", "ratio", "n"))).alias("holds"), glue.provenance(*map(F.col, ("refined", "logic", "same", "has"))).alias("findings"))


@query(expected("query, canonical, locked", ("a", "b", False)))
def row_guards(spark, d):
    df = spark.createDataFrame([("a", "b", None, "x"), ("", "b", False, "x"), ("c", None, False, "x"), ("d", "e", True, "x")], "query string, canonical string, locked boolean, shell string")
    return glue.safe_params(glue.unlocked(glue.complete_rows(df))).withColumn("locked", F.coalesce("locked", F.lit(False)))
