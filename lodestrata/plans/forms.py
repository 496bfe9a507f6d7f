"""Written forms of names, labels and lists over the tables, and what conclusions
make of entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import entities, glue
from lodestrata.plans.queries import query, read

#: Full-width forms of ASCII.
PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


@query("""SELECT p_partkey, p_name || ' (' || p_brand || ')' folded, lower(replace(p_name || p_brand, ' ', '')) || 'no1' norm, regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g') || '_No1' slug FROM part""")
def widths_of_parts(spark, d):
    wide = lambda c: F.translate(c, PLAIN, WIDE)
    rows = read(spark, d, "part").select("p_partkey", wide(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("s"), F.concat(wide(F.concat("p_name", F.lit(" "), "p_brand")), F.lit("　№1")).alias("n"))
    return rows.select("p_partkey", T.fold_width(F.col("s")).alias("folded"), T.search_norm(F.col("n")).alias("norm"), T.slug(F.col("n")).alias("slug"))


@query("""SELECT c_custkey, '- ' || c_name || ' ← ' || CASE WHEN c_custkey % 2 = 0 THEN c_name || 'a / ' || c_mktsegment ELSE '（无变体）' END || CASE WHEN c_custkey % 3 = 0 THEN ' ｜ n' || c_nationkey ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' ｜ 公众人物' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN ' ｜ ⚠ 疑误写' ELSE '' END line FROM customer""")
def lines_of_customers(spark, d):
    n = F.col("c_custkey")
    variants = F.when(n % 2 == 0, F.array(F.concat("c_name", F.lit("a")), F.col("c_mktsegment"))).otherwise(F.array().cast("array<string>"))
    hint = F.when(n % 3 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return read(spark, d, "customer").select(n, glue.list_line(F.col("c_name"), variants, hint, n % 5 == 0, n % 7 == 0).alias("line"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_partkey || '%' WHEN 1 THEN l_partkey || ' 万元' WHEN 2 THEN l_partkey::VARCHAR ELSE l_partkey || 'kg' END "label", CASE WHEN l_suppkey % 2 = 0 THEN l_orderkey || '/f.md' ELSE '/b/' || l_orderkey || '/f.md' END rel, CASE WHEN l_suppkey % 7 > 0 THEN l_linenumber || '/' || (l_suppkey % 7) || ' (' || round(100.0 * l_linenumber / (l_suppkey % 7))::BIGINT || '%)' ELSE '—' END part FROM lineitem""")
def labels_of_lines(spark, d):
    k = F.col("l_linenumber") % 4
    unit = F.when(k == 0, "%").when(k == 1, "万元").when(k == 3, "kg")
    path = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "/a/").otherwise("/b/"), F.col("l_orderkey").cast("string"), F.lit("/f.md"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", T.unit_label(F.col("l_partkey").cast("string"), unit).alias("label"), T.relative_path(path, "/a/").alias("rel"), T.fraction(F.col("l_linenumber").cast("long"), (F.col("l_suppkey") % 7).cast("long")).alias("part"))


@query("""SELECT page_id, '1. p' || page_id || chr(10) || url || chr(10) || substr(html, 1, 500) || chr(10) || chr(10) || '2. q' || chr(10) || 'u' || chr(10) AS "text" FROM pages""")
def results_of_pages(spark, d):
    own = F.struct(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("url"), F.col("html").alias("snippet"))
    return read(spark, d, "pages").select("page_id", T.numbered_results(F.array(own, F.struct(F.lit("q").alias("title"), F.lit("u").alias("url"), F.lit("").alias("snippet")))).alias("text"))


@query("""SELECT page_id, 'page ' || page_id || '.md' AS "name" FROM pages""")
def deliverables_of_pages(spark, d):
    n = F.col("page_id")
    title = F.concat(F.lit(" page:"), n.cast("string"), F.when(n % 2 == 0, ".md").otherwise(""))
    return read(spark, d, "pages").select("page_id", T.deliverable_name(title, ".md").alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'now' ELSE o_orderpriority END AS "text", list_sort(list_filter(list_distinct([o_orderstatus, o_orderpriority, 'x']), lambda v: v <> 'F')) names FROM orders""")
def states_of_orders(spark, d):
    n = F.col("o_orderkey")
    text = glue.prior_text(F.when(n % 2 == 0, "now").otherwise(""), F.col("o_orderpriority"), n % 3 == 0)
    return read(spark, d, "orders").select(n, text.alias("text"), F.sort_array(glue.union_less(F.array("o_orderstatus", "o_orderpriority"), F.array(F.lit("x"), F.col("o_orderstatus")), F.lit("F"))).alias("names"))


@query("""WITH s AS (SELECT p_partkey ord, [p_name, CASE WHEN p_size % 6 = 0 THEN p_name ELSE p_type END] m, ['term', 'person', 'brand'][p_size % 3 + 1] kind, CASE WHEN p_size % 7 = 0 THEN '不适用' ELSE 'w' || p_partkey END why, CASE WHEN p_size % 2 = 0 THEN p_name END pref FROM part),
g AS (SELECT array_to_string(list_sort(m), '|') || '#' || kind sig, min(ord) o, max(ord) l FROM s GROUP BY 1)
SELECT g.o AS ord, sig, why, CASE WHEN kind IN ('term', 'brand') AND pref IS NOT NULL THEN 'directive' ELSE 'flag' END route FROM g JOIN s ON s.ord = g.l WHERE m[1] <> m[2] AND why <> '不适用'""")
def suspects_of_parts(spark, d):
    size, n = F.col("p_size"), F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("term"), F.lit("person"), F.lit("brand")), (size % 3 + 1).cast("int"))
    why = F.when(size % 7 == 0, "不适用").otherwise(F.concat(F.lit("w"), n.cast("string")))
    members = F.array(F.concat("p_name", F.lit("（注）")), F.when(size % 6 == 0, F.col("p_name")).otherwise(F.col("p_type")))
    rows = read(spark, d, "part").select(n.alias("ord"), members.alias("members"), kind.alias("kind"), why.alias("why"), F.when(size % 2 == 0, F.concat("p_name", F.lit("（注）"))).alias("preferred"))
    return entities.clean_suspects(entities.merged_suspects(rows)).select("ord", "sig", "why", "route")


#: Conclusions of customers: a name's, its variant's, or another's.
CONCLUDED = """e AS (SELECT c_nationkey k, c_custkey n, c_name canonical, [c_name || 'v'] variants, CASE WHEN c_custkey % 2 = 0 THEN 'person' ELSE 'term' END kind, c_custkey % 7 = 0 locked, ['unknown', 'verified', 'contested', 'recheck'][c_custkey % 4 + 1] conf, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE '' END hint, c_custkey % 3 < 2 hit,
CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_name || 'v' ELSE c_mktsegment END h, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'id' || c_custkey END id, c_custkey % 8 < 5 concrete, c_custkey % 9 = 0 two FROM customer),
f AS (SELECT *, hit AND NOT locked h1, conf = 'contested' AND h <> canonical AND NOT two OR kind = 'person' AND NOT list_contains([canonical] || variants, h) bad FROM e), a AS (SELECT *, h1 AND bad rejected, h1 AND NOT bad applied FROM f)"""


@query(f"""WITH {CONCLUDED} SELECT n c_custkey, CASE WHEN applied THEN h ELSE canonical END canonical, CASE WHEN applied THEN list_filter([canonical] || variants, lambda x: x <> h) ELSE variants END variants, CASE WHEN applied AND id <> '' THEN id || CASE WHEN hint <> '' THEN '；' || hint ELSE '' END ELSE hint END hint, applied, rejected,
CASE WHEN locked THEN 'user' WHEN conf = 'contested' THEN CASE WHEN applied AND two THEN 'verified' ELSE 'contested' END WHEN applied AND concrete THEN 'verified' WHEN hit THEN 'recheck' WHEN conf IN ('verified', 'recheck') THEN conf ELSE 'unknown' END confidence FROM a""")
def concluded_customers(spark, d):
    n, name = F.col("c_custkey"), F.col("c_name")
    c, variant = read(spark, d, "customer"), F.concat("c_name", F.lit("v"))
    of = lambda *x: F.element_at(F.array(*map(F.lit, x)), (n % len(x) + 1).cast("int"))
    e = c.select(F.col("c_nationkey").alias("key"), n.alias("ord"), F.when(n % 2 == 0, "person").otherwise("term").alias("kind"), name.alias("canonical"), F.array(variant).alias("variants"), F.when(n % 3 == 0, "old").otherwise("").alias("hint"), (n % 7 == 0).alias("locked"), of("unknown", "verified", "contested", "recheck").alias("confidence"), F.lit("").alias("confidence_date"))
    hit = F.when(n % 5 == 0, name).when(n % 5 == 1, variant).otherwise(F.col("c_mktsegment"))
    r = c.where("c_custkey % 3 < 2").select(F.col("c_nationkey").alias("key"), F.when(n % 3 == 0, name).otherwise(variant).alias("query"), hit.alias("hit_canonical"), F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("id"), n.cast("string"))).alias("identity"), F.when(n % 8 < 5, "www.a.com").otherwise("网络搜索").alias("source"), (n % 9 == 0).alias("two_key"))
    return entities.applied_conclusions(e, r).select(F.col("ord").alias("c_custkey"), "canonical", "variants", "hint", "applied", "rejected", "confidence")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 AND o_custkey * 10 >= {glue.LEAST_CHUNK} THEN o_custkey * 10 END size FROM orders""")
def chunk_sizes_of_orders(spark, d):
    said = F.concat((F.col("o_custkey") * 10).cast("string"), F.when(F.col("o_orderkey") % 3 == 2, "x").otherwise(""))
    return read(spark, d, "orders").select("o_orderkey", glue.chunk_sizes(said).alias("size"))


NEEDED = sorted(glue.NEED_REFINED)[0]


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'no files' WHEN o_orderstatus = 'P' THEN 'unknown: P' WHEN o_orderstatus = 'F' THEN 'needs refine: {NEEDED}' END error FROM orders""")
def scopes_of_orders(spark, d):
    scope = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("refine"), F.col("o_orderstatus"))).when(F.col("o_orderstatus") == "F", F.array(F.lit(NEEDED))).otherwise(F.array(F.lit("refine"), F.lit(NEEDED)))
    return read(spark, d, "orders").select("o_orderkey", glue.scope_errors(scope, F.col("o_custkey") % 5).alias("error"))
