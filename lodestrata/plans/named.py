"""Entities that share names, over customers and suppliers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import CUT_MARK
from lodestrata.operators import clusters
from lodestrata.plans.queries import query, read

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

#: Mentions of each nation: two names of a customer, sometimes a title that names nobody.
MENTIONS = """m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fresh, ord) n FROM (SELECT c_nationkey k, c_custkey ord, c_custkey % 3 <> 0 fresh, c_mktsegment || (c_custkey % 31) AS canonical, [c_mktsegment || (c_custkey * 7 % 29)] || CASE WHEN c_custkey % 4 = 0 THEN ['CEO'] ELSE [] END variants,
CASE WHEN c_custkey % 3 = 0 THEN 'n' || (c_custkey % 7) || '；⚠ w' || (c_custkey % 2) WHEN c_custkey % 3 = 1 THEN 'n' || (c_custkey % 5) ELSE '' END hint, 'f' || (c_custkey % 3) AS file, c_acctbal > 5000 public, c_custkey % 11 = 0 suspect, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE '' END category FROM customer) t),
s AS (SELECT *, list_filter(list_distinct([canonical] || variants), lambda x: x <> 'CEO') st FROM m)"""


def homes(joins: str) -> str:
    """SQL: each row's home, one row of a nation after the other."""
    home = f"CASE WHEN {joins} THEN coalesce(list_min(list_transform(list_filter(f.own, lambda o: list_contains(s.st, o.s)), lambda o: o.h)), s.n) ELSE s.n END"
    return f"""f AS (SELECT DISTINCT k, 0::BIGINT n, 0::BIGINT home, []::STRUCT(s VARCHAR, h BIGINT)[] own FROM m UNION ALL SELECT s.k, s.n, {home}, f.own || list_transform(s.st, lambda x: {{'s': x, 'h': {home}}}) FROM f JOIN s ON s.k = f.k AND s.n = f.n + 1),
r AS (SELECT s.*, f.home FROM f JOIN s ON s.k = f.k AND s.n = f.n)"""


#: SQL: notes in the order of their first rows, three plain ones at most, then warnings.
HINTS = f"""c AS (SELECT k, home, c, min(n * 10 + i) o FROM r, unnest(range(1, len(string_split(hint, '；')) + 1)) x(i), (SELECT 1) y, LATERAL (SELECT string_split(hint, '；')[i] c) z WHERE c <> '' GROUP BY ALL),
h AS (SELECT k, home, list(c ORDER BY o) FILTER (NOT contains(c, '⚠')) p, list(c ORDER BY o) FILTER (contains(c, '⚠')) w FROM c GROUP BY ALL),
hint AS (SELECT k, home, array_to_string(coalesce(p[1:3], []) || coalesce(w, []) || CASE WHEN len(p) > 3 THEN ['{CUT_MARK}'] ELSE [] END, '；') hint FROM h)"""


def _mentions(spark, d):
    n, segment = F.col("c_custkey"), F.col("c_mktsegment")
    text = lambda c: c.cast("string")
    hint = F.when(n % 3 == 0, F.concat(F.lit("n"), text(n % 7), F.lit("；⚠ w"), text(n % 2))).when(n % 3 == 1, F.concat(F.lit("n"), text(n % 5))).otherwise("")
    return read(spark, d, "customer").select(
        F.col("c_nationkey").alias("topic"), F.lit("person").alias("kind"), n.alias("ord"), (n % 3 != 0).alias("is_fresh"), F.concat("c_mktsegment", text(n % 31)).alias("canonical"),
        F.concat(F.array(F.concat(segment, text(n * 7 % 29))), F.when(n % 4 == 0, F.array(F.lit("CEO"))).otherwise(clusters.empty())).alias("variants"), hint.alias("hint"), F.concat(F.lit("f"), text(n % 3)).alias("file"),
        (F.col("c_acctbal") > 5000).alias("public_figure"), (n % 11 == 0).alias("suspect"), F.when(n % 5 == 0, segment).otherwise("").alias("category"),
    )


@query(f"""WITH RECURSIVE {MENTIONS.replace("ORDER BY fresh, ord", "ORDER BY ord")}, {homes("true")}, {HINTS},
v AS (SELECT k, home, canonical, row_number() OVER (PARTITION BY k, home ORDER BY count(*) DESC, length(canonical) DESC, min(n)) rn FROM r GROUP BY k, home, canonical),
l AS (SELECT k, home, x, min(n * 10 + i) o FROM r, unnest(range(1, 4)) y(i), LATERAL (SELECT ([canonical] || variants)[i] x) z WHERE x IS NOT NULL GROUP BY ALL),
a AS (SELECT k, home, list(x ORDER BY o) names FROM l GROUP BY ALL),
t AS (SELECT k, home, list(file ORDER BY o) files FROM (SELECT k, home, file, min(n) o FROM r GROUP BY ALL) GROUP BY ALL),
b AS (SELECT k, home, bool_or(public) public_figure, bool_or(suspect) suspect, coalesce(arg_min(category, n) FILTER (category <> ''), '') category FROM r GROUP BY ALL)
SELECT k topic, row_number() OVER (PARTITION BY k ORDER BY home) - 1 AS ord, v.canonical, list_filter(names, lambda x: x <> v.canonical) variants, coalesce(hint, '') hint, files, public_figure, suspect, category, len(files) > 1 cross_file FROM b JOIN v USING (k, home) JOIN a USING (k, home) JOIN t USING (k, home) LEFT JOIN hint USING (k, home) WHERE rn = 1""")
def clustered_customers(spark, d):
    return clusters.cluster_entities(_mentions(spark, d)).drop("kind")


@query(f"""WITH RECURSIVE {MENTIONS}, {homes("s.fresh")}, {HINTS},
l AS (SELECT r.k, r.home, x, min(r.n * 10 + i) o FROM r, unnest(range(1, 4)) y(i), LATERAL (SELECT (CASE WHEN r.n = r.home THEN variants ELSE [canonical] || variants END)[i] x) z WHERE x IS NOT NULL GROUP BY ALL),
a AS (SELECT k, home, list(x ORDER BY o) names FROM l GROUP BY ALL), g AS (SELECT k, home, count(*) > 1 cross_file, coalesce(arg_min(category, n) FILTER (category <> ''), '') category FROM r GROUP BY ALL)
SELECT r.k topic, row_number() OVER (PARTITION BY r.k ORDER BY r.n) - 1 AS ord, r.canonical, CASE WHEN cross_file THEN list_filter(names, lambda x: x <> r.canonical) ELSE variants END variants, coalesce(CASE WHEN cross_file THEN hint.hint ELSE r.hint END, '') hint, g.category, cross_file FROM r JOIN a ON a.k = r.k AND a.home = r.n JOIN g ON g.k = r.k AND g.home = r.n LEFT JOIN hint ON hint.k = r.k AND hint.home = r.n WHERE r.n = r.home""")
def merged_customers(spark, d):
    return clusters.merge_entities(_mentions(spark, d)).drop("kind")


SEGMENT = "[" + ", ".join(f"'{s}'" for s in SEGMENTS) + "]"


@query(f"""WITH RECURSIVE {MENTIONS.replace("ORDER BY fresh, ord", "ORDER BY ord")}, {homes("true")}, {HINTS.replace("c AS (", "c0 AS (SELECT 1), c AS (", 1)},
d AS (SELECT s_nationkey k, s_suppkey ord, w || (s_suppkey % 31) own, [w || (s_suppkey % 31), w || (s_suppkey * 3 % 29)] names, CASE WHEN s_suppkey % 2 = 0 THEN 'note ' || s_suppkey ELSE '' END note FROM supplier, LATERAL (SELECT {SEGMENT}[s_suppkey % 5 + 1] w) x),
hit AS (SELECT DISTINCT m.k, m.ord e, d.ord d FROM m JOIN d ON d.k = m.k AND len(list_intersect([m.canonical] || m.variants, d.names)) > 0),
edge AS (SELECT a.d x, b.d y FROM hit a JOIN hit b USING (k, e) UNION SELECT a.ord, b.ord FROM d a JOIN d b ON a.k = b.k AND a.own = b.own),
walk AS (SELECT ord x, ord y FROM d UNION SELECT walk.x, edge.y FROM walk JOIN edge ON edge.x = walk.y), root AS (SELECT x, min(y) root FROM walk GROUP BY x),
head AS (SELECT d.k, root, arg_min(own, ord) canonical, coalesce(arg_min(note, ord) FILTER (note <> ''), '') note, count(DISTINCT own) > 1 several FROM d JOIN root ON x = ord GROUP BY ALL),
eat AS (SELECT DISTINCT hit.k, e, root FROM hit JOIN root ON x = d),
src AS (SELECT root, min(e) source_ord FROM eat GROUP BY root),
l AS (SELECT root, x, min(o) o FROM (SELECT root, unnest(names) x, unnest([d.ord * 10, d.ord * 10 + 1]) o FROM d JOIN root ON x = d.ord UNION ALL SELECT root, ([canonical] || variants)[i], 1000000000 + e * 10 + i FROM eat JOIN m ON m.ord = e, unnest(range(1, 4)) y(i)) WHERE x IS NOT NULL GROUP BY ALL),
w AS (SELECT root, list(x ORDER BY o) names FROM l GROUP BY root),
n AS (SELECT root, c, min(o) o FROM (SELECT root, unnest(string_split(hint, '；')) c, e o FROM eat JOIN m ON m.ord = e) WHERE c <> '' GROUP BY ALL),
nh AS (SELECT root, array_to_string(coalesce((list(c ORDER BY o) FILTER (NOT contains(c, '⚠')))[1:3], []) || coalesce(list(c ORDER BY o) FILTER (contains(c, '⚠')), []) || CASE WHEN count(*) FILTER (NOT contains(c, '⚠')) > 3 THEN ['{CUT_MARK}'] ELSE [] END, '；') hint FROM n GROUP BY root),
u AS (SELECT h.k, h.canonical, list_filter(names, lambda x: x <> h.canonical) writings, coalesce(hint, '') hint, true locked, note, several AND source_ord IS NOT NULL conflict, coalesce(source_ord, -1) source_ord, source_ord IS NULL late, coalesce(source_ord, root) place FROM head h JOIN w USING (root) LEFT JOIN src USING (root) LEFT JOIN nh USING (root)
UNION ALL SELECT k, canonical, variants, hint, false, '', false, ord, false, ord FROM m WHERE ord NOT IN (SELECT e FROM eat))
SELECT k topic, row_number() OVER (PARTITION BY k ORDER BY late, place) - 1 AS ord, canonical, writings, hint, locked, note, conflict, source_ord FROM u""")
def decreed_customers(spark, d):
    n = F.col("s_suppkey")
    word = F.element_at(F.array(*map(F.lit, SEGMENTS)), (n % 5 + 1).cast("int"))
    orders = read(spark, d, "supplier").select(F.col("s_nationkey").alias("topic"), n.alias("ord"), F.concat(word, (n % 31).cast("string")).alias("canonical"), F.array(F.concat(word, (n * 3 % 29).cast("string"))).alias("variants"), F.when(n % 2 == 0, F.concat(F.lit("note "), n.cast("string"))).otherwise("").alias("note"))
    return clusters.apply_decrees(_mentions(spark, d), orders)
