"""Near names and quotes over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import likeness
from lodestrata.plans.queries import query, read

#: A customer's name, one of its characters dropped, doubled, replaced or left as it is.
MISSPELT = """SELECT c_nationkey k, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN left(c_name, p - 1) || substr(c_name, p + 1) WHEN 2 THEN left(c_name, p) || substr(c_name, p) ELSE left(c_name, p - 1) || 'x' || substr(c_name, p + 1) END AS name FROM (SELECT *, 1 + c_custkey % length(c_name) p FROM customer)"""


def _misspelt(spark, d):
    n, name = F.col("c_custkey"), F.col("c_name")
    p = (1 + n % F.length("c_name")).cast("int")
    cut = lambda a, b: F.substring(name, a, b)
    head, tail, size = cut(F.lit(1), p - 1), cut(p + 1, F.length("c_name")), F.length("c_name")
    wrong = F.when(n % 4 == 0, name).when(n % 4 == 1, F.concat(head, tail)).when(n % 4 == 2, F.concat(cut(F.lit(1), p), cut(p, size))).otherwise(F.concat(head, F.lit("x"), tail))
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), wrong.alias("name"))


@query(f"""WITH w AS ({MISSPELT}), c AS (SELECT DISTINCT c_nationkey k, c_name AS name FROM customer) SELECT DISTINCT w.k, w.name, c.name other, levenshtein(w.name, c.name) edits FROM w JOIN c ON c.k = w.k AND w.name <> c.name WHERE levenshtein(w.name, c.name) <= 1""")
def misspelt_customers(spark, d):
    return likeness.near_names(_misspelt(spark, d), read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name")), ["k"])


@query(f"""WITH w AS ({MISSPELT}), c AS (SELECT DISTINCT c_nationkey k, c_name AS name FROM customer) SELECT DISTINCT w.k, w.name, c.name other, levenshtein(w.name, c.name) edits FROM w JOIN c ON c.k = w.k AND w.name <> c.name WHERE levenshtein(w.name, c.name) <= 2""")
def misspelt_twice(spark, d):
    return likeness.near_names(_misspelt(spark, d), read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name")), ["k"], most=2)


@query("""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 40, 60) WHEN doc_id % 3 = 1 THEN substr(text, 10, 20) || 'ZQX' || substr(text, 60, 25) ELSE reverse(substr(text, 5, 40)) END q FROM documents WHERE length(text) >= 20),
g AS (SELECT doc_id, i - 1 AS q, substr(p, i, 6) g FROM (SELECT doc_id, regexp_replace(q, '\\s+', '', 'g') p FROM q), unnest(range(1, length(p) - 4)) x(i)),
u AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') p FROM documents WHERE length(text) >= 20), v AS (SELECT doc_id, unnest(range(1, length(p) - 4)) - 1 AS s, unnest(list_transform(range(1, length(p) - 4), lambda i: p[i : i + 5])) g FROM u), s AS (SELECT v.* FROM v SEMI JOIN g ON g.doc_id = v.doc_id AND g.g = v.g),
m AS (SELECT DISTINCT doc_id, q, s - q d FROM g JOIN s USING (doc_id, g)), r AS (SELECT doc_id, count(*) + 5 n FROM (SELECT *, q - row_number() OVER (PARTITION BY doc_id, d ORDER BY q) run FROM m) GROUP BY doc_id, d, run),
l AS (SELECT doc_id, max(n) n FROM r GROUP BY doc_id), f AS (SELECT doc_id, count(DISTINCT q) n FROM m GROUP BY doc_id)
SELECT doc_id quote_id, count(*) n_grams, coalesce(any_value(f.n), 0) found, coalesce(any_value(l.n), 0) longest FROM g LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id) GROUP BY doc_id""")
def quotes_of_documents(spark, d):
    docs = read(spark, d, "documents").where("length(text) >= 20")
    n, cut = F.col("doc_id") % 3, lambda a, b: F.substring("text", a, b)
    quote = F.when(n == 0, cut(40, 60)).when(n == 1, F.concat(cut(10, 20), F.lit("ZQX"), cut(60, 25))).otherwise(F.reverse(cut(5, 40)))
    return likeness.quote_support(docs.select("doc_id", F.col("doc_id").alias("quote_id"), quote.alias("quote")), docs.select("doc_id", "text"), "doc_id")
