"""Numerals, line maps and the whole pair audit over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import atoms, audit, numerals, turns
from lodestrata.plans.documents import CONTENT, EMPTIES
from lodestrata.plans.queries import query, read

#: An order's price in whole units, times a power of ten by its key.
AMOUNT = "(floor(o_totalprice)::BIGINT * [1, 10, 100, 10000][o_orderkey % 4 + 1])"


def _amounts(spark, d):
    n = F.floor("o_totalprice") * F.element_at(F.array(*map(F.lit, (1, 10, 100, 10000))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", n.cast("long").alias("n"))


@query(f"""SELECT o_orderkey, {AMOUNT} AS "value" FROM orders""")
def numerals_of_orders(spark, d):
    return _amounts(spark, d).select("o_orderkey", numerals.numeral_value(numerals.spelled(F.col("n"))).cast("long").alias("value"))


@query(f"""WITH a AS (SELECT o_orderkey, {AMOUNT} n FROM orders) SELECT o_orderkey, n::DOUBLE lo, n::DOUBLE hi, CASE WHEN n % 10000 = 0 AND n < 100000000 THEN '万' WHEN n % 100000000 = 0 THEN '亿' ELSE '元' END unit, CASE o_orderkey % 3 WHEN 0 THEN '超过' WHEN 1 THEN '亏损' ELSE '' END polarity FROM a""")
def atoms_of_orders(spark, d):
    before = F.when(F.col("o_orderkey") % 3 == 0, "超过").when(F.col("o_orderkey") % 3 == 1, "亏损").otherwise("收入")
    said = _amounts(spark, d).select("o_orderkey", F.concat(F.lit("今年"), before, numerals.spelled(F.col("n")), F.lit("元，万一一些不算")).alias("t"))
    return said.select("o_orderkey", F.explode(atoms.number_atoms("t")).alias("a")).select("o_orderkey", "a.lo", "a.hi", "a.unit", "a.polarity")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT n FROM orders) SELECT o_custkey, o_orderkey turn_no, (o_orderkey % 5 = 1)::BIGINT dropped, (o_orderkey % 5 = 2)::BIGINT polarity_lost FROM p WHERE o_orderkey % 5 IN (1, 2)""")
def drift_of_orders(spark, d):
    """Prices that a copy drops, or says the other way round."""
    n, k = numerals.spelled(F.floor("o_totalprice")), F.col("o_orderkey")
    said = lambda word, value: F.concat(F.lit(word), value, F.lit("元"))
    refined = F.when(k % 5 == 1, F.lit("没有数")).when(k % 5 == 2, said("盈利", n)).when(k % 5 == 3, said("亏损", F.floor("o_totalprice").cast("string"))).otherwise(said("亏损", n))
    rows = read(spark, d, "orders").select("o_custkey", k.alias("turn_no"), said("亏损", n).alias("source"), refined.alias("refined"))
    return atoms.drift(rows, "o_custkey").withColumnRenamed("turn_no", "turn_no")


@query("""WITH l AS (SELECT doc_id, i line_no, length(regexp_replace(string_split(text, chr(10))[i], '[^a-z]', '', 'g')) n FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) x(i)), o AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) e FROM l)
SELECT doc_id, p place, line_no FROM o, unnest(range(0, e::BIGINT, 500)) y(p) WHERE p >= e - n""")
def places_in_lines(spark, d):
    """Every five hundredth letter of a text with its line."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    runs = audit.line_runs(docs, "doc_id", "text", "[a-z]")
    places = runs.groupBy("doc_id").agg(F.max("last").alias("most")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"), F.lit(500).cast("long"))).alias("place"))
    return turns.inside(places, "place", runs, "first", "last", ["doc_id"]).select("doc_id", "place", "line_no")


#: A copy of a document with one fault, by its id.
COPY = """CASE doc_id % 7 WHEN 1 THEN left(s, length(s) // 3) WHEN 2 THEN s || '（此处略）' WHEN 3 THEN s || chr(10) || '甲"乙「丙' WHEN 4 THEN s || '就就好好好' WHEN 6 THEN s || chr(10) || '，开头' ELSE s END"""
EMPTY = "这个甲那个乙就是说丙这个丁"
COUNTS = {
    "confirmation_repeat": ("b", "(对对对|是是是|嗯嗯|好好好)"), "filler": ("b", "(^|[，。])(嗯|呃|啊)[，。]"), "stutter": ("b", "(就就|我我|他他|你你|这这|那那|是是)"), "broken_start": ("b", "(?m)^[，。、；]"), "modal": ("b", "[吧呢嘛][。，]"), "empty_phrase": ("b", "(这个|那个|就是说|然后呢)"),
    "model_marker": ("r", audit.MODEL_MARKS), "quote_style": ("regexp_replace(r, '(?s)```.*?```|`[^`]*`|https?://[^\\s)]+|\\]\\([^)]*\\)', '', 'g')", '[一-龥]"|"[一-龥]|[「」『』]'),
}
FAILS = ("broken_start", "compression", "confirmation_repeat", "filler", "quote_style", "stutter", "under_refined")


@query(f"""WITH p AS (SELECT doc_id, s, {COPY} r FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 7 = 5 THEN '{EMPTY}' ELSE '' END s FROM documents)),
q AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(r, '(?s)<!--.*?-->', '', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^(#|>)')), chr(10)) b FROM p),
n AS (SELECT doc_id, {', '.join(f"len(regexp_extract_all({of}, '{pattern}')) AS {name}" for name, (of, pattern) in COUNTS.items())}, (({CONTENT.format('r')}) / greatest({CONTENT.format('s')}, 1) < {audit.COMPRESSION_FLOOR})::INT compression,
 (({CONTENT.format('r')}) >= {audit.COMPRESSION_FLOOR} * ({CONTENT.format('s')}) AND {EMPTIES.format('s')} >= {audit.EMPTY_LEAST} AND ({EMPTIES.format('s')} - {EMPTIES.format('r')}) / {EMPTIES.format('s')} < {audit.EMPTY_REDUCTION})::INT under_refined,
 0 AS phrase_repeat, 0 AS repeated_year, (len(regexp_extract_all(r, '(?m)^\\*\\*[^*\\n]{{1,12}}(\\*\\*[：:]|[：:]\\*\\*)')) >= 3 AND len(regexp_extract_all(r, '(?m)^[一-龥A-Za-z0-9·]{{1,12}}[：:]')) >= 3)::INT label_style FROM q),
f AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {c} > 0 THEN '{c}' END" for c in FAILS)}], lambda x: x IS NOT NULL) failed, ({' + '.join(f"({c} > 0)::INT" for c in [*COUNTS, "compression", "under_refined", "label_style"])})::BIGINT n_findings FROM n)
SELECT doc_id, CASE WHEN len(failed) > 0 THEN 'fail' ELSE 'ok' END status, failed, n_findings FROM f""")
def audited_documents(spark, d):
    """The rules of D3-D6 and D10-D12 over documents and faulty copies of them."""
    k = F.col("doc_id") % 7
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(k == 5, EMPTY).otherwise("")).alias("source"))
    s = F.col("source")
    copy = F.when(k == 1, F.substring(s, F.lit(1), F.floor(F.char_length(s) / 3).cast("int"))).when(k == 2, F.concat(s, F.lit("（此处略）"))).when(k == 3, F.concat(s, F.lit('\n甲"乙「丙'))).when(k == 4, F.concat(s, F.lit("就就好好好"))).when(k == 6, F.concat(s, F.lit("\n，开头"))).otherwise(s)
    return audit.pair_audit(rows.withColumn("refined", copy), "doc_id")
