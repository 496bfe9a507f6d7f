"""Fidelity audits of conversations against altered copies of themselves, and of
documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import anchors, audit, turns
from lodestrata.plans.queries import query, read

LABELS = {"user": "甲", "assistant": "乙", "system": "丙"}
#: Words of a copy that its source does not have, and the form that the source may have.
PLANTED, FORM = "云洲仪器", "云舟仪器"

#: The turns of each conversation on one line each, and what the copy says: other
#: labels in some places, a planted name in others.
TURNS = f"""t AS (SELECT conv_id id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) no, CASE role WHEN 'user' THEN '甲' WHEN 'assistant' THEN '乙' ELSE '丙' END who, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) x FROM conversations),
c AS (SELECT id, no, who, x, CASE WHEN (id + no) % 7 = 0 THEN CASE who WHEN '甲' THEN '乙' ELSE '甲' END ELSE who END lab, x || CASE WHEN (id + no) % 5 = 0 THEN '{PLANTED}' ELSE '' END y FROM t)"""
SHINGLES = "list_distinct(list_transform(range(1, greatest(length(k) - 2, 1) + 1), lambda i: substr(k, i, 3)))"
PLAIN = "regexp_replace({0}, '[^一-龥A-Za-z0-9]', '', 'g')"
#: Each turn of the copy with the source turn that shares most of its shingles.
ANCHORED = f"""a AS (SELECT id, no, unnest({SHINGLES}) s FROM (SELECT id, no, {PLAIN.format("x")} k FROM c)), b AS (SELECT id, no, unnest({SHINGLES}) s FROM (SELECT id, no, {PLAIN.format("y")} k FROM c)),
p AS (SELECT b.id, b.no, a.no src, count(*) shared FROM b JOIN a ON a.id = b.id AND a.s = b.s GROUP BY ALL),
n AS (SELECT id, no, src, shared FROM (SELECT p.*, row_number() OVER (PARTITION BY id, no ORDER BY shared DESC, src) rn, (SELECT count(*) FROM b WHERE b.id = p.id AND b.no = p.no) total FROM p) WHERE rn = 1 AND shared >= 4 AND shared / total >= 0.4)"""


def _turns(spark, d):
    """(id, no, who, x, lab, y): turns of a conversation and of its copy."""
    who = F.when(F.col("role") == "user", "甲").when(F.col("role") == "assistant", "乙").otherwise("丙")
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("no"), who.alias("who"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("x"))
    swapped = F.when((F.col("id") + F.col("no")) % 7 == 0, F.when(F.col("who") == "甲", "乙").otherwise("甲")).otherwise(F.col("who"))
    return c.withColumns({"lab": swapped, "y": F.concat("x", F.when((F.col("id") + F.col("no")) % 5 == 0, PLANTED).otherwise(""))})


def _document(rows, label: str, said: str, headings: bool):
    """One text a conversation; a copy has a heading before every third turn."""
    line = F.concat(F.col(label), F.lit("："), F.col(said))
    if headings:
        line = F.when(F.col("no") % 3 == 1, F.concat(F.lit("## S"), F.ceil(F.col("no") / 3).cast("string"), F.lit("\n"), line)).otherwise(line)
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def _pair(spark, d):
    rows = _turns(spark, d)
    source, copy = _document(rows, "who", "x", False), _document(rows, "lab", "y", True)
    return source, copy, anchors.speaker_turns(source, "id", "text"), anchors.speaker_turns(copy, "id", "text")


@query(f"""WITH {TURNS} SELECT id, no turn_no, lab speaker, '' ts, no + ceil(no / 3)::BIGINT start_line, (no + ceil(no / 3))::BIGINT end_line, y AS "text" FROM c""")
def turns_of_copies(spark, d):
    return _pair(spark, d)[3].select("id", "turn_no", "speaker", "ts", "start_line", "end_line", "text")


@query(f"""WITH {TURNS}, {ANCHORED} SELECT id, no turn_no, src source_no, shared FROM n""")
def anchors_of_copies(spark, d):
    _, _, a, b = _pair(spark, d)
    return anchors.anchored(a, b, "id").select("id", "turn_no", "source_no", "shared")


#: Where a turn of a copy goes when the second and the third change places.
MOVED = "CASE WHEN id % 2 = 0 AND no IN (2, 3) THEN 5 - no ELSE no END"


@query(f"""WITH RECURSIVE {TURNS}, m AS (SELECT id, {MOVED} no, y FROM c), a AS (SELECT id, no, unnest({SHINGLES}) s FROM (SELECT id, no, {PLAIN.format("x")} k FROM c)), b AS (SELECT id, no, unnest({SHINGLES}) s FROM (SELECT id, no, {PLAIN.format("y")} k FROM m)),
n AS (SELECT id, no, count(*) total FROM b GROUP BY ALL), p AS (SELECT b.id, b.no, a.no src, count(*) shared FROM b JOIN a ON a.id = b.id AND a.s = b.s JOIN n ON n.id = b.id AND n.no = b.no GROUP BY b.id, b.no, a.no, total HAVING count(*) >= 4 AND count(*) / total >= 0.4),
w AS (SELECT id, no, src, shared FROM p UNION SELECT w.id, p.no, p.src, w.shared + p.shared FROM w JOIN p ON p.id = w.id AND p.no > w.no AND p.src >= w.src)
SELECT id, max(shared)::BIGINT shared FROM w GROUP BY id""")
def alignment_of_copies(spark, d):
    """What copies with two turns exchanged share with their sources in order."""
    rows = _turns(spark, d)
    moved = rows.withColumn("no", F.when((F.col("id") % 2 == 0) & F.col("no").isin(2, 3), 5 - F.col("no")).otherwise(F.col("no")))
    a, b = rows.select("id", F.col("no").alias("turn_no"), F.col("x").alias("text")), moved.select("id", F.col("no").alias("turn_no"), F.col("y").alias("text"))
    return anchors.aligned(a, b, "id").groupBy("id").agg(F.sum("shared").alias("shared"))


@query(f"""WITH {TURNS}, {ANCHORED}, r AS (SELECT n.id, n.no, n.shared, s.who, x.lab FROM n JOIN c s ON s.id = n.id AND s.no = n.src JOIN c x ON x.id = n.id AND x.no = n.no WHERE NOT starts_with(s.x, '~~')),
k AS (SELECT id, who, lab, count(*) m, sum(count(*)) OVER (PARTITION BY id, who) total FROM r GROUP BY id, who, lab), l AS (SELECT id, who, lab expected FROM k WHERE total >= 3 AND m > 0.6 * total)
SELECT r.id, no turn_no, r.who speaker, expected, r.lab "label", CASE WHEN (SELECT count(DISTINCT who) FROM c WHERE c.id = r.id) >= 3 AND shared < 40 THEN 'review' ELSE 'mismatch' END tier FROM r JOIN l ON l.id = r.id AND l.who = r.who WHERE r.lab <> expected""")
def labels_of_copies(spark, d):
    _, _, a, b = _pair(spark, d)
    return anchors.attribution(a, b, "id")


RANGES = f"""{TURNS}, {ANCHORED}, i AS (SELECT DISTINCT id, 'S' || ceil(no / 3)::BIGINT title, src FROM n), g AS (SELECT *, src - row_number() OVER (PARTITION BY id, title ORDER BY src) run FROM i),
z AS (SELECT g.id, title, run, sum(length(c.x)) chars, min(src) f, max(src) l FROM g JOIN c ON c.id = g.id AND c.no = g.src GROUP BY g.id, title, run), q AS (SELECT id, title, f, l FROM (SELECT *, row_number() OVER (PARTITION BY id, title ORDER BY chars DESC, f) rn FROM z) WHERE rn = 1)"""


@query(f"""WITH {RANGES} SELECT id, title, f first_line, l last_line, '' ts FROM q""")
def ranges_of_copies(spark, d):
    _, copy, a, _ = _pair(spark, d)
    return anchors.section_ranges(a, copy, "id", "text")


@query(f"""WITH {RANGES} SELECT c.id, string_agg(CASE WHEN no % 3 = 1 THEN '## S' || ceil(no / 3)::BIGINT || chr(10) || CASE WHEN q.id IS NULL THEN '' ELSE '<!-- source: L' || f || '-' || l || ' -->' || chr(10) END ELSE '' END || lab || '：' || y, chr(10) ORDER BY no) AS "text" FROM c LEFT JOIN q ON q.id = c.id AND q.title = 'S' || ceil(no / 3)::BIGINT GROUP BY c.id""")
def anchors_in_copies(spark, d):
    _, copy, a, _ = _pair(spark, d)
    return anchors.annotate_anchors(copy, anchors.section_ranges(a, copy, "id", "text"), "id", "text")


@query(f"""WITH {TURNS} SELECT id, string_agg(who || '：' || x || CASE WHEN no = 2 AND id % 2 = 0 THEN chr(10) || '<!-- 此处可能缺失原文 L3-' || 3 + id % 4 || ' -->' ELSE '' END, chr(10) ORDER BY no) AS "text" FROM c GROUP BY id""")
def gaps_in_copies(spark, d):
    source = _pair(spark, d)[0]
    gaps = source.select("id", F.lit(2).cast("long").alias("after_line"), F.lit(3).cast("long").alias("first"), (3 + F.col("id") % 4).alias("last"), F.when(F.col("id") % 2 == 0, "hard").otherwise("soft").alias("severity"))
    once = anchors.annotate_gaps(source, gaps, "id", "text")
    return anchors.annotate_gaps(once, gaps, "id", "text")


@query(f"""WITH {TURNS}, {ANCHORED}, o AS (SELECT id, sum((length(y) - length(replace(y, '{PLANTED}', ''))) // {len(PLANTED)}) k FROM c GROUP BY id)
SELECT n.id, n.no turn_no, '{PLANTED}' canonical FROM n JOIN c ON c.id = n.id AND c.no = n.no JOIN c s ON s.id = n.id AND s.no = n.src JOIN o ON o.id = n.id WHERE contains(c.y, '{PLANTED}') AND k <= 3 AND NOT contains(s.x, '{PLANTED}') AND NOT contains(s.x, '{FORM}')""")
def names_of_copies(spark, d):
    _, _, a, b = _pair(spark, d)
    glossary = read(spark, d, "region").limit(1).select(F.lit(PLANTED).alias("canonical"), F.array(F.lit(FORM)).alias("variants"))
    return anchors.substituted_entities(a, b, glossary, "id")


@query(f"""WITH {TURNS}, l AS (SELECT id, max(no) FILTER (length(x) >= 8) no FROM c GROUP BY id), w AS (SELECT id, string_agg(CASE WHEN no % 3 = 1 THEN '##S' || ceil(no / 3)::BIGINT ELSE '' END || lab || y, '' ORDER BY no) w FROM c JOIN (SELECT id, max(no) m FROM c GROUP BY id) USING (id) WHERE id % 3 > 0 OR no < m GROUP BY id),
h AS (SELECT id, unnest({SHINGLES}) s FROM (SELECT id, {PLAIN.format("w")} k FROM w)), e AS (SELECT id, unnest({SHINGLES}) s FROM (SELECT id, {PLAIN.format("x")} k FROM c JOIN l USING (id, no)))
SELECT id FROM (SELECT e.id, count(h.s) / count(*) share FROM e LEFT JOIN h ON h.id = e.id AND h.s = e.s GROUP BY e.id) WHERE share < 0.4""")
def endings_of_copies(spark, d):
    rows = _turns(spark, d).withColumn("most", F.max("no").over(Window.partitionBy("id")))
    cut = _document(rows.where("id % 3 > 0 or no < most"), "lab", "y", True)
    return anchors.ending_missing(_pair(spark, d)[2], cut, "id")


@query(f"""WITH {TURNS} SELECT id, no turn_no, who speaker, CASE WHEN id % 3 = 2 THEN '' ELSE '00:' || lpad(no::VARCHAR, 2, '0') END ts, CASE WHEN id % 3 = 0 THEN 2 * no - 1 ELSE no END start_line, CASE WHEN id % 3 = 0 THEN 2 * no ELSE no END end_line, '—' || x AS "text" FROM c""")
def turns_in_three_forms(spark, d):
    """Labels with a time on lines of their own, bold labels, and plain ones."""
    rows = _turns(spark, d).withColumn("x", F.concat(F.lit("—"), "x"))
    ts = F.concat(F.lit("00:"), F.lpad(F.col("no").cast("string"), 2, "0"))
    line = F.when(F.col("id") % 3 == 0, F.concat("who", F.lit(" "), ts, F.lit("\n"), "x")).when(F.col("id") % 3 == 1, F.concat(F.lit("**"), "who", F.lit(" "), ts, F.lit("**："), "x")).otherwise(F.concat("who", F.lit("："), "x"))
    text = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return anchors.speaker_turns(text, "id", "text").select("id", "turn_no", "speaker", "ts", "start_line", "end_line", "text")


#: Names whose lines need a mark of doubt.
DOUBTED = ("the", "und", "les ", "de la", "zzzz")


@query(f"""WITH l AS (SELECT doc_id, i line_no, string_split(text, chr(10))[i] line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) x(i)) SELECT doc_id, n AS "name", line_no FROM l, (SELECT unnest([{', '.join(f"'{n}'" for n in DOUBTED)}]) n) WHERE line_no % 2 = 1 AND contains(line, n)""")
def unmarked_names(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    marked = F.transform(F.split("text", "\n", -1), lambda line, i: F.when(i % 2 == 1, F.concat(line, F.lit("（音）"))).otherwise(line))
    names = spark.createDataFrame([(n,) for n in DOUBTED], "name string")
    return anchors.missing_marks(docs.withColumn("text", F.array_join(marked, "\n")), names, "doc_id", "text")


#: Sixty characters in one order; a text has some of them, a quote the same or the other way round.
HAN = "".join(chr(0x4E00 + 7 * i) for i in range(60))


@query(f"""SELECT doc_id, reverse(substr('{HAN}', (1 + doc_id % 40)::INTEGER, 20)) quote FROM documents WHERE doc_id % 2 = 1""")
def quotes_made_up(spark, d):
    docs, said = read(spark, d, "documents"), F.substring(F.lit(HAN), (F.col("doc_id") % 40 + 1).cast("int"), F.lit(20))
    source = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), said).alias("text"))
    quote = F.when(F.col("doc_id") % 2 == 0, said).otherwise(F.reverse(said))
    return anchors.fabricated_quotes(source, docs.select("doc_id", F.concat(F.lit("他说“"), quote, F.lit("”，又说“好”")).alias("text")), "doc_id").select("doc_id", "quote")


# ---- orders and spans over the tables --------------------------------------------
@query("""WITH RECURSIVE l AS (SELECT l_orderkey k, l_linenumber item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey) j FROM lineitem),
m AS (SELECT a.k, a.i, b.j FROM l a JOIN l b ON b.k = a.k AND b.item = a.item), w AS (SELECT k, i, j, 1 n FROM m UNION SELECT w.k, m.i, m.j, w.n + 1 FROM w JOIN m ON m.k = w.k AND m.i > w.i AND m.j > w.j)
SELECT k l_orderkey, max(n) / (SELECT count(*) FROM l WHERE l.k = w.k) ratio FROM w GROUP BY k""")
def orders_of_lines(spark, d):
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, "l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"])
    both = read(spark, d, "lineitem").groupBy("l_orderkey").agg(by("l_shipdate").alias("a"), by("l_extendedprice").alias("b"))
    return both.select("l_orderkey", audit.order_ratio("a", "b").alias("ratio"))


@query("""WITH l AS (SELECT doc_id, i line_no, string_split(text, chr(10))[i] line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) x(i)), s AS (SELECT doc_id, s, s + 2 + doc_id % 3 * 400 e FROM (SELECT doc_id, unnest(range(1, max(line_no) + 1, 3)) s FROM l GROUP BY doc_id))
SELECT s.doc_id, s "first", count(*) n_lines, sum(length(coalesce(line, '')))::BIGINT chars FROM s JOIN l ON l.doc_id = s.doc_id AND line_no BETWEEN s AND e GROUP BY s.doc_id, s""")
def lines_in_spans(spark, d):
    rows = turns.lines(read(spark, d, "documents"), "doc_id", "text")
    starts = rows.where("line_no % 3 = 1").select("doc_id", F.col("line_no").alias("first"), (F.col("line_no") + 2 + F.col("doc_id") % 3 * 400).alias("last"))
    return turns.inside(rows, "line_no", starts, "first", "last", ["doc_id"]).groupBy("doc_id", "first").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))
