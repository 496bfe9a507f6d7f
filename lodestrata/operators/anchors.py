"""Refined turns anchored to source turns, and what rests on that.

Both texts are cut into labelled turns; a refined turn's anchor is the source
turn that shares most of its shingles. The match is an equi-join on (text,
shingle), so work grows with the texts and not with pairs of turns.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import HAN, WS, occurrences
from lodestrata.operators.audit import SHINGLE, shingled
from lodestrata.operators.names import name_hits
from lodestrata.operators.turns import inside, islands, lines, sections

#: Thresholds that behaviour does not fix.
ANCHOR_SHINGLES, ANCHOR_SHARE = 4, 0.4
MIN_SAMPLE, MAJORITY = 3, 0.6
QUOTE_HAN, QUOTE_SUPPORT = 12, 0.5
MOST_SUBSTITUTED = 3
#: Shingles that a text is searched for one by one.
MOST_SOUGHT = 64
GAP_MARK = "<!-- 此处可能缺失原文"
ANCHOR_MARK = "<!-- source:"

#: Fixed patterns: the three forms of a turn's label.
TIMED = r"\A([^\s：:#*<>0-9][^：:#*<>\n]{0,11}?(?: ?[0-9]+)?)\s+([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\s*\z"
BOLD = r"\A\*\*([^*：:\n]{1,16}?)(?:\s+([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?))?[：:]?\*\*[：:]?\s*(.*)\z"
INLINE = r"\A([一-龥A-Za-z0-9·]{1,8}(?: [0-9]+)?)[：:]\s*(.*)\z"


def speaker_turns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, turn_no, speaker, ts, start_line, end_line, text); spaces in
    labels are removed. Texts without labels have no turns. A text is one row,
    and its turns come from one ordered pass over its lines."""
    rows = lines(docs, id_col, text_col)
    form = F.when(F.col("line").rlike(TIMED), "timed").when(F.col("line").rlike(BOLD), "bold").when(F.col("line").rlike(INLINE), "inline")
    label = F.when(F.col("form") == "timed", F.regexp_extract("line", TIMED, 1)).when(F.col("form") == "bold", F.regexp_extract("line", BOLD, 1)).otherwise(F.regexp_extract("line", INLINE, 1))
    ts = F.when(F.col("form") == "timed", F.regexp_extract("line", TIMED, 2)).when(F.col("form") == "bold", F.regexp_extract("line", BOLD, 2)).otherwise("")
    rest = F.when(F.col("form") == "bold", F.regexp_extract("line", BOLD, 3)).when(F.col("form") == "inline", F.regexp_extract("line", INLINE, 2)).when(F.col("form") == "timed", "").otherwise(F.col("line"))
    w = Window.partitionBy(id_col).orderBy("line_no")
    marked = rows.withColumn("form", form).withColumn("heading", F.col("line").rlike(r"\A#{1,6} |\A<!--")).withColumn("turn_no", F.sum(F.col("form").isNotNull().cast("long")).over(w))
    said = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", rest.alias("rest")))), lambda x: x["rest"]), lambda x: x != ""), "\n")
    kept = marked.where("turn_no > 0 and not heading")
    head = F.min_by(F.struct(F.regexp_replace(label, r"\s", "").alias("speaker"), ts.alias("ts")), "line_no")
    return kept.groupBy(id_col, "turn_no").agg(head.alias("h"), F.min("line_no").alias("start_line"), F.max(F.when(F.trim("line") != "", F.col("line_no"))).alias("end_line"), said.alias("text")).select(id_col, "turn_no", "h.speaker", "h.ts", "start_line", "end_line", "text")


def anchored(source: DataFrame, refined: DataFrame, id_col: str) -> DataFrame:
    """(id, turn_no, source_no, shared, share): each refined turn's anchor; ties
    go to the earlier source turn. Both have (id, turn_no, text)."""
    a = shingled(source, [id_col, "turn_no"], "text", False).withColumnRenamed("turn_no", "source_no")
    b = shingled(refined, [id_col, "turn_no"], "text", False)
    total = b.groupBy(id_col, "turn_no").agg(F.count(F.lit(1)).alias("total"))
    met = b.join(a, [id_col, "shingle"]).groupBy(id_col, "turn_no", "source_no").agg(F.count(F.lit(1)).alias("shared"))
    best = met.withColumn("rn", F.row_number().over(Window.partitionBy(id_col, "turn_no").orderBy(F.desc("shared"), "source_no"))).where("rn = 1").drop("rn")
    out = best.join(total, [id_col, "turn_no"]).withColumn("share", F.col("shared") / F.col("total")).drop("total")
    return out.where((F.col("shared") >= ANCHOR_SHINGLES) & (F.col("share") >= ANCHOR_SHARE))


def candidates(source: DataFrame, refined: DataFrame, id_col: str) -> DataFrame:
    """(id, turn_no, source_no, shared): all source turns that hold enough of a refined turn's shingles."""
    a = shingled(source, [id_col, "turn_no"], "text", False).withColumnRenamed("turn_no", "source_no")
    b = shingled(refined, [id_col, "turn_no"], "text", False)
    total = b.groupBy(id_col, "turn_no").agg(F.count(F.lit(1)).alias("total"))
    met = b.join(a, [id_col, "shingle"]).groupBy(id_col, "turn_no", "source_no").agg(F.count(F.lit(1)).alias("shared"))
    return met.join(total, [id_col, "turn_no"]).where((F.col("shared") >= ANCHOR_SHINGLES) & (F.col("shared") / F.col("total") >= ANCHOR_SHARE)).drop("total")


def heaviest_chain(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of (turn, source, weight) sorted by turn those that go forward in both and
    weigh most together; a turn is taken once, a source turn as often as need be.
    A staircase holds, for each last source turn, the best weight so far."""
    stairs: list[tuple[int, int, int]] = []  # (source, weight, place in ``back``), rising in both
    back: list[tuple[int, int, int]] = []
    at = 0
    while at < len(pairs):
        turn, fresh = pairs[at][0], []
        while at < len(pairs) and pairs[at][0] == turn:
            _, source, weight = pairs[at]
            i = bisect_right(stairs, source, key=lambda x: x[0])
            best, before = (stairs[i - 1][1], stairs[i - 1][2]) if i else (0, -1)
            back.append((turn, source, before))
            fresh.append((source, best + weight, len(back) - 1))
            at += 1
        for step in fresh:
            i = bisect_right(stairs, step[0], key=lambda x: x[0])
            if i and stairs[i - 1][1] >= step[1]:
                continue
            start = i - 1 if i and stairs[i - 1][0] == step[0] else i
            while i < len(stairs) and stairs[i][1] <= step[1]:
                i += 1
            stairs[start:i] = [step]
    out, place = [], stairs[-1][2] if stairs else -1
    while place >= 0:
        turn, source, place = back[place]
        out.append((turn, source))
    return out[::-1]


def aligned(source: DataFrame, refined: DataFrame, id_col: str) -> DataFrame:
    """(id, turn_no, source_no, shared): refined turns aligned to source turns
    without going back: of all anchors those that rise in both texts and share
    most shingles together. Turns that moved have anchors but no alignment. A
    task holds the anchors of one text at a time, whose texts are no longer
    there."""
    pairs = candidates(source, refined, id_col)
    kind = pairs.schema[id_col].dataType.simpleString()

    def chains(batches):
        now, held = None, []

        def done():
            weight = {(t, s): w for t, s, w in held}
            return pd.DataFrame([(now, t, s, weight[t, s]) for t, s in heaviest_chain(held)], columns=[id_col, "turn_no", "source_no", "shared"])

        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if held and row[0] != now:
                    yield done()
                    held = []
                now = row[0]
                held.append(tuple(map(int, row[1:])))
        if held:
            yield done()

    ordered = pairs.select(id_col, F.col("turn_no").cast("long"), F.col("source_no").cast("long"), F.col("shared").cast("long")).repartition(id_col).sortWithinPartitions(id_col, "turn_no", "source_no")
    return ordered.mapInPandas(chains, f"{id_col} {kind}, turn_no long, source_no long, shared long")


def attribution(source: DataFrame, refined: DataFrame, id_col: str) -> DataFrame:
    """(id, turn_no, speaker, expected, label, tier): refined turns under
    another known label than the one that most of their source speaker's turns
    have; with three speakers or more weak cases are for review. Struck labels
    are left out."""
    pairs = anchored(source, refined, id_col)
    s = source.select(id_col, F.col("turn_no").alias("source_no"), "speaker", F.col("text").rlike(r"\A~~").alias("struck"))
    r = refined.select(id_col, "turn_no", F.col("speaker").alias("label"))
    rows = pairs.join(s, [id_col, "source_no"]).where("not struck").join(r, [id_col, "turn_no"])
    count = rows.groupBy(id_col, "speaker", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy(id_col, "speaker")))
    learned = count.where((F.col("all") >= MIN_SAMPLE) & (F.col("n") > MAJORITY * F.col("all"))).select(id_col, "speaker", F.col("label").alias("expected"))
    known = refined.select(id_col, F.col("speaker").alias("label")).distinct()
    parties = source.groupBy(id_col).agg(F.count_distinct("speaker").alias("parties"))
    wrong = rows.join(learned, [id_col, "speaker"]).where("label != expected").join(known, [id_col, "label"], "left_semi").join(parties, id_col)
    tier = F.when((F.col("parties") >= 3) & (F.col("shared") < 40), "review").otherwise("mismatch")
    return wrong.select(id_col, "turn_no", "speaker", "expected", "label", tier.alias("tier"))


def fabricated_quotes(source: DataFrame, refined: DataFrame, id_col: str) -> DataFrame:
    """(id, quote, support): curly-quoted spans of some length whose
    shingles the source lacks. Both have (id, text)."""
    spans = refined.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("“([^”]+)”"), F.lit(1)))).alias("quote"))
    spans = spans.where(F.regexp_count("quote", F.lit(HAN)) >= QUOTE_HAN)
    mine = shingled(spans, [id_col, "quote"], "quote", False)
    # a text is only asked for the shingles of its quotes: few are looked for one by one, many met with its own
    wanted = mine.groupBy(id_col).agg(F.collect_set(F.replace("shingle", F.lit(" "), F.lit(""))).alias("wanted_"))
    plain = source.select(id_col, F.regexp_replace("text", "[^一-龥A-Za-z0-9]+", "").alias("plain_")).join(wanted, id_col)
    own = F.regexp_extract_all("plain_", F.lit(f"(?=({'.' * SHINGLE}))."), F.lit(1))
    held = F.when(F.size("wanted_") <= MOST_SOUGHT, F.filter("wanted_", lambda s: F.contains("plain_", s))).otherwise(F.array_intersect("wanted_", own))
    have = plain.select(id_col, F.explode_outer(held).alias("shingle")).where("shingle is not null").select(id_col, F.array_join(F.split("shingle", ""), " ").alias("shingle")).distinct().withColumn("found", F.lit(1))
    support = mine.join(have, [id_col, "shingle"], "left").groupBy(id_col, "quote").agg((F.count("found") / F.count(F.lit(1))).alias("support"))
    return support.where(F.col("support") < QUOTE_SUPPORT)


def substituted_entities(source: DataFrame, refined: DataFrame, glossary: DataFrame, id_col: str) -> DataFrame:
    """(id, turn_no, canonical): canonicals of (canonical, variants) in
    refined turns whose anchor has none of their forms; those that are frequent
    in the refined text are left out."""
    hits = name_hits(refined, [id_col, "turn_no"], "text", glossary.select("canonical", "variants"), "canonical")
    said = hits.join(refined.select(id_col, "turn_no", "text"), [id_col, "turn_no"]).withColumn("n", F.sum(occurrences(F.col("text"), F.col("canonical"))).over(Window.partitionBy(id_col, "canonical")))
    few = said.where(F.col("n") <= MOST_SUBSTITUTED).select(id_col, "turn_no", "canonical", "variants")
    at = few.join(anchored(source, refined, id_col), [id_col, "turn_no"]).join(source.select(id_col, F.col("turn_no").alias("source_no"), F.col("text").alias("source_text")), [id_col, "source_no"])
    forms = F.concat(F.array("canonical"), "variants")
    return at.where(~F.exists(forms, lambda f: F.contains("source_text", f))).select(id_col, "turn_no", "canonical")


def merge_review(pairs: DataFrame, glossary: DataFrame, id_col: str) -> DataFrame:
    """Variants that were replaced throughout, with the four counts, and
    whether the canonical had stood in the source on its own. Pairs have (id,
    source, refined); spellings that differ by spaces and hyphens are no matter."""
    plain = lambda c: F.regexp_replace(F.lower(c), rf"[-_·]|{WS}", "")
    g = glossary.where(plain(F.col("variant")) != plain(F.col("canonical")))
    met = name_hits(pairs, [id_col], "source", g.select("canonical", "variant"), "variant").join(pairs, id_col)
    n = lambda text, name: occurrences(F.col(text), F.col(name))
    counts = met.select(id_col, F.col("variant").alias("from"), F.col("canonical").alias("to"), n("source", "variant").alias("source_from"), n("source", "canonical").alias("source_to"), n("refined", "variant").alias("refined_from"), n("refined", "canonical").alias("refined_to"))
    gone = (F.col("source_from") > 0) & (F.col("refined_from") == 0) & (F.col("refined_to") > F.col("source_to"))
    return counts.where(gone).withColumn("independent", F.col("source_to") >= 2)


def missing_marks(docs: DataFrame, people: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that name an unverified person (name) without a mark of doubt."""
    rows = lines(docs, id_col, text_col)
    met = name_hits(rows, [id_col, "line_no"], "line", people.select("name"), "name").join(rows.select(id_col, "line_no", "line"), [id_col, "line_no"])
    return met.where(~F.col("line").rlike("（音）|\\(音\\)|（待核")).select(id_col, "name", "line_no")


def section_ranges(source: DataFrame, refined_docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, title, first_line, last_line, ts): the source lines that a
    section covers: the largest run of neighbouring anchors by characters, the
    earlier on ties."""
    turns_ = speaker_turns(refined_docs, id_col, text_col)
    spans = sections(refined_docs, id_col, text_col).select(id_col, "title", F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"))
    met = anchored(source, turns_, id_col).join(turns_.select(id_col, "turn_no", "start_line"), [id_col, "turn_no"])
    held = inside(met, "start_line", spans, "s_start", "s_end", [id_col]).select(id_col, "title", "source_no").distinct()
    w = Window.partitionBy(id_col, "title").orderBy("source_no")
    runs = held.withColumn("run", F.col("source_no") - F.row_number().over(w))
    s = source.select(id_col, F.col("turn_no").alias("source_no"), "start_line", "end_line", "ts", F.length("text").alias("chars"))
    sized = runs.join(s, [id_col, "source_no"]).groupBy(id_col, "title", "run").agg(F.sum("chars").alias("chars"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.min_by("ts", "source_no").alias("ts"))
    best = sized.withColumn("rn", F.row_number().over(Window.partitionBy(id_col, "title").orderBy(F.desc("chars"), "first_line"))).where("rn = 1")
    return best.select(id_col, "title", "first_line", "last_line", "ts")


def _rebuilt(rows: DataFrame, id_col: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def annotate_gaps(docs: DataFrame, gaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """K9: a visible mark after a line for every hard gap (id, after_line,
    first, last); marks that are there stay single."""
    mark = F.concat(F.lit(f"{GAP_MARK} L"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(" -->"))
    marks = gaps.where("severity = 'hard'").select(id_col, "after_line", mark.alias("mark"))
    rows = lines(docs, id_col, text_col)
    old = rows.where(F.startswith("line", F.lit(GAP_MARK))).select(id_col, F.col("line").alias("mark")).distinct()
    new = marks.join(old, [id_col, "mark"], "left_anti").groupBy(id_col, "after_line").agg(F.array_join(F.array_sort(F.collect_set("mark")), "\n").alias("mark"))
    joined = rows.join(new.withColumnRenamed("after_line", "line_no"), [id_col, "line_no"], "left")
    return _rebuilt(joined.select(id_col, "line_no", F.concat_ws("\n", "line", "mark").alias("line")), id_col)


def annotate_anchors(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One invisible remark below each heading of (id, title, first_line,
    last_line, ts); an older remark is replaced."""
    rows = lines(docs, id_col, text_col).where(~F.startswith("line", F.lit(ANCHOR_MARK)))
    remark = F.concat(F.lit(f"{ANCHOR_MARK} L"), F.col("first_line").cast("string"), F.lit("-"), F.col("last_line").cast("string"), F.when(F.coalesce("ts", F.lit("")) != "", F.concat(F.lit(" "), F.col("ts"))).otherwise(""), F.lit(" -->"))
    titled = rows.withColumn("title", F.regexp_extract("line", r"\A## +(.*)\z", 1))
    joined = titled.join(ranges.select(id_col, "title", remark.alias("remark")), [id_col, "title"], "left")
    return _rebuilt(joined.select(id_col, "line_no", F.concat_ws("\n", "line", "remark").alias("line")), id_col)


def ending_missing(source: DataFrame, refined: DataFrame, id_col: str) -> DataFrame:
    """Texts whose last source turn of some length has no counterpart."""
    last = source.where(F.length("text") >= 8).withColumn("rn", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("turn_no")))).where("rn = 1")
    mine = shingled(last, [id_col], "text", False)
    have = shingled(refined, [id_col], "text", False).distinct().withColumn("found", F.lit(1))
    share = mine.join(have, [id_col, "shingle"], "left").groupBy(id_col).agg((F.count("found") / F.count(F.lit(1))).alias("share"))
    return share.where(F.col("share") < ANCHOR_SHARE).select(id_col)


def localised(flags: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """Flags (id, line_no, kind) by the section (id, title, start_line, end_line) that holds them."""
    s = spans.select(id_col, "title", "start_line", "end_line")
    return inside(flags, "line_no", s, "start_line", "end_line", [id_col]).groupBy(id_col, "title").agg(F.array_sort(F.collect_list("kind")).alias("flags"))


def lost_runs(share: DataFrame, id_col: str, floor: Column) -> DataFrame:
    """W4 over anchors: runs of source turns below a floor."""
    return islands(share.withColumn("lost", F.col("matched") < floor), [id_col], "turn_no", "lost").where("lost").drop("lost")


def heading_level(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, level): the heading level that sections are cut at: two, unless
    fewer than three such headings stand there and a deeper level has more."""
    marks = lines(docs, id_col, text_col).select(id_col, F.length(F.regexp_extract("line", r"\A(#{2,6}) ", 1)).alias("depth")).where("depth >= 2")
    n = marks.groupBy(id_col, "depth").count()
    per = n.groupBy(id_col).agg(F.coalesce(F.sum(F.when(F.col("depth") == 2, F.col("count"))), F.lit(0)).alias("two"), F.max(F.when(F.col("depth") > 2, F.struct("count", -F.col("depth")))).alias("deep"))
    deeper = (F.col("two") < 3) & (F.col("deep.count") > F.col("two"))
    return per.select(id_col, F.when(F.coalesce(deeper, F.lit(False)), -F.col("deep.col2")).otherwise(2).cast("long").alias("level"))
