"""Lines, turns and chunks of transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import WS, ends_with_question

#: A label: 1 to 12 Han characters, letters, digits or middle dots before a colon.
LABEL = r"\A(?:\*\*)?([一-龥A-Za-z0-9·]{1,12})(?:\*\*)?[：:]"


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, line)."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("at_", "line")).select(id_col, (F.col("at_") + 1).cast("long").alias("line_no"), "line")


def read_lines(docs: DataFrame, id_col: str, text_col: str, offset: int = 0, limit: int = 2000) -> DataFrame:
    """A page of numbered lines, long ones cut."""
    page = lines(docs, id_col, text_col).where((F.col("line_no") > offset) & (F.col("line_no") <= offset + limit))
    return page.select(id_col, "line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 6, " "), F.lit("\t"), F.substring("line", 1, 2000)).alias("shown"))


def spans(marked: DataFrame, keys: list[str], start: str, end: Column) -> DataFrame:
    """Each marked row reaches to the row before the next one."""
    order = Window.partitionBy(*keys).orderBy(start)
    return marked.withColumn("end_line", F.coalesce(F.lead(start).over(order) - 1, end))


def parse_turns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, turn_no, label, start_line, end_line, q) of labelled lines.
    Every line is numbered by the labels up to it, then turns are summed up."""
    w = Window.partitionBy(id_col).orderBy("line_no")
    marked = lines(docs, id_col, text_col).withColumn("label", F.regexp_extract("line", LABEL, 1)).withColumn("turn_no", F.sum((F.col("label") != "").cast("long")).over(w))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    got = marked.where("turn_no > 0").groupBy(id_col, "turn_no").agg(F.min_by("label", "line_no").alias("label"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), said.alias("said"))
    return got.select(id_col, "turn_no", "label", "start_line", "end_line", ends_with_question(F.col("said")).alias("q"))


def inside(points: DataFrame, at: str, spans: DataFrame, first: str, last: str, keys: list[str], width: int = 1024) -> DataFrame:
    """Points with the columns of the spans (keys, first, last) that hold them,
    both ends included. Both sides meet on bins of so many places, a span in
    every bin that it reaches into, so a long text is many small joins and no
    point meets the spans of other places. Spans without an end hold nothing."""
    bins = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    dealt = spans.where(F.col(first) <= F.col(last)).withColumn("bin_", F.explode(bins(F.col(first), F.col(last))))
    met = points.withColumn("bin_", F.floor(F.col(at) / width)).join(dealt, [*keys, "bin_"])
    return met.where(F.col(at).between(F.col(first), F.col(last))).drop("bin_")


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, value, first, last, n) of runs of one value."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("changed_", changed).withColumn("island_", F.sum("changed_").over(w))
    return numbered.groupBy(*keys, "island_", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("island_")


def read_plan(n_lines: Column, n_bytes: Column) -> Column:
    """starts of pages sized by byte density."""
    page = F.least(F.lit(600), F.greatest(F.lit(150), F.floor(n_lines * 45000 / F.greatest(n_bytes, F.lit(1))))).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n_lines - 1, F.lit(0)).cast("long"), page), lambda s: F.struct(s.alias("offset"), page.alias("limit")))


def range_plan(first: Column, last: Column, n_lines: Column, page: int = 300, margin: int = 30) -> Column:
    """page starts over a range with a margin on either side."""
    low = F.greatest(F.lit(1), first - margin).cast("long")
    high = F.least(n_lines, last + margin).cast("long")
    return F.transform(F.sequence(low, F.greatest(low, high), F.lit(page).cast("long")), lambda s: F.struct((s - 1).alias("offset"), F.least(F.lit(page).cast("long"), high - s + 1).alias("limit")))


def refine_parts(size: Column, n_lines: Column, mode: str | None, budget: int, chunk_size: int | None = None) -> Column:
    """how many parts a text is refined in. The budget splits only what
    exceeds it; a chunk size, when given, decides alone; "off" never splits."""
    one = F.lit(1).cast("long")
    if mode == "off":
        return one
    if chunk_size:
        parts = F.ceil(size / chunk_size)
    else:
        by_budget = F.when(size > budget, F.ceil(size / budget)).otherwise(1)
        by_speed = F.when(size > 12000, 2).otherwise(1) if mode == "speed" else one
        parts = F.greatest(by_budget, by_speed)
    return F.when(n_lines <= 1, 1).otherwise(F.greatest(parts, one)).cast("long")


def scout_parts(size: Column, n_lines: Column) -> Column:
    """F19."""
    return F.when((size > 40000) & (n_lines > 1), F.least(F.lit(6), F.greatest(F.lit(2), F.ceil(size / 20000)))).otherwise(1).cast("long")


def even_chunks(n_lines: Column, parts: Column) -> Column:
    """F16: (idx, start_line, end_line, is_last); empty tails are dropped."""
    per = F.greatest(F.ceil(n_lines / parts), F.lit(1)).cast("long")
    real = F.greatest(F.ceil(n_lines / per), F.lit(1)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), real - 1), lambda i: F.struct((i + 1).alias("idx"), (i * per + 1).alias("start_line"), F.when(i == real - 1, F.greatest(n_lines, F.lit(1))).otherwise((i + 1) * per).cast("long").alias("end_line"), (i == real - 1).alias("is_last")))


def _turn_cuts(turns: list[tuple[int, bool]], n_lines: int, parts: int) -> list[int]:
    """the last line of each part but the last. Part i ends after the turn
    whose end lies nearest to i/parts of the text, kept in rising order and,
    where another choice exists, not on a question."""
    n, cuts, taken = len(turns), [], -1
    for i in range(1, parts):
        goal = int(i * n_lines / parts + 0.5)
        ends = [turns[j + 1][0] - 1 for j in range(n - 1)]
        nearest = min(range(n - 1), key=lambda j: (abs(ends[j] - goal), j))
        low, high = taken + 1, (n - 2) - (parts - 1 - i)
        at = max(low, min(nearest, high))
        if turns[at][1]:
            calm = [j for j in [*range(at - 1, low - 1, -1), *range(at + 1, high + 1)] if not turns[j][1]]
            at = calm[0] if calm else at
        taken = at
        cuts.append(ends[at])
    return cuts


def turn_chunks(files: DataFrame, id_col: str) -> DataFrame:
    """F17 for files of (id, n_lines, parts, turns array<struct<start_line, q>>):
    (id, idx, start_line, end_line, is_last). A file is one row of the input, so
    a task holds one file's turns; files of too few turns are cut evenly."""
    kind = files.schema[id_col].dataType.simpleString()

    def cut(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                turns = sorted((int(t["start_line"]), bool(t["q"])) for t in r.turns)
                n, k = int(r.n_lines), int(r.parts)
                if k > 1 and len(turns) >= max(k, 2):
                    ends = [*_turn_cuts(turns, n, k), n]
                else:
                    per = max(1, -(-n // k))
                    ends = [*range(per, n, per), n] if k > 1 else [n]
                out += [(getattr(r, id_col), i + 1, (ends[i - 1] + 1) if i else 1, e, i == len(ends) - 1) for i, e in enumerate(ends)]
            yield pd.DataFrame(out, columns=[id_col, "idx", "start_line", "end_line", "is_last"])

    return files.select(id_col, "n_lines", "parts", "turns").mapInPandas(cut, f"{id_col} {kind}, idx long, start_line long, end_line long, is_last boolean")


def owners(turns: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """A turn belongs to the chunk that holds its label's line."""
    c = chunks.select(id_col, "idx", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    return inside(turns, "start_line", c, "c_start", "c_end", [id_col]).drop("c_start", "c_end")


def stitched(parts: Column) -> Column:
    """parts trimmed at the end, empty ones dropped, one blank line
    between them, a heading that repeats at a seam written once."""
    bare = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, rf"{WS}+\z", "")), lambda p: F.regexp_replace(p, WS, "") != "")

    def join(acc: Column, part: Column) -> Column:
        last = F.regexp_extract(acc, r"([^\n]*)\z", 1)
        first = F.regexp_extract(part, r"\A([^\n]*)", 1)
        twice = last.rlike(r"\A#{1,6} ") & (last == first)
        rest = F.regexp_replace(part, r"\A[^\n]*\n*", "")
        return F.when(acc == "", part).when(twice & (rest == ""), acc).when(twice, F.concat(acc, F.lit("\n\n"), rest)).otherwise(F.concat(acc, F.lit("\n\n"), part))

    return F.aggregate(bare, F.lit(""), join, lambda s: F.when(s == "", s).otherwise(F.concat(s, F.lit("\n"))))


def sections(docs: DataFrame, id_col: str, text_col: str, level: str = "##") -> DataFrame:
    """(id, title, start_line, end_line) of headings of one level."""
    all_lines = lines(docs, id_col, text_col)
    total = all_lines.groupBy(id_col).agg(F.max("line_no").alias("last_line"))
    heads = all_lines.where(F.col("line").rlike(rf"\A{level} ")).withColumn("title", F.regexp_replace("line", rf"\A{level} +", "")).join(total, id_col)
    return spans(heads, [id_col], "line_no", F.col("last_line")).select(id_col, "title", F.col("line_no").alias("start_line"), "end_line")


def verify_batches(entities: DataFrame, keys: list[str], deep: bool, size: int = 12, most: int = 12) -> DataFrame:
    """Eligible entities by worth, in batches; of (section_ord, ord,
    worth, suspect). ``overflow`` marks those beyond ``size * most``."""
    eligible = entities if deep else entities.where((F.col("worth") > 0) | F.coalesce("suspect", F.lit(False)))
    order = Window.partitionBy(*keys).orderBy(F.desc("worth"), "section_ord", "ord")
    rn = F.row_number().over(order)
    return eligible.withColumn("rank", rn.cast("long")).withColumn("overflow", F.col("rank") > size * most).withColumn("batch", F.when(~F.col("overflow"), F.floor((F.col("rank") - 1) / size).cast("long")))


def oldest(verified: DataFrame, keys: list[str], date: str, order: str, n: int = 2) -> DataFrame:
    """The n rows of the oldest dates, empty dates first."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(F.col(date), F.lit("")), order)
    return verified.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def batch_lists(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Each batch of ``verify_batches`` as a list of names, by section and
    then by rank; (keys, batch, section_ord, names)."""
    kept = batches.where("batch is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return kept.groupBy(*keys, "batch", "section_ord").agg(ordered.alias("names"))
