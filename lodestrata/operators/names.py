"""Which names stand in which texts, as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Starts of names that are looked up in the texts where they lie; more are met by a join.
MOST_STARTS = 10_000


def starts(text: Column) -> Column:
    """All characters of a text, and all pairs of neighbouring ones."""
    return F.array_union(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))))


def name_hits(docs: DataFrame, ids: list[str], text_col: str, names: DataFrame, name_col: str) -> DataFrame:
    """(ids, columns of ``names``): the names that a text holds. Texts and names
    meet on a name's first two characters, its only one where it has one, so no
    text is compared with names that share no start with it; then the whole
    name is looked for. Empty names stand nowhere."""
    keyed = names.where(F.length(name_col) > 0).withColumn("start_", F.substring(name_col, 1, 2))
    wanted = keyed.select("start_").distinct()
    known = [r.start_ for r in wanted.limit(MOST_STARTS + 1).collect()]
    if len(known) <= MOST_STARTS:
        held = F.array_intersect(starts(F.col(text_col)), F.array(*map(F.lit, sorted(known))).cast("array<string>"))
        each = docs.select(*ids, F.explode(held).alias("start_"))
    else:
        each = docs.select(*ids, F.explode(starts(F.col(text_col))).alias("start_")).join(wanted, "start_", "left_semi")
    met = each.join(keyed, "start_").drop("start_")
    return met.join(docs.select(*ids, F.col(text_col).alias("text_")), ids).where(F.contains("text_", F.col(name_col))).drop("text_")
