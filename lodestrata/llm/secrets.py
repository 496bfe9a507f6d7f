r"""Secret scans by corpus-wide ownership frequency, DataFrame functions only.

Candidates are matched per kind, leftmost and not overlapping: ``assign`` (a
key word, a sign, a value of 8 characters or more), ``access`` (key ids of 16
or more), ``hex`` (32 or more digits); ``known`` adds formats of well-known
issuers. A candidate's value is hashed; over all documents each hash is
counted by distinct repositories (``repo_col``) and distinct owners
(``owner_col``), and both come back with every span. A value is a widely copied
example if ``copied_owners`` owners or more have it, or if several owners have
it in ``copied_repos`` repositories or more; the rest look live, a value that
one owner repeats in any number of repositories among them.

Positions are code points, ends exclusive. Defined results: a null text is
empty; a null owner or repository counts as none; equal rows are scanned each;
an empty table gives no rows; other columns are left out by the scan, whatever
their names, and kept as they are by the redaction; texts of any length are
scanned whole, a span costs one walk through its text. Values that a third of
the documents share are summed per task before they are shuffled; spans are
judged once per distinct text, and go back to its copies under ``SALTS`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.scratch import Scratch

#: Fixed patterns: kind, pattern, group of the value, least length of the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KNOWN = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
KINDS = (("assign", ASSIGN, 1, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32), ("known", KNOWN, 0, 1))
BASE = 3
COPIED_OWNERS, COPIED_REPOS = 5, 100
SALTS = 8
SPAN = "array<struct<start:int,ord:int,kind:string,end:int,value_start:int,hash:string>>"
JUDGED = "array<struct<start:int,ord:int,kind:string,end:int,value_start:int,hash:string,repos:bigint,owners:bigint,live:boolean>>"


def _spans(text: Column, order: int) -> Column:
    """Spans of one kind. The pieces between the matches give their places."""
    kind, pattern, group, least = KINDS[order]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), (end - F.length(part["value"])).alias("value_start"), F.sha2(part["value"], 256).alias("hash"))
        kept = F.when(F.length(part["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), kept.alias("out"))

    # the piece after the last match has no hit: its length is null and it is left out
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(parts, start, lambda acc, part: F.when(part["hit"].isNull(), acc).otherwise(step(acc, part)), lambda acc: acc["out"])


def secret_spans(text: Column) -> Column:
    """All spans of a text, ordered by start, then kind as listed."""
    none = F.array().cast(SPAN)
    each = [F.when(text.rlike(pattern), _spans(text, i)).otherwise(none) for i, (_, pattern, _, _) in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def _salt(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col) + F.spark_partition_id(), F.lit(SALTS)).cast("int")


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def _found(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), secret_spans(text).alias("spans"), *_keys(text), _salt(id_col).alias("salt"), F.xxhash64(F.col(id_col), text).alias("own"))
    # texts without spans meet no key, and are spread by row
    return rows.withColumn("k1", F.when(F.size("spans") > 0, F.col("k1")).otherwise(F.col("own"))).drop("own")


def value_owners(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """(hash, repos, owners, live): distinct repositories and owners of each value, and the verdict."""
    each = found.select("owner", "repo", F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash"))
    counts = each.groupBy("hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))
    copied = (F.col("owners") >= copied_owners) | ((F.col("owners") > 1) & (F.col("repos") >= copied_repos))
    return counts.withColumn("live", ~copied)


def judged_texts(found: DataFrame, copied_owners: int, copied_repos: int) -> DataFrame:
    """(k1, k2, spans) of each distinct text with candidates: its spans with repos, owners and live."""
    texts = found.where(F.size("spans") > 0).groupBy("k1", "k2").agg(F.any_value("spans").alias("spans"))
    each = texts.select("k1", "k2", F.explode("spans").alias("s")).withColumn("hash", F.col("s.hash"))
    joined = each.join(value_owners(found, copied_owners, copied_repos), "hash")
    span = F.struct(*(F.col(f"s.{c}").alias(c) for c in ("start", "ord", "kind", "end", "value_start", "hash")), "repos", "owners", "live")
    return joined.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _salted(texts: DataFrame) -> DataFrame:
    return texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS
) -> DataFrame:
    """Per document: (doc_id, spans, n_live, n_copied); each span has start,
    end, kind, value_start, hash, repos, owners and live. Spans of the added kind
    stay only where they look live; those of the base kinds always stay."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(_found(docs, id_col, text_col, owner_col, repo_col))
    judged = judged_texts(found, copied_owners, copied_repos).withColumnRenamed("spans", "judged")
    rows = found.select("doc_id", "k1", "k2", "salt").join(_salted(judged), ["k1", "k2", "salt"], "left")
    kept = F.filter(F.coalesce("judged", F.array().cast(JUDGED)), lambda s: (s["ord"] < BASE) | s["live"])
    return (
        rows.select("doc_id", kept.alias("spans"))
        .withColumn("n_live", F.size(F.filter("spans", lambda s: s["live"])).cast("long"))
        .withColumn("n_copied", F.size("spans").cast("long") - F.col("n_live"))
    )


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``scan_secrets``; ``ownership`` has
    each span's repositories and owners, in the order of ``spans``."""
    joined = lambda spans, *parts: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *(s[p].cast("string") for p in parts))), ",")
    place = ("kind", "start", "end")
    count = lambda i: F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["ord"] < BASE), *place), 256).alias("base_sha256"), joined(F.col("spans"), *place).alias("spans"),
        joined(F.col("spans"), "repos", "owners").alias("ownership"), "n_live", "n_copied",
    )


def redact_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "[SECRET]", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """The documents with every live-looking value replaced by ``mark``; all
    rows and columns stay, and texts without such values are untouched."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    candidate = text.rlike("|".join(f"(?:{pattern})" for _, pattern, _, _ in KINDS))
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(_found(docs.where(candidate), id_col, text_col, owner_col, repo_col).where(F.size("spans") > 0))
    live = judged_texts(found, copied_owners, copied_repos).select("k1", "k2", F.filter("spans", lambda s: s["live"]).alias("live")).where(F.size("live") > 0)
    live = _salted(scratch.only(live)).select(*(F.col(c).alias(f"{c}_") for c in ("k1", "k2", "salt", "live")))

    def step(acc: Column, span: Column) -> Column:
        before = F.concat(acc["out"], F.substring(text, acc["at"] + 1, span["value_start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(span["value_start"] >= acc["at"], before).otherwise(acc["out"]).alias("out"))

    by_place = F.array_sort(F.transform("live_", lambda s: F.struct(s["value_start"], s["end"])))
    clean = F.aggregate(by_place, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    # only texts with a candidate are shuffled; the others stay where they are
    keyed = docs.where(candidate).withColumns({"row_k1_": F.xxhash64(text), "row_k2_": F.hash(text), "row_salt_": _salt(id_col)})
    joined = keyed.join(live, (F.col("row_k1_") == F.col("k1_")) & (F.col("row_k2_") == F.col("k2_")) & (F.col("row_salt_") == F.col("salt_")), "left")
    changed = joined.select(*[(F.when(F.col("live_").isNotNull(), clean).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c)) for c in docs.columns])
    return docs.where(~candidate).unionByName(changed)
