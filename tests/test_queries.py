"""Every query against its SQL on the smallest tables, and laws of the operators."""

import datetime
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import atoms, audit, entities, glossary, glue, turns
from lodestrata.plans.queries import ORACLE, QUERIES
from lodestrata.streaming import runlog

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in names) for r in df.collect()], key=repr)
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert got == sorted([tuple(norm(r[columns.index(c)]) for c in names) for r in result.fetchall()], key=repr)


def test_hints_are_idempotent(spark):
    df = spark.createDataFrame([("甲；乙；⚠ 丙；丁；戊",), ("",), (None,)], "h string").withColumn("once", T.merge_hints(F.col("h"), F.col("h")))
    assert df.where(T.merge_hints(F.col("once"), F.col("once")) != F.col("once")).count() == 0
    assert entities.joined_hints(["甲；乙", "⚠ 丙；甲；丁；戊"]) == "甲；乙；丁；⚠ 丙；" + T.CUT_MARK


def test_turn_cuts_keep_off_questions():
    at = [(1, False), (21, False), (41, False), (61, False), (81, False)]
    assert turns._turn_cuts(at, 100, 2) == [40]
    asked = [(1, False), (21, True), (41, False), (61, False), (81, False)]
    assert turns._turn_cuts(asked, 100, 2) == [20]
    every = [(s, True) for s, _ in at]
    assert turns._turn_cuts(every, 100, 2) == [40]
    assert turns._turn_cuts(at, 100, 5) == [20, 40, 60, 80]


def test_chunks_cover_every_line_once(spark):
    df = spark.range(1, 60).select(F.col("id").alias("n"), F.explode(F.array(*map(F.lit, range(1, 8)))).alias("k"))
    rows = df.select("n", "k", turns.even_chunks(F.col("n"), F.col("k").cast("long")).alias("c")).collect()
    for r in rows:
        assert [x for c in r.c for x in range(c.start_line, c.end_line + 1)] == list(range(1, r.n + 1))
        assert [c.is_last for c in r.c] == [False] * (len(r.c) - 1) + [True]


def test_rendered_glossary_is_stable(spark):
    rows = [("t", "term", 0, "a*b", ["x / y"], "n", False, "unknown", ""), ("t", "person", 0, "王", [], "", True, "verified", "2024-01")]
    schema = "key string, kind string, ord long, canonical string, variants array<string>, hint string, cross_file boolean, confidence string, confidence_date string"
    once = glossary.render(spark.createDataFrame(rows, schema), "key")
    twice = glossary.render(glossary.parse(once, "key"), "key")
    assert once.first().text == twice.first().text


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ("三千五百万元", ["3500|万"]), ("1.2亿元", ["1.2|亿"]), ("30到40家", ["30-40|家"]), ("30-40家", ["30-40|家"]), ("一下、第一、万一", []), ("", []), (None, []),
        ("一共十六个部门", ["16|"]), ("二〇一九年成立", ["2019|年"]), ("2019 年", ["2019|年"]), ("营收八千万", ["8000|万"]), ("8000 万", ["8000|万"]), ("两亿的盘子", ["2|亿"]), ("毛利率百分之三十", ["30|%"]), ("30%", ["30|%"]),
        ("一百二十多人", ["120|"]), ("二十四小时", ["24|小时"]), ("大概六七十亿", ["60-70|亿"]), ("三四十个点", ["30-40|个点"]), ("大概30到40个点", ["30-40|个点"]), ("30-40 个点", ["30-40|个点"]),
        ("干了两三年", []), ("招三五个人", []), ("去过一两次", []), ("砍掉七八家", []), ("就我们两个人", []), ("他做事一五一十很实在", []), ("五花八门的产品", []), ("沈其安 00:12", []), ("时间是 08:00:15 开始", []), ("回款一直下不来", []), ("这是第三点", []),
        ("那也就是 2 个亿", ["2|亿"]), ("约 2 亿元", ["2|亿"]), ("大概 1.5 个亿", ["1.5|亿"]), ("两个亿", ["2|亿"]), ("3 个千万", ["3|千万"]), ("过了 3 个月", ["3|个月"]), ("干了三个月才做完，投了三个亿", ["3|个月", "3|亿"]), ("讲 5 个方面", ["5|"]),
        ("以后千万不要这样", []), ("千万别忘了", []), ("花了一千万不到", ["1000|万"]), ("身价千万不止", ["1000|万"]),
    ],
)
def test_number_atoms(text, keys):
    assert [a["key"] for a in atoms.extract(text)] == keys


def test_run_log_stream_equals_table(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, d, h), "t", "e", 10, 1, 5, 60_000, "fail" if h == 3 else "ok") for d in (1, 2) for h in (1, 3)]
    runs = spark.createDataFrame(rows, runlog.SCHEMA)
    runlog.append(runs, str(tmp_path / "log"))
    stream = runlog.daily(runlog.stream(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("runs_by_day").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted(map(tuple, spark.table("runs_by_day").collect())) == sorted(map(tuple, runlog.daily(runs).collect()))


def test_polarity_and_hedges(spark):
    assert [atoms.extract(t)[0]["polarity"] for t in ("毛利率不到百分之三十", "去年亏损两亿", "增长超过五倍", "营收八千万")] == ["不到", "亏损", "超过", ""]
    df = spark.createDataFrame([("我觉得可能明年会好，据说也许能起来，估计不小",), ("明年一定会盈利，收入翻倍",)], "t string")
    assert [r.n for r in df.select(audit.hedges(F.col("t")).alias("n")).collect()] == [5, 0]


def test_run_guards():
    assert glue.scope_error(["scout", "refine", "logic"], 2) is None
    assert glue.scope_error(["logic"], 1) == "needs refine: logic"
    assert glue.scope_error(["scout"], 0) == "no files"
    assert glue.scope_error(["x"], 1) == "unknown: x"
    assert [glue.chunk_size(v) for v in ("2000", "1999", "-5", "a", "")] == [2000, None, None, None, None]


def test_artifacts_are_written_by_run(spark, tmp_path):
    from lodestrata.operators import report

    path = f"file://{tmp_path}/artifacts"
    rows = lambda run, text: spark.createDataFrame([(run, "review", "a", text), (run, "manifest", "b", "{}")], "run long, kind string, name string, text string")
    for df in (rows(1, "old"), rows(2, "two"), rows(1, "new")):
        report.write_artifacts(df, path)
    got = {(r.run, r.kind): r.text for r in spark.read.parquet(path).collect()}
    assert got == {(1, "review"): "new", (1, "manifest"): "{}", (2, "review"): "two", (2, "manifest"): "{}"}


def test_deliverable_names_and_doubtful_spellings(spark):
    df = spark.createDataFrame([("a 访谈总结",), ("b/c",)], "s string")
    assert [r[0] for r in df.select(T.deliverable_name(F.col("s"), " 访谈总结")).collect()] == ["a 访谈总结", "b c 访谈总结"]
    df = spark.createDataFrame([("疑似误写",), ("K - Frame",), ("plain",)], "s string")
    assert [r[0] for r in df.select(T.phonetically_suspect(F.col("s"))).collect()] == [True, True, False]


def test_entities_grow_batch_by_batch(spark, tmp_path):
    from lodestrata.streaming import cumulative

    schema = "topic string, kind string, ord long, canonical string, variants array<string>, hint string, category string"
    batches = [[("t", "person", 0, "王明", ["王总"], "旧", "")], [("t", "person", 0, "王明（董事长）", ["小明"], "新", "x"), ("t", "person", 1, "李华", [], "", "")], [("t", "person", 0, "小明", ["明明"], "", "")]]
    state, source = f"file://{tmp_path}/state", f"{tmp_path}/source"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        cumulative.start(spark.readStream.schema(schema).parquet(source), state, f"{tmp_path}/checkpoint").awaitTermination(120)
        assert cumulative.versions(spark, state) == list(range(i + 1))
    got = {r.canonical: r.variants for r in cumulative.latest(spark, state).collect()}
    assert got == {"王明": ["王总", "王明（董事长）", "小明", "明明"], "李华": []}
    cumulative.merged_into(state)(spark.createDataFrame(batches[2], schema), 2)  # a batch that runs again
    assert {r.canonical: r.variants for r in cumulative.latest(spark, state).collect()} == got


def test_findings_of_a_pair_stay_in_its_row(spark):
    """Pairs without an id, or of one id, keep findings of their own."""
    rows = [(None, "甲乙丙丁", "甲乙丙丁就就好好好"), (1, "甲乙丙丁", "甲乙丙丁"), (1, "甲乙丙丁戊己", "甲")]
    got = audit.pair_audit(spark.createDataFrame(rows, "id long, source string, refined string"), "id").collect()
    assert sorted((r.status, tuple(r.failed), r.n_findings) for r in got) == [("fail", ("compression",), 1), ("fail", ("confirmation_repeat", "stutter"), 2), ("ok", (), 0)]


def test_what_a_rule_needs_stands_in_all_that_meets_it(spark):
    import random

    r = random.Random(7)
    bits = ["对对对", "是是是", "嗯", "呃", "啊", "好好好", "就", "我", "可", "2024年", "，", "。", "；", "吧", "呢", "嘛", "这个", "那个", "就是说", "然后呢", "的话", "对吧", "（略", "）", "[略]", "[omitted]", "<!-- gap", "甲", '"', "「", "\n", "`", "a", " "]
    texts = [("".join(r.choice(bits) for _ in range(r.randrange(1, 9))),) for _ in range(3000)]
    t = F.col("t")
    rules = {name: pattern for name, pattern, _ in audit.CLEAN_RULES} | {"model_marker": audit.MODEL_MARKS, "empty_words": audit.EMPTY_WORDS, "quote_style": '[一-龥]"|"[一-龥]|[「」『』]'}
    differs = [F.count_if(audit.counted(t, name, pattern) != F.regexp_count(t, F.lit(pattern))).alias(name) for name, pattern in rules.items()]
    met = [F.count_if(F.regexp_count(t, F.lit(pattern)) > 0).alias(name) for name, pattern in rules.items()]
    texts = spark.createDataFrame(texts, "t string")
    assert set(texts.agg(*differs).first()) == {0} and min(texts.agg(*met).first().asDict()[n] for n in audit.NEEDED) > 0
