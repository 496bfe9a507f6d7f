"""Near names, quotes, numerals and committed batches against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import atoms, audit, likeness, numerals, turns
from lodestrata.streaming import ledger


def edits(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_near_names_equal_brute_force(spark, most):
    r = random.Random(most)
    word = lambda: "".join(r.choice("ab王") for _ in range(r.randrange(0, 6)))
    left, right = ([(r.choice([1, None]), r.choice([word(), word(), None])) for _ in range(60)] for _ in "lr")
    df = lambda rows: spark.createDataFrame(rows, "k long, name string").withColumn("rest_", F.lit("clash"))
    got = [tuple(x) for x in likeness.near_names(df(left), df(right), ["k"], most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, a, b, edits(a, b)) for k, a in left for j, b in right if k == j and a is not None and b is not None and a != b and edits(a, b) <= most}


def test_quotes_equal_a_scan(spark):
    r = random.Random(4)
    sources = [(i, "".join(r.choice("abc \n") for _ in range(r.choice([0, 5, 80, 300])))) for i in range(8)] + [(9, None)]
    quotes = [(n, i, (t or "")[a : a + 20] + r.choice(["", "x", "ab"]) + (t or "")[b : b + 12]) for n, (i, t) in enumerate(sources * 3) for a, b in [(r.randrange(0, 60), r.randrange(0, 60))]]
    got = {x.quote_id: (x.n_grams, x.found, x.longest) for x in likeness.quote_support(spark.createDataFrame(quotes, "quote_id long, k long, quote string"), spark.createDataFrame(sources, "k long, text string"), "k", 4).collect()}
    bare = lambda t: "".join((t or "").split())
    want, texts = {}, dict(sources)
    for n, i, q in quotes:
        q, t = bare(q), bare(texts[i])
        runs = [q[j : j + 4] for j in range(len(q) - 3)]
        if runs:
            stretch = max((b - a for a in range(len(q)) for b in range(a + 4, len(q) + 1) if q[a:b] in t), default=0)
            want[n] = (len(runs), sum(g in t for g in runs), stretch)
    assert got == want


def test_numerals_round_trip_and_read(spark):
    r = random.Random(6)
    numbers = [0, 1, 10, 11, 20, 100, 101, 110, 1001, 10_000, 10_001, 100_010, 20_010_000, 10**8, 10**8 + 1, 10**11 + 10, 10**12 - 1] + [r.randrange(10 ** r.randrange(1, 13)) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    back = df.select("n", numerals.spelled(F.col("n")).alias("t")).withColumn("v", numerals.numeral_value(F.col("t")).cast("long"))
    assert back.where("not (v <=> n)").count() == 0
    said = {"三千五百万": 35_000_000, "二零二三": 2023, "十五": 15, "两百零三": 203, "一亿三千万": 130_000_000, "〇": 0, "": None, "三x": None, None: None, "万": 10_000}
    got = {x.t: x.v for x in spark.createDataFrame([(k,) for k in said], "t string").select("t", numerals.numeral_value(F.col("t")).cast("long").alias("v")).collect()}
    assert got == said
    assert spark.createDataFrame([(-1,), (10**12,), (None,)], "n long").where(numerals.spelled(F.col("n")).isNotNull()).count() == 0


def test_idioms_inside_numerals_are_none():
    assert [a["key"] for a in atoms.extract("二万一千元，万一不行，一些一下")] == ["21000|元"]


def test_amounts_stay_when_written_out(spark):
    rows = [("亏损二十万元", "亏损200000元"), ("亏损200000元", "亏损20万"), ("亏损1.1万元", "盈利11000元"), ("亏损二十万元", "亏损20元"), ("来了二十万人", "来了200000元"), ("亏损二十万元", "没有数"), ("亏损三元", "没有数"), ("亏损三元", "亏损3元")]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "id long, turn_no long, source string, refined string")
    assert {(r.turn_no, r.dropped, r.polarity_lost) for r in atoms.drift(df, "id").collect()} == {(2, 0, 1), (3, 1, 0), (4, 1, 0), (5, 1, 0), (6, 1, 0)}


def test_places_map_to_lines(spark):
    text = "甲a乙\n<!-- 丙\n丁 -->\n戊己\n\n庚" + "\n辛" * 3000
    rows = spark.createDataFrame([(1, text), (2, None), (3, "abc")], "id long, text string")
    runs = audit.line_runs(rows, "id", "text")
    flat = audit.line_map(rows, "id", "text").where("id = 1").first()
    places = spark.range(len(flat.norm)).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("place"))
    got = [x.line_no for x in turns.inside(places, "place", runs, "first", "last", ["id"]).orderBy("place").collect()]
    assert got == flat.line_of
    assert {x.id for x in runs.select("id").distinct().collect()} == {1}


def test_batches_are_committed_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.entries(spark, path) is None and ledger.committed(spark, path) == []
    rows = spark.range(10)
    for number, part in ((0, rows.where("id < 4")), (1, rows.where("id >= 4")), (1, rows.where("id >= 4"))):
        ledger.commit(part, number, path)
    rows.write.parquet(f"{path}/batch=7")  # ended before its entry
    assert ledger.committed(spark, path) == [0, 1]
    assert sorted(x.id for x in ledger.entries(spark, path).collect()) == [*range(10)]


def test_ageing_runs_again_and_forgets_old_versions(spark, tmp_path):
    path, step = str(tmp_path / "aged"), None
    step = ledger.ageing_into(path, ["k"])
    state = {}
    r = random.Random(2)
    for number in range(6):
        names = [(r.choice("ab"), r.randrange(12)) for _ in range(6)]
        batch = spark.createDataFrame(names, "k string, name long")
        for _ in range(2 if number == 3 else 1):
            step(batch, number)
        for n in set(names):
            state.setdefault(n, number)
        for key in {k for k, _ in state}:
            for old in sorted((v, n) for (k, n), v in state.items() if k == key)[:2]:
                state[key, old[1]] = number
        assert {(x.k, x.name): x.verified for x in ledger.latest(spark, path).collect()} == state
    assert ledger.committed(spark, path) == [4, 5]


def test_forms_of_names_are_never_sent_to_all(spark, tmp_path):
    spark.createDataFrame([(1, f"Customer#{i:09d}") for i in range(50)], "k long, name string").write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    plan = likeness.near_names(names, names, ["k"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_forms_of_names_are_never_rows(spark):
    names = spark.createDataFrame([(1, f"Customer#{i:09d}") for i in range(1000)], "k long, name string")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    near = likeness.near_names(names, names, ["k"], 2)
    assert near.count() == sum(edits(f"{a:03d}", f"{b:03d}") <= 2 for a in range(1000) for b in range(1000)) - 1000
    assert written() - before < 500_000  # 650 forms a name are 650,000 rows


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_blocks_of_names_equal_brute_force(most):
    r = random.Random(most)
    word = lambda n: "".join(r.choice("ab\0𠀀") for _ in range(n))
    for a in range(6):
        for b in range(max(0, a - most), a + most + 1):
            left, right = (sorted({word(n) for _ in range(30)}) for n in (a, b))
            same = likeness.np.array([right.index(x) if x in right else -(10**9) for x in left])
            spelled = likeness._spelled(left, a), likeness._spelled(right, b)
            want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x != y and edits(x, y) <= most}
            codes = likeness._met(*spelled, same, most, 10**6)
            assert [(c // len(right), c % len(right)) for c in codes.tolist()] == sorted(want)
            if len(want) > 3:
                assert likeness._met(*spelled, same, most, 3) is None
            for limit in (3, 10**6):
                near = [(i, j) for x, y in likeness._near(*spelled, same, most, limit) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                assert len(near) == len(set(near)) and set(near) >= want


def test_names_split_where_they_are_near_to_too_many(monkeypatch):
    monkeypatch.setattr(likeness, "comb", lambda n, k: 0)  # never compared one by one
    left, right = ([f"{i:03d}" for i in range(n)] for n in (70, 90))
    near = [(i, j) for x, y in likeness._near(likeness._spelled(left, 3), likeness._spelled(right, 3), likeness.np.arange(70), 1, 200) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(near) == len(set(near)) < 70 * 90
    assert set(near) >= {(i, j) for i in range(70) for j in range(90) if i != j and edits(left[i], right[j]) <= 1}


def test_names_meet_across_blocks_and_kinds_of_keys(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("ab王") for _ in range(r.randrange(0, 5)))
    left, right = ([(r.choice([2**60 + 1, None]), r.choice("xy"), word()) for _ in range(120)] for _ in "lr")
    df = lambda rows: spark.createDataFrame(rows, "k long, l string, name string")
    got = [tuple(x) for x in likeness.near_names(df(left), df(right), ["k", "l"], 2, chars=40, limit=50).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, l, a, b, edits(a, b)) for k, l, a in left for m, n, b in right if (k, l) == (m, n) and a != b and edits(a, b) <= 2}  # noqa: E741


def test_only_grams_that_are_asked_for_leave_a_source(spark):
    quotes = spark.createDataFrame([(1, 1, "𠀀bcdef𠀀"), (2, 1, "nowhere")], "quote_id long, k long, quote string")
    sources = spark.createDataFrame([(1, "x𠀀bc def𠀀" * 3), (1, "𠀀bcdef")], "k long, text string")
    out = likeness.quote_support(quotes, sources, "k")
    assert sorted(map(tuple, out.collect())) == [(1, 2, 2, 7), (2, 2, 0, 0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "LeftSemi" not in plan


def test_texts_are_only_asked_for_shingles_of_their_quotes(spark):
    from lodestrata.operators import anchors

    r = random.Random(8)
    han = lambda n: "".join(chr(0x4E00 + r.randrange(40)) for _ in range(n))
    sources = [(i, han(30 if i % 2 else 400) + " x，y") for i in range(12)] + [(12, None)]
    refined = [(i, "".join(f"“{(t or '')[5:12]}{han(8)}”" for _ in range(1 if i % 3 else 9))) for i, t in sources]
    df = lambda rows: spark.createDataFrame(rows, "id long, text string")
    out = anchors.fabricated_quotes(df(sources), df(refined), "id")
    bare = lambda t: "".join(c for c in t or "" if "一" <= c <= "龥" or c.isascii() and c.isalnum())
    want = {}
    for (i, t), (_, said) in zip(sources, refined, strict=True):
        for q in {q.strip("“") for q in said.split("”") if q}:
            grams = {q[j : j + 3] for j in range(len(q) - 2)}
            share = sum(g in bare(t) for g in grams) / len(grams)
            if len(q) >= anchors.QUOTE_HAN and share < anchors.QUOTE_SUPPORT:
                want[i, q] = share
    assert want and {(x.id, x.quote): x.support for x in out.collect()} == want
    assert "contains(plain_" in out._jdf.queryExecution().analyzed().toString().replace("Contains", "contains") or "array_intersect" in out._jdf.queryExecution().analyzed().toString()
