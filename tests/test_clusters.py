"""Clusters, merging, decrees and components against plain Python, at odd rows and in one key."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import audit, clusters, turns
from lodestrata.operators.components import components, numbered
from lodestrata.shared import Steps


def greedy(rows):
    """The home of each (rid, names, joins), one after the other."""
    made, out = [], {}
    for rid, names, joins in rows:
        home = next((c for c in made if joins and c["names"] & set(names)), None)
        if home is None:
            home = {"rid": rid, "names": set()}
            made.append(home)
        home["names"] |= set(names)
        out[rid] = home["rid"]
    return out


@pytest.mark.parametrize("seed, vocab, joins", [(1, 30, True), (2, 60, True), (3, 40, False), (4, 300, False)])
def test_homes_equal_the_fold(spark, seed, vocab, joins):
    r = random.Random(seed)
    rows = [(k, rid, [f"n{r.randrange(vocab)}" for _ in range(r.choice([0, 1, 1, 2, 3]))], joins or r.random() < 0.6) for k in ("a", None, "b") for rid in r.sample(range(1000), 40)]
    rows = [(k, i, o, n, j) for i, (k, o, n, j) in enumerate(rows)]
    df = spark.createDataFrame([(k or "c", i, o, n, j) for k, i, o, n, j in rows], "topic string, rid long, ord long, strong array<string>, joins boolean")
    got = {x.rid: x.home for x in clusters.first_homes(df, ["topic"], ["ord"], Steps(spark)).collect()}
    want = {}
    for key in ("a", None, "b"):
        want |= greedy([(i, n, j) for k, i, o, n, j in sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1]))])
    assert got == want


MENTION = "topic string, kind string, ord long, file string, canonical string, variants array<string>, hint string, public_figure boolean, suspect boolean, category string"


def test_clusters_of_odd_rows(spark):
    rows = [("t", "person", 0, None, None, None, None, None, None, None), ("t", "person", 1, "f", " ", ["a"], None, True, None, None), ("t", "person", 1, "g", "a", ["b", "b", " a "], "x", None, None, ""), (None, "person", 1, "f", "a", [], "y", None, True, "c"), ("t", "person", 9, "f", "王总", None, "", False, False, "z"), ("t", "person", 10, "f", "王总", None, "", False, False, "z")]
    df = spark.createDataFrame(rows, MENTION).withColumns({"home": F.lit("clash"), "n": F.lit(1), "seq_": F.lit(2)})
    got = sorted((str(x.topic), x.ord, x.canonical, sorted(x.variants), x.hint, sorted(x.files), x.public_figure, x.suspect, x.category, x.cross_file) for x in clusters.cluster_entities(df).collect())
    assert [g for g in got if g[0] == "t"] == [("t", 0, "a", ["b"], "x", ["f", "g"], True, False, "", True), ("t", 1, "王总", [], "", ["f"], False, False, "z", False), ("t", 2, "王总", [], "", ["f"], False, False, "z", False)]
    assert clusters.cluster_entities(df.where("false")).count() == 0


def test_one_key_holds_all_rows(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("t").alias("topic"), F.lit("person").alias("kind"), F.col("id").alias("ord"), (F.col("id") % 3).cast("string").alias("file"), F.when(F.col("id") % 3 == 0, "common").otherwise(F.concat(F.lit("n"), (F.col("id") % 20_000).cast("string"))).alias("canonical"), F.array(F.concat(F.lit("v"), (F.col("id") % 40_000).cast("string"))).alias("variants"), F.lit("").alias("hint"), F.lit(False).alias("public_figure"), F.lit(False).alias("suspect"), F.lit("").alias("category"))
    got = clusters.cluster_entities(df)
    first = got.where("canonical = 'common'").first()
    assert first.ord == 0 and len(first.variants) > 10_000
    assert got.count() == got.agg(F.max("ord")).first()[0] + 1


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 300)] + [(500, i) for i in range(501, 600)] + [(7, 7), (8, None)] + [(r.randrange(700, 900), r.randrange(700, 900)) for _ in range(120)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Steps(spark)).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), Steps(spark)).count() == 0


def test_numbers_are_dense_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("k"), (F.col("id") * 7919 % 5000).alias("o"))
    got = numbered(df, ["k"], ["o"], "at", Steps(spark)).collect()
    for key in (True, False):
        assert [x.at for x in sorted((x for x in got if x.k == key), key=lambda x: x.o)] == [*range(sum(x.k == key for x in got))]


def test_orders_of_any_length():
    r = random.Random(5)

    def table(a, b):
        best = [0] * (len(b) + 1)
        for v in a:
            before = 0
            for j, u in enumerate(b):
                before, best[j + 1] = best[j + 1], before + 1 if v == u else max(best[j + 1], best[j])
        return best[-1]

    for _ in range(60):
        a, b = ([r.randrange(6) for _ in range(r.randrange(0, 30))] for _ in "ab")
        assert audit.common_order(a, b) == table(a, b)
    long = [*range(100_000)]
    mixed = long[50_000:] + long[:50_000]
    began = time.time()
    assert audit.common_order(long, mixed) == 50_000
    assert time.time() - began < 30


def test_points_meet_spans_over_bins(spark):
    r = random.Random(8)
    spans = [(k, i, a := r.randrange(-50, 400), a + r.choice([-1, 0, 3, 200])) for k in (1, 2, None) for i in range(30)]
    points = [(k, r.randrange(-60, 600)) for k in (1, 2, None) for _ in range(100)]
    s, p = spark.createDataFrame(spans, "k long, i long, a long, b long"), spark.createDataFrame(points, "k long, x long")
    got = sorted((x.k, x.x, x.i) for x in turns.inside(p, "x", s, "a", "b", ["k"], 16).collect())
    assert got == sorted((k, x, i) for k, x in points for j, i, a, b in spans if k is not None and k == j and a <= x <= b)


def test_rows_hit_one_decree_of_a_name(spark, monkeypatch):
    rows = spark.createDataFrame([("t", i, "a", ["b"], "") for i in range(50)], "topic string, ord long, canonical string, variants array<string>, hint string")
    orders = spark.createDataFrame([("t", i, f"c{i}", ["b"], "") for i in range(40)] + [("t", 40, "d", ["e"], ""), ("t", 41, "f", ["e"], "")], "topic string, ord long, canonical string, variants array<string>, note string")
    sizes, keep = [], clusters.Steps.keep
    monkeypatch.setattr(clusters.Steps, "keep", lambda self, df: [out := keep(self, df), sizes.append(out.count())][0])
    got = clusters.apply_decrees(rows, orders).orderBy("ord").collect()
    assert [(r.canonical, r.conflict, r.source_ord) for r in got] == [("c0", True, 0), ("d", False, -1), ("f", False, -1)]
    assert max(sizes) <= 50 + 42
