"""Sinks and states that batches of the tables are committed to, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.operators import report
from lodestrata.plans.queries import query, read
from lodestrata.shared import shared_folder
from lodestrata.streaming import ledger

BATCHES = 4


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query(f"""SELECT event_id % {BATCHES} AS batch, event_type, count(*) n, sum("value") total FROM events GROUP BY 1, 2""")
def events_in_ledger(spark, d):
    """Events by batch; one batch runs twice, and one ends before its entry."""
    path, rows = _folder(spark), read(spark, d, "events").withColumn("b", F.col("event_id") % BATCHES)
    for number in [*range(BATCHES), 1]:
        ledger.commit(rows.where(F.col("b") == number).drop("b"), number, path)
    rows.where("b = 2").drop("b").write.parquet(f"{path}/batch={BATCHES}")
    return ledger.entries(spark, path).groupBy(F.col("batch").cast("long").alias("batch"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("""SELECT o_orderstatus run, lower(o_orderpriority) kind, count(*) n, min(o_orderkey) first FROM orders GROUP BY 1, 2""")
def artifacts_of_orders(spark, d):
    """Artifacts of runs; a run that is written again replaces its own."""
    path = _folder(spark)
    made = read(spark, d, "orders").select(F.col("o_orderstatus").alias("run"), F.lower("o_orderpriority").alias("kind"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").cast("string").alias("text"))
    report.write_artifacts(made, path)
    report.write_artifacts(made.where("run = 'F'"), path)
    return spark.read.parquet(path).groupBy("run", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("name").cast("long")).alias("first"))


def _steps() -> str:
    """SQL: states of each kind of event, batch after batch."""
    seen = "list_transform(list_filter(b.names, lambda x: NOT list_contains(list_transform(s.state, lambda e: e.u), x)), lambda x: {'v': b.b, 'u': x})"
    return f"""b AS (SELECT event_type k, user_id % {BATCHES} b, list(DISTINCT user_id) names FROM events GROUP BY 1, 2),
s AS (SELECT DISTINCT event_type k, -1::BIGINT b, []::STRUCT(v BIGINT, u BIGINT)[] state FROM events UNION ALL SELECT k, b, list_transform(range(1, len(state) + 1), lambda i: CASE WHEN i <= {ledger.OLDEST} THEN {{'v': b, 'u': state[i].u}} ELSE state[i] END) FROM (SELECT b.k, b.b, list_sort(s.state || {seen}) state FROM s JOIN b ON b.k = s.k AND b.b = s.b + 1))"""


@query(f"""WITH RECURSIVE {_steps()}, l AS (SELECT k, unnest(state) e FROM s WHERE b = {BATCHES - 1}) SELECT k event_type, e.u "name", e.v verified FROM l""")
def aged_users(spark, d):
    """Users of each kind of event, batch by batch as a stream: new ones are
    verified when they come, and the two oldest again with every batch."""
    path = _folder(spark)
    rows = read(spark, d, "events").select("event_type", F.col("user_id").alias("name"))
    for number in range(BATCHES):
        rows.where(F.col("name") % BATCHES == number).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in").writeStream.foreachBatch(ledger.ageing_into(f"{path}/state", ["event_type"])).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    return ledger.latest(spark, f"{path}/state")
