"""Jobs as a stream, and the table of facts."""

from __future__ import annotations

import os
import tempfile
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from casewright.operators.fact_table import FactTable
from casewright.streaming import stateful

START = datetime(2024, 3, 1, 12)
SCHEMA = "document bigint, event bigint, kind string, at timestamp"


def rows(spark, folder: str, name: int, events: list[tuple[int, int, str, float]]) -> None:
    """A file of events (document, event, kind, hours after START)."""
    table = [(d, e, k, START + timedelta(hours=h)) for d, e, k, h in events]
    spark.createDataFrame(table, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    newest = sorted(Path(folder).glob("*.parquet"), key=lambda p: p.stat().st_mtime)[-1]
    os.utime(newest, (1_700_000_000 + name, 1_700_000_000 + name))


def run(spark, source: str, folder: str) -> list[tuple]:
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = stateful.drained(stateful.transitions(stream, delay="2 hours", lease_minutes=60), folder)
    return sorted((r.document, round((r.at - START).total_seconds() / 3600, 3), r.step, r.status, r.attempt, r.cause) for r in out.collect())


def test_leases_late_rows_repeats_and_a_restart(spark):
    source, folder = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    rows(spark, source, 1, [(1, 1, "submit", 0), (1, 2, "claim", 0.1), (2, 3, "submit", 0), (2, 4, "claim", 0.2), (2, 5, "done", 0.5), (2, 5, "done", 0.5)])
    first = [(1, 0.0, "VALIDATE", "PENDING", 0, "submit"), (1, 0.1, "VALIDATE", "PROCESSING", 0, "claim"), (2, 0.0, "VALIDATE", "PENDING", 0, "submit"), (2, 0.2, "VALIDATE", "PROCESSING", 0, "claim"), (2, 0.5, "SPLIT", "PENDING", 0, "done")]
    assert run(spark, source, folder) == first
    # a repeat from the earlier run, and time that ends the lease of document 1
    rows(spark, source, 2, [(2, 5, "done", 0.5), (2, 6, "claim", 1.0), (3, 7, "submit", 9)])
    second = sorted([*first, (1, 1.1, "VALIDATE", "RETRYING", 1, "expired"), (2, 1.0, "SPLIT", "PROCESSING", 0, "claim"), (2, 2.0, "SPLIT", "RETRYING", 1, "expired"), (3, 9.0, "VALIDATE", "PENDING", 0, "submit")])
    assert run(spark, source, folder) == second
    # older than the watermark: dropped; claims that run out three times end in DEAD_LETTER
    rows(spark, source, 3, [(1, 8, "claim", 3.0), (1, 9, "claim", 9.0), (1, 10, "claim", 10.5), (1, 11, "claim", 12.0), (1, 12, "submit", 20.0)])
    third = sorted([*second, (1, 9.0, "VALIDATE", "PROCESSING", 1, "claim"), (1, 10.0, "VALIDATE", "RETRYING", 2, "expired"), (1, 10.5, "VALIDATE", "PROCESSING", 2, "claim"), (1, 11.5, "VALIDATE", "DEAD_LETTER", 3, "expired"), (1, 20.0, "VALIDATE", "PENDING", 0, "submit")])
    assert run(spark, source, folder) == third
    assert run(spark, source, folder) == third


def files(folder: str) -> set[str]:
    return {str(p) for p in Path(folder).rglob("*.parquet") if "/facts/" in str(p)}


def test_facts_of_other_workspaces_stay(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    f = spark.createDataFrame([("a", k, "x", k) for k in range(6)] + [("b", k, "y", 1) for k in range(4)], "workspace_id string, fact_date int, note string, metadata_cases bigint")
    t = FactTable(spark, folder, f.schema)
    assert t.read().count() == 0 and t.current().count() == 0
    log = {r.workspace_id: (r.fact_rows, r.cases) for r in t.refresh(f, ["a", "b", "c"]).collect()}
    assert log == {"a": (6, 15), "b": (4, 4), "c": (0, 0)}
    before = files(folder)
    t.refresh(f.where("fact_date = 1").withColumn("note", F.lit("new")), ["a"])
    assert before < files(folder)
    got = sorted(map(tuple, t.read().select("workspace_id", "fact_date", "note", "metadata_cases").collect()))
    assert got == [("a", 1, "new", 1)] + [("b", k, "y", 1) for k in range(4)]
    t.refresh(f.limit(0), ["b"])
    assert {r.workspace_id for r in t.read().collect()} == {"a"}
    assert t.log().count() == 5 and {r.workspace_id: r.fact_rows for r in t.current().collect()} == {"a": 1, "b": 0, "c": 0}


def test_a_refresh_without_its_log_is_not_seen(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    f = spark.createDataFrame([("a", 1, 2)], "workspace_id string, fact_date int, metadata_cases bigint")
    t = FactTable(spark, folder, f.schema)
    t.refresh(f, ["a"])
    f.withColumn("metadata_cases", F.lit(99).cast("bigint")).write.partitionBy("workspace_id").parquet(f"{folder}/facts/broken")
    assert [r.metadata_cases for r in t.read().collect()] == [2]


def test_first_rows_beyond_what_one_task_may_hold(spark, monkeypatch):
    from casewright.streaming import lifecycle

    monkeypatch.setattr(lifecycle, "HELD", 10)
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("priority"))
    order = [F.desc("priority"), F.col("id")]
    want = sorted(((r, r % 7) for r in range(1000)), key=lambda r: (-r[1], r[0]))
    for n in (5, 10, 11, 345, 999, 1000, 5000):
        out = lifecycle.first_rows(rows, order, n)
        assert list(map(tuple, out.collect())) == want[:n]
        assert n <= 10 or "GlobalLimit" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_state_is_asked_once_a_document_and_batch():
    calls = []

    class Held:
        def __init__(self):
            self.value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        getValueState = staticmethod(lambda name, schema: Held())  # noqa: N815
        getMapState = None  # noqa: N815
        registerTimer = staticmethod(lambda at: calls.append("timer"))  # noqa: N815

    import pandas as pd

    jobs = stateful.Jobs(3_600_000, 24 * stateful.HOUR, 3, True)
    jobs.init(Handle())
    batch = pd.DataFrame({"event": [*range(500), 7], "kind": ["submit", "claim"] * 250 + ["claim"], "at_ms": [k * 60_000 for k in [*range(500), 7]]})
    rows = pd.concat(jobs.handleInputRows((1,), iter([batch]), None))
    assert rows["status"].tolist()[:3] == ["PENDING", "PROCESSING", "RETRYING"] and len(calls) < 10
    calls.clear()
    assert not len(pd.concat(jobs.handleInputRows((1,), iter([batch]), None))) and len(calls) < 10


def test_facts_hold_no_objects(spark, tmp_path):
    """the percentile of facts lies between two counted days, as Spark's does, and no aggregate of facts holds objects."""
    from datetime import datetime, timedelta

    from casewright.plans import cases

    day = datetime(1996, 1, 1)
    after = [0, 1, 1, 5, 9, 9, 40, None]  # days from an order to its first item; the last has none
    spark.createDataFrame([(0, "x", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(0, 0, "m")], "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(42 * k, 0, "F", 300000.0 * (k % 2), day - timedelta(days=n or 0), "1-URGENT") for k, n in enumerate(after)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(42 * k, "A", "F", 0.0, 0.0, 46.0, day) for k, n in enumerate(after) if n is not None]
    spark.createDataFrame(items, "l_orderkey bigint, l_returnflag string, l_linestatus string, l_discount double, l_tax double, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    f = cases.facts(spark, str(tmp_path))
    told = {r["offence"]: (r["metadata_cases"], r["targets"], r["with_text"], r["failed_fetches"], round(r["avg_days"], 9) if r["avg_days"] is not None else None, r["p95_days"]) for r in f.collect()}
    known = [n for n in after if n is not None]
    p95 = spark.createDataFrame([(n,) for n in known], "n int").selectExpr("percentile(n, 0.95)").first()[0]
    assert told == {"A": (7, 3, 7, 7, round(sum(known) / 7, 9), p95), None: (1, 1, 0, 0, None, None)}
    assert "ObjectHashAggregate" not in f._jdf.queryExecution().executedPlan().toString()


def test_edges_are_spread_by_their_number(spark, sf, monkeypatch):
    """the partitions in which edges are made and meet grow with the rows, beyond Spark's own number."""
    from casewright import shared
    from casewright.plans import graphs

    assert [shared.shares(spark, n) for n in (0, 1_000_000, 1_000_001)] == [4, 4, 5]
    monkeypatch.setattr(graphs, "shares", lambda spark, rows: shared.shares(spark, rows, most=500))
    out = graphs.dml_upsert_edge(spark, sf)
    assert out.rdd.getNumPartitions() == graphs.edges(spark, sf).rdd.getNumPartitions() == 12
