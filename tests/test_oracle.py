"""Every query with SQL gives the rows that DuckDB gives; the others run and have rows."""

import glob
import os

import duckdb
import pytest

from siftline.plans import queries as plans


def rows(columns, values):
    def text(v):
        if v is None:
            return ""
        return str(bool(v)) if isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_as_duckdb(spark, duck, small, name):
    got = plans.QUERIES[name](spark, small)
    want = duck.execute(plans.ORACLE[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_stream_is_batch(spark, small):
    batch = plans.QUERIES["inventory_history"](spark, small)
    stream = plans.QUERIES["stream_upsert"](spark, small).select(*batch.columns)
    assert sorted(map(str, batch.collect())) == sorted(map(str, stream.collect()))


def test_exports_hold_no_secret(spark, small):
    for name in ("har_entries", "postman_items", "raw_http_text", "request_index"):
        text = "\n".join(str(r.asDict(True)) for r in plans.QUERIES[name](spark, small).collect())
        assert "Bearer b" not in text and "password=p" not in text and '"authToken":"s"' not in text, name


def test_compacted_state_is_the_same(spark, small, tmp_path):
    from siftline.operators import inventory
    from siftline.sources import bridge
    from siftline.streaming.upsert import InventoryState

    rows = bridge.history(spark, small).where("event_id < 150")
    state = InventoryState(spark, str(tmp_path))
    state.update(rows.where("save = 0"), 0)
    state.compact()
    state.update(rows.where("save = 2 AND event_id < 80"), 1)
    state.update(rows.where("save = 2 AND event_id >= 80"), 2)
    state.compact()
    state.update(rows.where("save = 1"), 3)
    want = inventory.inventory(inventory.latest(inventory.analyze(rows)))
    assert sorted(map(str, state.groups().select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["inventory", "rebuild_affected", "workflow_yield", "candidate_rows", "har_entries", "raw_http_text", "asset_union", "coverage_matrix"])
def test_requests_are_analysed_once(spark, small, name):
    """One scan of the requests, one flattening of bodies, and no Expand."""
    plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("json_leaves") <= 2 and plan.count("Expand") == 0, plan  # a node and its output
    assert plan.count("ArrowEvalPython [json_leaves") <= 1
    assert plan.count("events.parquet") <= 2


def test_exports_are_documents(spark, small, tmp_path):
    import json

    from siftline.operators import export

    rows = plans._curated(spark, small)
    candidates = export.query_candidates(plans.analyzed(spark, small), export.Gates())
    export.write_har(export.har(rows), str(tmp_path / "har"))
    export.write_postman(export.postman(rows), str(tmp_path / "postman"))
    export.write_index(export.index(rows), str(tmp_path / "index"))
    export.write_candidates(candidates, str(tmp_path / "candidates"))
    read = lambda name: json.loads("".join(p.read_text() for p in (tmp_path / name).glob("part-*")))
    n = rows.count()
    assert len(read("har")["log"]["entries"]) == len(read("postman")["item"]) == len(read("index")) == n > 0
    assert len(read("candidates/candidates.json")) == candidates.count()
    urls = [x for p in (tmp_path / "candidates/urls.txt").glob("part-*") for x in p.read_text().split()]
    assert len(urls) == len(set(urls)) > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.QUERIES) <= set(e.queries())
