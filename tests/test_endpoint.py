import datetime as dt
from decimal import Decimal

import pytest

from voltide.plans import endpoint as e


@pytest.fixture()
def relations(spark):
    market = spark.createDataFrame([("task", f"asset-{i:02d}", Decimal(100), 0.03) for i in range(8)], "task_id string, underlying_id string, spot decimal(24,8), risk_free_rate double")
    quotes = spark.createDataFrame([(f"row_{i:06d}", f"asset-{i % 8:02d}", Decimal(1) + Decimal(i) / 100) for i in range(1, 161)], "row_id string, underlying_id string, bid decimal(24,8)")
    task = spark.createDataFrame([("task", dt.date(2026, 8, 14), Decimal("12.34"), 0.125, None)], "task_id string, valuation_date date, exact_value decimal(24,8), double_value double, nullable_value string")
    return {"solver_visible.market": market, "solver_visible.quotes": quotes, "metadata.public_task": task}


def make(spark, relations, **k):
    return e.Endpoint(spark, relations, **({"seconds": 60} | k))


def test_answers(spark, relations):
    q = make(spark, relations).query
    got = q("SELECT q.row_id, m.spot FROM solver_visible.quotes q JOIN solver_visible.market m USING (underlying_id) WHERE q.bid > 1.5 ORDER BY q.row_id LIMIT 2")
    assert got == {"columns": ["row_id", "spot"], "rows": [["row_000051", "100.00000000"], ["row_000052", "100.00000000"]], "row_count": 2, "truncated": False}
    assert q("SELECT (SELECT count(*) FROM solver_visible.market) a, (SELECT count(*) FROM solver_visible.quotes) b")["rows"] == [[8, 160]]
    assert q("SELECT * FROM metadata.public_task")["rows"] == [["task", "2026-08-14", "12.34000000", 0.125, None]]
    assert q("SHOW TABLES")["rows"] == [["metadata.public_task"], ["solver_visible.market"], ["solver_visible.quotes"]]
    assert q("DESCRIBE solver_visible.market")["row_count"] == 4
    assert q("WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM a) SELECT 'solver_visible.market' AS t, x FROM b")["rows"] == [["solver_visible.market", 1]]


BAD = [
    "DELETE FROM solver_visible.quotes", "CREATE TABLE x AS SELECT 1", "INSERT INTO solver_visible.quotes SELECT 1", "SET spark.x=1", "DROP VIEW v", "SHOW DATABASES",
    "SELECT * FROM other.table", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM range(5)", "SELECT * FROM spark_catalog.solver_visible.quotes", "SELECT rand()", "SELECT uuid()",
    "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT system.builtin.abs(1)", "SELECT current_user()", "SELECT * FROM (WITH a AS (SELECT 1) SELECT * FROM a) JOIN a",
    "SELECT 1 WHERE EXISTS (SELECT 1 FROM hidden)", "SELECT (SELECT max(x) FROM hidden)", "EXPLAIN SELECT 1", "CACHE TABLE q", "USE x",
]


@pytest.mark.parametrize("sql", BAD)
def test_refusals(spark, relations, sql):
    with pytest.raises(e.CapabilityError):
        make(spark, relations).query(sql)


def test_other_errors(spark, relations):
    end = make(spark, relations, calls=5)
    for sql, kind in (("SELEC 1 FROM (", e.SyntaxError_), ("SELECT nope FROM solver_visible.market", e.BindError), ("", e.InputError), ("SELECT 1; SELECT 2", e.SyntaxError_), ("SELECT TIMESTAMP'2020-01-01 00:00:00'", e.ValueError_)):
        with pytest.raises(kind):
            end.query(sql)
    with pytest.raises(e.BudgetError):
        end.query("SELECT 1")


def test_caps(spark, relations):
    sql = "SELECT row_id FROM solver_visible.quotes ORDER BY row_id"
    got = make(spark, relations, rows=10).query(sql)
    assert got["row_count"] == 10 and got["truncated"]
    assert make(spark, relations, size=200).query(sql)["truncated"]
    with pytest.raises(e.TimeoutError_):
        make(spark, relations, seconds=0.01).query("SELECT count(*) FROM solver_visible.quotes a, solver_visible.quotes b, solver_visible.quotes c, solver_visible.quotes d WHERE a.bid * b.bid * c.bid * d.bid > 3")


def test_submissions(spark):
    want = spark.createDataFrame([("r1", "0.10000000"), ("r2", None)], "row_id string, delta string")
    check = lambda rows, names="row_id string, delta string": e.check_submission(want, spark.createDataFrame(rows, names), ["delta"])
    assert check([("r2", None), ("r1", "0.10000000")]) == []
    assert check([("r2", None), ("r1", "0.10000001")]) == ["delta: 1 rows"]
    assert check([("r1", "0.1")]) == ["delta is not an eight-place decimal", "missing: 1 rows", "delta: 1 rows"]
    assert check([("r1", None), ("r1", None)]) == ["row_id repeats"]
    assert check([("r1", "a")], "row_id string, gamma string")[0].startswith("fields")
