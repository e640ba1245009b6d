import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.functions.canonical import quantise
from voltide.operators import calendar, chain, dependence, integrity, paths, quotes, selection
from voltide.sources import snapshot, tables

SPEC = paths.MarketSpec(loadings={"A": (0.8,), "B": (0.5,)}, spots={"A": "100", "B": "50"})
DAYS = ["2026-01-02", "2026-01-05", "2026-01-06", "2026-01-07", "2026-01-08"]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()))


def test_calendar(spark):
    days = [r.date for r in calendar.business_days(spark, "2026-01-01", "2026-01-12").orderBy("date").collect()]
    assert days == [d for d in (dt.date(2026, 1, n) for n in range(1, 13)) if d.weekday() < 5]
    df = spark.createDataFrame([(dt.date(2026, 1, n),) for n in range(1, 13)], "d date")
    for r in df.select("d", calendar.following(F.col("d")).alias("f"), calendar.previous(F.col("d")).alias("p"), calendar.plus_business_days(F.col("d"), 7).alias("n")).collect():
        f = r.d
        while f.weekday() > 4:
            f += dt.timedelta(1)
        p = r.d - dt.timedelta(1)
        while p.weekday() > 4:
            p -= dt.timedelta(1)
        assert (r.f, r.p) == (f, p)
        if r.d.weekday() < 5:
            n = r.d
            for _ in range(7):
                n += dt.timedelta(1)
                while n.weekday() > 4:
                    n += dt.timedelta(1)
            assert r.n == n


def test_paths_continue_as_one(spark):
    whole = paths.make_paths(spark, SPEC, DAYS)
    head = paths.make_paths(spark, SPEC, DAYS[:3])
    tail = paths.make_paths(spark, SPEC, DAYS[3:], head)
    assert rows(head.unionByName(tail)) == rows(whole)
    for r in whole.collect():
        assert r.spot_low <= min(r.spot_open, r.spot_close) <= max(r.spot_open, r.spot_close) <= r.spot_high
        assert r.spot_close == r.spot_close.quantize(Decimal("0.01")) and r.volume > 0
    with pytest.raises(ValueError):
        paths.make_paths(spark, SPEC, DAYS[1:2], head)
    with pytest.raises(ValueError):
        paths.make_paths(spark, SPEC, DAYS[::-1])


def market(spark):
    daily = paths.make_paths(spark, SPEC, DAYS)
    listing = daily.where(F.col("date") == DAYS[0]).select("underlying_id", F.col("date").alias("listing_date"), F.col("spot_close").alias("spot"))
    contracts = chain.candidate_grid(listing, [3, 30], ["0.9", "1.0", "1.1"])
    return daily, contracts, quotes.make_quotes(daily, contracts, SPEC)


def test_chain_and_quotes_pass_the_gates(spark):
    daily, contracts, quoted = market(spark)
    assert contracts.count() == 2 * 2 * 3 * 2 and chain.collapsed_strikes(contracts).count() == 0
    assert chain.liquid(contracts, 10).count() == 2 * 1 * 3 * 2 - 0 * 4
    near = chain.liquid(contracts, 180, "0.95", "1.05")
    assert {r.moneyness for r in near.collect()} == {Decimal("1.0000")}
    found = {"daily": daily, "contracts": contracts, "quotes": quoted, "underlyings": daily.select("underlying_id").distinct(), "pricing": daily.select("date", "underlying_id")}
    assert set(integrity.market_gates(found).values()) == {0}
    broken = found | {"quotes": quoted.where("option_id not like '%C'"), "contracts": contracts}
    with pytest.raises(integrity.GateError) as e:
        integrity.market_gates(broken)
    assert list(e.value.failures) == ["missing_quote"]
    with pytest.raises(integrity.GateError) as e:
        integrity.market_gates({k: v for k, v in found.items() if k != "pricing"})
    assert list(e.value.failures) == ["table pricing is missing"]
    again = quotes.make_quotes(daily.repartition(5), contracts, SPEC)
    a, b = integrity.multiset_difference(quoted, again)
    assert a.count() == b.count() == 0
    near = chain.nearest_to_forward(contracts.withColumn("forward", F.lit(98.0)), expiries=1, strikes=2)
    assert near.count() == 2 * 2 * 2


def test_dependence(spark):
    load = spark.createDataFrame([("a", 0, 0.8), ("b", 0, 0.5), ("b", 1, 0.5)], "driver string, factor int, loading double")
    rho = {(r.driver_i, r.driver_j): r.rho for r in dependence.correlation(load).collect()}
    assert rho == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 0.4, ("b", "a"): 0.4}
    assert dependence.asymmetric(dependence.correlation(load)).count() == 0 and dependence.overlong(load).count() == 0
    assert dependence.overlong(load.withColumn("loading", F.lit(1.1))).count() == 2
    wrong = dependence.correlation(load).withColumn("rho", F.col("rho") + 0.01)
    assert dependence.provenance_errors(wrong, load).count() == 4


def test_digests(spark):
    df = spark.createDataFrame([(i, f"x{i}", None if i % 3 else i / 7) for i in range(50)], "k long, s string, v double")
    assert integrity.multiset_digest(df) == integrity.multiset_digest(df.repartition(7)) != integrity.multiset_digest(df.where("k > 0"))
    assert integrity.ordered_digest(df, ["k"]) == integrity.ordered_digest(df.orderBy(F.desc("k")), ["k"])
    named = df.withColumn("task", F.lit("a"))
    copy = integrity.project_identity(named, ["k"], {"task": "b"})
    assert integrity.content_digest(copy, ["k"], ["task"]) == integrity.content_digest(named, ["k"], ["task"])
    with pytest.raises(ValueError):
        integrity.ordered_digest(df.union(df), ["k"])
    shifted = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert shifted.select(integrity.canonical_row(shifted).alias("c")).distinct().count() == 2


def test_private_fields(spark):
    df = spark.createDataFrame([('{"a":{"Physical-Dynamics":1}}',), ('{"a":1}',), ('"{\\\\"rngseed\\\\":3}"',)], "doc string")
    assert integrity.private_json_rows(df, ["doc"], ["physical_dynamics"]).count() == 1
    for spelled in ('{"\\u0073eed": 1}', '{"se:ed": 1}', '{"se/ed": 1}', '[[{"x": {"SEED": 1}}]]', '{"a": "[{\\"seed\\": 1}]"}', "[" * 100_000):
        assert integrity.private_in_json(spelled, frozenset({"seed"})), spelled[:40]
    for fine in ('{"seeds": "seed"}', "seed", '"seed"', None, "{"):
        assert not integrity.private_in_json(fine, frozenset({"seed"})), fine
    assert integrity.private_fields(spark.createDataFrame([((1,),)], "x struct<Gen_Seed:int>").schema, {"genseed"}) == ["x.Gen_Seed"]


def test_curriculum_buckets(spark):
    tasks = spark.createDataFrame([("r", 0, 0.99), ("c1", 1, 0.5), ("c2", 1, 0.99), ("e", 2, 0.1), ("z", 3, 0.1)], "task_id string, stage int, pass_rate double")
    bands = [("low", 0.0, 1.0), ("mid", 0.3, 1.0), ("high", 0.8, 0.25)]
    got = {r.task_id: round(r.weight, 10) for r in selection.curriculum_weights(tasks, {"replay": 0.2, "current": 0.6, "explore": 0.2}, bands, 1).collect()}
    assert got == {"r": 0.2, "c1": 0.48, "c2": 0.12, "e": 0.2}
    zero = selection.curriculum_weights(tasks.where("stage = 1"), {"replay": 0.2, "current": 0.6, "explore": 0.2}, [("all", 0.0, 0.0)], 1)
    assert {r.weight for r in zero.collect()} == {0.5}


def test_mutation_and_registry(spark):
    tasks = spark.createDataFrame([("t1", {"a": 1, "b": 2})], "task_id string, coordinates map<string,int>")
    child = selection.mutate(tasks, {"a": 3}, allowed=["a"], most_changed=1).collect()[0]
    assert child.parent_id == "t1" and child.coordinates == {"a": 3, "b": 2} and child.task_id.startswith("task-")
    assert selection.mutate(tasks, {"a": 1}, allowed=["a"], most_changed=1).count() == 0
    with pytest.raises(ValueError):
        selection.mutate(tasks, {"b": 3}, allowed=["a"], most_changed=1)
    r = selection.Registry()
    r.register("x", 1)
    with pytest.raises(ValueError):
        r.register("x", 2)


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, None), ("a", 6, 3.0)], "k string, t int, v double")
    got = {(r.k, r.t): (r.v, r.t_matched) for r in selection.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 5): (None, 5), ("a", 1): (None, None), ("b", 9): (None, None)}


def test_snapshot_store(spark, tmp_path):
    daily = paths.make_paths(spark, SPEC, DAYS)
    schemas, keys = {"daily": daily.schema}, {"daily": ["underlying_id", "date"]}
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/one", schemas, keys)
    first = store.sync({"daily": daily.where(F.col("date") < "2026-01-07")})
    assert first["revision"] == 1 and store.read("daily").count() == 6
    assert store.sync({"daily": daily.where(F.col("date") < "2026-01-07")}) == first
    store.sync({"daily": daily})
    assert rows(store.read("daily")) == rows(daily)

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.sync({"daily": daily.withColumn("underlying_id", F.lit("C")).dropDuplicates(["date"])}, refuse)
    assert store.read("daily").count() == 10 and store.failures()[0]["error"] == "no"
    store.freeze()
    with pytest.raises(ValueError):
        store.sync({"daily": daily})
    with pytest.raises(ValueError):
        integrity.assert_compatible(daily, daily.withColumn("volume", F.lit(1).cast("long")), ["underlying_id", "date"], "daily")
    integrity.assert_compatible(daily, daily, ["underlying_id", "date"], "daily")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    folder = f"file://{tmp_path}/pub"
    m = tables.publish(spark, {"t": df}, folder, {"id": "x"})
    assert m["counts"] == {"t": 2}
    with pytest.raises(FileExistsError):
        tables.publish(spark, {"t": df}, folder)
    assert tables.attach(spark, folder, "parent", ["t"])["t"].count() == 2 and spark.table("parent_t").count() == 2
    tables.detach(spark, "parent", ["t"])
    new, summary = tables.insert_only_merge(df, spark.createDataFrame([(2, "z"), (3, "c")], "k long, s string"), ["k"])
    assert rows(new) == [(3, "c")] and tuple(summary.first()) == (2, 1, 1)
    tables.write_jsonl(df, f"{folder}/lines", ["k"])
    assert rows(tables.read_jsonl(spark, f"{folder}/lines", "k long, s string")) == rows(df)
    steps = tables.Migrations()
    steps.step("1", "2")(lambda t: {"t": tables.add_column(t["t"], "extra", "double")})
    assert steps.upgrade({"t": df}, "1", "2")["t"].columns == ["k", "s", "extra"]
    with pytest.raises(ValueError):
        steps.upgrade({"t": df}, "1", "2", "FROZEN")
    (tmp_path / "c.json").write_text('{"seed": 1}')
    assert tables.json_config(spark, f"file://{tmp_path}/c.json", {"seed": int}) == {"seed": 1}
    with pytest.raises(ValueError):
        tables.json_config(spark, f"file://{tmp_path}/c.json", {"seed": str})
    assert rows(tables.describe(df)) == [("k", "BIGINT", "YES"), ("s", "STRING", "YES")]


def test_exact_sum_is_that_of_fsum(spark):
    import math
    import random

    rng = random.Random(1)
    rows_ = [(g, rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-300, 300)) for g in range(3) for _ in range(500)]
    rows_ += [(3, 1e308), (3, -1e308), (3, 5e-324), (4, None), (5, 0.0), (6, 0.1), (6, 0.2), (6, 0.3), (None, 1.5), (None, 2.0)]
    got = {r.k: r.sum_x for r in integrity.exact_sum(spark.createDataFrame(rows_, "k int, x double"), ["k"], "x").collect()}
    want = {}
    for k, x in rows_:
        want.setdefault(k, []).append(x)
    assert got == {k: (None if set(v) == {None} else math.fsum(v)) for k, v in want.items()}


def test_full_correlation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dependence, "BLOCK", 3)
    load = spark.createDataFrame([(f"d{i}", f, 0.05 * i + 0.01 * f) for i in range(10) for f in range(i % 3 + 1)], "driver string, factor int, loading double")
    own = {}
    for r in load.collect():
        own.setdefault(r.driver, {})[r.factor] = r.loading
    got = {(r.driver_i, r.driver_j): r.rho for r in dependence.correlation(load).collect()}
    assert len(got) == 100
    for (i, j), rho in got.items():
        assert rho == pytest.approx(1.0 if i == j else sum(v * own[j].get(f, 0.0) for f, v in own[i].items()))


def test_row_ids_are_those_of_one_order(spark):
    df = spark.range(997).selectExpr("id % 7 AS a", "id AS b", "'x' AS row")
    got = {r.row_id: (r.a, r.b) for r in chain.with_row_ids(df, "a", "b").collect()}
    assert got == {f"row_{n:06d}": k for n, k in enumerate(sorted((i % 7, i) for i in range(997)), 1)}


def test_bridge_follows_the_mean_and_ends_at_the_close():
    spec = paths.MarketSpec(bridge_steps=8)
    grid = paths.bridge_prices(spec, "A", "2026-01-05", Decimal(100), Decimal(103), 0.0, 3 / 365)
    assert grid[0] == 100 and grid[-1] == 103 and len(grid) == 9
    assert grid == paths.bridge_prices(spec, "A", "2026-01-05", Decimal(100), Decimal(103), 0.0, 3 / 365)
    calm = paths.MarketSpec(bridge_steps=4, drift=((0.0, 4.0),), vol=((0.0, 1e-6),), increment="0.00000001")
    up = paths.bridge_prices(calm, "A", "d", Decimal(100), quantise(100 * math.exp(1.0)), 0.0, 0.25)
    assert [float(x) for x in up] == pytest.approx([100 * math.exp(k / 4) for k in range(5)], rel=1e-5)


def test_quotes_equal_a_row_by_row_reading(spark):
    daily, contracts, quoted = market(spark)
    from voltide.functions import bsm, curves, rng
    from voltide.functions.canonical import quantise_to_increment

    listing = {r.option_id: r.listing_date for r in contracts.collect()}
    spot = {(r.underlying_id, r.date): r.spot_close for r in daily.collect()}
    found = quoted.collect()
    assert found
    for r in found:
        start, end = (r.date - listing[r.option_id]).days / 365, (r.expiry - listing[r.option_id]).days / 365
        one = lambda x: np.array([float(x)])
        value = bsm.price(np.array([r.call_put == "call"]), one(spot[r.underlying_id, r.date]), one(r.strike), one(end - start), one(0.03), one(0.01), one(curves.root_mean_square(list(SPEC.vol), start, end)))[0]
        mid = quantise_to_increment(max(0.0, float(value)), SPEC.increment)
        half, key = max(Decimal("0.01"), mid * Decimal("0.01")), (SPEC.snapshot_id, SPEC.seed)
        noise = lambda side: Decimal(str(min(1.5, max(0.5, 1 + 0.2 * rng.gaussian(*key, "bid-ask-noise", side, r.option_id, r.date.isoformat())))))  # noqa: B023, E731
        bid, ask = quantise_to_increment(max(Decimal(0), mid - half * noise("bid")), SPEC.increment), quantise_to_increment(mid + half * noise("ask"), SPEC.increment)
        u = rng.uniform(*key, "option-activity", r.option_id, r.date.isoformat())
        assert (r.mid, r.settlement_price, r.bid, r.ask, r.volume, r.open_interest) == (mid, mid, bid, ask, int(25 + u * 475), int(500 + u * 4500))


def test_paths_and_quotes_take_all_parts(spark, sf):
    from voltide.operators.paths import MarketSpec, make_paths
    from voltide.plans import operators_

    parts = {f"P{r.p_partkey}": r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    got = {(r.underlying_id, str(r.date)): r for r in operators_.keyed_rng_paths(spark, sf).collect()}
    assert set(got) == {(p, day) for p in parts for day in operators_.DAYS}
    few = dict(list(parts.items())[-3:])
    spec = MarketSpec(loadings={k: (0.2 + 0.05 * (r.p_size % 10), 0.3) for k, r in few.items()}, spots={k: f"{r.p_retailprice:.2f}" for k, r in few.items()})
    want = make_paths(spark, spec, operators_.DAYS).collect()
    assert len(want) == 30 and all(got[r.underlying_id, str(r.date)] == r for r in want)
    assert {r.underlying_id for r in operators_.option_quotes(spark, sf).select("underlying_id").distinct().collect()} == set(parts)


def test_scratch_is_released(spark):
    from pathlib import Path

    from voltide.session import Scratch, release, scratch_path

    kept = Scratch(spark).table(spark.range(3).toDF("x"), "kept")
    folder = Path(scratch_path(spark, "x").removeprefix("file://")).parent.parent
    assert kept.count() == 3 and any(folder.rglob("*.parquet"))
    release(spark)
    assert not folder.exists()
    assert Scratch(spark).table(spark.range(2).toDF("x"), "again").count() == 2


def broadcasts(df) -> int:
    """Joins that are planned as broadcasts, under Spark's own threshold."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exploded_contracts_are_not_broadcast(spark, sf):
    from voltide.plans.contracts import expected_quotes

    assert broadcasts(expected_quotes(spark, sf)) == 0


def test_gates_broadcast_no_table_of_the_market(spark, sf):
    from voltide.plans.contracts import _market

    market = _market(spark, sf)
    assert {name: broadcasts(gate(market)) for name, gate in integrity.MARKET_GATES.items()} == dict.fromkeys(integrity.MARKET_GATES, 0)


def test_paths_are_made_on_all_cores_side_by_side(spark, sf):
    from voltide.plans import operators_

    assert operators_.keyed_rng_paths(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    # Names that were last seen on different days, and a name that is given twice, in one batch.
    names = spark.createDataFrame([("A", "100", [0.8]), ("B", "50", [0.5, 0.3]), ("C", "7", [0.1])] * 2, "underlying_id string, spot string, loading array<double>").coalesce(1)
    whole = paths.make_paths(spark, SPEC, DAYS, underlyings=names)
    head = whole.where((F.col("date") < F.lit(DAYS[2]).cast("date")) & (F.col("underlying_id") != "C") & ((F.col("underlying_id") == "A") | (F.col("date") < F.lit(DAYS[1]).cast("date"))))
    tail = paths.make_paths(spark, SPEC, DAYS[2:], head, underlyings=names)
    assert rows(tail.where("underlying_id = 'A'")) == rows(whole.where((F.col("underlying_id") == "A") & (F.col("date") >= F.lit(DAYS[2]).cast("date"))))
    alone = paths.make_paths(spark, SPEC, DAYS[2:], head, underlyings=names.where("underlying_id = 'B'"))
    assert alone.count() == len(DAYS) - 2 and rows(alone) == rows(tail.where("underlying_id = 'B'"))
    assert tail.where("underlying_id = 'C'").count() == len(DAYS) - 2


def test_bridge_ranges_are_made_on_all_cores(spark, sf):
    from voltide.plans import operators_

    found = operators_.bridge_ohlc(spark, sf)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.where("not high_ok or not low_ok or range < 0").count() == 0 and found.count() == 200 * len(operators_.DAYS)


def test_draws_of_some_days_are_made_at_once(monkeypatch):
    import pandas as pd

    names, days = [f"P{i}" for i in range(100)], [f"2026-02-{n:02d}" for n in range(1, 13)]
    few = pd.DataFrame({"underlying_id": names, "spot": "90.5", "loading": [[0.3, 0.2]] * len(names), "last_date": None, "last_close": None, "first_date": None})
    spec, calls, words = paths.MarketSpec(), [], paths.rng._words
    monkeypatch.setattr(paths.rng, "_words", lambda seeds, n: calls.append(len(seeds)) or words(seeds, n))
    whole = pd.concat(paths._daily_rows(spec, days, few), ignore_index=True)
    # 12 volumes and 11 closes a name and its 11 bridges in full chunks, not some for each day; seeds without a pair are drawn once more.
    assert len(calls) <= -(-len(names) * 11 * 64 // paths.rng._AT_ONCE) + 3 and len(whole) == 1200
    monkeypatch.setattr(paths, "DRAWS", 66 * len(names) * 5)
    parts = list(paths._daily_rows(spec, days, few))
    assert len(parts) == 3 and pd.concat(parts, ignore_index=True).equals(whole)
    one = whole[whole["underlying_id"] == "P7"].to_dict("records")
    for k in range(1, len(days)):
        start, end = (k - 1) / 365.0, k / 365.0
        eps = paths.shock(paths.MarketSpec(loadings={"P7": (0.3, 0.2)}), "P7", days[k])
        assert one[k]["spot_open"] == one[k - 1]["spot_close"] and one[k]["spot_close"] == paths.next_close(spec, one[k]["spot_open"], start, end, eps)
        grid = paths.bridge_prices(spec, "P7", days[k], one[k]["spot_open"], one[k]["spot_close"], start, end)
        assert (one[k]["spot_high"], one[k]["spot_low"], one[k]["volume"]) == (max(grid), min(grid), paths.volume(spec, "P7", days[k]))


def test_quotes_are_made_on_all_cores(spark, sf):
    from voltide.plans import operators_

    assert operators_.option_quotes(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_submatrix_makes_its_own_cells_alone(spark):
    load = spark.createDataFrame([(i, f, 0.01 * (i % 9) + 0.1 * f) for i in range(60) for f in (0, 1)], "driver long, factor int, loading double")
    few = spark.createDataFrame([(i,) for i in (3, 5, 5, 77)], "driver long")
    found = dependence.submatrix_of(load, few)
    assert rows(found) == rows(dependence.submatrix(dependence.correlation(load), few)) and found.count() == 4
    # A loading that can't be computed fails the matrix, but not a submatrix without it.
    broken = load.withColumn("loading", F.when(F.col("driver") == 9, F.raise_error(F.lit("made"))).otherwise(F.col("loading")).cast("double"))
    assert dependence.submatrix_of(broken.where("factor < 2"), few).count() == 4


def test_a_correlation_matrix_is_made_on_all_cores(spark):
    load = spark.createDataFrame([(i, f, 0.01 * (i % 9) + 0.1 * f) for i in range(300) for f in (0, 1, 5) if (i + f) % 4], "driver long, factor int, loading double")
    found = dependence.correlation(load)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    x = np.zeros((300, 3))
    for r in load.collect():
        x[r.driver, (0, 1, 5).index(r.factor)] = r.loading
    want = x @ x.T
    np.fill_diagonal(want, 1.0)
    cells = {(r.driver_i, r.driver_j): r.rho for r in found.collect()}
    there = sorted({r.driver for r in load.collect()})
    assert set(cells) == {(i, j) for i in there for j in there} and all(abs(v - want[k]) < 1e-15 for k, v in cells.items())
    many = load.withColumn("factor", F.col("factor") + 10 * (F.col("driver") % 20))
    one = {(r.driver_i, r.driver_j): r.rho for r in dependence.correlation(many).collect()}
    assert len(one) == len(cells) and all(one[k] == (cells[k] if (k[0] - k[1]) % 20 == 0 else 0.0) for k in cells)


def test_provenance_shuffles_no_cells(spark):
    load = spark.createDataFrame([(i, f, 0.01 * (i % 9) + 0.1 * f) for i in range(130) for f in (0, 1)], "driver long, factor int, loading double")
    full = dependence.correlation(load)
    assert dependence.provenance_errors(full, load).count() == 0
    changed = F.when((F.col("driver_i") == 3) & (F.col("driver_j") == 5), F.lit(None)).when((F.col("driver_i") == 4) & (F.col("driver_j") == 4), 0.5).otherwise(F.col("rho"))
    stated = full.withColumn("rho", changed).where("driver_i != 7 and not (driver_i = 129 and driver_j = 128)")
    extra = spark.createDataFrame([(1, 999, 0.1), (None, 2, 0.1)], "driver_i long, driver_j long, rho double")
    found = dependence.provenance_errors(stated.unionByName(extra), load)
    cells = {(r.driver_i, r.driver_j): (r.stated, r.rho) for r in found.collect()}
    rho = {(r.driver_i, r.driver_j): r.rho for r in full.collect()}
    want = {(7, j): (None, rho[7, j]) for j in range(130)} | {(129, 128): (None, rho[129, 128]), (3, 5): (None, rho[3, 5]), (4, 4): (0.5, 1.0), (1, 999): (0.1, None), (None, 2): (0.1, None)}
    assert cells == want and found.count() == len(want)
    assert "FullOuter" not in found._jdf.queryExecution().executedPlan().toString()
