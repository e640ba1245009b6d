"""Queries of sources, sinks, canonical forms, projections, gates and the
endpoint, each through the library's own operator and with SQL of its own."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltide.functions import canonical, curves
from voltide.operators import chain, export, integrity, selection
from voltide.plans.endpoint import Endpoint, EndpointError, check_submission
from voltide.plans.market import OPTIONS_SQL, options, t
from voltide.plans.registry import query
from voltide.session import scratch_path
from voltide.sources import dataset, snapshot, tables


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def attached_join(spark, d):
    """Tables of another folder under a catalogue's name, joined, detached."""
    names = ["nation", "region"]
    tables.attach(spark, d, "parent", names)
    out = spark.sql("SELECT n_nationkey, n_name, r_name FROM parent_nation JOIN parent_region ON n_regionkey = r_regionkey")
    tables.detach(spark, "parent", names)
    return out


@query("""SELECT * FROM (VALUES ('name', '"market"'), ('seed', '20260806'), ('tick', '0.5'), ('underlyings', '["A","B"]')) v(setting, content)""")
def json_settings(spark, d):
    """A configuration file, read and checked."""
    path = f"{scratch_path(spark, 'config')}.json"
    tables.Files(spark, path).write_text(path, '{"seed": 20260806, "name": "market", "tick": 0.5, "underlyings": ["A", "B"]}')
    found = tables.json_config(spark, path, {"seed": int, "name": str, "tick": float, "underlyings": list})
    return spark.createDataFrame([(k, canonical.canonical_json(v)) for k, v in sorted(found.items())], "setting string, content string")


@query("SELECT name AS column_name, kind AS column_type, 'YES' AS nullable FROM (VALUES ('r_regionkey', 'BIGINT'), ('r_name', 'STRING')) v(name, kind)")
def described_table(spark, d):
    region = t(spark, d, "region")
    return tables.describe(region.select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def appended_table(spark, d):
    """Two batches appended to one table."""
    folder, o = scratch_path(spark, "appended"), t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    for rest in (0, 1):
        tables.append(o.where(F.col("o_orderkey") % 2 == rest), folder, "orders")
    return tables.load(spark, folder, "orders", o.schema)


@query("SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier)")
def published_counts(spark, d):
    """A folder published whole, as its manifest tells it."""
    folder = scratch_path(spark, "published")
    tables.publish(spark, {n: t(spark, d, n) for n in ("customer", "supplier")}, folder, {"source": "test"})
    manifest = json.loads(tables.Files(spark, folder).read_text(f"{folder}/manifest.json"))
    return spark.createDataFrame([(k, n) for k, n in sorted(manifest["counts"].items())], "table_name string, n long")


@query("SELECT 'task-' || p_partkey AS task_id, CASE WHEN p_size % 2 = 0 THEN 'delta' ELSE 'gamma' END AS metric, p_name AS prompt, p_brand AS answer FROM part")
def dataset_records(spark, d):
    """Training records written as JSON lines and read again."""
    folder, lit = scratch_path(spark, "dataset"), F.lit
    metric = F.when(F.col("p_size") % 2 == 0, "delta").otherwise("gamma")
    rows = t(spark, d, "part").select(lit("1").alias("schema_version"), F.concat(lit("task-"), "p_partkey").alias("task_id"), lit("f").alias("task_family"), metric.alias("metric"), lit("s").alias("snapshot_id"), F.col("p_name").alias("prompt"), F.col("p_brand").alias("answer"), lit(True).alias("verified"), F.sha2("p_name", 256).alias("digest"))
    dataset.write_records(rows, folder)
    return dataset.read_records(spark, folder).select("task_id", "metric", "prompt", "answer")


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events), k AS (SELECT * FROM p WHERE NOT (user_id % 7 = 0 AND position = 1))
SELECT 'user-' || user_id AS task_id, count(*) AS n FROM k GROUP BY user_id HAVING max(position) <> count(*) - 1""")
def broken_trajectories(spark, d):
    """Trajectories written and read as JSON lines; some lost an event."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = t(spark, d, "events").withColumn("position", at.cast("long")).where(~((F.col("user_id") % 7 == 0) & (F.col("position") == 1)))
    folder = scratch_path(spark, "trajectories")
    dataset.write_trajectories(e.select(F.concat(F.lit("user-"), "user_id").alias("task_id"), "position", F.col("event_type").alias("kind"), F.col("props").alias("payload")), folder)
    return dataset.broken_trajectories(tables.read_jsonl(spark, folder, dataset.EVENT)).select("task_id", "n")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS nth, o_orderkey, true AS truncated, 50::BIGINT AS row_count FROM orders ORDER BY o_orderkey LIMIT 50")
def endpoint_bounded(spark, d):
    """An endpoint's answer, cut at its row budget."""
    got = Endpoint(spark, {"market.orders": t(spark, d, "orders")}, rows=50, seconds=120).query("SELECT o_orderkey FROM market.orders ORDER BY o_orderkey")
    return spark.createDataFrame([(i, r[0], got["truncated"], got["row_count"]) for i, r in enumerate(got["rows"], 1)], "nth long, o_orderkey long, truncated boolean, row_count long")


_ASKED = [
    ("DELETE FROM market.nation", "not_allowed"),
    ("SELECT * FROM parquet.`/tmp/x`", "not_allowed"),
    ("SELECT * FROM range(5)", "not_allowed"),
    ("SELECT * FROM read_files('/tmp/x')", "not_allowed"),
    ("SELECT * FROM hidden", "not_allowed"),
    ("SELECT rand()", "not_allowed"),
    ("SELECT system.builtin.abs(1)", "not_allowed"),
    ("SELECT nope FROM market.nation", "bind_error"),
    ("SELEC 1 FROM (", "syntax_error"),
    ("SELECT 1; SELECT 2", "syntax_error"),
    (" ", "invalid_input"),
    ("SELECT TIMESTAMP'2020-01-01 00:00:00'", "unsupported_value"),
    ("SELECT count(*) FROM market.nation", "ok"),
    ("WITH x AS (SELECT 1 AS y) SELECT y FROM x", "ok"),
    ("SELECT * FROM information_schema.tables", "ok"),
]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(sql)}, '{code}')" for i, (sql, code) in enumerate(_ASKED)) + ") v(nth, asked, code)")
def endpoint_codes(spark, d):
    """What the guard says to each text."""
    end, rows = Endpoint(spark, {"market.nation": t(spark, d, "nation")}, calls=len(_ASKED), seconds=120), []
    for i, (sql, _) in enumerate(_ASKED):
        try:
            end.query(sql)
            code = "ok"
        except EndpointError as e:
            code = e.code
        rows.append((i, sql, code))
    return spark.createDataFrame(rows, "nth int, asked string, code string")


@query("""SELECT json_array(s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(24,8)) AS VARCHAR), '2026-08-14', NULL)::VARCHAR AS encoded FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 8)""")
def endpoint_values(spark, d):
    """How values leave the endpoint: decimals and dates as texts."""
    end = Endpoint(spark, {"market.supplier": t(spark, d, "supplier")}, seconds=120)
    got = end.query("SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(24,8)) AS x, DATE'2026-08-14' AS day, CAST(NULL AS STRING) AS none FROM market.supplier ORDER BY s_suppkey LIMIT 8")
    return spark.createDataFrame([(json.dumps(r, separators=(",", ":")),) for r in got["rows"]], "encoded string")


@query("SELECT * FROM (VALUES ('changed', 'not_allowed'), ('extra', 'not_allowed'), ('same', 'ok')) v(inventory, code)")
def endpoint_inventory(spark, d):
    """An endpoint opens only over exactly the relations and contents agreed."""
    nation, rows = t(spark, d, "nation"), []
    same = {"market.nation": integrity.multiset_digest(nation)}
    for name, inventory in (("same", same), ("extra", same | {"market.other": ""}), ("changed", {"market.nation": integrity.multiset_digest(nation.where("n_nationkey > 0"))})):
        try:
            Endpoint(spark, {"market.nation": nation}, inventory=inventory)
            rows.append((name, "ok"))
        except EndpointError as e:
            rows.append((name, e.code))
    return spark.createDataFrame(rows, "inventory string, code string")


@query("SELECT 'nations' AS tool, (SELECT count(*) FROM nation) AS n, 'budget_exhausted' AS again UNION ALL SELECT 'regions', (SELECT count(*) FROM region), 'budget_exhausted'")
def endpoint_tools(spark, d):
    """Fixed queries without parameters, each to be called once."""
    end = Endpoint(spark, {"market.nation": t(spark, d, "nation"), "market.region": t(spark, d, "region")}, seconds=120)
    rows = []
    for name, tool in end.tools({"nations": "SELECT * FROM market.nation", "regions": "SELECT * FROM market.region"}).items():
        got = tool()
        try:
            tool()
            again = "ok"
        except EndpointError as e:
            again = e.code
        rows.append((name, got["row_count"], again))
    return spark.createDataFrame(rows, "tool string, n long, again string")


@query("SELECT 'extra: ' || (SELECT count(*) FROM part WHERE p_partkey % 50 = 0) || ' rows' AS error UNION ALL SELECT 'missing: ' || (SELECT count(*) FROM part WHERE p_partkey % 41 = 0) || ' rows' UNION ALL SELECT 'delta: ' || (SELECT count(*) FROM part WHERE p_partkey % 37 = 0 AND p_partkey % 41 <> 0) || ' rows'")
def submission_errors(spark, d):
    """A submission with planted missing, extra and wrong rows."""
    part = t(spark, d, "part")
    text = lambda x: x.cast("decimal(24,8)").cast("string")
    row, size = F.concat(F.lit("row_"), "p_partkey"), F.col("p_size")
    want = part.select(row.alias("row_id"), text(size).alias("delta"))
    sent = part.where("p_partkey % 41 != 0").select(row.alias("row_id"), text(size + F.when(F.col("p_partkey") % 37 == 0, 1).otherwise(0)).alias("delta"))
    extra = part.where("p_partkey % 50 = 0").select(F.concat(F.lit("more_"), "p_partkey").alias("row_id"), F.lit("0.00000000").alias("delta"))
    return spark.createDataFrame([(e,) for e in check_submission(want, sent.unionByName(extra), ["delta"])], "error string")


@query("""SELECT p_partkey AS option_id, p_brand AS option_name, NULL::VARCHAR AS chain_id, NULL::DATE AS listing_date, NULL::DECIMAL(24,8) AS listing_spot, NULL::DECIMAL(24,8) AS strike_moneyness, (SELECT count(*) FROM supplier) AS dependences, 0::BIGINT AS mapped, 0::BIGINT AS revision_counts, 0::BIGINT AS laws FROM part""")
def migrated_table(spark, d):
    """An old version's tables in the newest one."""
    old = {
        "option_contracts": t(spark, d, "part").select(F.col("p_partkey").alias("option_id"), F.col("p_brand").alias("option_name")),
        "underlying_dependence": t(spark, d, "supplier").select("s_suppkey", F.lit("old").alias("mapping_id")),
        "snapshot_revisions": t(spark, d, "region").select("r_regionkey"),
    }
    new = tables.market_migrations().upgrade(old, "2.3", "2.6")
    laws = new["intraday_bridge_specs"].select("snapshot_id").unionByName(new["underlying_volume_models"].select("snapshot_id")).agg(F.count("*").alias("laws"))
    dep = new["underlying_dependence"].agg(F.count("*").alias("dependences"), F.count("mapping_id").alias("mapped"))
    rev = new["snapshot_revisions"].agg(F.sum(sum(map(F.col, tables.ADDED["snapshot_revisions"]))).alias("revision_counts"))
    totals = [df.first()[k] for df, k in ((dep, "dependences"), (dep, "mapped"), (rev, "revision_counts"), (laws, "laws"))]
    return new["option_contracts"].select("*", *(F.lit(n).cast("bigint").alias(k) for n, k in zip(totals, ("dependences", "mapped", "revision_counts", "laws"), strict=True)))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 10 = 3 AND o_totalprice > 50000 AND o_orderstatus IN ('F', 'O')")
def bound_parameters(spark, d):
    """Values bound to a text, not spliced into it."""
    sql = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey % 10 = :rest AND o_totalprice > :least AND array_contains(:states, o_orderstatus)"
    return spark.sql(sql, {"rest": 3, "least": 50000.0, "states": F.array(F.lit("F"), F.lit("O"))}, orders=t(spark, d, "orders"))


@query("SELECT n_nationkey, true AS stamped FROM nation")
def stamped_rows(spark, d):
    """The default of a row's time: one time for the whole query, kept out of
    what is compared."""
    now = F.current_timestamp()
    return t(spark, d, "nation").withColumn("created_at", now).select("n_nationkey", (F.col("created_at").isNotNull() & (F.col("created_at") == now)).alias("stamped"))


@query("""WITH l AS (SELECT p_partkey, e.days, m, s, DATE '2026-01-02' + e.days AS raw FROM part, (SELECT unnest([1, 3, 30])::INTEGER AS days) e, (SELECT unnest(['0.9', '1.1']) AS m), (SELECT unnest(['C', 'P']) AS s)),
x AS (SELECT *, (CASE isodow(raw) WHEN 6 THEN raw + 2 WHEN 7 THEN raw + 1 ELSE raw END)::DATE AS expiry FROM l)
SELECT 'P' || p_partkey || '-' || lpad(days::VARCHAR, 4, '0') || 'D-M' || replace(m, '.', 'p') || '-' || s AS option_id, day.x::DATE AS date, expiry
FROM x, (SELECT unnest([DATE '2026-01-02', DATE '2026-01-05', DATE '2026-01-06']) AS x) day WHERE day.x < expiry""")
def expected_quotes(spark, d):
    """Every live contract and day that must have a quote."""
    listing = t(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("underlying_id"), F.lit("2026-01-02").cast("date").alias("listing_date"), F.col("p_retailprice").alias("spot"))
    contracts = chain.candidate_grid(listing, [1, 3, 30], ["0.9", "1.1"])
    daily = listing.select("underlying_id", F.explode(F.array(*(F.lit(x).cast("date") for x in ("2026-01-02", "2026-01-05", "2026-01-06")))).alias("date"))
    return chain.expected_quotes(daily, contracts).select("option_id", "date", "expiry")


@query("""SELECT 'P' || p_partkey || '-0030D-K' || k.token || '-' || s AS option_id, k.strike::DOUBLE AS strike FROM part, (VALUES ('50p25', 50.0), ('100', 100.0), ('112p75', 113.0)) k(token, strike), (SELECT unnest(['C', 'P']) AS s)""")
def absolute_strikes(spark, d):
    """A chain of given strikes, rounded half to even on the increment."""
    listing = t(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("underlying_id"), F.lit("2026-01-02").cast("date").alias("listing_date"), F.col("p_retailprice").alias("spot"))
    grid = chain.candidate_grid(listing, [30], strikes=["50.25", "100", "112.75"])
    return grid.select("option_id", F.col("strike").cast("double").alias("strike"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 6 IN (0, 1, 2, 3)")
def private_documents(spark, d):
    """Rows whose documents hide a private key: plain, escaped, in a text, with
    punctuation, in a list."""
    docs = ['{"a": {"Gen-Seed": 1}}', '{"\\u0067enseed": 2}', '{"a": "{\\"gen_seed\\": 3}"}', '[{"ge:n/seed": 4}]', '{"a": "gen_seed", "seeds": 1}', "not json: gen_seed"]
    doc = F.element_at(F.array(*map(F.lit, docs)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return integrity.private_json_rows(t(spark, d, "part").select("p_partkey", doc.alias("doc")), ["doc"], ["gen_seed"]).select("p_partkey")


@query("""WITH g AS (SELECT 'P' || p_partkey AS underlying_id, e AS expiry, k::DOUBLE AS strike, s AS call_put, p_retailprice * 0.1 AS forward FROM part, (SELECT unnest([30, 60, 90])::INTEGER AS e), (SELECT unnest([80, 90, 100, 110, 120, 130, 150]) AS k), (SELECT unnest(['call', 'put']) AS s)),
n AS (SELECT *, dense_rank() OVER (PARTITION BY underlying_id, expiry ORDER BY abs(ln(strike / forward)), strike) AS kr FROM g WHERE expiry <= 60)
SELECT underlying_id, expiry, strike, call_put, 'row_' || lpad((row_number() OVER (ORDER BY underlying_id, expiry, strike, call_put))::VARCHAR, 6, '0') AS row_id FROM n WHERE kr <= 5""")
def task_rows(spark, d):
    """The option grid of a task, numbered in canonical order."""
    each = lambda name, xs: F.explode(F.array(*map(F.lit, xs))).alias(name)
    g = t(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("underlying_id"), (F.col("p_retailprice") * 0.1).alias("forward"))
    g = g.select("*", each("expiry", [30, 60, 90])).select("*", each("strike", [80.0, 90.0, 100.0, 110.0, 120.0, 130.0, 150.0])).select("*", each("call_put", ["call", "put"]))
    return export.select_task_rows(g).select("underlying_id", "expiry", "strike", "call_put", "row_id")


@query(r"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice * (CASE l_linenumber % 2 WHEN 0 THEN 1 ELSE -1 END) AS DECIMAL(18,2)) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(v AS DECIMAL(24,8)) AS VARCHAR) AS text, regexp_full_match(CAST(CAST(v AS DECIMAL(24,8)) AS VARCHAR), '-?(0|[1-9][0-9]*)\.[0-9]{8}') AS valid FROM x""".replace("\\\\", "\\"))
def decimal_texts(spark, d):
    """Eight-place texts of doubles, and whether they are well formed."""
    x = F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", canonical.decimal_column(x).alias("text")).withColumn("valid", F.col("text").rlike("^" + canonical.DECIMAL8.pattern + "$"))


@query("""SELECT o_orderkey, '{"decimal":"' || CAST(o_totalprice AS DECIMAL(24,8))::VARCHAR || '"}' AS price, '{"date":"' || CAST(o_orderdate AS DATE)::VARCHAR || '"}' AS day, '{"datetime":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS moment, '"' || o_orderstatus || '"' AS status, o_custkey::VARCHAR AS customer,
 CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '{"float64":"0.5"}' END AS half FROM orders""")
def tagged_scalars(spark, d):
    """Scalars with their types as canonical JSON."""
    tag = canonical.tagged_column
    return t(spark, d, "orders").select("o_orderkey", tag(F.col("o_totalprice").cast("decimal(24,8)")).alias("price"), tag(F.to_date("o_orderdate")).alias("day"), tag(F.col("o_orderdate").cast("timestamp_ntz")).alias("moment"), tag(F.col("o_orderstatus")).alias("status"), tag(F.col("o_custkey")).alias("customer"), tag(F.when(F.col("o_orderkey") % 5 != 0, 0.5)).alias("half"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'NO_BRACKET' ELSE 'OK' END AS iv_status FROM part WHERE p_partkey % 4 IN (0, 1, 3)")
def half_boundaries(spark, d):
    """Rows that may not be published: without a root, or a hair from a rounding
    boundary (0 and 5e-12 away are too near, 2e-11 is not)."""
    off = F.element_at(F.array(*(F.lit(x).cast("decimal(20,15)") for x in ("0", "0.000000000005", "0.00000000002", "0"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    delta = ((F.col("p_partkey") % 1000).cast("decimal(20,15)") / 1000 + F.lit("0.123456785").cast("decimal(20,15)") + off).cast("double")
    status = F.when(F.col("p_partkey") % 4 == 3, "NO_BRACKET").otherwise("OK")
    return export.unpublishable(t(spark, d, "part").select("p_partkey", status.alias("iv_status"), delta.alias("delta")), ["delta"]).select("p_partkey", "iv_status")


_DRIFT, _VOL = [(0.0, 0.05), (0.3, 0.02)], [(0.1, 0.2), (0.4, 0.35)]


@query(f"""WITH {OPTIONS_SQL}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tau,
  0.04 * least(tau, 0.1) + CASE WHEN tau > 0.1 THEN (power(0.2 + 0.5 * (least(tau, 0.4) - 0.1), 3) - power(0.2, 3)) / (3 * 0.5) ELSE 0 END + CASE WHEN tau > 0.4 THEN 0.1225 * (tau - 0.4) ELSE 0 END AS square,
  CASE WHEN tau <= 0.3 THEN 0.05 * tau - 0.05 * tau * tau ELSE 0.0105 + 0.02 * (tau - 0.3) END AS drift FROM opt)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(square, 8) AS variance, round(sqrt(square / tau), 8) AS rms, round(drift - 0.5 * square, 8) AS mean FROM x""")
def curve_moments(spark, d):
    """Integrated variance, root mean square and log mean over each life."""
    o, zero, tau = options(spark, d), F.lit(0.0), F.col("tau")
    mean, variance = curves.log_moments_columns(_DRIFT, _VOL, zero, tau)
    return o.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(variance, 8).alias("variance"), F.round(curves.rms_column(_VOL, zero, tau), 8).alias("rms"), F.round(mean, 8).alias("mean"))


@query("SELECT p_partkey, 'child' AS task_id, p_brand, p_size FROM part")
def projected_identity(spark, d):
    """A copy under another identity, whose content digest must not change."""
    named = t(spark, d, "part").select("p_partkey", F.lit("parent").alias("task_id"), "p_brand", "p_size")
    return integrity.project_identity(named, ["p_partkey"], {"task_id": "child"})


def _market(spark, d):
    """A small market around the parts table; some gates are planted to fail."""
    part = t(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("underlying_id"), F.col("p_retailprice").cast("decimal(24,8)").alias("spot"), F.col("p_partkey").alias("k"))
    date = F.lit("2026-01-02").cast("date")
    daily = part.select("underlying_id", date.alias("date"), F.col("spot").alias("spot_open"), (F.col("spot") + 1).alias("spot_high"), (F.col("spot") - F.when(F.col("k") % 7 == 0, -1).otherwise(1)).alias("spot_low"), F.col("spot").alias("spot_close"), F.lit(100).cast("bigint").alias("volume"), "k")
    contracts = chain.candidate_grid(part.withColumn("listing_date", date), [30], ["0.9", "1.1"])
    quotes = contracts.where("k % 5 != 0 or call_put = 'call'").select(date.alias("date"), "underlying_id", "option_id", "call_put", "strike", "expiry", F.lit(1).cast("decimal(24,8)").alias("bid"), F.when(F.col("k") % 11 == 0, 0.5).otherwise(2).cast("decimal(24,8)").alias("ask"))
    pricing = part.where("k % 3 != 0").select(date.alias("date"), "underlying_id", F.lit(0.03).alias("risk_free_rate"), F.lit(0.01).alias("dividend_yield"))
    loadings = part.select(F.col("underlying_id").alias("driver"), F.lit(0).alias("factor"), (F.lit(0.1) + F.lit(0.1) * (F.col("k") % 5)).alias("loading"))
    return {"underlyings": part.where("k % 13 != 0"), "daily": daily, "contracts": contracts, "quotes": quotes, "pricing": pricing, "loadings": loadings}


@query("""WITH p AS (SELECT p_partkey AS k FROM part), q AS (SELECT count(*) FILTER (WHERE k % 11 = 0 AND k % 5 = 0) * 2 + count(*) FILTER (WHERE k % 11 = 0 AND k % 5 <> 0) * 4 AS crossed FROM p)
SELECT gate, n FROM (SELECT 'orphan_contract' AS gate, 4 * count(*) FILTER (WHERE k % 13 = 0) AS n FROM p UNION ALL SELECT 'orphan_daily', count(*) FILTER (WHERE k % 13 = 0) FROM p UNION ALL SELECT 'missing_quote', 2 * count(*) FILTER (WHERE k % 5 = 0) FROM p
UNION ALL SELECT 'missing_pricing', count(*) FILTER (WHERE k % 3 = 0) FROM p UNION ALL SELECT 'bad_ohlc', count(*) FILTER (WHERE k % 7 = 0) FROM p UNION ALL SELECT 'crossed_quote', crossed FROM q) WHERE n > 0""")
def market_gate_counts(spark, d):
    """All gates over a market with planted faults."""
    try:
        integrity.market_gates(_market(spark, d))
        failures = {}
    except integrity.GateError as e:
        failures = e.failures
    return spark.createDataFrame(sorted(failures.items()), "gate string, n long")


@query("""SELECT 'P' || p_partkey AS underlying_id, CASE WHEN p_partkey % 9 = 0 THEN 'volume' WHEN p_partkey % 8 = 0 THEN 'missing' ELSE 'high' END AS fault FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 8 = 0 OR p_partkey % 7 = 0""")
def observation_replay(spark, d):
    """Stored observations against those made again; faults are planted."""
    again, k = _market(spark, d)["daily"], F.col("k")
    stored = again.where((k % 8 != 0) | (k % 9 == 0)).withColumn("volume", F.when(k % 9 == 0, 1).otherwise(F.col("volume")).cast("bigint")).withColumn("spot_high", F.when(k % 7 == 0, F.col("spot_high") + 1).otherwise(F.col("spot_high")))
    out = integrity.observation_replay(stored.drop("k"), again.drop("k"))
    fault = F.when(F.col("volume").isNull(), "missing").when(F.col("volume") != F.col("again_volume"), "volume").otherwise("high")
    return out.select("underlying_id", fault.alias("fault"))


@query("""WITH s AS (SELECT p_partkey FROM (SELECT p_partkey, sha256('pub|5|P' || p_partkey) AS h FROM part WHERE p_partkey % 3 <> 0 ORDER BY h LIMIT 6))
SELECT 'option_chain_quotes' AS relation, sum(CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 4 END)::BIGINT AS n FROM s UNION ALL SELECT 'option_contracts', sum(CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 4 END)::BIGINT FROM s UNION ALL SELECT 'pricing_context', 6 UNION ALL SELECT 'underlying_dependence', 72 UNION ALL SELECT 'underlying_state', 6""")
def public_projection(spark, d):
    """A child snapshot of a sampled universe, by its relations' counts."""
    market = _market(spark, d)
    chosen = export.sample_underlyings(market["pricing"].select("underlying_id"), 6, "pub", 5)
    out = export.public_projection(market, chosen, "2026-01-02", "child", {"seed", "loading", "spotopen"})
    r = out["metadata"].first()
    return spark.createDataFrame([(k, r[k]) for k in export.PUBLIC], "relation string, n long")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 10 = 0")
def changed_definitions(spark, d):
    """Definitions that a new version changed: rows of the old one that the new
    one has otherwise, or lacks."""
    old = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    new = old.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 10 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    lost, _ = integrity.multiset_difference(old, new)
    try:
        integrity.assert_compatible(old, new, ["s_suppkey"], "supplier")
        return lost.limit(0)
    except ValueError:
        return lost


@query("SELECT * FROM (VALUES (1, 'OPEN', (SELECT count(*) FROM nation WHERE n_regionkey < 2), 0), (2, 'OPEN', (SELECT count(*) FROM nation), 0), (2, 'OPEN', (SELECT count(*) FROM nation), 1), (3, 'FROZEN', (SELECT count(*) FROM nation), 1)) v(revision, status, n, failures)")
def snapshot_history(spark, d):
    """Revisions of a snapshot: two syncs, one that its gates refuse, a freeze."""
    nation = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    store = snapshot.SnapshotStore(spark, scratch_path(spark, "store"), {"nation": nation.schema}, {"nation": ["n_nationkey"]})
    rows = []

    def note():
        m = store.manifest()
        rows.append((m["revision"], m["status"], store.read("nation").count(), len(store.failures())))

    def refuse(_):
        raise ValueError("no")

    store.sync({"nation": nation.where("n_regionkey < 2")})
    note()
    store.sync({"nation": nation})
    note()
    try:
        store.sync({"nation": nation.withColumn("n_nationkey", F.col("n_nationkey") + 1000)}, refuse)
    except ValueError:
        note()
    store.freeze()
    note()
    return spark.createDataFrame(rows, "revision int, status string, n long, failures int")


@query("""SELECT p_partkey, array_position(['Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15'], p_brand) - 1 AS f_rank, p_size AS s_rank, p_brand || '-S' || p_size || '-L3' AS id FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15')""")
def coordinate_ids(spark, d):
    """Ranks of coordinates in their declared order, and their canonical ids."""
    levels = {"F": [f"Brand#1{i}" for i in range(1, 6)]}
    part = t(spark, d, "part").where(F.col("p_brand").isin(levels["F"]))
    rank = lambda a, x: selection.coordinate_rank(a, x, levels)
    return part.select("p_partkey", rank("F", F.col("p_brand")).alias("f_rank"), rank("S", F.col("p_size")).alias("s_rank"), selection.canonical_coordinates(["F", "S", "L"], ["F"], F=F.col("p_brand"), S=F.col("p_size"), L=F.lit(3)).alias("id"))


@query("SELECT s_suppkey AS task_id, n_name AS family, 'v-' || n_nationkey AS variant_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def legacy_adapter(spark, d):
    """Legacy tasks under the identity of the one variant that they match."""
    variants = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("v-"), "n_nationkey").alias("variant_id"), F.col("n_name").alias("family"))
    tasks = t(spark, d, "supplier").select(F.col("s_suppkey").alias("task_id"), "s_nationkey")
    return selection.adapt_legacy(tasks, variants, ["s_nationkey"]).select("task_id", "family", "variant_id")


@query("""SELECT l_orderkey % 50 AS k, CAST(sum(CAST(l_quantity * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) AS DECIMAL(38,0)) * 1099511627776 + CAST(l_partkey AS DECIMAL(38,0))) AS DOUBLE) / 1099511627776.0 AS sum_x FROM lineitem GROUP BY 1""")
def exact_float_sum(spark, d):
    """The correctly rounded sum of doubles far apart in size."""
    x = F.col("l_quantity") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1) + F.col("l_partkey") / F.lit(float(2**40))
    return integrity.exact_sum(t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), x.alias("x")), ["k"], "x")


@query("""SELECT s_suppkey, list_element(['iv', 'delta', 'gamma'], (r % 3 + 1)::INTEGER) AS target, r AS slot FROM (SELECT s_suppkey, (row_number() OVER (ORDER BY sha256('all|4|' || s_suppkey), s_suppkey) - 1)::INTEGER AS r FROM supplier)""")
def allocation_of_all(spark, d):
    """Rows of one group dealt to targets in hash order, numbered in ranges."""
    return selection.allocate_round_robin(t(spark, d, "supplier"), ["iv", "delta", "gamma"], "all", 4, "s_suppkey").select("s_suppkey", "target", "slot")
