"""Function families of the endpoint's surface, with oracles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from voltide.functions import canonical
from voltide.plans.market import t
from voltide.plans.registry import query
from voltide.plans.relational import text_query

text_query(
    "fn_string",
    "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS lo, length(p_name) AS n, substring(p_name, 2, 3) AS sub, replace(p_brand, '#', '-') AS rep, concat_ws('/', p_brand, p_type) AS cw, left(p_name, 2) AS l2, right(p_name, 2) AS r2, lpad(p_brand, 10, '*') AS lp, reverse(p_brand) AS rev, instr(p_name, 'a') AS pos, trim('  x ') AS tr, repeat('ab', 2) AS rp, ascii(p_name) AS code, levenshtein(p_brand, 'Brand#11') AS lev, split_part(p_brand, '#', 2) AS part2, starts_with(p_brand, 'Brand#1') AS sw, contains(p_name, 'e') AS has_e, translate(p_brand, 'ad', 'xy') AS tl FROM part",
    "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS lo, length(p_name) AS n, substring(p_name, 2, 3) AS sub, replace(p_brand, '#', '-') AS rep, concat_ws('/', p_brand, p_type) AS cw, left(p_name, 2) AS l2, right(p_name, 2) AS r2, lpad(p_brand, 10, '*') AS lp, reverse(p_brand) AS rev, instr(p_name, 'a') AS pos, trim('  x ') AS tr, repeat('ab', 2) AS rp, ascii(p_name) AS code, levenshtein(p_brand, 'Brand#11') AS lev, split_part(p_brand, '#', 2) AS part2, startswith(p_brand, 'Brand#1') AS sw, contains(p_name, 'e') AS has_e, translate(p_brand, 'ad', 'xy') AS tl FROM part",
)
text_query(
    "fn_regex",
    "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 2) AS g, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS masked, len(regexp_extract_all(p_type, '[A-Z]+'))::INTEGER AS words FROM part",
    "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 2) AS g, regexp_replace(p_type, '[AEIOU]', '_') AS masked, size(regexp_extract_all(p_type, '[A-Z]+', 0)) AS words FROM part",
)
text_query(
    "fn_date",
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, isodow(o_orderdate) AS dow, CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, last_day(CAST(o_orderdate AS DATE)) AS ld, dayname(o_orderdate) AS dn, strftime(o_orderdate, '%Y/%m/%d') AS txt, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS later, weekofyear(o_orderdate) AS wk FROM orders".replace("year(o_orderdate) AS y", "year(o_orderdate)::INTEGER AS y").replace("month(o_orderdate) AS m,", "month(o_orderdate)::INTEGER AS m,").replace("day(o_orderdate) AS dd", "day(o_orderdate)::INTEGER AS dd").replace("quarter(o_orderdate) AS q", "quarter(o_orderdate)::INTEGER AS q").replace("dayofyear(o_orderdate) AS doy", "dayofyear(o_orderdate)::INTEGER AS doy").replace("isodow(o_orderdate) AS dow", "isodow(o_orderdate)::INTEGER AS dow").replace("CAST(o_orderdate AS DATE)) AS days", "CAST(o_orderdate AS DATE))::INTEGER AS days").replace("weekofyear(o_orderdate) AS wk", "weekofyear(o_orderdate)::INTEGER AS wk").replace("dayname(o_orderdate) AS dn", "left(dayname(o_orderdate), 3) AS dn"),
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, extract(DAYOFWEEK_ISO FROM o_orderdate) AS dow, CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, last_day(o_orderdate) AS ld, dayname(CAST(o_orderdate AS DATE)) AS dn, date_format(o_orderdate, 'yyyy/MM/dd') AS txt, datediff(CAST(o_orderdate AS DATE), DATE'1992-01-01') AS days, add_months(CAST(o_orderdate AS DATE), 3) AS later, weekofyear(o_orderdate) AS wk FROM orders",
)
text_query(
    "fn_math",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - 0.05) AS a, ceil(l_quantity / 7) AS c, floor(l_quantity / 7) AS f, round(sqrt(l_quantity), 8) AS s, round(ln(l_quantity), 8) AS l, round(log10(l_quantity), 8) AS l10, round(exp(l_discount), 8) AS e, round(pow(l_quantity, 1.5), 4) AS p, sign(l_discount - 0.05) AS sg, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS le, l_linenumber % 3 AS md, round(sin(l_quantity), 8) AS sn, round(atan(l_quantity), 8) AS at, round(degrees(l_discount), 6) AS deg FROM lineitem".replace("ceil(l_quantity / 7) AS c", "ceil(l_quantity / 7)::BIGINT AS c").replace("floor(l_quantity / 7) AS f", "floor(l_quantity / 7)::BIGINT AS f").replace("sign(l_discount - 0.05) AS sg", "sign(l_discount - 0.05)::DOUBLE AS sg"),
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - 0.05D) AS a, ceil(l_quantity / 7) AS c, floor(l_quantity / 7) AS f, round(sqrt(l_quantity), 8) AS s, round(ln(l_quantity), 8) AS l, round(log10(l_quantity), 8) AS l10, round(exp(l_discount), 8) AS e, round(pow(l_quantity, 1.5), 4) AS p, sign(l_discount - 0.05D) AS sg, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS le, l_linenumber % 3 AS md, round(sin(l_quantity), 8) AS sn, round(atan(l_quantity), 8) AS at, round(degrees(l_discount), 6) AS deg FROM lineitem",
)
text_query(
    "fn_hash",
    "SELECT p_partkey, sha256(p_name) AS sha, md5(p_name) AS md, sha1(p_name) AS s1, lower(hex(encode(p_brand))) AS hx, base64(encode(p_brand)) AS b64, bit_count(p_size)::INTEGER AS bits FROM part",
    "SELECT p_partkey, sha2(p_name, 256) AS sha, md5(p_name) AS md, sha1(p_name) AS s1, lower(hex(p_brand)) AS hx, base64(cast(p_brand AS binary)) AS b64, bit_count(p_size) AS bits FROM part",
)
text_query(
    "fn_array",
    "SELECT p_partkey, len(a)::INTEGER AS n, list_contains(a, 7) AS has7, array_to_string(list_transform(a, lambda x: x * 2), ',') AS twice, array_to_string(list_filter(a, lambda x: x % 2 = 0), ',') AS even, list_sum(a)::BIGINT AS total, a[1] AS head, array_to_string(list_sort(list_distinct(a)), ',') AS uniq, array_to_string(a[2:3], ',') AS sl FROM (SELECT p_partkey, [p_size, p_size % 7, 7, p_size % 3] AS a FROM part)",
    "SELECT p_partkey, size(a) AS n, array_contains(a, 7) AS has7, array_join(transform(a, x -> x * 2), ',') AS twice, array_join(filter(a, x -> x % 2 = 0), ',') AS even, aggregate(a, 0L, (s, x) -> s + x) AS total, element_at(a, 1) AS head, array_join(array_sort(array_distinct(a)), ',') AS uniq, array_join(slice(a, 2, 2), ',') AS sl FROM (SELECT p_partkey, array(p_size, p_size % 7, 7, p_size % 3) AS a FROM part)",
)
text_query(
    "fn_map_struct",
    "SELECT p_partkey, m['size'] AS size, len(map_keys(m))::INTEGER AS n, s.b AS brand FROM (SELECT p_partkey, MAP {'size': p_size, 'seven': 7} AS m, {'a': p_size, 'b': p_brand} AS s FROM part)",
    "SELECT p_partkey, m['size'] AS size, size(map_keys(m)) AS n, s.b AS brand FROM (SELECT p_partkey, map('size', p_size, 'seven', 7) AS m, named_struct('a', p_size, 'b', p_brand) AS s FROM part)",
)
text_query(
    "fn_json",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, json_array_length('[1,2,3]')::INTEGER AS n, json_valid(props) AS ok FROM events",
    "SELECT event_id, get_json_object(props, '$.k') AS k, json_array_length('[1,2,3]') AS n, try_parse_json(props) IS NOT NULL AS ok FROM events",
)
text_query(
    "fn_conditional",
    "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'pos' ELSE 'neg' END AS side, coalesce(NULL, s_name) AS nm, CAST(s_suppkey AS VARCHAR) AS txt, CAST('12' AS INTEGER) AS num, isfinite(s_acctbal) AS fin FROM supplier",
    "SELECT s_suppkey, if(s_acctbal > 0, 'pos', 'neg') AS side, coalesce(NULL, s_name) AS nm, CAST(s_suppkey AS STRING) AS txt, CAST('12' AS INT) AS num, NOT isnan(s_acctbal) AND abs(s_acctbal) < double('infinity') AS fin FROM supplier",
)
text_query(
    "fn_vector",
    "SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 1",
    "SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x) / (sqrt(aggregate(a.embedding, 0D, (s, x) -> s + double(x) * double(x))) * sqrt(aggregate(b.embedding, 0D, (s, x) -> s + double(x) * double(x)))), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 1",
)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(CAST(l_extendedprice AS DECIMAL(24,8)) / 0.25, 0)::DOUBLE * 0.25 AS on_tick FROM lineitem")
def tick_rounding(spark, d):
    x = F.col("l_extendedprice").cast("decimal(24,8)")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", canonical.tick(x, "0.25").cast("double").alias("on_tick"))


@query("""SELECT p_partkey, 'solver-' || left(sha256('{"brand":"' || p_brand || '","id":' || p_partkey || '}'), 24) AS id, ('0x' || left(sha256('v1|' || p_partkey || '|' || p_brand), 8))::BIGINT AS seed FROM part""")
def stable_ids(spark, d):
    """Content ids of canonical JSON, and the seeds of keyed streams."""
    h = F.sha2(F.concat_ws("|", F.lit("v1"), F.col("p_partkey").cast("string"), "p_brand"), 256)
    return t(spark, d, "part").select("p_partkey", canonical.stable_id_column("solver-", id=F.col("p_partkey"), brand=F.col("p_brand")).alias("id"), F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").alias("seed"))


@query("SELECT o_orderkey, (CAST(o_totalprice AS DECIMAL(24,8)) * CAST(1.05 AS DECIMAL(24,8)))::DOUBLE AS product, round((CAST(o_totalprice AS DECIMAL(24,8)) - 7)::DOUBLE, 6) AS less FROM orders")
def decimal_arithmetic(spark, d):
    x = F.col("o_totalprice").cast("decimal(24,8)")
    return t(spark, d, "orders").select("o_orderkey", (x * F.lit(Decimal("1.05")).cast("decimal(24,8)")).cast("double").alias("product"), F.round((x - 7).cast("double"), 6).alias("less"))


@query("SELECT event_type, user_id % 3 AS g, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 2 GROUP BY ALL")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, d, "events").where(k > 2).groupBy("event_type", (F.col("user_id") % 3).alias("g")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS doc FROM nation""")
def json_object(spark, d):
    return t(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("doc"))


text_query(
    "fn_string_more",
    "SELECT p_partkey, starts_with(p_brand, 'Brand#1') AS sw, ends_with(p_brand, '3') AS ew, contains(p_type, 'STEEL') AS ct, levenshtein(p_brand, 'Brand#23')::INTEGER AS lev, translate(p_brand, 'Bd', 'bD') AS tr, repeat(left(p_name, 1), 3) AS rp, split_part(p_type, ' ', 2) AS sp, ascii(p_name) AS asc, chr(65 + p_size % 26) AS ch, rtrim(rpad(left(p_name, 2), 6, ' ')) AS rt, octet_length(encode(p_name))::INTEGER AS ol, array_to_string(string_split(p_type, ' '), '|') AS ss, printf('%05d', p_size) AS pf, hamming(left(p_brand, 7), 'Brand#1')::INTEGER AS hm FROM part",
    "SELECT p_partkey, startswith(p_brand, 'Brand#1') AS sw, endswith(p_brand, '3') AS ew, contains(p_type, 'STEEL') AS ct, levenshtein(p_brand, 'Brand#23') AS lev, translate(p_brand, 'Bd', 'bD') AS tr, repeat(left(p_name, 1), 3) AS rp, split_part(p_type, ' ', 2) AS sp, ascii(p_name) AS asc, char(65 + p_size % 26) AS ch, rtrim(rpad(left(p_name, 2), 6, ' ')) AS rt, octet_length(p_name) AS ol, array_join(split(p_type, ' '), '|') AS ss, format_string('%05d', p_size) AS pf, aggregate(zip_with(split(left(p_brand, 7), ''), split('Brand#1', ''), (x, y) -> if(x = y, 0, 1)), 0, (s, x) -> s + x) AS hm FROM part",
)
text_query(
    "fn_date_more",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS plus, make_date(year(o_orderdate), month(o_orderdate), 1) AS first, monthname(o_orderdate) AS mn, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate)::INTEGER AS s, weekofyear(o_orderdate) AS wk, epoch(o_orderdate)::BIGINT AS ep, CAST(time_bucket(INTERVAL 7 DAY, CAST(o_orderdate AS DATE), DATE '1992-01-01') AS DATE) AS bucket, date_diff('month', date_trunc('month', CAST(o_orderdate AS DATE)), DATE '1999-01-01')::BIGINT AS months, CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE) AS parsed FROM orders",
    "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 10) AS plus, make_date(year(o_orderdate), month(o_orderdate), 1) AS first, date_format(o_orderdate, 'MMMM') AS mn, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, weekofyear(o_orderdate) AS wk, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS ep, date_add(DATE'1992-01-01', CAST(floor(datediff(CAST(o_orderdate AS DATE), DATE'1992-01-01') / 7) * 7 AS INT)) AS bucket, timestampdiff(MONTH, date_trunc('month', o_orderdate), TIMESTAMP'1999-01-01') AS months, CAST(to_timestamp(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd') AS DATE) AS parsed FROM orders",
)
text_query(
    "fn_math_more",
    "SELECT p_partkey, round(cbrt(p_retailprice), 8) AS cb, round(degrees(p_size / 10.0::DOUBLE), 8) AS dg, round(radians(p_size * 1.0::DOUBLE), 8) AS rd, round(sin(p_size) + cos(p_size) + tan(p_size / 100.0::DOUBLE), 8) AS trig, round(atan2(p_size, 7), 8) AS at2, round(asin(p_size / 100.0::DOUBLE) + acos(p_size / 100.0::DOUBLE) + atan(p_size), 8) AS inv, round(log2(p_size), 8) AS l2, factorial(p_size % 10)::BIGINT AS f, gcd(p_size, 12)::BIGINT AS g, lcm(p_size, 12)::BIGINT AS lc, xor(p_size, 5) AS x, round(sinh(p_size / 50.0::DOUBLE) + cosh(p_size / 50.0::DOUBLE) + tanh(p_size / 50.0::DOUBLE), 8) AS hyp, greatest(p_size, 20) AS gr, least(p_size, 20) AS le, p_size % 7 AS md, round_even(p_size / 4.0::DOUBLE, 0) AS re FROM part",
    "SELECT p_partkey, round(cbrt(p_retailprice), 8) AS cb, round(degrees(p_size / 10D), 8) AS dg, round(radians(double(p_size)), 8) AS rd, round(sin(p_size) + cos(p_size) + tan(p_size / 100D), 8) AS trig, round(atan2(p_size, 7), 8) AS at2, round(asin(p_size / 100D) + acos(p_size / 100D) + atan(p_size), 8) AS inv, round(log2(p_size), 8) AS l2, factorial(int(p_size % 10)) AS f, bigint(aggregate(filter(sequence(1, 12), i -> p_size % i = 0 AND 12 % i = 0), 1, (s, i) -> greatest(s, i))) AS g, bigint(p_size * 12 / aggregate(filter(sequence(1, 12), i -> p_size % i = 0 AND 12 % i = 0), 1, (s, i) -> greatest(s, i))) AS lc, p_size ^ 5 AS x, round(sinh(p_size / 50D) + cosh(p_size / 50D) + tanh(p_size / 50D), 8) AS hyp, greatest(p_size, 20) AS gr, least(p_size, 20) AS le, p_size % 7 AS md, bround(p_size / 4D, 0) AS re FROM part",
)
text_query(
    "fn_list_more",
    "SELECT p_partkey, list_position(a, 7)::INTEGER AS pos, array_to_string(list_concat(a, [1, 2]), ',') AS cc, list_has_any(a, [7, 9]) AS anyof, list_min(a) AS mn, list_max(a) AS mx, round(list_avg(a), 8) AS av, len(list_distinct(a))::INTEGER AS un, array_to_string(list_transform(range(1, 4), lambda i: a[i] * i), ',') AS zip, array_to_string(flatten([a, a]), ',') AS fl, array_to_string(list_reverse(a), ',') AS rv, array_to_string(list_intersect(a, [7, 1]), ',') AS it, array_to_string(array_append(a, 0), ',') AS ap, list_reduce(a, lambda x, y: x * 2 + y) AS red FROM (SELECT p_partkey, [p_size, 7, p_size % 5] AS a FROM part)",
    "SELECT p_partkey, int(array_position(a, 7)) AS pos, array_join(concat(a, array(1, 2)), ',') AS cc, arrays_overlap(a, array(7, 9)) AS anyof, array_min(a) AS mn, array_max(a) AS mx, round(aggregate(a, 0D, (s, x) -> s + x) / size(a), 8) AS av, size(array_distinct(a)) AS un, array_join(zip_with(a, sequence(1, 3), (x, i) -> x * i), ',') AS zip, array_join(flatten(array(a, a)), ',') AS fl, array_join(reverse(a), ',') AS rv, array_join(array_intersect(a, array(7, 1)), ',') AS it, array_join(array_append(a, 0), ',') AS ap, aggregate(slice(a, 2, 2), element_at(a, 1), (x, y) -> x * 2 + y) AS red FROM (SELECT p_partkey, array(p_size, 7, p_size % 5) AS a FROM part)",
)
text_query(
    "fn_map_more",
    "SELECT p_partkey, array_to_string(list_sort(map_keys(map_concat(m, MAP {'extra': 1}))), ',') AS keys, list_sum(map_values(m))::BIGINT AS total, map_contains(m, 'seven') AS has, len(map_entries(m))::INTEGER AS n, struct_extract(s, 'b') AS b, map_from_entries([('k', p_size)])['k'] AS made FROM (SELECT p_partkey, p_size, MAP {'size': p_size, 'seven': 7} AS m, struct_pack(a := p_size, b := p_brand) AS s FROM part)",
    "SELECT p_partkey, array_join(array_sort(map_keys(map_concat(m, map('extra', 1)))), ',') AS keys, aggregate(map_values(m), 0L, (s, x) -> s + x) AS total, map_contains_key(m, 'seven') AS has, size(map_entries(m)) AS n, s.b AS b, map_from_entries(array(struct('k', p_size)))['k'] AS made FROM (SELECT p_partkey, p_size, map('size', p_size, 'seven', 7) AS m, named_struct('a', p_size, 'b', p_brand) AS s FROM part)",
)
text_query(
    "fn_json_more",
    "SELECT n_regionkey, array_to_string(list_sort(json_keys('{\"a\":' || n_regionkey || ',\"b\":2}')), ',') AS keys, json_extract_string('{\"a\":{\"b\":[10,' || n_regionkey || ']}}', '$.a.b[1]')::BIGINT AS deep, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, array_join(array_sort(json_object_keys(concat('{\"a\":', n_regionkey, ',\"b\":2}'))), ',') AS keys, bigint(get_json_object(concat('{\"a\":{\"b\":[10,', n_regionkey, ']}}'), '$.a.b[1]')) AS deep, array_join(array_sort(from_json(to_json(collect_list(n_name)), 'array<string>')), ',') AS names FROM nation GROUP BY n_regionkey",
)
text_query(
    "agg_more",
    "WITH l AS (SELECT *, CASE WHEN l_linenumber <= 4 THEN 1 ELSE l_linenumber END AS m FROM lineitem) SELECT l_returnflag, mode(m) AS md, round(skewness(l_quantity), 5) AS sk, round(regr_slope(l_extendedprice, l_quantity), 6) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 4) AS ic, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(covar_pop(l_extendedprice, l_quantity), 3) AS cp, round(covar_samp(l_extendedprice, l_quantity), 3) AS cs, bool_or(l_discount > 0.05) AS bo, round(product(1 + l_discount / 100000), 8) AS pr, count(DISTINCT l_partkey) AS exact, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS near, any_value(l_returnflag) AS av FROM l GROUP BY l_returnflag",
    "WITH l AS (SELECT *, CASE WHEN l_linenumber <= 4 THEN 1 ELSE l_linenumber END AS m FROM lineitem) SELECT l_returnflag, mode(m) AS md, round(skewness(l_quantity) * sqrt(count(*) * (count(*) - 1D)) / (count(*) - 2), 5) AS sk, round(regr_slope(l_extendedprice, l_quantity), 6) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 4) AS ic, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(covar_pop(l_extendedprice, l_quantity), 3) AS cp, round(covar_samp(l_extendedprice, l_quantity), 3) AS cs, bool_or(l_discount > 0.05) AS bo, round(exp(sum(ln(1 + l_discount / 100000))), 8) AS pr, count(DISTINCT l_partkey) AS exact, abs(approx_count_distinct(l_partkey, 0.02) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS near, any_value(l_returnflag) AS av FROM l GROUP BY l_returnflag",
)
