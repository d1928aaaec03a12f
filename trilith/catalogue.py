"""Queries over the driver's tables, one or more for each operator, each with the SQL that checks it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .operators.frames import with_index
from .operators.recursion import shared_folder
from .sources import files, graph

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, text: str, with_graph: bool = False) -> Engine:
    """An engine with the tables that the query's text names."""
    e = Engine(spark).register_tables(sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text)])
    if with_graph:
        e.register_graph("shop", *shop(spark, sf_dir))
    return e


def shop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and suppliers as nodes; what lies in what as edges, and neighbours among nations."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def nodes(t: str, p: str, label: str, *extra: str) -> DataFrame:
        names = ("balance",)
        have = [F.col(x).alias(n) for x, n in zip(extra, names)] + [F.lit(None).cast("double").alias(n) for n in names[len(extra) :]]
        return read(t).select(F.concat(F.lit(p), F.col(f"{p}_{t}key" if t in ("region", "nation") else f"{p}_{'cust' if p == 'c' else 'supp'}key").cast("string")).alias("id"), F.array(F.lit(label)).alias("labels"), F.col(f"{p}_name").alias("name"), *have)

    n = nodes("region", "r", "Region").union(nodes("nation", "n", "Nation")).union(nodes("customer", "c", "Customer", "c_acctbal")).union(nodes("supplier", "s", "Supplier", "s_acctbal"))

    def edges(t: str, a: str, b: str, p: str, q: str, kind: str) -> DataFrame:
        src, dst = F.concat(F.lit(p), F.col(a).cast("string")), F.concat(F.lit(q), F.col(b).cast("string"))
        return read(t).select(F.concat_ws("-", F.lit(kind), src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))

    nation = read("nation").withColumn("next", F.col("n_nationkey") + 1).where("n_nationkey < 24")
    near = nation.select(F.concat_ws("-", F.lit("NEXT"), "n_nationkey").alias("id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("next").cast("string")).alias("dst"), F.lit("NEXT").alias("type"))
    e = edges("nation", "n_nationkey", "n_regionkey", "n", "r", "IN").union(edges("customer", "c_custkey", "c_nationkey", "c", "n", "IN")).union(edges("supplier", "s_suppkey", "s_nationkey", "s", "n", "IN")).union(near)
    return n, e


def sql(name: str, text: str, oracle: str | None = None, **params: object) -> None:
    """Registers a query in the dialect; where DuckDB reads the same text it is its own check."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, text).query(text, params=params)
    ORACLE_SQL[name] = oracle or text


def cypher(name: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, text, True).query(text, "cypher")
    ORACLE_SQL[name] = oracle


# scans, projections, predicates
sql("scan_project", "SELECT c_custkey AS k, c_name AS n, c_acctbal * 2 AS b FROM customer")
sql("filter_3vl", "SELECT c_custkey AS k FROM customer WHERE NOT (nullif(c_nationkey, 3) = 5 AND c_acctbal > 0) OR nullif(c_nationkey, 3) IS NULL")
sql("between_in_like", "SELECT p_partkey AS k, p_name AS n FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type IN ('PROMO', 'SMALL') AND p_brand LIKE 'Brand#1%'")
sql("not_like_ilike", "SELECT p_partkey AS k FROM part WHERE p_brand NOT LIKE '%2' AND p_type ILIKE '%eco%'")
sql("is_distinct_from", "SELECT c_custkey AS k FROM customer WHERE nullif(c_nationkey, 3) IS DISTINCT FROM 4 AND (c_acctbal > 0) IS NOT FALSE")
sql("null_source", "SELECT 1 + 2 AS a, 'x' || 'y' AS b")
sql("arithmetic", "SELECT o_orderkey AS k, o_orderkey // 7 AS q, o_orderkey % 7 AS r, o_orderkey / 0 AS z, 2 ^ 3 AS p FROM orders", "SELECT o_orderkey AS k, (o_orderkey // 7)::BIGINT AS q, o_orderkey % 7 AS r, NULL::DOUBLE AS z, 8.0::DOUBLE AS p FROM orders")
sql("values_clause", "SELECT v.a AS a, v.b AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
sql("params", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = :seg AND c_acctbal > ?low", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000", seg="BUILDING", low=1000)
sql("statements", "SELECT 1 AS a; SELECT n_name AS n FROM nation", "SELECT n_name AS n FROM nation")
# joins
sql("inner_comma_join", "SELECT c.c_custkey AS k, n.n_name AS n FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey")
sql("left_join_on_extra", "SELECT c.c_custkey AS k, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey")
sql("right_join", "SELECT o.o_orderkey AS o, c.c_custkey AS c FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT'")
sql("full_join_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a FULL OUTER JOIN region b ON a.n_regionkey = b.r_regionkey AND a.n_nationkey > b.r_regionkey * 7")
sql("using_join", "SELECT k AS k, a.x AS x, b.y AS y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b USING (k)")
sql("self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("cross_join", "SELECT r.r_name AS a, q.r_name AS b FROM region r, region q")
sql("lateral_topk", "SELECT c.c_custkey AS k, t.o AS o, t.p AS p FROM customer c JOIN LATERAL (SELECT o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) t ON TRUE", "SELECT o_custkey AS k, o_orderkey AS o, o_totalprice AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
sql("left_lateral", "SELECT n.n_name AS n, t.s AS s FROM nation n LEFT JOIN LATERAL (SELECT s_suppkey AS s FROM supplier WHERE s_nationkey = n.n_nationkey AND s_acctbal > 5000) t ON TRUE", "SELECT n_name AS n, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
sql("semi_exists", "SELECT c.c_custkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
sql("anti_not_exists", "SELECT c.c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
sql("in_subquery", "SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("not_in", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_acctbal > 0")
sql("not_in_null", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)")
sql("not_in_empty", "SELECT n_nationkey AS k FROM nation WHERE nullif(n_nationkey, 3) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 100)")
sql("not_in_value", "SELECT n_nationkey AS k, n_nationkey NOT IN (SELECT nullif(r_regionkey, 0) FROM region) AS b FROM nation")
sql("quant_any", "SELECT p_partkey AS k FROM part WHERE p_size = ANY (SELECT n_nationkey FROM nation)")
sql("quant_all_gt", "SELECT p_partkey AS k FROM part WHERE p_size > ALL (SELECT n_nationkey FROM nation)")
sql("quant_all_empty", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 100)")
sql("quant_any_ne", "SELECT p_partkey AS k FROM part WHERE p_size <> SOME (SELECT r_regionkey FROM region) AND p_size < ANY (SELECT n_nationkey FROM nation)")
sql("scalar_corr", "SELECT l.l_partkey AS k, round(sum(l.l_extendedprice) / 7, 2) AS s FROM lineitem l WHERE l.l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey) GROUP BY l.l_partkey")
sql("scalar_uncorr_having", "SELECT l_suppkey AS k, sum((l_extendedprice)::decimal(22,6))::double AS s FROM lineitem GROUP BY l_suppkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.0105 FROM lineitem)")
# aggregation
sql("group_basic", "SELECT l_returnflag AS f, count(*) AS n, sum((l_quantity)::decimal(22,6))::double AS q, round(avg(l_discount), 6) AS d, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag")
sql("having", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 50 AND max(c_acctbal) > 9000")
sql("count_distinct", "SELECT l_returnflag AS f, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
sql("filter_agg", "SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') AS m FROM orders GROUP BY o_custkey")
sql("agg_over_empty", "SELECT count(*) AS n, sum(n_nationkey) AS s, avg(n_nationkey) AS a FROM nation WHERE n_nationkey > 1000", "SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS s, avg(n_nationkey) AS a FROM nation WHERE n_nationkey > 1000")
sql("group_as_distinct", "SELECT c_nationkey AS k, c_mktsegment AS m FROM customer GROUP BY c_nationkey, c_mktsegment")
sql("hidden_aggregate_order", "SELECT c_nationkey AS k FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 10")
sql("collect_ordered", "SELECT n_regionkey AS k, array_join(collect(n_name ORDER BY n_name DESC), ',') AS ns FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name DESC) AS ns FROM nation GROUP BY 1")
sql("collect_nulls", "SELECT n_regionkey AS k, array_join(collect(nullif(n_nationkey, 3) ORDER BY n_nationkey), ',', '-') AS ns FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, string_agg(coalesce(nullif(n_nationkey, 3)::VARCHAR, '-'), ',' ORDER BY n_nationkey) AS ns FROM nation GROUP BY 1")
sql("rollup", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
# order, distinct, limit
sql("distinct_all", "SELECT DISTINCT p_type AS t, p_brand AS b FROM part")
sql("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey AS c, o_orderkey AS o FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
sql("topk", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("offset_limit", "SELECT p_partkey AS k FROM part ORDER BY p_size, p_partkey LIMIT 15 OFFSET 30")
sql("order_nulls", "SELECT n_nationkey AS k FROM nation ORDER BY nullif(n_regionkey, 2), n_nationkey LIMIT 22", "SELECT n_nationkey AS k FROM nation ORDER BY nullif(n_regionkey, 2) NULLS LAST, n_nationkey LIMIT 22")
sql("order_nulls_desc", "SELECT n_nationkey AS k FROM nation ORDER BY nullif(n_regionkey, 2) DESC, n_nationkey LIMIT 7", "SELECT n_nationkey AS k FROM nation ORDER BY nullif(n_regionkey, 2) DESC NULLS FIRST, n_nationkey LIMIT 7")
# sets
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql(_name, f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 20")
sql("set_associativity", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey < 2")
sql("set_parentheses", "SELECT n_nationkey AS k FROM nation EXCEPT (SELECT r_regionkey FROM region INTERSECT (SELECT c_nationkey FROM customer WHERE c_nationkey > 2))")
sql("set_order", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey AS k FROM region ORDER BY k LIMIT 9")
# common table expressions
sql("cte_inline", "WITH t AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT a.k AS k, a.n AS n FROM t a JOIN t b ON a.n = b.n AND a.k <> b.k")
sql("cte_materialized", "WITH r(k, v) AS MATERIALIZED (SELECT l_suppkey, sum(l_quantity) FROM lineitem GROUP BY l_suppkey) SELECT k AS k, v AS v FROM r WHERE v = (SELECT max(v) FROM r)")
sql("recursive_cte_all", "WITH RECURSIVE t(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 50) SELECT n AS n, s AS s FROM t")
sql("recursive_cte_deep", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 1000) SELECT count(*) AS c, sum(n) AS s FROM t", "SELECT 1000::BIGINT AS c, 500500::BIGINT AS s")
sql("recursive_cte_orders", "WITH RECURSIVE t(k) AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 350000 UNION SELECT o.o_orderkey FROM t, orders o WHERE o.o_orderkey = t.k // 2 AND o.o_orderstatus <> 'P') SELECT k AS k FROM t")
sql("recursive_cte_shadows", "WITH RECURSIVE big AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 20), region(k) AS (SELECT k FROM big UNION SELECT k // 2 FROM region) SELECT k AS k FROM region", "WITH RECURSIVE big AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 20), t(k) AS (SELECT k::BIGINT FROM big UNION SELECT k // 2 FROM t) SELECT k AS k FROM t")
sql("recursive_cte_distinct", "WITH RECURSIVE t(a) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT (a * 7 + 2) % 25 FROM t) SELECT a AS a FROM t")
# values
sql("case_expr", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS s, CASE p_type WHEN 'PROMO' THEN 1 ELSE 0 END AS p FROM part")
sql("cast_try", "SELECT p_partkey AS k, p_brand::number AS b, p_size::text AS s, CAST(p_size AS number) AS d FROM part", "SELECT p_partkey AS k, TRY_CAST(p_brand AS DOUBLE) AS b, p_size::VARCHAR AS s, p_size::DOUBLE AS d FROM part")
sql("subscript_slice", "SELECT a[0] AS x, a[5] AS y, array_join(a[1:3], '-') AS z FROM (SELECT ARRAY[n_nationkey, n_regionkey, 7] AS a FROM nation) t", "SELECT n_nationkey AS x, NULL::INTEGER AS y, n_regionkey || '-7' AS z FROM nation")
sql("struct_row", "SELECT r.a AS a, r.b AS b FROM (SELECT ROW(n_name AS a, n_regionkey AS b) AS r FROM nation) t", "SELECT n_name AS a, n_regionkey AS b FROM nation")
sql("array_subquery", "SELECT t.n AS n, array_join(array_sort(t.a), ',') AS ns FROM (SELECT r.r_name AS n, ARRAY(SELECT n.n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS a FROM region r) t", "SELECT r_name AS n, string_agg(n_name, ',' ORDER BY n_name) AS ns FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
sql("unwind_ordinality", "SELECT n.n_name AS n, u.v AS v, u.i AS i FROM nation n, unwind(ARRAY[n.n_regionkey, n.n_nationkey]) WITH ORDINALITY u(v, i)", "SELECT n_name AS n, n_regionkey AS v, 1 AS i FROM nation UNION ALL SELECT n_name, n_nationkey, 2 FROM nation")
sql("json_access", "SELECT event_id AS k, (props::json -> 'k')::number AS v FROM events", "SELECT event_id AS k, TRY_CAST(props ->> 'k' AS DOUBLE) AS v FROM events")
sql("deep_match", "SELECT n_name AS n FROM (SELECT n_name, ARRAY[n_regionkey, n_nationkey] AS a FROM nation) t WHERE a @> ARRAY[1]", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1 OR n_nationkey = 1")
sql("date_add_sub_extract", "SELECT o_orderkey AS k, date.extract(o_orderdate, 'year') AS y, date.extract(date.add(o_orderdate, interval('1 month 3 days')), 'day') AS d FROM orders WHERE o_orderdate < date.sub('1996-01-01'::date, interval('2 weeks'))", "SELECT o_orderkey AS k, extract(year FROM o_orderdate)::INTEGER AS y, extract(day FROM o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY)::INTEGER AS d FROM orders WHERE o_orderdate < TIMESTAMP '1995-12-18'")
sql("string_functions", "SELECT n_name AS n, substr(n_name, 2, 3) AS s, slice(n_name, -3, -1) AS t, coalesce(nullif(n_name, 'FRANCE'), 'none') AS c FROM nation", "SELECT n_name AS n, substr(n_name, 2, 3) AS s, n_name[greatest(length(n_name) - 2, 1) : length(n_name) - 1] AS t, coalesce(nullif(n_name, 'FRANCE'), 'none') AS c FROM nation")
# the subset of the warehouse benchmark whose columns exist here
_REVENUE = "l.l_extendedprice * (1 - l.l_discount)"
sql("tpch_q1", "SELECT l_returnflag AS f, l_linestatus AS s, sum((l_quantity)::decimal(22,6))::double AS q, sum((l_extendedprice)::decimal(22,6))::double AS b, sum((l_extendedprice * (1 - l_discount))::decimal(22,6))::double AS d, sum((l_extendedprice * (1 - l_discount) * (1 + l_tax))::decimal(22,6))::double AS c, round(avg(l_quantity), 4) AS aq, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02'::date GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag AS f, l_linestatus AS s, sum((l_quantity)::decimal(22,6))::double AS q, sum((l_extendedprice)::decimal(22,6))::double AS b, sum((l_extendedprice * (1 - l_discount))::decimal(22,6))::double AS d, sum((l_extendedprice * (1 - l_discount) * (1 + l_tax))::decimal(22,6))::double AS c, round(avg(l_quantity), 4) AS aq, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
_Q3 = "SELECT l.l_orderkey AS l_orderkey, o.o_orderdate AS o_orderdate, sum(({r})::decimal(22,6))::double AS revenue FROM customer c, orders o, lineitem l WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate < {d} GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l.l_orderkey LIMIT 10"


def dated(name: str, text: str) -> None:
    """Dates stand as {day} and years as {year:column}: the dialect writes them in its own way."""
    mine = re.sub(r"\{year:([\w.]+)\}", r"date.extract(\1, 'year')", re.sub(r"\{(\d{4}-\d\d-\d\d)\}", r"'\1'::date", text))
    theirs = re.sub(r"\{year:([\w.]+)\}", r"extract(year FROM \1)::INTEGER", re.sub(r"\{(\d{4}-\d\d-\d\d)\}", r"TIMESTAMP '\1'", text))
    sql(name, mine, theirs)


dated("tpch_q3", _Q3.format(r=_REVENUE, d="{1998-01-01} AND l.l_shipdate > {1998-01-01}"))
dated("tpch_q5", f"SELECT n.n_name AS n, sum(({_REVENUE})::decimal(22,6))::double AS revenue FROM customer c, orders o, lineitem l, supplier s, nation n, region r WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA' AND o.o_orderdate >= {{1997-01-01}} AND o.o_orderdate < {{1998-01-01}} GROUP BY n.n_name")
dated("tpch_q6", "SELECT sum((l_extendedprice * l_discount)::decimal(22,6))::double AS revenue FROM lineitem WHERE l_shipdate >= {1997-01-01} AND l_shipdate < {1998-01-01} AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
dated("tpch_q7", f"SELECT t.a AS a, t.b AS b, t.y AS y, sum((t.v)::decimal(22,6))::double AS revenue FROM (SELECT x.n_name AS a, z.n_name AS b, {{year:l.l_shipdate}} AS y, {_REVENUE} AS v FROM supplier s, lineitem l, orders o, customer c, nation x, nation z WHERE s.s_suppkey = l.l_suppkey AND o.o_orderkey = l.l_orderkey AND c.c_custkey = o.o_custkey AND s.s_nationkey = x.n_nationkey AND c.c_nationkey = z.n_nationkey AND (x.n_name = 'NATION_6' AND z.n_name = 'NATION_7' OR x.n_name = 'NATION_7' AND z.n_name = 'NATION_6') AND l.l_shipdate BETWEEN {{1996-01-01}} AND {{1999-12-31}}) t GROUP BY t.a, t.b, t.y")
dated("tpch_q8", f"SELECT t.y AS y, round(sum(CASE WHEN t.n = 'NATION_7' THEN t.v ELSE 0 END) / sum(t.v), 6) AS share FROM (SELECT {{year:o.o_orderdate}} AS y, {_REVENUE} AS v, m.n_name AS n FROM part p, supplier s, lineitem l, orders o, customer c, nation x, nation m, region r WHERE p.p_partkey = l.l_partkey AND s.s_suppkey = l.l_suppkey AND l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = x.n_nationkey AND x.n_regionkey = r.r_regionkey AND r.r_name = 'AMERICA' AND s.s_nationkey = m.n_nationkey AND o.o_orderdate BETWEEN {{1997-01-01}} AND {{1998-12-31}} AND p.p_type = 'ECONOMY') t GROUP BY t.y")
dated("tpch_q10", f"SELECT c.c_custkey AS k, c.c_name AS n, sum(({_REVENUE})::decimal(22,6))::double AS revenue FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate >= {{1997-10-01}} AND o.o_orderdate < {{1998-01-01}} AND l.l_returnflag = 'R' GROUP BY c.c_custkey, c.c_name ORDER BY revenue DESC, k LIMIT 20")
sql("tpch_q13", "SELECT t.n AS n, count(*) AS customers FROM (SELECT c.c_custkey AS k, count(o.o_orderkey) AS n FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority <> '5-LOW' GROUP BY c.c_custkey) t GROUP BY t.n")
dated("tpch_q14", f"SELECT round(100.0 * sum(CASE WHEN p.p_type LIKE 'PROMO%' THEN {_REVENUE} ELSE 0 END) / sum({_REVENUE}), 6) AS promo FROM lineitem l, part p WHERE l.l_partkey = p.p_partkey AND l.l_shipdate >= {{1997-09-01}} AND l.l_shipdate < {{1997-10-01}}")
dated("tpch_q15", "WITH r(k, v) AS MATERIALIZED (SELECT l_suppkey, sum((l_extendedprice * (1 - l_discount))::decimal(22,6))::double FROM lineitem WHERE l_shipdate >= {1997-01-01} AND l_shipdate < {1997-04-01} GROUP BY l_suppkey) SELECT s.s_suppkey AS k, s.s_name AS n, r.v AS v FROM supplier s, r WHERE s.s_suppkey = r.k AND r.v = (SELECT max(v) FROM r)")
sql("tpch_q17", "SELECT round(sum(l.l_extendedprice) / 7.0, 2) AS y FROM lineitem l, part p WHERE p.p_partkey = l.l_partkey AND p.p_type = 'PROMO' AND l.l_quantity < (SELECT 0.4 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p.p_partkey)")
sql("tpch_q18", "SELECT o.o_orderkey AS k, sum((l.l_quantity)::decimal(22,6))::double AS q FROM orders o, lineitem l WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180) AND o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
sql("tpch_q19", f"SELECT sum(({_REVENUE})::decimal(22,6))::double AS revenue FROM lineitem l, part p WHERE (p.p_partkey = l.l_partkey AND p.p_brand LIKE 'Brand#1%' AND l.l_quantity BETWEEN 1 AND 11 AND p.p_size BETWEEN 1 AND 5) OR (p.p_partkey = l.l_partkey AND p.p_brand LIKE 'Brand#2%' AND l.l_quantity BETWEEN 10 AND 20 AND p.p_size BETWEEN 1 AND 10)")
sql("tpch_q22", "SELECT c.c_nationkey AS k, count(*) AS n, sum((c.c_acctbal)::decimal(22,6))::double AS s FROM customer c WHERE c.c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) GROUP BY c.c_nationkey")

# graphs: customers and suppliers lie in nations, nations in regions, and each nation has a next one
cypher("cy_match_1hop", "MATCH (c:Customer)-[r:IN]->(n:Nation {name: 'NATION_3'}) RETURN c.name AS c, type(r) AS t", "SELECT c_name AS c, 'IN' AS t FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
cypher("cy_match_2hop", "MATCH (s:Supplier)-[:IN]->(n:Nation)-[:IN]->(r:Region) WHERE s.balance > 9000 RETURN s.name AS s, n.name AS n, r.name AS r", "SELECT s_name AS s, n_name AS n, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 9000")
cypher("cy_undirected", "MATCH (a:Nation)-[:NEXT]-(b:Nation) RETURN a.name AS a, b.name AS b", "SELECT p.n_name AS a, q.n_name AS b FROM nation p JOIN nation q ON abs(p.n_nationkey - q.n_nationkey) = 1")
cypher("cy_two_types", "MATCH (a:Nation)-[r:NEXT|IN]->(b) RETURN a.name AS a, b.name AS b, type(r) AS t", "SELECT n_name AS a, r_name AS b, 'IN' AS t FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT p.n_name, q.n_name, 'NEXT' FROM nation p JOIN nation q ON q.n_nationkey = p.n_nationkey + 1")
cypher("cy_optional", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:IN]->(n) WHERE s.balance > 8000 RETURN n.name AS n, s.name AS s", "SELECT n_name AS n, s_name AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000")
cypher("cy_pattern_pred", "MATCH (n:Nation) WHERE (n)-[:NEXT]->(:Nation {name: 'NATION_5'}) OR n.name = 'NATION_9' RETURN n.name AS n", "SELECT n_name AS n FROM nation WHERE n_name IN ('NATION_4', 'NATION_9')")
cypher("cy_exists", "MATCH (n:Nation) WHERE NOT EXISTS { (s:Supplier)-[:IN]->(n) WHERE s.balance > 5000 } RETURN n.name AS n", "SELECT n_name AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
cypher("cy_aggregate", "MATCH (c:Customer)-[:IN]->(n:Nation) RETURN n.name AS n, count(*) AS k, max(c.balance) AS m", "SELECT n_name AS n, count(*) AS k, max(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
cypher("cy_with_pipeline", "MATCH (c:Customer)-[:IN]->(n:Nation) WITH n, count(c) AS k WHERE k > 55 MATCH (n)-[:IN]->(r:Region) RETURN r.name AS r, n.name AS n, k ORDER BY k DESC, n LIMIT 5", "SELECT r_name AS r, n_name AS n, k FROM (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE k > 55 ORDER BY k DESC, n LIMIT 5")
cypher("cy_unwind", "UNWIND [1, 2, 3] AS x UNWIND [10, 20] AS y RETURN x + y AS s, x AS x", "SELECT x + y AS s, x FROM (VALUES (1), (2), (3)) a(x), (VALUES (10), (20)) b(y)")
cypher("cy_quantifiers", "UNWIND [[1, 2], [3, 4], [2, 6]] AS l RETURN l[0] AS a, all(x IN l WHERE x > 1) AS p, any(x IN l WHERE x = 2) AS q, none(x IN l WHERE x > 4) AS r, single(x IN l WHERE x = 3) AS s", "SELECT * FROM (VALUES (1, false, true, true, false), (3, true, false, true, true), (2, true, true, false, false)) t(a, p, q, r, s)")
cypher("cy_list_comp", "MATCH (r:Region) RETURN r.name AS r, size([(n:Nation)-[:IN]->(r) | n.name]) AS k", "SELECT r_name AS r, count(*)::INTEGER AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
cypher("cy_list_filter", "UNWIND [1, 2] AS k RETURN k AS k, [x IN [1, 2, 3, 4] WHERE x > k | x * 10][-1] AS l, 'ab' + 'cd' STARTS WITH 'abc' AS s, k IN [2, 5] AS i", "SELECT k, 40 AS l, true AS s, k = 2 AS i FROM (VALUES (1), (2)) t(k)")
cypher("cy_union", "MATCH (r:Region) RETURN r.name AS n UNION MATCH (x:Region) RETURN x.name AS n", "SELECT r_name AS n FROM region")
cypher("cy_union_all", "MATCH (r:Region) RETURN r.name AS n UNION ALL MATCH (x:Region) RETURN x.name AS n", "SELECT r_name AS n FROM region UNION ALL SELECT r_name FROM region")
cypher("cy_chained", "MATCH (s:Supplier) WHERE 1000 < s.balance <= 4000 XOR s.name CONTAINS '7' RETURN s.name AS s", "SELECT s_name AS s FROM supplier WHERE (1000 < s_acctbal AND s_acctbal <= 4000) <> (s_name LIKE '%7%')")
cypher("cy_varlen_1_3", "MATCH (a:Nation)-[p:NEXT*1..3]->(b:Nation) RETURN a.name AS a, b.name AS b, size(p) AS k", "SELECT x.n_name AS a, y.n_name AS b, y.n_nationkey - x.n_nationkey AS k FROM nation x JOIN nation y ON y.n_nationkey - x.n_nationkey BETWEEN 1 AND 3")
cypher("cy_varlen_zero", "MATCH (a:Nation {name: 'NATION_20'})-[:NEXT*0..2]->(b) RETURN b.name AS b", "SELECT n_name AS b FROM nation WHERE n_nationkey BETWEEN 20 AND 22")
cypher("cy_varlen_any", "MATCH (a:Nation {name: 'NATION_21'})-[p:NEXT*]->(b:Nation) RETURN b.name AS b, size(p) AS k", "SELECT n_name AS b, n_nationkey - 21 AS k FROM nation WHERE n_nationkey > 21")
cypher("cy_shortest", "MATCH (a:Nation {name: 'NATION_2'})-[p:NEXT*..6]-(b:Nation) RETURN b.name AS b, min(size(p)) AS k", "SELECT n_name AS b, abs(n_nationkey - 2) AS k FROM nation WHERE n_nationkey <> 2 AND abs(n_nationkey - 2) <= 6")
cypher("cy_path", "MATCH p = (a:Nation {name: 'NATION_1'})-[:IN]->(r:Region) RETURN size(p.nodes) AS n, length(p) AS e", "SELECT 2 AS n, 1 AS e")


cypher("cy_between_two", "MATCH (a:Nation {name: 'NATION_3'})-[p:NEXT*1..8]-(b:Nation {name: 'NATION_9'}) RETURN size(p) AS k, p[0].id AS first", "SELECT 6 AS k, 'NEXT-3' AS first")
cypher("cy_optional_two", "MATCH (r:Region) OPTIONAL MATCH (r)<-[e:IN]-(n:Nation)<-[:IN]-(s:Supplier) WHERE s.balance > 9500 RETURN r.name AS r, n.name AS n, s.name AS s, type(e) AS t", "SELECT r_name AS r, n_name AS n, s_name AS s, CASE WHEN s_name IS NOT NULL THEN 'IN' END AS t FROM region LEFT JOIN (SELECT * FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9500) ON n_regionkey = r_regionkey")
cypher("cy_ends_and_labels", "MATCH (n:Nation)-[e:IN]->(r:Region) WHERE n:Nation AND r.name = 'ASIA' RETURN startNode(e).name AS a, endNode(e).name AS b, labels(r)[0] AS l", "SELECT n_name AS a, r_name AS b, 'Region' AS l FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
cypher("cy_lists_added", "MATCH (r:Region) WITH r.name AS r, [r.name] AS a, r.labels AS b RETURN r, size(a + b) AS k, (a + b)[1] AS l", "SELECT r_name AS r, 2 AS k, 'Region' AS l FROM region")
cypher("cy_map_projection", "MATCH (r:Region) WITH r {.name, size: size(r.labels)} AS m RETURN m.name AS n, m.size AS s", "SELECT r_name AS n, 1 AS s FROM region")
cypher("cy_from_graph", "FROM shop MATCH (r:Region) RETURN r.name AS n", "SELECT r_name AS n FROM region")
cypher("cy_call", "MATCH (n:Nation)-[:IN]->(r:Region {name: 'ASIA'}) CALL explode(n.labels) YIELD col AS l RETURN n.name AS n, l", "SELECT n_name AS n, 'Nation' AS l FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
QUERIES["cy_param"] = lambda spark, sf_dir: engine(spark, sf_dir, "", True).query("MATCH (r:Region) WHERE r.name IN $names RETURN r.name AS n", "cypher", {"names": ["ASIA", "EUROPE"]})
ORACLE_SQL["cy_param"] = "SELECT r_name AS n FROM region WHERE r_name IN ('ASIA', 'EUROPE')"


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, orders, parts and events; who placed an order, what it holds, and the next event of the same user."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda t, p, k, label, n, price: read(t).select(key(p, k).alias("id"), F.array(F.lit(label)).alias("labels"), F.col(n).cast("string").alias("name"), F.expr(price).cast("double").alias("price"))
    nodes = node("customer", "c", "c_custkey", "Customer", "c_name", "c_acctbal").union(node("orders", "o", "o_orderkey", "Order", "o_orderstatus", "o_totalprice")).union(node("part", "p", "p_partkey", "Part", "p_brand", "p_retailprice")).union(node("events", "e", "event_id", "Event", "event_type", "value"))
    edge = lambda df, src, dst, kind: df.select(F.concat_ws("-", F.lit(kind), src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    later = read("events").withColumn("then", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("then IS NOT NULL")
    placed, holds = edge(read("orders"), key("c", "o_custkey"), key("o", "o_orderkey"), "PLACED"), edge(read("lineitem").select("l_orderkey", "l_partkey").distinct(), key("o", "l_orderkey"), key("p", "l_partkey"), "HOLDS")
    return nodes, placed.union(holds).union(edge(later, key("e", "event_id"), key("e", "then"), "NEXT"))


def trading(name: str, text: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.register_graph("trade", *trade(spark, sf_dir))
        return e.query(text, "cypher")

    QUERIES[name], ORACLE_SQL[name] = run, oracle


trading("cy_orders_2hop", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:HOLDS]->(p:Part) WHERE p.price > 905 AND o.price > 100000 RETURN c.name AS c, count(DISTINCT p.id) AS k, max(o.price) AS m", "SELECT c_name AS c, count(DISTINCT p_partkey) AS k, max(o_totalprice) AS m FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_retailprice > 905 AND o_totalprice > 100000 GROUP BY 1")
trading("cy_orders_varlen", "MATCH (c:Customer)-[r:PLACED|HOLDS*2..2]->(p:Part) WHERE c.price > 5000 RETURN p.name AS b, count(*) AS k", "SELECT p_brand AS b, count(*) AS k FROM customer JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_acctbal > 5000 GROUP BY 1")
trading("cy_events_varlen", "MATCH (a:Event {name: 'signup'})-[r:NEXT*1..3]->(b:Event) WHERE b.name = 'purchase' RETURN size(r) AS steps, count(*) AS k", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT (b.i - a.i)::INTEGER AS steps, count(*) AS k FROM e a JOIN e b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 1 AND 3 WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY 1")
trading("cy_optional_orders", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.price > 450000 RETURN c.name AS c, count(o) AS k", "SELECT c_name AS c, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 GROUP BY 1")


def nested(name: str, text: str, oracle: str, lang: str = "sql") -> None:
    """One language inside another, over the same session."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, text, True).query(text, lang)
    ORACLE_SQL[name] = oracle


nested("lang_sql_cypher", "SELECT n.n_name AS n, g.k AS k FROM nation n JOIN (LANG cypher MATCH (c:Customer)-[:IN]->(x:Nation) RETURN x.name AS name, count(*) AS k) g ON g.name = n.n_name WHERE n.n_regionkey = 2", "SELECT n_name AS n, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1")
nested("lang_sql_in_cypher", "SELECT n_nationkey AS k FROM nation WHERE n_name IN (LANG cypher MATCH (a:Nation {name: 'NATION_4'})-[:NEXT*1..2]->(b) RETURN b.name AS b)", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (5, 6)")
nested("lang_cypher_sql", "UNWIND (LANG SQL SELECT n_name AS v FROM nation WHERE n_regionkey = 1) AS v MATCH (n:Nation {name: v})-[:NEXT]->(m) RETURN n.name AS n, m.name AS m", "SELECT a.n_name AS n, b.n_name AS m FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_regionkey = 1", "cypher")


def atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region, with its nations and how many customers they have."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    n = read("customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    nation = read("nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    one = F.format_string('<nation id="%d" customers="%d"><name>%s</name></nation>', "n_nationkey", F.coalesce("k", F.lit(0)), "n_name")
    inner = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("x")))), lambda s: s["x"]), "").alias("inner"))
    region = read("region").join(inner, F.col("r_regionkey") == F.col("n_regionkey"))
    return region.select(F.col("r_regionkey").cast("string").alias("doc"), F.concat(F.format_string('<region id="%d" name="%s">', "r_regionkey", "r_name"), "inner", F.lit("</region>")).alias("xml"))


def xquery(name: str, text: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, text)
        e.register_xml("atlas", atlas(spark, sf_dir))
        return e.query(text, "sql" if text.lstrip().upper().startswith("SELECT") else "xquery")

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle


xquery("xq_sequence", "(1, 2, 3, 4 to 6)[. mod 2 = 0]", "SELECT * FROM (VALUES (2), (4), (6)) t(value)")
xquery("xq_range_pred", "(10 to 20)[position() = 3 or position() = last()]", "SELECT * FROM (VALUES (12), (20)) t(value)")
xquery("xq_path", "$atlas/region/nation/name", "SELECT '<name>' || n_name || '</name>' AS value FROM nation")
xquery("xq_attribute", "$atlas//nation[@customers > 60]/@id", "SELECT c_nationkey::VARCHAR AS value FROM customer GROUP BY c_nationkey HAVING count(*) > 60")
xquery("xq_axes", "for $n in $atlas//nation[name = 'NATION_7'] return ($n/../@name, $n/ancestor::region/@id, count($n/following-sibling::nation), $n/descendant-or-self::nation/@id)[. != 'none']", "SELECT r_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 7 UNION ALL SELECT r_regionkey::VARCHAR FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 7 UNION ALL SELECT count(*)::VARCHAR FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 7 AND b.n_nationkey > 7 UNION ALL SELECT '7'")
xquery("xq_positional", "$atlas/region/nation[2]/@id", "SELECT n_nationkey::VARCHAR AS value FROM (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation) WHERE p = 2")
xquery("xq_last", "$atlas/region/nation[last()]/preceding-sibling::nation[1]/@id", "SELECT n_nationkey::VARCHAR AS value FROM (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS p FROM nation) WHERE p = 2")
xquery("xq_flwor", "for $n in $atlas//nation let $c := $n/@customers where $c > 55 order by number($c) descending return $n/name || ':' || $c", "SELECT n_name || ':' || count(*) AS value FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 55")
xquery("xq_flwor_group", "for $n in $atlas//nation group by $big := $n/@customers > 60 return count($n)", "SELECT count(*)::INTEGER AS value FROM (SELECT c_nationkey, count(*) > 60 AS b FROM customer GROUP BY 1) GROUP BY b")
xquery("xq_quantified", "for $r in $atlas/region where some $c in $r/nation/@customers satisfies $c > 70 return $r/@name", "SELECT DISTINCT r_name AS value FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) ON c_nationkey = n_nationkey WHERE k > 70")
xquery("xq_constructor", 'for $r in $atlas/region return <r n="{$r/@name}">{sum($r/nation/@customers)}</r>', """SELECT '<r n="' || r_name || '">' || count(*) || '</r>' AS value FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer, with the orders in the order of their keys."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    one = F.format_string('<order id="%d" total="%s" status="%s"><priority>%s</priority></order>', "o_orderkey", F.col("o_totalprice").cast("string"), "o_orderstatus", "o_orderpriority")
    inner = read("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("x")))), lambda s: s["x"]), "").alias("inner"))
    rows = read("customer").join(inner, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").cast("string").alias("doc"), F.concat(F.format_string('<customer id="%d" segment="%s">', "c_custkey", "c_mktsegment"), F.coalesce("inner", F.lit("")), F.lit("</customer>")).alias("xml"))


def ledgers(name: str, text: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.register_xml("ledger", ledger(spark, sf_dir))
        return e.query(text, "xquery")

    QUERIES[name], ORACLE_SQL[name] = run, oracle


ledgers("xq_orders_path", "$ledger/customer/order[@total > 400000]/@id", "SELECT o_orderkey::VARCHAR AS value FROM orders WHERE o_totalprice > 400000")
ledgers("xq_orders_flwor", "for $c in $ledger/customer let $o := $c/order[@status = 'F'] where count($o) > 5 order by number($c/@id) return $c/@id || ':' || count($o)", "SELECT o_custkey || ':' || count(*) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) > 5")
ledgers("xq_orders_group", "for $o in $ledger//order group by $p := $o/priority return $p || ' ' || count($o)", "SELECT o_orderpriority || ' ' || count(*) AS value FROM orders GROUP BY o_orderpriority")
ledgers("xq_orders_sibling", "$ledger/customer/order[@status = 'P']/following-sibling::order[1]/@id", "SELECT DISTINCT t::VARCHAR AS value FROM (SELECT o_orderstatus AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders) WHERE s = 'P' AND t IS NOT NULL")
_IN = "FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 7"
for _axis, _step, _oracle in (
    ("child", "child::name", "SELECT 'NATION_7' AS value"),
    ("parent", "parent::region/@id", "SELECT n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey = 7"),
    ("self", "self::nation/@id", "SELECT '7' AS value"),
    ("attribute", "attribute::id", "SELECT '7' AS value"),
    ("descendant", "descendant::text()", "SELECT 'NATION_7' AS value"),
    ("descendant_or_self", "descendant-or-self::name", "SELECT 'NATION_7' AS value"),
    ("ancestor", "ancestor::region/@id", "SELECT n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey = 7"),
    ("ancestor_or_self", "ancestor-or-self::nation/@id", "SELECT '7' AS value"),
    ("following", "following::nation/@id", f"SELECT b.n_nationkey::VARCHAR AS value {_IN} AND b.n_nationkey > 7"),
    ("following_sibling", "following-sibling::nation/@id", f"SELECT b.n_nationkey::VARCHAR AS value {_IN} AND b.n_nationkey > 7"),
    ("preceding", "preceding::nation/@id", f"SELECT b.n_nationkey::VARCHAR AS value {_IN} AND b.n_nationkey < 7"),
    ("preceding_sibling", "preceding-sibling::nation/@id", f"SELECT b.n_nationkey::VARCHAR AS value {_IN} AND b.n_nationkey < 7"),
):
    xquery(f"xq_axis_{_axis}", f"for $n in $atlas//nation[name = 'NATION_7'] for $x in $n/{_step} return string($x)", _oracle)
xquery("xq_set_values", "((1 to 3) union (2 to 4), (1 to 5) except (2 to 3), (1 to 5) intersect (4 to 9))", "SELECT * FROM (VALUES (1), (2), (3), (4), (1), (4), (5), (4), (5)) t(value)")
xquery("xq_set_nodes", "for $r in $atlas/region for $n in ($r/nation[@id > 20] | $r/nation[@id < 2]) except $r/nation[@id = 1] return string($n/@id)", "SELECT n_nationkey::VARCHAR AS value FROM nation WHERE n_nationkey > 20 OR n_nationkey = 0")
xquery("xq_if_switch", "for $n in $atlas//nation return (if ($n/@id < 3) then 'low' else 'high', switch ($n/@id) case '4' return 'four' default return 'other')", "SELECT unnest([CASE WHEN n_nationkey < 3 THEN 'low' ELSE 'high' END, CASE WHEN n_nationkey = 4 THEN 'four' ELSE 'other' END]) AS value FROM nation")
xquery("xq_cast_and_map", "for $n in $atlas//nation where $n/@id cast as xs:integer > 20 and not(empty($n/name)) or $n/@id = '3' return ($n/@id ! number(.)) + 1", "SELECT (n_nationkey + 1)::DOUBLE AS value FROM nation WHERE n_nationkey > 20 OR n_nationkey = 3")
xquery("xq_at_allowing_empty", "for $r in $atlas/region[@id < 2] for $x allowing empty at $i in $r/nation[@id > 20]/@id return $r/@id || ':' || $i || ':' || $x", "SELECT r || ':' || CASE WHEN v IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY r ORDER BY v) END || ':' || coalesce(v::VARCHAR, '') AS value FROM (SELECT r_regionkey AS r, n_nationkey AS v FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 20 WHERE r_regionkey < 2)")
xquery("xq_node_order", "for $r in $atlas/region for $a in $r/nation for $b in $r/nation where $a << $b and not($a is $b) return $a/@id || '-' || $b/@id", "SELECT a.n_nationkey || '-' || b.n_nationkey AS value FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
xquery("xq_aggregates", "for $r in $atlas/region return (min($r/nation/name), max($r/nation/@id), string(boolean($r/nation)), string(exists($r/x)))", "SELECT unnest([min(n_name), max(n_nationkey)::VARCHAR, 'true', 'false']) AS value FROM nation GROUP BY n_regionkey")
xquery("lang_sql_xquery", "SELECT n.n_regionkey AS r, count(*) AS k FROM nation n WHERE n.n_name IN (LANG xquery for $n in $atlas//nation[@id > 9] return string($n/name)) GROUP BY n.n_regionkey", "SELECT n_regionkey AS r, count(*) AS k FROM nation WHERE n_nationkey > 9 GROUP BY 1")
xquery("lang_xquery_sql", "for $x in (LANG SQL SELECT r_name FROM region WHERE r_regionkey < 2) return <r>{$x}</r>", "SELECT '<r>' || r_name || '</r>' AS value FROM region WHERE r_regionkey < 2")
nested("lang_correlated_lateral", "SELECT n.n_name AS n, g.k AS k FROM nation n, (LANG cypher MATCH (c:Customer)-[:IN]->(x:Nation) WHERE x.name = n.n_name AND c.balance > 9000 RETURN c.name AS k) g", "SELECT n_name AS n, c_name AS k FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
nested("lang_correlated_exists", "SELECT n.n_name AS n FROM nation n WHERE EXISTS (LANG cypher MATCH (s:Supplier)-[:IN]->(x) WHERE x.name = n.n_name AND s.balance > 7000 RETURN s.name AS s)", "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 7000)")
nested("lang_correlated_array", "SELECT t.n AS n, size(t.a) AS k FROM (SELECT n.n_name AS n, ARRAY(LANG cypher MATCH (s:Supplier)-[:IN]->(x) WHERE x.name = n.n_name RETURN s.name AS s) AS a FROM nation n) t", "SELECT n_name AS n, count(s_suppkey)::INTEGER AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")


def _extended(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    """An engine with a user's function, aggregate and table function."""
    from .functions.samples import Digits, shifted, spread

    e = engine(spark, sf_dir, text)
    e.registry.function("shifted", shifted)
    e.registry.aggregate("spread", spread)
    e.registry.table_function("digits", Digits)
    e.registry.builder("squared", lambda x: f"({x} * {x})")
    e.registry.fold("weighted", "named_struct('s', 0D, 'w', 0D)", lambda acc, x, w: f"named_struct('s', {acc}.s + {x} * {w}, 'w', {acc}.w + {w})", lambda acc: f"round({acc}.s / {acc}.w, 6)")
    e.registry.bundle({"cast": {"cents": lambda x: f"cast(round({x} * 100) AS BIGINT)"}, "operator": {"<->": lambda a, b: f"abs({a} - {b})"}, "builder": {"twice": lambda x: f"({x} + {x})"}})
    e.register_language("keys", lambda e, text, params: e.query(f"SELECT n_nationkey AS k FROM nation WHERE n_regionkey = {int(text)}"))
    return e


def extended(name: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _extended(spark, sf_dir, text).query(text)
    ORACLE_SQL[name] = oracle


extended("udf_scalar", "SELECT c_custkey AS k, shifted(c_acctbal) AS b, squared(c_nationkey) AS s FROM customer", "SELECT c_custkey AS k, c_acctbal + 1 AS b, c_nationkey * c_nationkey AS s FROM customer")
extended("udaf_custom", "SELECT c_nationkey AS k, spread(c_acctbal) AS s FROM customer GROUP BY c_nationkey", "SELECT c_nationkey AS k, max(c_acctbal) - min(c_acctbal) AS s FROM customer GROUP BY 1")
extended("udaf_two_arguments", "SELECT l_returnflag AS f, weighted(l_discount, l_quantity) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag AS f, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS d FROM lineitem GROUP BY 1")
extended("custom_cast", "SELECT c_custkey AS k, c_acctbal::cents AS c, twice(c_nationkey) AS t FROM customer", "SELECT c_custkey AS k, round(c_acctbal * 100)::BIGINT AS c, c_nationkey + c_nationkey AS t FROM customer")
extended("custom_operator", "SELECT n_nationkey AS k, n_nationkey OPERATOR(<->) n_regionkey AS d FROM nation", "SELECT n_nationkey AS k, abs(n_nationkey - n_regionkey) AS d FROM nation")
extended("custom_language", "SELECT c_custkey AS c FROM customer WHERE c_nationkey IN (LANG keys 3)", "SELECT c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 3")
extended("udtf_custom", "SELECT n.n_nationkey AS k, t.d AS d FROM nation n, digits(n.n_nationkey) t", "SELECT n_nationkey AS k, unnest(string_split(n_nationkey::VARCHAR, ''))::INTEGER AS d FROM nation")
sql("default_names", "SELECT n_nationkey, n.n_name, n_regionkey + 1 FROM nation n", 'SELECT n_nationkey, n_name AS "n.n_name", n_regionkey + 1 AS "n_regionkey + 1" FROM nation')
sql("quoted_names", 'SELECT "n_name" AS "a b", `n_regionkey` AS c -- a comment\n FROM nation /* another */ WHERE "n_nationkey" > 3', 'SELECT n_name AS "a b", n_regionkey AS c FROM nation WHERE n_nationkey > 3')
sql("order_alias", "SELECT n_regionkey AS r, count(*) AS k FROM nation GROUP BY n_regionkey ORDER BY k DESC, r DESC LIMIT 3")
sql("cube", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("grouping_sets", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("deep_match_struct", "SELECT t.n AS n FROM (SELECT n_name AS n, ROW(n_regionkey AS a, n_nationkey AS b) AS s FROM nation) t WHERE t.s @> ROW(2 AS a)", "SELECT n_name AS n FROM nation WHERE n_regionkey = 2")
sql("cast_boolean", "SELECT n_nationkey AS k, n_regionkey::boolean AS a, (-n_regionkey) AS b, nullif(n_name, 'NATION_3')::boolean AS c FROM nation", "SELECT n_nationkey AS k, n_regionkey <> 0 AS a, -n_regionkey AS b, n_name <> 'NATION_3' AND n_name IS NOT NULL AS c FROM nation")
sql("now", "SELECT count(*) AS n FROM nation WHERE now() > '2020-01-01'::date", "SELECT 25::BIGINT AS n")
sql("interval_parse", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= date.add('1995-01-01'::date, interval('1-2')) AND o_orderdate < date.add('1996-03-01'::date, interval('5 days 12:00:00'))", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-03-06 12:00:00'")


# sources: what is read was written from a table into the shared folder
def source(name: str, oracle: str):
    def register(run: Callable[[SparkSession, str, str], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, f"{shared_folder(spark)}/source-{uuid.uuid4().hex}")
        ORACLE_SQL[name] = oracle

    return register


@source("src_csv", "SELECT c_custkey AS k, c_name AS n, c_acctbal AS b FROM customer")
def _csv(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal").write.csv(path, sep="|", header=True)
    return files.csv(spark, path, "k long, n string, b double")


@source("src_ndjson", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders")
def _ndjson(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_orderstatus AS s").write.json(path)
    return files.ndjson(spark, path, "k long, s string")


@source("src_graph_json", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def _graph_json(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    nodes, edges = shop(spark, sf_dir)
    graph.write_json(graph.Graph("shop", nodes.where("array_contains(labels, 'Nation') OR array_contains(labels, 'Region')"), edges.where("id LIKE 'IN-n%'")), path)
    e = Engine(spark)
    e.register_graph("again", *graph.read_json(spark, path))
    return e.query("MATCH (n:Nation)-[:IN]->(r:Region) RETURN n.name AS n, r.name AS r", "cypher")


@source("src_csv_edges", "SELECT count(*) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def _csv_edges(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('c', c_custkey) AS a", "concat('n', c_nationkey) AS b").write.csv(path, sep="|", header=True)
    e = Engine(spark)
    e.register_graph("edges", shop(spark, sf_dir)[0], graph.edges_of_csv(spark, path, "LIVES").union(shop(spark, sf_dir)[1].where("type = 'IN' AND id LIKE 'IN-n%'")))
    return e.query("MATCH (c:Customer)-[:LIVES]->(n:Nation)-[:IN]->(r:Region {name: 'AMERICA'}) RETURN count(*) AS k", "cypher")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.register_objects("words", [("one", 1), ("two", 2)], "w string, n int", lambda x: (x[0].upper(), x[1]))
    return e.query("SELECT w.w AS w, n.n_name AS n FROM words w JOIN nation n ON n.n_nationkey = w.n")


QUERIES["src_objects"] = _objects
ORACLE_SQL["src_objects"] = "SELECT w, n_name AS n FROM (VALUES ('ONE', 1), ('TWO', 2)) t(w, i) JOIN nation ON n_nationkey = i"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    e.create_index("orders", "o_custkey")
    return e.query("SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_custkey IN (7, 70, 700)")


QUERIES["index_scan"] = _index
ORACLE_SQL["index_scan"] = "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_custkey IN (7, 70, 700)"
QUERIES["row_index"] = lambda spark, sf_dir: with_index(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), "i", F.desc("o_totalprice"), F.asc("o_orderkey")).select(F.col("o_orderkey").alias("k"), F.col("i").cast("long").alias("i"))
ORACLE_SQL["row_index"] = "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders"
