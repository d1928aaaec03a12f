"""The SQL dialect on small tables; expected rows follow the standard."""

import pytest

from trilith.engine import Engine
from trilith.functions.datetime import interval
from trilith.plans.lexer import QueryError


@pytest.fixture(scope="module")
def db(spark):
    e = Engine(spark)
    e.register_table("trees", spark.createDataFrame([(10, "oak", "north", 31, None), (11, "elm", "north", 22, 10), (12, "ash", "south", 17, 10), (13, "yew", "south", 17, 12), (14, "fir", "ridge", 9, 10), (15, "box", None, None, 11)], "tid int, kind string, grove string, height int, parent int"))
    e.register_table("groves", spark.createDataFrame([("north", 70), ("south", 40), ("valley", 25)], "gname string, acres int"))
    e.register_table("pairs", spark.createDataFrame([(2, 12), (4, None), (6, 36), (8, 48), (10, None)], "a int, b int"))
    e.register_table("picks", spark.createDataFrame([(2,), (6,)], "p int"))
    e.register_table("words", spark.createDataFrame([("moss",), ("Fern",), ("red_bark",), ("",), (None,), ("50% shade",)], "w string"))
    return e


def rows(db, text, **params):
    return [tuple(r) for r in db.query(text, params=params).collect()]


CASES = [
    ("SELECT DISTINCT ON (grove) grove, kind FROM trees ORDER BY grove, height DESC, kind", [("north", "oak"), ("ridge", "fir"), ("south", "ash"), (None, "box")]),
    ("SELECT a FROM pairs WHERE a > ALL (SELECT p FROM picks WHERE p > 90) ORDER BY a", [(2,), (4,), (6,), (8,), (10,)]),
    ("SELECT a FROM pairs WHERE a > ALL (SELECT p FROM picks) ORDER BY a", [(8,), (10,)]),
    ("SELECT a FROM pairs WHERE a > ANY (SELECT p FROM picks) ORDER BY a", [(4,), (6,), (8,), (10,)]),
    ("SELECT a FROM pairs WHERE a = ANY (SELECT p FROM picks) ORDER BY a", [(2,), (6,)]),
    ("SELECT a FROM pairs WHERE a <> ALL (SELECT p FROM picks) ORDER BY a", [(4,), (8,), (10,)]),
    ("SELECT a > ALL (SELECT b FROM pairs) AS x FROM pairs WHERE a = 2", [(False,)]),
    ("SELECT 60 > ALL (SELECT b FROM pairs) AS x", [(None,)]),
    ("SELECT 60 = ALL (SELECT p FROM picks WHERE p > 7) AS x, 6 < ANY (SELECT p FROM picks WHERE p > 7) AS y", [(True, False)]),
    ("SELECT b FROM pairs ORDER BY b", [(12,), (36,), (48,), (None,), (None,)]),
    ("SELECT b FROM pairs ORDER BY b DESC LIMIT 3", [(None,), (None,), (48,)]),
    ("SELECT b FROM pairs ORDER BY b NULLS FIRST LIMIT 1 OFFSET 1", [(None,)]),
    ("SELECT w FROM words WHERE w LIKE '50\\%%' OR w ILIKE 'f%'", [("Fern",), ("50% shade",)]),
    ("SELECT NULL AND TRUE AS a, NULL AND FALSE AS b, NULL OR TRUE AS c, NOT NULL AS d", [(None, False, True, None)]),
    ("SELECT grove, collect(height ORDER BY height DESC) AS s FROM trees WHERE grove IN ('north', 'south') GROUP BY grove ORDER BY grove", [("north", [31, 22]), ("south", [17, 17])]),
    ("SELECT collect(b ORDER BY a) AS s FROM pairs", [([12, None, 36, 48, None],)]),
    ("SELECT collect(DISTINCT grove ORDER BY grove) AS s FROM trees", [(["north", "ridge", "south", None],)]),
    ("SELECT count(*) FILTER (WHERE height > 17) AS a, count(parent) AS b, count(DISTINCT grove) AS c FROM trees", [(2, 5, 3)]),
    ("SELECT grove FROM trees INTERSECT ALL SELECT grove FROM trees ORDER BY grove", [("north",), ("north",), ("ridge",), ("south",), ("south",), (None,)]),
    ("SELECT a FROM pairs EXCEPT SELECT p FROM picks ORDER BY a", [(4,), (8,), (10,)]),
    ("WITH RECURSIVE up AS (SELECT tid, kind, parent FROM trees WHERE kind = 'yew' UNION ALL SELECT t.tid, t.kind, t.parent FROM trees t JOIN up u ON t.tid = u.parent) SELECT kind FROM up", [("yew",), ("ash",), ("oak",)]),
    ("WITH t(n) AS (SELECT 2 UNION SELECT (n * 2) % 11 FROM t) SELECT count(*) AS c, max(n) AS m FROM t", [(10, 10)]),
    ("WITH t AS NOT MATERIALIZED (SELECT a FROM pairs), u AS MATERIALIZED (SELECT a FROM t) SELECT max(x.a) + min(y.a) AS m FROM u x, u y", [(12,)]),
    ("SELECT t.kind, s.mx FROM trees t JOIN LATERAL (SELECT max(a) AS mx FROM pairs WHERE pairs.a < t.tid - 8) s ON TRUE WHERE t.tid < 12 ORDER BY t.tid", [("oak", None), ("elm", 2)]),
    ("SELECT g.gname, t.kind FROM groves g LEFT JOIN trees t ON t.grove = g.gname AND t.height > 20 ORDER BY g.gname, t.kind", [("north", "elm"), ("north", "oak"), ("south", None), ("valley", None)]),
    ("SELECT kind FROM trees WHERE parent NOT IN (SELECT tid FROM trees WHERE tid > 10) ORDER BY kind", [("ash",), ("elm",), ("fir",)]),
    ("SELECT kind FROM trees WHERE tid NOT IN (SELECT parent FROM trees)", []),
    ("SELECT kind FROM trees WHERE (height < 10 OR tid NOT IN (SELECT parent FROM trees WHERE parent IS NOT NULL)) AND grove IS NOT NULL ORDER BY kind", [("fir",), ("yew",)]),
    ("SELECT kind FROM trees WHERE NOT (tid NOT IN (SELECT parent FROM trees)) ORDER BY kind", [("ash",), ("elm",), ("oak",)]),
    ("SELECT kind FROM trees WHERE (tid NOT IN (SELECT parent FROM trees)) IS NULL ORDER BY kind", [("box",), ("fir",), ("yew",)]),
    ("SELECT kind FROM trees WHERE parent NOT IN (SELECT tid FROM trees WHERE tid > 90) ORDER BY kind LIMIT 2", [("ash",), ("box",)]),
    ("SELECT 9 / 2 AS a, 9 // 2 AS b, 9 % 2 AS c, 3 ^ 2 AS d, 4 / 0 AS e, 'x' + 'y' AS f, 0x2A AS g", [(4.5, 4, 1, 9.0, None, "xy", 42)]),
    ("SELECT 'q'::number AS a, '34'::number AS b, NULL::text AS c, 'soon'::date AS d", [(None, 34.0, None, None)]),
    ("SELECT ''::boolean AS a, 'maybe'::boolean AS b, 0::boolean AS c", [(False, True, False)]),
    ("SELECT ARRAY[7, 8, 9][1] AS a, ARRAY[7, 8, 9][0:2] AS b, ARRAY[7][5] AS c, ROW(1 AS x, 'y' AS z).z AS d", [(8, [7, 8], None, "y")]),
    ("SELECT u.value AS v FROM unwind(ARRAY[5, 6]) u", [(5,), (6,)]),
    ("SELECT v.col0 AS a, v.col1 AS b FROM (VALUES (3, 'r'), (4, 's')) AS v ORDER BY a", [(3, "r"), (4, "s")]),
    ("SELECT $q$don't$q$ AS x, 'don''t' AS y, \"a\" AS c FROM pairs WHERE a = 2 -- the end", [("don't", "don't", 2)]),
    ("SELECT ARRAY[5, 6] @> ARRAY[6] AS x, ARRAY[5] @> ARRAY[6] AS y", [(True, False)]),
    ("SELECT grove FROM trees GROUP BY grove HAVING count(*) > 1 ORDER BY max(height) DESC", [("north",), ("south",)]),
    ("SELECT kind FROM trees WHERE height = (SELECT max(height) FROM trees); SELECT 8 AS x", [(8,)]),
    ("SELECT a FROM pairs EXCEPT SELECT p FROM picks EXCEPT SELECT 8 ORDER BY a", [(4,), (10,)]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_query(db, text, want):
    got = rows(db, text)
    assert (got == want) if "ORDER BY" in text or "LIMIT" in text else sorted(got, key=str) == sorted(want, key=str)


def test_names_parameters_and_errors(db):
    assert db.query("SELECT t.kind, count(*) FROM trees t GROUP BY t.kind").columns == ["t.kind", "count(*)"]
    assert rows(db, "SELECT kind FROM trees WHERE grove = :g AND height > ?low", g="north", low=25) == [("oak",)]
    for bad in ("SELECT FROM", "SELECT 1 +", "SELECT a FROM t NATURAL JOIN u", "SELECT ~", "SELECT :nothing", "SELECT 1 FROM trees JOIN groves", "SELECT 1 FROM trees, trees", "SELECT 1 FROM trees x JOIN groves X ON TRUE", "WITH RECURSIVE t AS (SELECT 1 FROM t) SELECT 1"):
        with pytest.raises(QueryError):
            db.query(bad)
    assert list(db.rows("SELECT 1 AS a")) == [{"a": 1}] and list(db.rows("SELECT 1 AS a", serialise=tuple)) == [(1,)]
    assert rows(db, "SELECT x.a AS a FROM pairs x WHERE EXISTS (SELECT 1 FROM pairs x WHERE x.a = 2) AND x.a > 8") == [(10,)]


def test_recursion_leaves_tables_alone_and_goes_deep(db):
    got = rows(db, "WITH RECURSIVE trees(n) AS (SELECT 1 UNION SELECT n + 1 FROM trees WHERE n < 12) SELECT count(*) AS c, max(t.n) AS m FROM trees t")
    assert got == [(12, 12)] and rows(db, "SELECT count(*) AS c FROM trees") == [(6,)]
    assert rows(db, "WITH RECURSIVE t(n) AS (SELECT tid FROM trees WHERE tid = 10 UNION ALL SELECT n + 1 FROM t WHERE n < 160) SELECT max(n) AS m, count(*) AS c FROM t") == [(160, 151)]
    assert rows(db, "WITH RECURSIVE s AS (SELECT 4 AS x), t(n) AS (SELECT x FROM s UNION SELECT n - 1 FROM t WHERE n > (SELECT min(p) FROM picks)) SELECT n FROM t ORDER BY n") == [(2,), (3,), (4,)]


def test_a_materialized_part_is_read_once(db):
    plan = db.query("WITH u AS MATERIALIZED (SELECT grove, count(*) AS n FROM trees GROUP BY grove) SELECT x.grove FROM u x, u y WHERE x.n = y.n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_not_in_is_an_anti_join(db):
    plan = db.query("SELECT kind FROM trees WHERE tid NOT IN (SELECT parent FROM trees WHERE height > 1)")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "isnull" not in plan.split("LeftAnti")[1].split("\n")[0]


def test_user_functions(db):
    from pyspark.sql import functions as F

    db.registry.builder("thrice", lambda x: f"({x} * 3)")
    db.registry.function("loud", F.udf(lambda s: s and s.upper() + "?"))
    db.registry.operator("||", lambda a, b: f"concat({a}, '~', {b})")
    assert rows(db, "SELECT thrice(a) AS a, loud('x') AS b, 'p' || 'q' AS c FROM pairs WHERE a = 4") == [(12, "X?", "p~q")]


def test_scoped_functions_casts_folds_languages_and_rules(spark):
    e = Engine(spark)
    e.register_objects("spans", [{"a": 2, "b": 5}, {"a": 4, "b": 4}], "a int, b int")
    e.registry.builder("length", lambda a, b: f"({b} - {a})", schema="span")
    e.registry.bundle({"fold": {"span_total": ("0", lambda s, a, b: f"{s} + {b} - {a}")}, "cast": {"tenths": lambda x: f"({x} * 10)"}})
    assert rows(e, "SELECT span.length(s.a, s.b) AS n, s.a::tenths AS t FROM spans s ORDER BY n") == [(0, 40), (3, 20)]
    assert rows(e, "SELECT span_total(a, b) AS n FROM spans") == [(3,)]
    e.register_language("upto", lambda e, text, params: e.spark.range(int(text)).toDF("i"))
    assert rows(e, "SELECT count(*) AS c FROM (LANG upto 4) u, spans s WHERE u.i < s.a") == [(6,)]
    e.register_rule(lambda df: df.limit(1))
    assert len(rows(e, "SELECT a FROM spans")) == 1


def test_intervals():
    assert interval("1 year 2 months") == "make_interval(1, 2, 0, 0, 0, 0, 0.0)"
    assert interval("3 4:05:06 ago") == "make_interval(0, 0, 0, -3, -4, -5, -6.0)"
    assert interval("1-2") == "make_interval(1, 2, 0, 0, 0, 0, 0.0)"
    with pytest.raises(ValueError):
        interval("soon")


@pytest.mark.parametrize(
    "inner",
    [
        "SELECT kind AS k FROM trees WHERE grove = g.gname ORDER BY height DESC, tid DESC LIMIT 1",
        "SELECT trees.kind AS k FROM trees WHERE grove = g.gname ORDER BY trees.height + 0 DESC, tid DESC LIMIT 1",
        "SELECT max(kind) AS k FROM trees WHERE grove = g.gname GROUP BY tid HAVING count(*) > 0 ORDER BY max(height) DESC, tid DESC LIMIT 1",
        "SELECT DISTINCT ON (tid) kind AS k FROM trees WHERE grove = g.gname ORDER BY height DESC, tid DESC LIMIT 1",
    ],
)
def test_limit_of_each_outer_row_keeps_its_order(db, inner):
    text = f"SELECT g.gname AS g, t.k AS k FROM groves g JOIN LATERAL ({inner}) t ON TRUE ORDER BY g"
    assert rows(db, text) == [("north", "oak"), ("south", "yew")]
    plan = db.query(text)._jdf.queryExecution().optimizedPlan().toString()
    assert "DESC NULLS FIRST" in plan.split("row_number() windowspecdefinition(grove")[1].split("specifiedwindowframe")[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        # an alias comes before a column of its name; the last ORDER BY of a set operation is the whole's
        ("SELECT g.gname AS g, t.height AS h FROM groves g, LATERAL (SELECT 0 - tid AS height FROM trees WHERE grove = g.gname ORDER BY height LIMIT 1) t ORDER BY g", [("north", -11), ("south", -13)]),
        ("SELECT g.gname AS g, t.tid AS t FROM groves g, LATERAL (SELECT * FROM trees WHERE grove = g.gname ORDER BY height, kind LIMIT 1 OFFSET 1) t ORDER BY g", [("north", 10), ("south", 13)]),
        ("SELECT g.gname AS g, (SELECT kind FROM trees WHERE grove = g.gname ORDER BY height, tid DESC LIMIT 1) AS k FROM groves g ORDER BY g", [("north", "elm"), ("south", "yew"), ("valley", None)]),
        ("SELECT t.a AS a FROM (SELECT a AS a FROM pairs UNION ALL SELECT p AS a FROM picks ORDER BY a DESC LIMIT 3) t ORDER BY a", [(6,), (8,), (10,)]),
    ],
)
def test_limits_within(db, text, want):
    assert rows(db, text) == want
