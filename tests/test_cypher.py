"""Cypher on a graph of harbours, ships and the routes between them."""

import pytest

from trilith.engine import Engine
from trilith.plans.lexer import QueryError


@pytest.fixture(scope="module")
def db(spark):
    e = Engine(spark)
    nodes = [("k", ["Port"], "Kiel", 9), ("m", ["Port"], "Malmo", 4), ("r", ["Port", "Hub"], "Riga", None), ("t", ["Port"], "Turku", 6), ("w", ["Ship"], "Walrus", 120), ("x", ["Ship"], "Xebec", 45)]
    edges = [("r1", "k", "m", "ROUTE", 7), ("r2", "m", "r", "ROUTE", 11), ("r3", "r", "t", "ROUTE", 5), ("r4", "k", "t", "ROUTE", 30), ("c1", "w", "k", "CALLS", None), ("c2", "w", "r", "CALLS", None), ("c3", "x", "r", "CALLS", None)]
    e.register_graph("sea", spark.createDataFrame(nodes, "id string, labels array<string>, name string, size int"), spark.createDataFrame(edges, "id string, src string, dst string, type string, hours int"))
    e.register_table("berths", spark.createDataFrame([("Malmo", 3), ("Riga", 8)], "port string, n int"))
    return e


CASES = [
    ("MATCH (p:Port) RETURN p.name ORDER BY p.size", [("Malmo",), ("Turku",), ("Kiel",), ("Riga",)]),
    ("MATCH (p:Port:Hub) RETURN p.name AS n", [("Riga",)]),
    ('MATCH (a {name: "Kiel"})-[:ROUTE]->(b) RETURN b.name AS n ORDER BY n', [("Malmo",), ("Turku",)]),
    ("MATCH (a)<-[r:ROUTE]-(b) WHERE r.hours < 10 RETURN a.name AS a, r.hours AS h ORDER BY h", [("Turku", 5), ("Malmo", 7)]),
    ("MATCH (a:Port {name: 'Malmo'})-[:ROUTE]-(b) RETURN b.name AS n ORDER BY n", [("Kiel",), ("Riga",)]),
    ("MATCH (a {name: 'Riga'})-[:ROUTE*0..0]->(b) RETURN b.name AS n", [("Riga",)]),
    ("MATCH (a {name: 'Malmo'})-[r:ROUTE*0..2]->(b) RETURN b.name AS n, size(r) AS k ORDER BY k", [("Malmo", 0), ("Riga", 1), ("Turku", 2)]),
    ("MATCH (a {name: 'Kiel'})-[r:ROUTE*]->(b {name: 'Turku'}) RETURN size(r) AS k ORDER BY k", [(1,), (3,)]),
    ("MATCH (a {name: 'Kiel'})-[r:ROUTE*1..3]->(b {name: 'Turku'}) RETURN size(r) AS k, r[0].hours AS h ORDER BY k", [(1, 30), (3, 7)]),
    ("MATCH (a {name: 'Riga'})-[r:ROUTE*1..4]-(b {name: 'Riga'}) RETURN size(r) AS k", [(4,), (4,)]),
    ("MATCH (a:Ship) OPTIONAL MATCH (a)-[:CALLS]->(p:Port) WHERE p.size > 5 RETURN a.name AS a, p.name AS p ORDER BY a", [("Walrus", "Kiel"), ("Xebec", None)]),
    ("MATCH (p:Port) OPTIONAL MATCH (p)<-[c:CALLS]-(s:Ship)-[:CALLS]->(q:Port) WHERE q.name <> p.name RETURN p.name AS p, s.name AS s, q.name AS q ORDER BY p", [("Kiel", "Walrus", "Riga"), ("Malmo", None, None), ("Riga", "Walrus", "Kiel"), ("Turku", None, None)]),
    ("MATCH (s:Ship) OPTIONAL MATCH (s)-[c:TOWS]->(o) RETURN s.name AS s, o AS o, c AS c ORDER BY s", [("Walrus", None, None), ("Xebec", None, None)]),
    ("MATCH (s:Ship) RETURN s.name AS n UNION MATCH (s:Ship) RETURN s.name AS n", [("Walrus",), ("Xebec",)]),
    ("MATCH (p:Hub) RETURN p.name AS n UNION ALL MATCH (p:Port) WHERE p.size > 5 RETURN p.name AS n", [("Riga",), ("Kiel",), ("Turku",)]),
    ("MATCH (a)-[:CALLS]->(p)<-[:CALLS]-(b) RETURN a.name AS a, b.name AS b ORDER BY a", [("Walrus", "Xebec"), ("Xebec", "Walrus")]),
    ("MATCH (p:Port) WHERE (:Ship)-[:CALLS]->(p) RETURN p.name AS n ORDER BY n", [("Kiel",), ("Riga",)]),
    ("MATCH (p:Port) WHERE NOT (p)<-[:CALLS]-() RETURN p.name AS n ORDER BY n", [("Malmo",), ("Turku",)]),
    ("MATCH (p:Port) WHERE p.size IS NULL OR p.size < 5 RETURN collect(p.name) AS ns, count(p.size) AS k", [(["Malmo", "Riga"], 1)]),
    ("MATCH (p:Port) WITH p.name AS n, p.size AS a WHERE a > 3 RETURN n ORDER BY a DESC SKIP 1 LIMIT 1", [("Turku",)]),
    ("MATCH (p:Port) RETURN p:Hub AS x, p.name AS n ORDER BY n LIMIT 3", [(False, "Kiel"), (False, "Malmo"), (True, "Riga")]),
    ("MATCH (a)-[r:ROUTE {hours: 11}]->(b) RETURN startNode(r).name AS s, endNode(r).name AS e", [("Malmo", "Riga")]),
    ("RETURN [4, 5, 6][-2] AS a, [4, 5, 6][1..3] AS b, [4] + [5] AS c, 'sea' + 'port' AS d, {k: 7}.k AS e", [(5, [5, 6], [4, 5], "seaport", 7)]),
    ("MATCH (p:Hub) WITH p.labels AS a, [p.name] AS b RETURN a + b AS l", [(["Port", "Hub", "Riga"],)]),
    ("MATCH (p:Hub) WITH p {.name, tags: p.labels} AS m RETURN m.name AS n, size(m.tags) AS k", [("Riga", 2)]),
    ("UNWIND [8, 2, 5] AS x WITH x ORDER BY x RETURN collect(x) AS l", [([2, 5, 8],)]),
    ("UNWIND [9, 4, 7, 2] AS x RETURN DISTINCT x % 2 AS m ORDER BY m", [(0,), (1,)]),
    ("RETURN 4 < 5 < 6 AS a, 8 IN [7, 8] AS b, 'harbour' ENDS WITH 'our' AS c, false XOR true AS d", [(True, True, True, True)]),
    ("RETURN CASE WHEN 4 > 5 THEN 'p' ELSE 'q' END AS a // the end", [("q",)]),
    ("UNWIND (LANG SQL SELECT port, n FROM berths) AS b MATCH (p {name: b.port}) RETURN p.name AS p, b.n AS n ORDER BY n", [("Malmo", 3), ("Riga", 8)]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_query(db, text, want):
    got = [tuple(r) for r in db.query(text, "cypher").collect()]
    assert (got == want) if "ORDER BY" in text else sorted(got, key=str) == sorted(want, key=str)


def test_optional_match_is_a_plain_join(db):
    plan = db.query("MATCH (s:Ship) OPTIONAL MATCH (s)-[:CALLS]->(p:Port) WHERE p.size > 5 RETURN s.name AS s, p.name AS p", "cypher")._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_writes_are_refused_and_parameters_bind(db):
    with pytest.raises(QueryError):
        db.query("CREATE (a:Buoy) RETURN a", "cypher")
    assert [r.n for r in db.query("MATCH (p {name: $port}) RETURN p.name AS n", "cypher", {"port": "Turku"}).collect()] == ["Turku"]
    assert [tuple(r) for r in db.query("LANG cypher MATCH (c:Ship {size: 45}) RETURN c.name AS n LANG EXIT").collect()] == [("Xebec",)]
    assert [tuple(r) for r in db.query("SELECT count(*) AS k FROM (LANG cypher MATCH (p:Port) RETURN p.name AS n) t WHERE t.n <> 'Kiel'").collect()] == [(3,)]


def test_limit_of_a_correlated_block_keeps_its_order(db):
    text = "SELECT b.port AS p, t.s AS s FROM berths b, (LANG cypher MATCH (s:Ship)-[:CALLS]->(p:Port) WHERE p.name = b.port RETURN s.name AS s ORDER BY s.size LIMIT 1) t"
    df = db.query(text)
    assert [tuple(r) for r in df.collect()] == [("Riga", "Xebec")]
    assert "ASC NULLS LAST" in df._jdf.queryExecution().optimizedPlan().toString().split("row_number() windowspecdefinition(")[1].split("specifiedwindowframe")[0]
