"""XQuery over a garden of three beds."""

import pytest

from trilith.engine import Engine
from trilith.plans.lexer import QueryError
from trilith.sources import xml
from trilith.sources.xml import nodes_of

GARDEN = (
    '<garden><bed no="n1" area="8"><soil>loam</soil><herb>sage</herb><herb>dill</herb><dug>1988</dug></bed>\n'
    '<bed no="n2" area="21"><soil>sandy clay</soil><herb>mint</herb><dug>1994</dug></bed>\n'
    '<bed no="n3" area="13"><soil>peat</soil><herb>sage</herb><dug>1991</dug></bed></garden>'
)


@pytest.fixture(scope="module")
def db(spark):
    e = Engine(spark)
    e.register_xml("plot", spark.createDataFrame([("g", GARDEN)], "doc string, xml string"))
    e.register_table("limits", spark.createDataFrame([(9,), (18,)], "low int"))
    return e


CASES = [
    ("(5, 6, 7)[last()]", [7]),
    ("(3 to 6)[. > 4]", [5, 6]),
    ("()", []),
    ("3 + 4 * 5 - 9 div 2", [18.5]),
    ("11 idiv 4, 11 mod 4", [2, 3]),
    ("(4, 5, 6) = 6", [True]),
    ("(4, 5) = (6, 7)", [False]),
    ("if (3 < 4) then 'p' else 'q'", ["p"]),
    ("'x' || 'y'", ["xy"]),
    ("not(2 = 2) or true()", [True]),
    ("(2, 3, 4) ! (. * 3)", [6, 9, 12]),
    ("(1 to 3) union (2 to 4)", [1, 2, 3, 4]),
    ("(1 to 4) intersect (3 to 6), (1 to 4) except 2", [3, 4, 1, 3, 4]),
    ("<sum>{ 4 + 5 }</sum>", ["<sum>9</sum>"]),
    ("<p q='{2 + 2}'><r/>s{ (3, 4) }</p>", ['<p q="4"><r/>s3 4</p>']),
    ("<wrap>{ $plot/garden/bed[1]/soil }</wrap>", ["<wrap><soil>loam</soil></wrap>"]),
    ("element y { 'p < q' }", ["<y>p &lt; q</y>"]),
    ("element y { attribute k { 1 + 1 }, attribute m { 'a\"b' }, 'z' }", ['<y k="2" m="a&quot;b">z</y>']),
    ("<p>{ attribute q { 'r' } }</p>", ['<p q="r"/>']),
    ("for $b in $plot//bed let $h := $b/herb return ($h/../soil, count($h/text()))", ["<soil>loam</soil>", "2", "<soil>sandy clay</soil>", "1", "<soil>peat</soil>", "1"]),
    ("for $b in $plot//bed group by $large := $b/@area > 10 return string(count($b/herb)) || ':' || $b/soil", ["2:loam", "2:sandy clay"]),
    ("$plot/garden/bed/soil", ["<soil>loam</soil>", "<soil>sandy clay</soil>", "<soil>peat</soil>"]),
    ("$plot//herb", ["<herb>sage</herb>", "<herb>dill</herb>", "<herb>mint</herb>", "<herb>sage</herb>"]),
    ("$plot/garden/bed[@area > 10]/@no", ["n2", "n3"]),
    ("$plot/garden/bed[@area != @no]/@no", ["n1", "n2", "n3"]),
    ("$plot/garden/bed[herb = 'sage' and @area < 10]/@no", ["n1"]),
    ("$plot/garden/bed[2]/preceding-sibling::bed/@no", ["n1"]),
    ("$plot/garden/bed[last()]/@no", ["n3"]),
    ("$plot/garden/bed[position() < 3]/@no", ["n1", "n2"]),
    ("$plot//dug/text()", ["1988", "1994", "1991"]),
    ("count($plot//bed)", [3]),
    ("sum($plot//bed/@area), avg($plot//bed/@area)", [42.0, 14.0]),
    ("min($plot//bed/@area), max($plot//soil)", ["8", "sandy clay"]),
    ("for $b in $plot/garden/bed where $b/@area > 10 order by $b/dug descending return $b/@no", ["n2", "n3"]),
    ("for $b in $plot/garden/bed let $h := $b/herb return count($h)", [2, 1, 1]),
    ("for $b in $plot/garden/bed let $h := $b/herb | $b/soil return count($h except $b/soil)", [2, 1, 1]),
    ("for $x at $i in (7, 8, 9) return $i * $x", [7, 16, 27]),
    ("for $x in (1, 2) for $y in (30, 40) order by $y, $x return $x + $y", [31, 32, 41, 42]),
    ("for $b in $plot//bed group by $large := $b/@area > 10 return count($b)", [1, 2]),
    ("for $h in $plot//herb return $h/../@no", ["n1", "n1", "n2", "n3"]),
    ("for $b in $plot//bed return for $h in $b/herb return $h", ["<herb>sage</herb>", "<herb>dill</herb>", "<herb>mint</herb>", "<herb>sage</herb>"]),
    ("switch ('m') case 'k' return 5 case 'm' case 'n' return 6 default return 7", [6]),
    ("'31' cast as xs:integer + 1", [32.0]),
    ("declare namespace g = 'http://g'; <!-- weed -->", ["<!-- weed -->"]),
    ("<p><!--m--><?v w?>{ comment { 'z' } }</p>", ["<p><!--m--><?v w?><!--z--></p>"]),
    ("some $x in (4, 5, 6) satisfies $x > 5", [True]),
    ("every $x in (4, 5, 6) satisfies $x > 5", [False]),
    ("for $b in $plot//bed where exists($b/herb[2]) return string($b/soil)", ["loam"]),
    ("for $b in $plot//bed where $b/@area > (LANG SQL SELECT max(low) AS m FROM limits) return $b/@no", ["n2"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_query(db, text, want):
    assert [r.value for r in db.query(text, "xquery").collect()] == want


def test_node_table_numbers_intervals():
    rows = nodes_of("d", "<a x='1'>t<b>u</b><!--c--></a>")
    assert [(r[1], r[3], r[5], r[6], r[7]) for r in rows] == [(0, -1, "document", None, "tu"), (1, 0, "element", "a", "tu"), (2, 1, "text", None, "t"), (3, 1, "element", "b", "u"), (4, 3, "text", None, "u"), (6, 1, "comment", None, "c")]
    a, b = rows[1], rows[3]
    assert a[1] < b[1] and b[2] < a[2] and b[9] == "<b>u</b>"


def test_errors_and_parameters(db):
    for bad in ("for $x in", "$nothing", "foo(1)", "1 +"):
        with pytest.raises(QueryError):
            db.query(bad, "xquery")
    assert [r.value for r in db.query("$low + 1", "xquery", {"low": 4}).collect()] == [5]
    got = db.query("SELECT count(*) AS k FROM (LANG xquery $plot//bed[@area > 10]/@no) AS t WHERE t.value <> 'n2'").collect()
    assert got[0].k == 1


def test_documents_are_parsed_once(db):
    plan = db.query("for $b in $plot//bed return ($b/../@x, $b/ancestor::garden/@no, count($b/following-sibling::bed))", "xquery")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


AREAS = "for $b in $plot//bed group by $large := $b/@area > 10 return "


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (AREAS + "count($b) || ' ' || count($b/@no) || ' ' || exists($b) || ' ' || empty($b/@deep)", ["1 1 true true", "2 2 true true"]),
        (AREAS + "sum($b/@area) || ' ' || avg($b/@area) || ' ' || min($b/@area) || ' ' || max($b/@no)", ["8 8 8 n1", "34 17 13 n3"]),
        (AREAS + "(if ($b) then 'some' else 'none')", ["some", "some"]),
        ("for $b in $plot//bed let $w := $b/@area * 2 group by $large := $b/@area > 10 let $all := $b return count($all) || ' ' || sum($w) || ' ' || max($w)", ["1 16 16", "2 68 42"]),
        ("for $h in $plot//herb let $no := $h/../@no group by $n := $no group by $k := count($h) return $k || ':' || count($h)", ["1:2", "2:2"]),
    ],
)
def test_groups_are_aggregated_without_being_gathered(db, text, want):
    df = db.query(text, "xquery")
    assert [r.value for r in df.collect()] == want
    if AREAS in text:
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_counts_as_nothing_in_a_group(db):
    text = "for $b in $plot//bed for $h allowing empty in $b/herb[2] group by $no := $b/@no return $no || ':' || count($h) || ':' || count($h/text())"
    assert [r.value for r in db.query(text, "xquery").collect()] == ["n1:1:1", "n2:0:0", "n3:0:0"]


def test_steps_from_any_depth(spark):
    e = Engine(spark)
    e.register_xml("nest", spark.createDataFrame([("d", "<a><a x='5'><b>m</b><b y='6'>n</b></a><b>o</b></a>")], "doc string, xml string"))
    want = {"$nest//a//b/text()": ["m", "n", "o"], "$nest//b[1]/text()": ["m", "o"], "$nest//b[@y = 6]/text()": ["n"], "$nest//a/@x": ["5"], "$nest//@y": ["6"], "$nest//a/b[last()]/text()": ["n", "o"]}
    assert {q: [r.value for r in e.query(q, "xquery").collect()] for q in want} == want
    plan = e.query("for $b in $nest//b return $b/@y", "xquery")._jdf.queryExecution().optimizedPlan().toString()
    # one for the step, one with the row that for starts from
    assert plan.count("Join") == 2 and "first(xml" not in plan


def test_small_documents_share_a_frame(monkeypatch):
    import pandas as pd

    texts = [f"<p n='{i}'>t<q/></p>" for i in range(30)]
    batches = [pd.DataFrame({"doc": [str(i) for i in part], "xml": [texts[i] for i in part]}) for part in (range(20), range(20, 30))]
    want = [r for i, t in enumerate(texts) for r in nodes_of(str(i), t)]
    rows = lambda found: [tuple(None if x != x else x for x in r) for f in found for r in f.itertuples(index=False)]
    found = list(xml.frames(iter(batches)))
    assert len(found) == 1 and rows(found) == want
    monkeypatch.setattr(xml, "FRAME_ROWS", 9)
    found = list(xml.frames(iter(batches)))
    assert len(found) == 10 and rows(found) == want
    assert list(xml.frames(iter([]))) == []
