"""SQL over relations gives what the same steps on whole documents give, from hot columns where a slot holds them."""

import json

import pytest
from pyspark.sql import functions as F

from hotleaf.errors import DocError
from hotleaf.operators.relation import Catalog

DOCS = [
    {"s": "a", "n": 1, "l": [{"p": 5}], "c": "x"},
    {"s": "1", "n": 2.50, "l": {"0": {"p": 6}}, "c": "it's"},
    {"s": 1, "n": None, "l": [], "c": {"d": [7, 8]}},
    {"s": None, "n": -3, "l": [{"p": None}]},
    {"s": {"k": "v"}, "l": 9},
    {"s": [1, 2], "n": 1.0, "l": [{"p": "q"}]},
    {},
]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    c = Catalog(spark, str(tmp_path_factory.mktemp("sql")))
    rows = spark.createDataFrame([(k, json.dumps(d), k % 2) for k, d in enumerate(DOCS)], "id long, doc string, tenant int")
    c.import_table("public.docs", rows, [["s"], ["n"], ["l", 0, "p"]]).declare_path_type(["n"], "numeric")
    return c


def both(catalog, text, **more):
    """The rows, after comparing them with those of whole documents."""
    rows = sorted(map(str, catalog.sql(text, **more).collect()))
    plain = Catalog(catalog.spark, catalog.root, rewrite=False)
    assert rows == sorted(map(str, plain.sql(text, **more).collect()))
    return rows


def plan(catalog, text, **more):
    return catalog.sql(text, **more)._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "text",
    [
        "SELECT id, doc->>'s' AS v FROM public.docs",
        "SELECT id, doc->'s' AS v FROM public.docs d",
        "SELECT id, doc->'s'->>'k' AS v, doc->'s'->0 AS w, doc->'s'->-1 AS x FROM public.docs",
        "SELECT id, d.doc->'l'->0->>'p' AS v FROM public.docs AS d",
        "SELECT id, doc->'l'->'0'->'p' AS v, doc#>>'{l,0,p}' AS w, doc#>'{c,d,-1}' AS x FROM public.docs",
        "SELECT id FROM public.docs WHERE doc->>'s'='1'",
        "SELECT id FROM public.docs WHERE doc->>'s' IS NULL OR doc->>'s' = 'a'",
        "SELECT id FROM public.docs WHERE NOT (doc->>'s' = 'a') AND tenant = 0",
        "SELECT id, doc->>'s' = '1' AS hit FROM public.docs",
        "SELECT id FROM public.docs WHERE doc->'n' = '1' AND tenant >= 0",
        "SELECT id FROM public.docs WHERE doc->'c'->'d'->1 = '8.0'",
        "SELECT id FROM public.docs WHERE doc->>'c' = 'it''s'",
        "SELECT id, (doc->>'n')::numeric AS n FROM public.docs WHERE (doc->>'n')::numeric > -5 ORDER BY 2",
        "SELECT * FROM public.docs WHERE doc->>'s' = 'a'",
        "SELECT d.* FROM public.docs d WHERE d.doc->>'s' = 'a'",
        "SELECT x.v, count(*) AS n FROM (SELECT doc->>'s' AS v FROM public.docs) x GROUP BY x.v",
        "SELECT count(*) AS n FROM (SELECT * FROM public.docs) q WHERE q.doc->>'s' = 'a'",
        "WITH q AS (SELECT id, doc->>'s' AS v FROM public.docs WHERE tenant = 0) SELECT * FROM q",
        "SELECT a.id, b.doc->>'s' AS v FROM public.docs a LEFT JOIN public.docs b ON a.id = b.id + 1 AND b.doc->>'s' = 'a' WHERE a.doc->>'s' IS NOT NULL",
        "SELECT id, 1.5e0 AS x, transform(array(1, 2), y -> y + 1) AS t FROM public.docs -- doc->'s'\n WHERE doc->>'s' = \"a\"",
    ],
)
def test_same_rows_as_whole_documents(catalog, text):
    both(catalog, text)


def test_rows(catalog):
    assert both(catalog, "SELECT id FROM public.docs WHERE doc->>'s' = '1'") == ["Row(id=1)", "Row(id=2)"]
    assert both(catalog, "SELECT id FROM public.docs WHERE doc->>'s' IS NULL") == ["Row(id=3)", "Row(id=6)"]
    assert both(catalog, "SELECT id FROM public.docs WHERE doc->'n' = '1.0'") == ["Row(id=0)", "Row(id=5)"]
    assert both(catalog, "SELECT id FROM d WHERE doc->'l'->0->>'p' = :p", d=catalog.relation("public.docs"), args={"p": "5"}) == ["Row(id=0)"]


def test_hot_paths_read_no_template_and_push_their_filters(catalog):
    text = plan(catalog, "SELECT id FROM public.docs WHERE doc->>'s' = 'a' AND tenant = 0")
    assert "template" not in text and "PushedFilters" in text and 'In(h0, ["a",a])' in text
    text = plan(catalog, "SELECT id FROM public.docs WHERE doc->'s' = '\"a\"'")
    assert "template" not in text and "EqualTo(h0_key" in text
    text = plan(catalog, "SELECT id FROM public.docs WHERE (doc->>'n')::numeric >= 2")
    assert "template" not in text and "GreaterThanOrEqual(t1_numeric" in text
    assert "template" in plan(catalog, "SELECT id FROM public.docs WHERE doc->>'c' = 'a'")
    assert "template" in plan(Catalog(catalog.spark, catalog.root, rewrite=False), "SELECT id FROM public.docs WHERE doc->>'s' = 'a'")


def test_errors(catalog):
    with pytest.raises(DocError, match="42702"):
        catalog.sql("SELECT doc->>'s' FROM d JOIN e ON d.id = e.id", d=catalog.relation("public.docs"), e=catalog.relation("public.docs"))
    with pytest.raises(DocError, match="42501"):
        catalog.as_user("ann").sql("SELECT doc->>'s' FROM public.docs")


def test_policies_filter_rows(catalog):
    c = Catalog(catalog.spark, catalog.root + "-rls")
    r = c.import_table("public.docs", catalog.relation("public.docs").df(), [["s"]]).grant("ann", "read")
    r.enable_rls().set_policy("own", "select", ["ann"], using="tenant = 0")
    assert c.as_user("ann").sql("SELECT max(tenant) AS t, count(doc->>'s') AS n FROM public.docs").collect()[0][:] == (0, 3)


def test_views_are_dropped(catalog):
    catalog.sql("SELECT doc->>'s' AS s FROM public.docs").agg(F.count("s")).collect()
    assert not [t for t in catalog.spark.catalog.listTables() if t.name.startswith("hotleaf_")]
