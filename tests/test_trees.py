"""Plan searches by structure against a walk over each document."""

import random
from xml.sax.saxutils import quoteattr

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.documents import implicit_conversions, non_sargable_scans
from fleetlens.plans.trees import attribute, nodes
from tests.plan_walk import conversions, scans

KINDS = ("StmtSimple", "RelOp", "TableScan", "IndexScan", "ScalarOperator", "Identifier", "ColumnReference", "Convert", "Predicate")


#: What mostly lies below what; the rest is by chance.
USUAL = {"StmtSimple": ("RelOp", "RelOp", "Convert", "StmtSimple"), "RelOp": ("TableScan", "IndexScan", "ScalarOperator", "RelOp"), "ScalarOperator": ("Convert", "Identifier", "ScalarOperator"),
         "Convert": ("ScalarOperator",), "Identifier": ("ColumnReference",), "": ("StmtSimple",)}


def element(dice, depth, parent=""):
    kind = dice.choice(USUAL.get(parent, KINDS) if dice.random() < 0.8 else KINDS)
    have = {}
    if kind == "StmtSimple":
        have = {"StatementText": dice.choice(["SELECT 1", "a < b AND c > 'x'", 'say "hi"', "two\nlines", ""])}
    elif kind == "Convert":
        have = {"Implicit": dice.choice(["1", "true", "0"]), "DataType": "int"} | ({"Length": str(dice.randrange(9))} if dice.random() < 0.5 else {})
    elif kind == "ScalarOperator" and dice.random() < 0.6:
        have = {"ScalarString": dice.choice(["f(a)", "a>1 & b", ""])}
    elif kind == "ColumnReference":
        have = {k: v for k, v in {"Database": "[db]", "Schema": dice.choice(["[dbo]", "[sys]"]), "Table": "[t%d]" % dice.randrange(3), "Column": "c%d" % dice.randrange(3)}.items() if dice.random() < 0.85}
    text = "".join(f" {k}={quoteattr(v)}" for k, v in have.items())
    prefix = dice.choice(["", "", "p:"]) if depth < 3 else ""
    inner = "".join(element(dice, depth + 1, kind) for _ in range(dice.choice((0, 1, 1, 2, 3)))) if depth < 9 else ""
    inner += dice.choice(["", "", "some text", "<!-- <Convert Implicit='1'> -->", "<![CDATA[<RelOp>]]>"])
    return f"<{prefix}{kind}{text}>{inner}</{prefix}{kind}>" if inner or dice.random() < 0.3 else f"<{prefix}{kind}{text} />"


@pytest.fixture(scope="module")
def documents():
    dice = random.Random(12)
    chain = '<StmtSimple StatementText="s"><RelOp><TableScan/><ScalarOperator ScalarString="f(c1)"><Convert Implicit="1" DataType="int" Length="4"><ScalarOperator><Identifier><ColumnReference Database="[db]" Schema="[dbo]" Table="[t1]" Column="c1"/></Identifier></ScalarOperator></Convert></ScalarOperator></RelOp></StmtSimple>'
    out = [f'<?xml version="1.0"?><ShowPlanXML xmlns:p="urn:p">{"".join(element(dice, 0) for _ in range(6))}{chain if i % 3 else ""}</ShowPlanXML>' for i in range(120)]
    nested = chain.replace("<RelOp>", f"<RelOp>{chain}", 1)
    return list(enumerate([*out, f"<a>{chain}{chain}</a>", f"<a>{nested}</a>", chain[:-13], chain.replace("</RelOp>", "</RelOps>"), "no document Implicit=\"1\" <TableScan ScalarString", None, ""])) + [(1, out[1])] * 2


def test_conversions_equal_the_walk(spark, documents):
    plans = spark.createDataFrame(documents, "plan_handle int, query_plan string")
    columns = spark.createDataFrame([("dbo", f"t{i}", f"c{j}", "char", j) for i in range(3) for j in range(3)], "schema_name string, table_name string, column_name string, data_type string, max_length int")
    bare = lambda x: (x or "").strip("[]")
    rows = [(i, n) for i, text in documents for n in conversions(text)]
    want = [(i, n["statement"], "dbo", bare(n["table_name"]), n["column_name"], n["detail"], n["length"]) for i, n in rows if n["schema_name"] == "[dbo]" and n["table_name"] and n["column_name"]]
    got = implicit_conversions(plans, columns).select("plan_handle", "statement", "schema_name", "table_name", "column_name", "convert_to", "convert_to_length")
    as_text = lambda rows: sorted(map(str, rows))
    assert as_text(map(tuple, got.fillna(-1).collect())) == as_text((*r[:6], -1 if r[6] is None else r[6]) for r in want) and len(want) > 200
    assert implicit_conversions(plans, columns, database="other").count() == 0 < implicit_conversions(plans, columns, database="db").count()


def test_scans_equal_the_walk(spark, documents):
    plans = spark.createDataFrame(documents, "plan_handle int, query_plan string")
    want = [(i, n["statement"], n["schema_name"], n["table_name"], n["column_name"], n["scan_type"], n["detail"]) for i, text in documents for n in scans(text)]
    got = non_sargable_scans(plans).select("plan_handle", "statement", "schema_name", "table_name", "column_name", "scan_type", "scalar_string")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 300
    plan = non_sargable_scans(plans)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nodes_have_intervals_and_levels(spark):
    df = spark.createDataFrame([(1, '<a x="1"><b/><b y="p>q"><c/></b></a>'), (2, "<a><b></a>"), (3, "<a></b>"), (4, "</a><a>")], "id int, doc string")
    got = nodes(df, ["id"], "doc", ("a", "b", "c")).select("id", "name", "entry", "leave", "level", attribute("tag", "y").alias("y"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 0, 5, 0, None), (1, "b", 1, 1, 1, None), (1, "b", 2, 4, 1, "p>q"), (1, "c", 3, 3, 2, None)], key=str)
