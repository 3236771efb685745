"""The searches in plan documents as a plain walk, to compare with."""

from xml.etree import ElementTree


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _statements(document):
    try:
        root = ElementTree.fromstring(document)
    except (ElementTree.ParseError, TypeError):
        return
    for node in root.iter():
        if _tag(node) == "StmtSimple":
            yield node


def _columns(node):
    return [x for i in node.iter() if _tag(i) == "Identifier" for x in i if _tag(x) == "ColumnReference"]


def _row(statement, column, **more):
    row = {"statement": statement.get("StatementText"), "schema_name": column.get("Schema"), "table_name": column.get("Table"), "column_name": column.get("Column"),
           "detail": None, "length": None, "scan_type": None}
    return row | more


def conversions(document):
    out = []
    for statement in _statements(document):
        for node in statement.iter():
            if _tag(node) != "Convert" or node.get("Implicit") not in ("1", "true"):
                continue
            direct = [c for s in node if _tag(s) == "ScalarOperator" for i in s if _tag(i) == "Identifier" for c in i if _tag(c) == "ColumnReference"]
            if direct and direct[0].get("Schema") not in (None, "[sys]"):
                length = node.get("Length")
                out.append(_row(statement, direct[0], detail=node.get("DataType"), length=int(length) if length else None))
    return out


def scans(document):
    out = []
    for statement in _statements(document):
        for node in statement.iter():
            if _tag(node) != "RelOp" or not any(_tag(x) in ("TableScan", "IndexScan") for x in node):
                continue
            kind = "TableScan" if any(_tag(x) == "TableScan" for x in node.iter()) else "IndexScan"
            for op in node.iter():
                if _tag(op) == "ScalarOperator" and op.get("ScalarString"):
                    found = _columns(op)
                    if any(x.get("Schema") not in (None, "[sys]") and x.get("Database") for x in found):
                        out.append(_row(statement, found[0], detail=op.get("ScalarString"), scan_type=kind))
    return out
