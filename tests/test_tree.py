"""Node rows hold the page's tree, and rules stated as joins give what the tree walk gives."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from citelake.functions import html
from citelake.operators import tree
from citelake.plans import queries


def some_page(rng: random.Random, depth: int = 0) -> str:
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "p", "h2", "ul", "ol", "table", "div", "b", "nav", "script", "note", "br"])
        inner = some_page(rng, depth + 1) if depth < 3 else "deep"
        if kind == "text":
            out.append(rng.choice([" a ", "b\nc", "&amp;", "  "]))
        elif kind in ("ul", "ol"):
            items = "".join(f"<li>{rng.choice(['x', ' ', 'y <b>z</b>'])}{inner if rng.random() < 0.3 else ''}</li>" for _ in range(rng.randint(0, 3)))
            out.append(f"<{kind}>{items}</{kind}>")
        elif kind == "table":
            rows = "".join("<tr>" + "".join(f"<{c}>{rng.choice('pq ')}</{c}>" for c in rng.choices(["td", "th"], k=rng.randint(1, 3))) + "</tr>" for _ in range(rng.randint(0, 3)))
            out.append(f"<table><tbody>{rows}</tbody></table>")
        elif kind == "note":
            out.append("<!-- n -->")
        elif kind == "br":
            out.append("<br>")
        elif kind == "script":
            out.append("<script>if (a < b) {}</script>")
        else:
            out.append(f"<{kind}>{inner}" + (f"</{kind}>" if rng.random() < 0.9 else ""))
    return "".join(out)


def test_numbers_tell_what_is_inside():
    rng = random.Random(4)
    for _ in range(50):
        rows = html.numbered(some_page(rng))
        assert [r["pre"] for r in rows] == list(range(len(rows)))
        for r in rows:
            assert len(r["above"]) == r["depth"]
            assert {x["pre"] for x in rows if r["pre"] in x["above"]} == set(range(r["pre"] + 1, r["last"] + 1))
    assert html.numbered(None) == html.numbered("") == []


def walked(source: str) -> tuple[list, list, list]:
    """Headings, list items and first-level cells by walking the pruned tree."""
    root = html.parse(source)
    html._prune(root, html.STRIPPED | html.SKIPPED)
    heads = [(int(e.tag[1]), " ".join(e.text().split())) for e in root.walk() if e.tag in html.HEADINGS]
    items, cells, tables = [], [], []

    def own(element) -> str:
        out = []
        for child in element.children:
            if isinstance(child, html.Element):
                out.append("" if child.tag in ("ul", "ol", "li") else own(child))
            elif not isinstance(child, html.Note):
                out.append(child)
        return "".join(out)

    def visit(element, lists, state):
        for child in element.children:
            if not isinstance(child, html.Element):
                continue
            if child.tag == "li" and lists:
                text = " ".join(own(child).split())
                if text:
                    lists[-1][1] += 1
                    items.append((len(lists) - 1, lists[-1][0] == "ol", lists[-1][1], text))
            if child.tag == "table":
                tables.append([])
                visit(child, lists, (len(tables), state))
                continue
            if child.tag == "tr" and state:
                tables[state[0] - 1].append(0)
            if child.tag in ("td", "th") and state and tables[state[0] - 1]:
                rows = tables[state[0] - 1]
                rows[-1] += 1
                cells.append((state[0], len(rows), rows[-1], " ".join(child.text().split())))
            visit(child, [*lists, [child.tag, 0]] if child.tag in html.LISTS else lists, state)

    visit(root, [], None)
    return [h for h in heads if h[1]], items, cells


def test_rules_as_joins(spark):
    rng = random.Random(9)
    pages = [(n, some_page(rng)) for n in range(60)] + [(60, None), (61, "")]
    nodes = tree.shown(tree.node_rows(spark.createDataFrame(pages, "p int, html string"), "p"), "p").cache()
    heads, items, cells = ({n: [] for n, _ in pages} for _ in range(3))
    for r in tree.headings(nodes, "p").orderBy("p", "pre").collect():
        heads[r["p"]].append((r["level"], r["text"]))
    for r in tree.list_items(nodes, "p").orderBy("p", "pre").collect():
        items[r["p"]].append((r["level"], r["ordered"], r["number"], r["text"]))
    for r in tree.table_cells(nodes, "p").orderBy("p", "table", "row", "column").collect():
        cells[r["p"]].append((r["table"], r["row"], r["column"], r["text"]))
    for n, source in pages:
        want = walked(source or "")
        # an unclosed element can hold a later list, so an item's number counts its own list's items in document order
        assert (heads[n], sorted(items[n]), sorted(cells[n])) == (want[0], sorted(want[1]), sorted(want[2])), (n, source)
    assert sum(map(len, items.values())) > 30 and sum(map(len, cells.values())) > 30


def test_nodes_leave_a_worker_in_bounded_pieces(spark):
    """Many pages in one batch of Spark's become many small batches of nodes, with none lost."""
    pages = spark.range(0, 3000, 1, 1).selectExpr("id as p", "repeat('<p>x</p>', 20) as html")
    nodes = tree.node_rows(pages, "p")
    assert nodes.count() == 3000 * 40 and nodes.select("p", "pre").distinct().count() == 3000 * 40
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_rules_on_trees(spark):
    rng = random.Random(11)
    pages = [(n, some_page(rng)) for n in range(150)] + [(150, None), (151, "")]
    trees = tree.page_trees(spark.createDataFrame(pages, "p int, html string"), "p").select("p", tree.shown_nodes(F.col("nodes")).alias("nodes")).cache()
    rules = [rule(F.col("nodes")).alias(name) for name, rule in (("h", tree.tree_headings), ("i", tree.tree_list_items), ("c", tree.tree_table_cells))]
    got = {r["p"]: [[tuple(x) for x in r[k]] for k in "hic"] for r in trees.select("p", *rules).collect()}
    for n, source in pages:
        want = walked(source or "")
        assert (got[n][0], sorted(got[n][1]), got[n][2]) == (want[0], sorted(want[1]), want[2]), (n, source)
    assert sum(len(x[1]) for x in got.values()) > 30 and sum(len(x[2]) for x in got.values()) > 30


def test_outline_of_records_writes_and_deals_out_no_nodes(spark, monkeypatch):
    monkeypatch.setattr(queries.shared, "written", None)
    rows = queries.record_outline(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above, _, _ = plan.partition("MapInArrow")
    assert "Join" not in above and "Repartition" not in above and "Aggregate" not in above
    kinds = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert kinds == {"heading": 300, "item": 4500, "cell": 3450}
