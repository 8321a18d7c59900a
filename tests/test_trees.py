"""Trees and tagged tables against plain recursion."""

import random

from plumbline.operators import trees

NODES = "doc long, page int, id long, parent long, ord int, role string"
SPANS = "doc long, page int, mark string, seq long, text string, x double, y double, w double, size double, body double"


def test_paths_of_any_depth(spark, tmp_path):
    rng, rows, wanted = random.Random(3), [], {}
    for doc in range(5):
        parents = {0: None}
        for node in range(1, 60):
            parents[node] = node - 1 if doc == 0 else rng.randrange(node)  # the first is a chain
        rows += [(doc, 0, n, p, n * 7 % 11 if doc else 0, "abc"[n % 3]) for n, p in parents.items()]
        for n in parents:
            path, at = [], n
            while at is not None:
                path.append(at)
                at = parents[at]
            wanted[doc, n] = path[::-1]
    rows += [(9, 0, 1, 2, 0, "a"), (9, 0, 2, 1, 0, "a"), (9, 0, 3, 77, 0, "b"), (9, 0, 4, 3, 0, "a")]  # a circle, and a parent that isn't there
    found = trees.tree_paths(spark.createDataFrame(rows, NODES).repartition(3), ["doc", "page"], f"file://{tmp_path}/paths")
    got = found.withColumn("a", trees.nearest(found.path, ["a"], itself=False)).collect()
    assert {(r.doc, r.id): [n.id for n in r.path] for r in got} == {**wanted, (9, 3): [3], (9, 4): [3, 4]}
    for r in got:
        above = [n.id for n in r.path[:-1] if n.role == "a"]
        assert r.a == (above[-1] if above else None)


def build(doc, page, table, node, group):
    """Nodes of a tree that holds a table (rows of texts, None for a missing cell), and which node a cell's text belongs to."""
    nodes, marks = [(doc, page, node, None, 0, "Document"), (doc, page, node + 1, node, 0, "P"), (doc, page, node + 2, node, 1, "Table")], {}
    at, holder = node + 3, node + 2
    if group:
        nodes.append((doc, page, at, node + 2, 0, "TBody"))
        holder, at = at, at + 1
    for r, row in enumerate(table):
        tr = at
        nodes.append((doc, page, tr, holder, r, "TR"))
        at += 1
        for c, text in enumerate(row):
            if text is None:
                continue
            nodes += [(doc, page, at, tr, c, "TD"), (doc, page, at + 1, at, 0, "P")]
            marks[r, c] = at + 1
            at += 2
    return nodes, marks


def test_tagged_tables(spark, tmp_path):
    nodes, marks, spans = [], [], []
    tables = {(1, 1): [["a", "b", "c"], ["d", None, "e f"]], (1, 2): [["g", "h", "i"]], (1, 4): [["k", "l", "m"], ["n", "o", "p"]], (2, 1): [["only", "row"]], (3, 1): [["x"], ["y"]]}
    for (doc, page), table in tables.items():
        made, owners = build(doc, page, table, 100 * page, page == 2)
        nodes += made
        for (r, c), node in owners.items():
            marks.append((doc, page, f"m{r}.{c}", node))
            for k, word in enumerate(table[r][c].split()):
                spans.append((doc, page, f"m{r}.{c}", len(spans), word, 50.0 + 100 * c, 100.0 + 40 * r + 12 * k, 30.0, 10.0, 10.0))
        marks.append((doc, page, "prose", 100 * page + 1))
        spans.append((doc, page, "prose", len(spans), "prose", 20.0, 20.0, 400.0, 10.0, 10.0))
        spans.append((doc, page, None, len(spans), "no mark", 20.0, 30.0, 400.0, 10.0, 10.0))
    out = trees.tagged_tables(spark.createDataFrame(spans, SPANS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(marks, "doc long, page int, mark string, node long"), ["doc"], "body", f"file://{tmp_path}/tagged")
    got = {}
    for r in out.orderBy("doc", "table", "page", "row").collect():
        got.setdefault((r.doc, r.table), []).append((r.page, r.cells))
    assert got == {(1, 1): [(1, ["a", "b", "c"]), (1, ["d", "", "e f"]), (2, ["g", "h", "i"])], (1, 2): [(4, ["k", "l", "m"]), (4, ["n", "o", "p"])]}


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], NODES)
    assert trees.tree_paths(none, ["doc", "page"], f"file://{tmp_path}/none").collect() == []


def test_settled_paths_are_not_broadcast(spark, tmp_path):
    """The joins of paths that were written are shuffles: their files are small where their rows are many and alike."""
    nodes = spark.range(40).selectExpr("cast(1 as long) AS doc", "cast(0 as int) AS page", "id", "CASE WHEN id > 0 THEN id div 2 END AS parent", "cast(id as int) AS ord", "CASE WHEN id = 0 THEN 'Table' ELSE 'TR' END AS role")
    paths = trees.tree_paths(nodes, ["doc", "page"], f"file://{tmp_path}/paths")
    plan = trees.tree_cells(paths, ["doc", "page"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
