"""Steps that must not grow faster than their input, nor hold more of it at once than they need."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.functions import words
from plumbline.operators import columns, geometry, layout, sequences, trees
from plumbline.plans import base, q_pages, q_tables
from plumbline.sources import records


def test_references_are_read_once(spark):
    """A page of 30,000 references was read anew for each of them."""
    rows = spark.createDataFrame([("&lt;a&#65; &bogus; " * 10_000,), ("&amp;&#x1F600;x",), ("none",), (None,)], "v string")
    began = time.monotonic()
    got = [r.out for r in rows.select(t.html_unescape(F.col("v")).alias("out")).collect()]
    assert got == ["<aA &bogus; " * 10_000, "&\U0001f600x", "none", None]
    assert time.monotonic() - began < 20


def test_long_last_lines(spark):
    """The column was sought from each character of the text anew."""
    texts = ["a\n" * 3 + "x" * 400_000, "a\nb", "", "\n", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "k int, v string")
    began = time.monotonic()
    got = [r.p for r in rows.select("k", t.line_and_column(F.col("v"), F.length("v")).alias("p")).orderBy("k").collect()]
    assert [(p.line, p.column) for p in got] == [(4, 400_001), (2, 2), (1, 1), (2, 1), (None, None)]
    assert time.monotonic() - began < 20


def test_wide_spans_are_no_rows(spark):
    """Every point of every span was a row."""
    rows = [(1, 0.0, 400.0)] * 3 + [(1, 10.5, 5.0), (1, 15.5, 1.0), (2, -5.0, 1.0), (2, 500.0, 9.0), (2, 7.0, 0.0), (3, None, 2.0)]
    spans = spark.createDataFrame(rows, "page int, x double, w double")
    found = layout.coverage(spans, "page", 400)
    got = {(r.page, r.point): r.n for r in found.collect()}
    want = {}
    for page, x, w in rows:
        low = max(0, min(399, int(x // 1))) if x is not None else 399
        high = min(400, max(low + 1, int(-(-(x + w) // 1)))) if x is not None else 400
        for point in range(low, high):
            want[page, point] = want.get((page, point), 0) + 1
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence") < plan.index("Window")  # points are made after all sums


def test_shapes_in_one_pass(spark):
    rows = spark.createDataFrame([("s", i, "" if i % 2 else "5.00", "5.00" if i % 2 else " ", f"{95 if i % 2 else 100}.00") for i in range(1, 8)], "s string, r int, debit string, credit string, balance string")
    found = sequences.balance_shapes(rows, ["s"], "r", "balance", ["debit", "credit"])
    assert [tuple(r) for r in found.collect()] == [("s", "debit-credit", 6, 6)]
    found = sequences.balance_shapes(rows, ["s"], "r", "balance", ["credit", "debit"])
    assert [tuple(r) for r in found.collect()] == [("s", "debit-credit", 6, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert sequences.balance_shapes(rows, ["s"], "r", "balance", ["debit"]).first().shape == "signed"


def test_batches_of_few_texts(spark):
    """A worker holds some hundreds of whole texts at a time, not ten thousand."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(3000).repartition(1).select(F.lit("Ab, ça. d").alias("v"), "id")
    size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "int")
    for made, want in ((words.sentence_case, "Ab, ça. D"), (words.title_case, "Ab, Ça. D"), (t.fold_accents, "Ab, ca. d")):
        spark.conf.set(key, "10000")
        try:
            got = rows.select(made(F.col("v")).alias("v"), size("id").alias("n")).distinct().collect()
            assert {r.v for r in got} == {want} and max(r.n for r in got) <= 256
        finally:
            spark.conf.unset(key)


def test_small_blocks_share_tasks(spark, tmp_path):
    """Each block of a file was a task and a file of its own, however small."""
    (tmp_path / "a.csv").write_text("".join(f'{i},"x\n{i}"\n' for i in range(20_000)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2048")
    try:
        rows = records.read_records(spark, f"file://{tmp_path}/a.csv", ",", "utf-8", folder=f"file://{tmp_path}/out")
    finally:
        spark.conf.set(key, before)
    got = rows.select("_row", F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(1)).alias("b")).orderBy("_row").collect()
    assert [tuple(r) for r in got] == [(i, str(i), f"x\n{i}") for i in range(20_000)]
    assert len(list((tmp_path / "out" / "lines").glob("part-*"))) <= spark.sparkContext.defaultParallelism


def test_areas_of_gathered_boxes(spark, monkeypatch):
    """A page's boxes were joined with its strips, through five sorts."""
    r = random.Random(3)
    rows = [(p, float(r.randrange(12)), float(r.randrange(12)), float(r.randrange(5)), float(r.randrange(1, 5))) for p in range(40) for _ in range(r.randrange(1, 9))]
    boxes = spark.createDataFrame([*rows, (99, 1.0, 1.0, 0.0, 3.0)], "page int, x double, y double, w double, h double")
    want = {}
    for p, x, y, w, h in rows:
        want.setdefault(p, set()).update((a, b) for a in range(int(x), int(x + w)) for b in range(int(y), int(y + h)))
    want = {p: float(len(cells)) for p, cells in want.items() if cells}
    found = layout.union_area(boxes, "page")
    assert {r.page: r.area for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(layout, "MANY", 3)
    assert {r.page: r.area for r in layout.union_area(boxes, "page").collect()} == want


def test_justified_of_gathered_lines(spark, monkeypatch):
    r = random.Random(4)
    rows = [(b, k, r.choice([0.0, 1.0, 1.5, 3.0, None]), r.choice([90.0, 91.5, 93.1])) for b in range(80) for k in range(r.randrange(1, 9))]
    lines = spark.createDataFrame(rows, "b int, k int, x0 double, x1 double")
    want = {r.b: r.justified for r in layout._justified(lines, ["b"], "k", "x0", "x1").collect()} if hasattr(layout, "_justified") else None
    found = layout.justified(lines, ["b"], "k", "x0", "x1")
    assert {r.b: r.justified for r in found.collect()} == want and {True, False} == set(want.values())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    monkeypatch.setattr(layout, "MANY", 4)
    assert {r.b: r.justified for r in layout.justified(lines, ["b"], "k", "x0", "x1").collect()} == want


def test_values_are_read_once(spark):
    """A column's values were read in the task that read its file, each as often as it stands there."""
    rows = spark.range(1000).select("id", F.lit("$1.50").alias("a"), F.when(F.col("id") % 4 == 0, "x").otherwise("7").alias("b"), F.when(F.col("id") < 2, "1").alias("c"))
    found = geometry.column_kinds(rows, "id", ["a", "b", "c"])
    assert sorted(map(tuple, found.collect())) == [("a", 1000, "money", 2), ("b", 1000, "number", 0), ("c", 2, "text", 0)]
    assert "Aggregate [name" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Aggregate [") == 2


def test_finished_nodes_are_not_joined(spark, monkeypatch, tmp_path):
    """Nodes that had reached a root were joined by a null key, all in one task."""
    nodes = spark.createDataFrame([(1, i, i // 2 if i > 1 else None, i, "a") for i in range(1, 200)], "tree int, id int, parent int, ord int, role string")
    plans, settled = [], trees.settled
    monkeypatch.setattr(trees, "settled", lambda frame, folder, name: (plans.append(frame._jdf.queryExecution().optimizedPlan().toString()), settled(frame, folder, name))[1])
    got = {r.id: [n.id for n in r.path] for r in trees.tree_paths(nodes, ["tree"], f"file://{tmp_path}/t").collect()}
    up = lambda i: [*up(i // 2), i] if i else []
    assert got == {i: up(i) for i in range(1, 200)}
    assert len(plans) > 2 and all("Union" in p and "isnotnull(_up" in p.split("Join LeftOuter")[1] for p in plans[1:])


def test_lines_of_gathered_pages(spark):
    """A page's spans were joined with their lines and shuffled once more to gather them."""
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randrange(6), i, r.choice(["x", " y ", "  "]), float(r.randrange(9)), r.choice([None, *[k / 2 for k in range(60)]]), 4.0, 6.0, 6.0) for i in range(600)]
    spans = spark.createDataFrame(rows, "doc string, page int, seq int, text string, x double, y double, w double, size double, body double")
    told = lambda found: sorted((x.doc, x.page, x.line, x._body, tuple((s.x, s.seq, s.w, s.size, s.y, s.text, s.weight) for s in x._s)) for x in found.collect())
    want = told(columns._gathered(columns.runs_of(spans, ["doc", "page"], "body"), ["doc", "page", "line"], "body"))
    found = columns.page_lines(spans, ["doc", "page"], "body")
    assert told(found) == want and max(len({s[4] for s in x[4]}) for x in want) > 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [") == 1


def test_profiles_of_counted_places(spark, monkeypatch, tmp_path):
    """Each run of a document was sorted and joined several times, all in one task."""
    rows = [("d", i // 10, float(i % 10), float(50 + 100 * (i % 2)), 40.0, 10.0) for i in range(4000)]
    runs = spark.createDataFrame(rows, "doc string, page int, line double, x double, w double, body double")
    sizes, settled = {}, columns.settled
    monkeypatch.setattr(columns, "settled", lambda frame, folder, name: sizes.setdefault(name, settled(frame, folder, name)))
    found = columns.profile(runs, ["doc"], "body", columns.SCOUT).orderBy("col").collect()
    assert [(x.x0, x.x1, x.align, x.support) for x in found] == [(50.0, 90.5, "right", 2000), (150.0, 190.0, "right", 2000)]
    assert sizes["places"].count() == 2 and {"extent", "laid", "told"} <= set(sizes)


def test_larger_tables_make_more_tasks(spark, monkeypatch):
    """A window's tasks were as many as the session's partitions, or fewer, however large the table."""
    made = lambda: base.keyed(spark, "/root/testdata/sf0.01", "lineitem", "l_suppkey").rdd.getNumPartitions()
    assert made() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(base, "PART", 1 << 15)
    assert made() > 20
    plan = q_tables.chains(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_suppkey") == 1 and "REPARTITION_BY_NUM" in plan


def test_many_rows_of_a_small_file_are_shuffled(spark, monkeypatch):
    """Marks and spans, some ten a customer, were taken for as small as the customers' file and sent through the driver."""
    plans, settled = [], trees.settled
    seen = lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(trees, "settled", lambda frame, folder, name: (seen(frame), settled(frame, folder, name))[1])
    seen(q_pages.tagged(spark, "/root/testdata/sf0.001"))
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
