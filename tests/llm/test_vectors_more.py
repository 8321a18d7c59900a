import numpy as np

from plumbline.llm import vectors


def test_large_components_link(spark):
    rows = [(1, [1e200, 1e200, 0.0, 0.0], 0), (2, [2e200, 2.1e200, 0.0, 0.0], 0), (3, [1e-200, 1e-200, 0.0, 0.0], 0), (4, [0.0, 0.0, 1e300, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.forest_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_ids_in_two_labels(spark, monkeypatch):
    """Ids occur in both labels, and leaves are split on by samples of their own."""
    monkeypatch.setattr(vectors, "SAMPLE", 200)
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        x = rng.standard_normal((1500, 16))
        x[750:] = x[:750] + 0.02 * rng.standard_normal((750, 16))
        rows += [(int(k), v.tolist(), label) for k, v in enumerate(x)]
    out = vectors.forest_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links = sum(r.n_links for r in out)
    wanted = 0
    for label in (0, 1):
        x = np.array([v for _, v, m in rows if m == label])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        wanted += int((x @ x.T >= 0.93).sum()) - len(x)
    assert 0.95 * wanted <= links <= wanted


def test_leaves_without_links(spark):
    rng = np.random.default_rng(1)
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(rng.standard_normal((300, 32)))]
    out = vectors.forest_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.n_links for r in out} == {0} and all(r.kept for r in out)
