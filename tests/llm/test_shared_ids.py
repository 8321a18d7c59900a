import random

from plumbline.llm import minhash


def test_shared_ids_are_no_hot_key(spark, docs):
    """Near copies under two ids, three thousand rows of them, and other texts under one of the ids."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(3000):
        words = list(base)
        words[rng.randrange(60)] = f"x{k}"
        rows.append((k % 2, " ".join(words)))
    rows += [(0, f"quite another text number {k} with words of its own {k * k} and {k + 1} more") for k in range(300)] + [(5, "one two three four five six seven"), (4, "one two three four five six seven")]
    out = minhash.near_duplicates(docs(rows)).collect()
    assert len(out) == len(rows)
    near = [r for r in out if r.n_shingles == 56]
    assert len(near) == 3000 and {r.component_id for r in near} == {0}
    assert {(r.doc_id, r.component_id) for r in out if r.n_shingles == 3} == {(5, 4), (4, 4)}


def test_ids_of_any_type(spark):
    rows = [("b", "one two three four five six seven"), ("a", "One two three four five six seven"), ("c", "nothing of the kind is in here"), (None, "one two three four five six seven")]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: (None, False)}
