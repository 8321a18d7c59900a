from pyspark.sql import functions as F

from plumbline.functions import fold


def test_fold():
    assert fold.fold("plain “text” – naïve €5 œ") == ("plain “text” – naïve €5 œ", 0, 0, [])
    assert fold.fold("Łódź → čas x​y ĳs") == ("Lódz -> cas xy ijs", 5, 0, [])
    assert fold.fold("Привет 😀 Ж ≤ 日本 a\n") == ("   <=  a", 1, 11, ["Cyrillic", "Chinese, Japanese or Korean", "emoji", "symbols"])
    assert fold.bare("ǘ") == "u" and fold.bare("е") is None and fold.bare("a") is None and fold.script_of("가") == "Korean"


def test_every_letter_left_can_be_drawn(spark):
    rows = spark.createDataFrame([(k, "".join(map(chr, range(start, start + 500)))) for k, start in enumerate((0, 0x180, 0x1E00, 0x2000, 0x2190, 0xAC00, 0x1F600))] + [(99, None)], "k int, t string").select("k", fold.folded(F.col("t")).alias("f"))
    for r in rows.collect():
        assert not fold._ODD.search(r.f.text) and (r.k == 99) == (r.f.simplified + r.f.dropped == 0)
    assert fold.folding(rows, "f").first().texts == 7
