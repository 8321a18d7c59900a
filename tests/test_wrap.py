import random
import re

from pyspark.sql import functions as F

from plumbline.functions import wrap

WIDTHS = {"i": 200, "m": 800, " ": 250, "é": 450}


def plain(text, room):
    """Word by word, each width summed anew."""
    measure = lambda s: sum(WIDTHS.get(c, 500) for c in s)
    out = []
    for part in text.split("\n"):
        if measure(part) <= room:
            out.append(part)
            continue
        line = ""
        for token in re.findall(r"\s+|\S+", part):
            if measure(line + token) <= room:
                line += token
                continue
            if line.strip():
                out.append(line.rstrip())
                line = ""
            if token.isspace():
                line = ""
                continue
            while measure(token) > room:
                n = 1
                while n < len(token) and measure(token[: n + 1]) <= room:
                    n += 1
                out.append(token[:n])
                token = token[n:]
            line = token
        if line.strip():
            out.append(line.rstrip())
    return out or [""]


def test_wrap_equals_plain_loops():
    rng = random.Random(1)
    for _ in range(600):
        text = "".join(rng.choice("aim é  mmiiab\n") for _ in range(rng.randint(0, 80)))
        for room in (1, 700, 1800, 4000):
            assert wrap.wrap(text, room, WIDTHS, 500) == plain(text, room), (text, room)


def test_column(spark):
    rows = spark.createDataFrame([(1, "aa bb cc"), (2, None), (3, "x" * 100_000)], "k int, t string")
    got = {r.k: r.l for r in rows.select("k", wrap.wrapped(F.col("t"), 25.0, 10.0, {}, 500).alias("l")).collect()}
    assert got[1] == ["aa bb", "cc"] and got[2] == [""] and len(got[3]) == 20_000 and set(got[3]) == {"xxxxx"}
    assert wrap.wrap("a b c", 500, {}, 500, most=2) == ["a", "b"]
