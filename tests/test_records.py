"""Records of split files against one parse of the whole file."""

import random

import pytest

from plumbline.sources import delimited, records


def plain(text, mark=","):
    """Records by one pass over all characters."""
    rows, row, at, unclosed = [], [], 0, False
    while at < len(text):
        if text[at] == '"':
            value, at = "", at + 1
            while True:
                end = text.find('"', at)
                if end < 0:
                    value, at, unclosed = value + text[at:], len(text), True
                    break
                value += text[at:end]
                rest = text[end + 1 :].lstrip(" ")
                if text.startswith('""', end):
                    value, at = value + '"', end + 2
                elif not rest or rest[0] == mark or rest.startswith(("\n", "\r\n")):
                    at = len(text) - len(rest)
                    break
                else:
                    value, at = value + '"', end + 1
            row.append(value)
        else:
            end = min(e for e in (text.find(mark, at), text.find("\n", at), len(text)) if e >= 0)
            row.append(text[at:end].removesuffix("\r") if end == len(text) or text[end] == "\n" else text[at:end])
            at = end
        if text.startswith("\r\n", at):
            at += 1
        if at < len(text) and text[at] == mark:
            at += 1
            if at == len(text) or text[at] == "\n":
                row.append("")
            else:
                continue
        if not (at < len(text) and text[at] == mark):
            rows.append(row)
            row, at = [], at + 1
    return rows, unclosed


def made(seed, rows=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bc", "", "é", "5\" pipe", "x y", "1.50", "日本"])
    quoted = lambda: '"' + rng.choice(["a,b", "two\nlines", "", 'say ""no""', "\n\n", "end\r\nthere", 'odd "mark', ",", "plain"]) + '"' + rng.choice(["", "", " "])
    return "".join(",".join(quoted() if rng.random() < 0.3 else word() for _ in range(rng.randint(1, 5))) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(rows))


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("257", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(3))
def test_split_records_equal_one_pass(spark, tmp_path, small_splits, seed):
    text = made(seed)
    if seed == 2:
        text += 'last,"never closed\nand more,\n"" so'
    (tmp_path / "a.csv").write_bytes(("﻿" if seed else "").encode() + text.encode())
    wanted, unclosed = plain(text)
    frame = records.read_records(spark, f"file://{tmp_path}/a.csv", ",", "utf-8", folder=f"file://{tmp_path}/work")
    assert spark.read.text(f"file://{tmp_path}/a.csv").rdd.getNumPartitions() > 10
    got = frame.orderBy("_row").collect()
    assert [r._row for r in got] == list(range(len(wanted)))
    assert [r.cells for r in got] == wanted
    assert [r._row for r in got if r.unclosed] == ([len(wanted) - 1] if unclosed else [])
    if unclosed:
        assert got[-1].swallowed == 2


def test_states_of_lines():
    assert [records.ends_inside(x, ",", s) for x in ("a,b", 'a,"b', '"a" ,b"c', 'x",y', 'x"y', '""') for s in (False, True)] == [False, True, True, True, False, False, False, False, False, True, False, True]
    assert records.cells('"a"b",c', ",") == (['a"b', "c"], False) and records.cells('5" x,"y" \r', ",") == (['5" x', "y"], False) and records.cells("", ",") == ([""], False)


@pytest.mark.parametrize(("encoding", "mark"), [("utf-8-sig", ";"), ("cp1252", "|"), ("shift_jis", "\t")])
def test_form_is_told(spark, tmp_path, small_splits, encoding, mark):
    word = "日本語のテスト" if encoding == "shift_jis" else "Café naïve déjà"
    text = "\r\n".join(mark.join([word, f'"{k}{mark}{word}\r\n{k}"', "z"] if k % 7 == 3 else [word, str(k), "z"]) for k in range(120)) + "\r\n"
    (tmp_path / "b.csv").write_bytes(text.encode(encoding))
    got = records.read_records(spark, f"file://{tmp_path}/b.csv", folder=f"file://{tmp_path}/work").orderBy("_row").collect()
    assert [r.cells for r in got] == [[word, f"{k}{mark}{word}\r\n{k}" if k % 7 == 3 else str(k), "z"] for k in range(120)]


def test_rows_keep_surplus_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text('sep=;\na;b\n"x\ny";2;3;4\n\nz\n;;\n \n')
    folder = f"file://{tmp_path}"
    rows = delimited.read_rows(spark, f"{folder}/c.csv", 2, None, f"{folder}/w1", None).orderBy("_row").collect()
    assert [(r._row, r.c0, r.c1, r.more) for r in rows] == [(0, "a", "b", []), (1, "x\ny", "2", ["3", "4"]), (2, "", "", []), (3, "z", "", []), (4, "", "", [""]), (5, " ", "", [])]
    found = records.read_records(spark, f"{folder}/c.csv", folder=f"{folder}/w2")
    assert records.without_blank_end(found).count() == 4
    told = records.ragged(found).first()
    assert (told.columns, told.rows, told.ragged, told.unclosed, told.swallowed) == (4, 6, 5, 0, 0)


def test_wide_characters_are_refused(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes("a,b\nc,d\n".encode("utf-16"))
    with pytest.raises(ValueError, match="read_grid"):
        records.read_records(spark, f"file://{tmp_path}/d.csv", folder=f"file://{tmp_path}/work")


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert records.read_records(spark, f"file://{tmp_path}/e.csv", folder=f"file://{tmp_path}/work").collect() == []
