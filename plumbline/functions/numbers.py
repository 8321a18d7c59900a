"""Numbers and amounts written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import SPACE, js_trim

#: Currency signs and codes, and the ways in which digits are grouped.
SIGNS = "£$€₹¥₨"
CODES = r"(?i)(?:\b(?:GBP|USD|EUR|INR|AUD|CAD|SGD|AED)\b|\bRs\.?)"
GAPS = " \t\n\x0b\f\r\u00a0\u2009\u202f"
SPACED = r"^\d{1,3}(?:[ \x{A0}\x{2009}\x{202F}]\d{3})+(?:[.,]\d{1,2})?$"
PLAIN, INDIAN, EUROPEAN = r"^\d{1,3}(?:,\d{3})+$", r"^\d{1,2}(?:,\d{2})+,\d{3}$", r"^\d{1,3}(?:\.\d{3})+$"
CREDIT = r"(^|[\s\d.])(CR|DR|Cr|Dr|cr|dr)\.?(\s|$)"
#: Fixed value: decimals that make money.
MONEY = 2
#: Digits alone, with a sign and decimals at most; and what no amount holds: anything but digits, points, commas, brackets, signs, white space and letters of codes and markers.
BARE = r"^-?[0-9]+(?:\.[0-9]{1,2})?$"
DASHES = "−–—"
FOREIGN = rf"[^0-9.,()+\-{DASHES}{SIGNS}{SPACE}ABCDEGINPRSUabcdeginprsu]"
#: Those of them that are printable ASCII, one by one, which Java looks up in a table.
FOREIGN_ASCII = "[" + "".join(f"\\x{k:02x}" for k in range(33, 127) if chr(k) not in "0123456789.,()+-$ABCDEGINPRSUabcdeginprsu") + "]"


def _bound(value: Column, f) -> Column:
    """f of a value that is evaluated once."""
    return F.transform(F.array(value), f)[0]


def amount(c: Column) -> Column:
    """value, negative, currency, marker (CR, DR), grouping, decimals; null for what is no amount or could be two.

    Signs, gaps and brackets are taken off without patterns; currency codes and markers are sought where there are letters. Digits alone, and texts that no amount can be, are told at once.
    """
    return _bound(c, lambda v: F.when(v.rlike(BARE), _bare(v)).otherwise(_written(v)))


def _written(v: Column) -> Column:
    """amount of what isn't digits alone."""
    found = lambda x: F.when(x.rlike(BARE), _bare(x)).when(x.rlike("[0-9]"), _bound(_bound(_bound(_bound(x, _money), _marked), _digits), _finished))
    return F.when(v.rlike(FOREIGN_ASCII), None).when(v.rlike(FOREIGN), None).otherwise(_bound(js_trim(F.translate(v, DASHES, "---")), found))


def is_amount(c: Column) -> Column:
    """True where amount has a value, false else; digits alone are told at once."""
    return F.coalesce(F.when(c.rlike(BARE), True).otherwise((c != "") & amount(c)["value"].isNotNull()), F.lit(False))


def _bare(x: Column) -> Column:
    none, point = F.lit(None).cast("string"), F.instr(x, ".")
    decimals = F.when(point > 0, F.length(x) - point).otherwise(0)
    return F.struct(
        x.try_cast("double").alias("value"), x.startswith("-").alias("negative"), none.alias("currency"), none.alias("marker"), F.lit("none").alias("grouping"), decimals.alias("decimals"),
    )


def _money(s: Column) -> Column:
    """The text without currencies, the currency, and whether it has letters."""
    unsigned, lettered = F.translate(s, SIGNS, ""), s.rlike("[A-Za-z]")
    code = F.when(lettered, F.regexp_replace(F.upper(F.regexp_extract(s, f"({CODES})", 1)), r"\.$", ""))
    currency = F.when(unsigned != s, F.regexp_extract(s, f"([{SIGNS}])", 1)).when(code != "", code)
    bare = F.when(lettered, F.regexp_replace(unsigned, CODES, "")).otherwise(unsigned)
    return F.struct(js_trim(bare).alias("s"), currency.alias("currency"), lettered.alias("lettered"))


def _bracketed(x: Column) -> Column:
    return x.startswith("(") & x.endswith(")") & (F.length(x) > 1)


def _inside(x: Column) -> Column:
    return F.when(_bracketed(x), F.trim(F.substring(x, F.lit(2), F.length(x) - 2), F.lit(" \t\n\x0b\f\r"))).otherwise(x)


def _marked(m: Column) -> Column:
    outer = m["s"]
    x = _inside(outer)
    marker = F.when(m["lettered"] & x.rlike(CREDIT), F.upper(F.regexp_extract(x, CREDIT, 2)))
    rest = F.when(marker.isNotNull(), js_trim(F.regexp_replace(x, CREDIT, "$1 "))).otherwise(x)
    negative = _bracketed(outer) | F.coalesce(marker == "DR", F.lit(False)) | _bracketed(rest)
    return F.struct(_inside(rest).alias("s"), marker.alias("marker"), negative.alias("negative"), m["currency"].alias("currency"))


def _digits(m: Column) -> Column:
    tight = F.translate(m["s"], GAPS, "")
    spaced = (tight != m["s"]) & js_trim(m["s"]).rlike(SPACED)
    dashed = tight.startswith("-") | tight.endswith("-")
    bare = F.when(dashed, F.regexp_replace(tight, "^-|-$", "")).otherwise(tight)
    body = F.when(spaced, js_trim(m["s"])).when(bare.startswith("+"), F.substring(bare, F.lit(2), F.length(bare))).otherwise(bare)
    return F.struct(body.alias("s"), spaced.alias("spaced"), (m["negative"] | dashed).alias("negative"), m["marker"].alias("marker"), m["currency"].alias("currency"))


def _read(d: Column) -> Column:
    """whole, fraction and grouping of digits with points and commas."""
    x = d["s"]
    without = lambda y, sign: F.replace(y, F.lit(sign), F.lit(""))
    dots, commas = F.length(x) - F.length(without(x, ".")), F.length(x) - F.length(without(x, ","))
    tail = F.substring_index(F.translate(x, ",", "."), ".", -1)
    head = F.substring(x, F.lit(1), F.length(x) - F.length(tail) - 1)
    point = F.substring(x, F.length(x) - F.length(tail), F.lit(1))

    def out(whole: Column, fraction: Column, grouping: str) -> Column:
        return F.struct(whole.alias("whole"), fraction.alias("fraction"), F.lit(grouping).alias("grouping"))

    none, empty = F.lit(None).cast("struct<whole:string,fraction:string,grouping:string>"), F.lit("")
    both = (
        F.when(~tail.rlike(r"^\d{1,3}$"), none)
        .when((point == ".") & head.rlike(INDIAN), out(without(head, ","), tail, "indian")).when((point == ".") & head.rlike(PLAIN), out(without(head, ","), tail, "plain"))
        .when((point == ",") & head.rlike(EUROPEAN), out(without(head, "."), tail, "european")).otherwise(none)
    )
    parted = dots + commas > 0
    return (
        F.when(d["spaced"], out(F.translate(F.when(parted, head).otherwise(x), GAPS, ""), F.when(parted, tail).otherwise(empty), "space"))
        .when(~x.rlike(r"^[.,]*[0-9][0-9.,]*$"), none)
        .when(~parted, out(x, empty, "none"))
        .when((dots > 0) & (commas > 0), both)
        .when(dots == 1, F.when(tail.rlike(r"^\d{1,2}$"), out(head, tail, "none")).otherwise(none))
        .when(dots > 1, F.when(x.rlike(EUROPEAN), out(without(x, "."), empty, "european")).otherwise(none))
        .otherwise(F.when(x.rlike(INDIAN), out(without(x, ","), empty, "indian")).when(x.rlike(PLAIN), out(without(x, ","), empty, "plain")).when(x.rlike(r"^\d{1,3},\d{1,2}$"), out(head, tail, "european")).otherwise(none))
    )


def _finished(d: Column) -> Column:
    def made(r: Column) -> Column:
        value = F.concat(r["whole"], F.when(r["fraction"] != "", F.concat(F.lit("."), r["fraction"])).otherwise("")).try_cast("double")
        return F.when(
            r["whole"].rlike(r"^\d+$"),
            F.struct(
                F.when(d["negative"], -value).otherwise(value).alias("value"), d["negative"].alias("negative"), d["currency"].alias("currency"),
                d["marker"].alias("marker"), r["grouping"].alias("grouping"), F.length(r["fraction"]).alias("decimals"),
            ),
        )

    return _bound(_read(d), made)


def minor_units(value: Column, decimals: int = 2) -> Column:
    """Whole minor units; halves go up, also below zero."""
    return F.floor(value * F.lit(float(10**decimals)) + 0.5).cast("long")


NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"


def coerced_kind(c: Column) -> Column:
    """What a cell becomes in JSON: blank, null, true, false, object, array, number or text.

    Whole numbers beyond 2**53 - 1 stay text, as do long decimals that wouldn't come back as they are.
    """
    x = js_trim(c)
    n = x.try_cast("double")
    whole_unsafe = (n == F.floor(n)) & (F.abs(n) > 9007199254740991)
    return (
        F.when(x == "", "blank").when(x.isin("null", "NULL", "Null"), "null").when(x.isin("true", "TRUE", "True"), "true").when(x.isin("false", "FALSE", "False"), "false")
        .when(x == "{}", "object").when(x == "[]", "array").when(~x.rlike(NUMBER), "text").when(whole_unsafe | (F.length(x) > 15), "text").otherwise("number")
    )


def coerced(c: Column) -> Column:
    """kind, number and text of a cell: numbers as doubles, everything that stays text as it was."""
    kind = coerced_kind(c)
    return F.struct(kind.alias("kind"), F.when(kind == "number", js_trim(c).try_cast("double")).alias("number"), F.when(kind.isin("text", "blank"), c).alias("text"))


def reading(c: Column) -> Column:
    """some (not blank), value, decimals and rich (written as money is) of the amount that a trimmed cell may be, and y, m, d, order, ambiguous of the date: all that doesn't hang on its column."""
    from plumbline.functions import dates

    def told(a: Column, rich: Column, d: Column, some: Column) -> Column:
        return F.struct(some.alias("some"), a["value"].alias("value"), a["decimals"].alias("decimals"), rich.alias("rich"), *[d[f].alias(f) for f in ("y", "m", "d", "order", "ambiguous")])

    def worded(v: Column, x: Column) -> Column:
        a = x["a"]
        rich = a.isNotNull() & (a["currency"].isNotNull() | a["marker"].isNotNull() | (a["decimals"] >= MONEY) | v.rlike(r"^\(.*\)$"))
        return told(a, rich, x["d"], F.coalesce(v != "", F.lit(False)))

    # Digits alone are no date.
    none = F.lit(None).cast("struct<y:int,m:int,d:int,order:string,ambiguous:boolean>")
    bare = lambda v: _bound(_bare(v), lambda a: told(a, a["decimals"] >= MONEY, none, F.lit(True)))
    long = lambda v: _bound(F.struct(_written(v).alias("a"), dates.placed_parts(v).alias("d")), lambda x: worded(v, x))
    return _bound(c, lambda v: F.when(v.rlike(BARE), bare(v)).otherwise(long(v)))


def fits(read: Column, column_kind: Column, order: Column) -> Column:
    """True if what was read of a cell is of its column's kind."""
    from plumbline.functions import dates

    return F.when(column_kind == "date", dates.parts_fit(read, order)).otherwise(read["value"].isNotNull())


def typed_reading(text: Column, read: Column, column_kind: Column, order: Column) -> Column:
    """typed_cell of a trimmed text that was read."""
    from plumbline.functions import dates

    iso = F.when(column_kind == "date", dates.parts_iso(read, order))
    number = F.when(column_kind.isin("money", "number"), read["value"])
    return _bound(F.struct(text.alias("text"), iso.alias("iso"), number.alias("number")), lambda x: _typed(x, column_kind))


def _typed(x: Column, column_kind: Column) -> Column:
    text, iso, number = x["text"], x["iso"], x["number"]
    kind = F.when(text == "", "empty").when(iso.isNotNull(), "date").when(number.isNotNull(), "number").otherwise("text")
    off = (text != "") & (column_kind != "text") & iso.isNull() & number.isNull()
    return F.struct(kind.alias("kind"), iso.alias("iso"), number.alias("number"), F.when(kind == "text", text).alias("text"), off.alias("off_type"))


def typed_cell(raw: Column, column_kind: Column, order: Column) -> Column:
    """kind (empty, date, number, text), iso, number, text and off_type: what a cell is in a column of a kind. One that doesn't fit keeps its text."""
    text = js_trim(raw)
    return _bound(F.struct(text.alias("text"), reading(text).alias("read")), lambda x: typed_reading(x["text"], x["read"], column_kind, order))


def sums_match(value: Column, total: Column) -> Column:
    """Equal up to 0.01, or a thousand millionth of the total."""
    return F.abs(value - total) <= F.greatest(F.lit(0.01), F.abs(total) * 1e-9)


def human_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal below 10."""
    def shown(scaled: Column, unit: str) -> Column:
        text = F.when(scaled < 10, F.format_string("%.1f", scaled)).otherwise(F.format_string("%.0f", scaled))
        return F.concat(text, F.lit(f" {unit}"))

    n = n.cast("double")
    return F.when(n < 1024, F.concat(F.format_string("%.0f", n), F.lit(" B"))).when(n < 1024**2, shown(n / 1024, "KB")).when(n < 1024**3, shown(n / 1024**2, "MB")).otherwise(shown(n / 1024**3, "GB"))


def roman(n: Column) -> Column:
    """Roman numerals, 1 to 3999."""
    steps = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
    out, left = F.lit(""), n.cast("int")
    for value, letters in steps:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(left / value).cast("int")))
        left = left % value
    return F.when(n.between(1, 3999), out)


def percent_change(before: Column, after: Column) -> Column:
    """Whole percent, halves up; 0 where there was nothing before."""
    return F.when(before > 0, F.floor((after - before) / before * 100 + 0.5)).otherwise(0).cast("long")


#: Fixed value: numbers as a spreadsheet writes them.
NUMBER_LIKE = r"^[-+(]?\s*[£$€¥]?\s*(?:\d{1,3}(?:[ .,]\d{3})+|\d+)(?:[.,]\d+)?\s*[)%]?$"
CLOCK = r"(?i)^\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]\.?m\.?)?$"


def spreadsheet_number(c: Column) -> Column:
    """A number as a spreadsheet writes it: (99), 12% (as 12), $1,234.50, 1.234,56; the last separator is the point unless it is the only kind and groups three digits."""
    s = js_trim(c)
    digits = F.regexp_replace(s, "[^0-9.,]", "")
    tail = F.substring_index(F.translate(digits, ",", "."), ".", -1)
    cut = F.length(digits) - F.length(tail)  # 0: no separator
    point = F.substring(digits, cut, F.lit(1))
    other = F.when(point == ".", digits.contains(",")).otherwise(digits.contains("."))
    decimal = (cut > 0) & ~((F.length(tail) == 3) & ~other)
    whole = F.translate(F.when(decimal, F.substring(digits, F.lit(1), cut - 1)).otherwise(digits), ".,", "")
    value = F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(decimal & (tail != ""), tail).otherwise("0")).try_cast("double")
    negative = s.startswith("-") | (s.startswith("(") & s.endswith(")"))
    return F.when(s.rlike(NUMBER_LIKE), F.when(negative, -value).otherwise(value))


def value_kind(c: Column) -> Column:
    """blank, number, date or text."""
    from plumbline.functions import dates

    return F.when(js_trim(c) == "", "blank").when(js_trim(c).rlike(NUMBER_LIKE), "number").when(js_trim(c).rlike(CLOCK) | (dates.inspect(c)["kind"] != "not-a-date"), "date").otherwise("text")


def count_across(space: Column, item: Column, gap: Column) -> Column:
    """How many items with gaps between them fit a space."""
    return F.greatest(F.lit(0), F.floor((space + gap) / (item + gap) + 1e-9)).cast("int")


def letters(n: Column, places: int = 7) -> Column:
    """a to z, aa, ab, …: 1 is a."""
    out, left = F.lit(""), n.cast("long")
    for _ in range(places):
        out = F.when(left > 0, F.concat(F.char(97 + (left - 1) % 26), out)).otherwise(out)
        left = F.when(left > 0, F.floor((left - 1) / 26)).otherwise(F.lit(0)).cast("long")
    return out
