"""Dates written as text: what they can mean, and rewriting them once a column's order is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import js_trim

#: Month names, their short forms, and the forms in which dates are read.
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS = {name: k for k, name in enumerate(MONTH_NAMES, 1)} | {name[:3]: k for k, name in enumerate(MONTH_NAMES, 1)} | {"febr": 2, "sept": 9}
TIME = r"^(.*?)[T\s]+(\d{1,2}:\d{2}(?::\d{2})?(?:\.\d{1,6})?(?:\s?[APap]\.?[Mm]\.?)?(?:\s?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?)$"
ISO = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
MONTH_FIRST = r"([A-Za-z]{3,9})\.?[\s\-/]+(\d{1,2})(?:st|nd|rd|th)?,?[\s\-/]+(\d{2}|\d{4})"
DAY_FIRST = r"(\d{1,2})(?:st|nd|rd|th)?[\s\-/]+([A-Za-z]{3,9})\.?,?[\s\-/]+(\d{2}|\d{4})"
YEAR_FIRST = r"(\d{4})[\s\-/]+([A-Za-z]{3,9})\.?[\s\-/]+(\d{1,2})(?:st|nd|rd|th)?"
#: One form with the same separator twice, written out, as the parts must keep their numbers in the pattern of all forms.
SLASHED = (r"(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})", r"(\d{1,2})-(\d{1,2})-(\d{2}|\d{4})", r"(\d{1,2})\.(\d{1,2})\.(\d{4})")
#: All forms at once, three parts each; and a date as year|month|day or, in either order, as |||year|first|second.
FORMS = "^(?:" + "|".join((ISO, MONTH_FIRST, DAY_FIRST, YEAR_FIRST, *SLASHED)) + ")$"
PARTS = "$1$6$9$10|$2$4$8$11|$3$5$7$12|$15$18$21|$13$16$19|$14$17$20"


def is_real(y: Column, m: Column, d: Column) -> Column:
    """True for a day of the Gregorian calendar, years 1 to 9999."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce((y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= days), F.lit(False))


def full_year(raw: Column) -> Column:
    """Two digits: to 68 in this century, from 69 on in the last."""
    n = raw.try_cast("int")
    return F.when(F.length(raw) == 4, n).when(F.length(raw) == 2, F.when(n <= 68, 2000 + n).otherwise(1900 + n))


def month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.element_at(table, F.lower(name))


def inspect(c: Column) -> Column:
    """kind (not-a-date, fixed, ordered, ambiguous), order (dmy, mdy), y, first, second and time.

    For fixed dates first is the month and second the day; else they are the numbers as written.
    Only texts of 4 to 40 characters with a digit are looked into, by one pattern for all forms.
    """
    return _bound(js_trim(c), lambda value: F.when(F.length(value).between(4, 40) & value.rlike("[0-9]"), _bound(_said(value), lambda x: _bound(_numbers(x), _judged))).otherwise(_none()))


def _bound(value: Column, f) -> Column:
    """f of a value that is evaluated once: an array of one, transformed."""
    return F.transform(F.array(value), f)[0]


def _none() -> Column:
    nothing = F.lit(None).cast("int")
    return F.struct(F.lit("not-a-date").alias("kind"), F.lit(None).cast("string").alias("order"), nothing.alias("y"), nothing.alias("first"), nothing.alias("second"), F.lit("").alias("time"))


def _said(value: Column) -> Column:
    """parts of the date as written, and its time."""
    timed = value.contains(":") & value.rlike(TIME)
    body = F.when(timed, js_trim(F.regexp_extract(value, TIME, 1))).otherwise(value)
    time = F.when(timed, js_trim(F.regexp_extract(value, TIME, 2))).otherwise("")
    return F.struct(F.split(F.regexp_replace(body, FORMS, PARTS), r"\|", -1).alias("p"), time.alias("t"))


def _numbers(s: Column) -> Column:
    """shape (1 fixed, 2 numbers in either order, 0 none), year, first and second; for shape 1 first is the month."""
    p = s["p"]
    shape = F.when(F.size(p) != 6, 0).when(p[0] != "", 1).when(p[3] != "", 2).otherwise(0)
    month = F.coalesce(p[1].try_cast("int"), month_number(p[1]))
    pick = lambda fixed, free: F.when(F.size(p) != 6, None).when(p[0] != "", fixed).otherwise(free)
    return F.struct(
        shape.alias("shape"), full_year(pick(p[0], p[3])).alias("y"), pick(month, p[4].try_cast("int")).alias("a"), pick(p[2], p[5]).try_cast("int").alias("b"), s["t"].alias("t"),
    )


def _judged(n: Column) -> Column:
    y, a, b = n["y"], n["a"], n["b"]

    def result(kind: str, order: str | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(order).cast("string").alias("order"), y.alias("y"), a.alias("first"), b.alias("second"), n["t"].alias("time"))

    none = _none()
    can = F.struct(is_real(y, a, b).alias("mdy"), is_real(y, b, a).alias("dmy"))
    return _bound(can, lambda c: (
        F.when((n["shape"] == 1) & c["mdy"], result("fixed")).when(n["shape"] != 2, none)
        .when(c["dmy"] & c["mdy"], result("ambiguous")).when(c["dmy"], result("ordered", "dmy")).when(c["mdy"], result("ordered", "mdy")).otherwise(none)
    ))


def written(i: Column, order: Column | str | None = None, style: str = "iso") -> Column:
    """An inspected date in one style (iso, us, eu) with its time kept; null if it is none, or is ambiguous and no order is given."""
    order = F.lit(order).cast("string") if order is None or isinstance(order, str) else order
    own = F.coalesce(i["order"], order)
    month_first = (i["kind"] == "fixed") | (own == "mdy")
    month, day = F.when(month_first, i["first"]).otherwise(i["second"]), F.when(month_first, i["second"]).otherwise(i["first"])
    y, m, d = F.lpad(i["y"].cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
    date = {"iso": F.concat_ws("-", y, m, d), "us": F.concat_ws("/", m, d, y), "eu": F.concat_ws("/", d, m, y)}[style]
    settled = (i["kind"] == "fixed") | own.isNotNull()
    return F.when((i["kind"] != "not-a-date") & settled, F.concat(date, F.when(i["time"] == "", "").otherwise(F.concat(F.lit(" "), i["time"]))))


def normalise(c: Column, order: Column | str | None = None, style: str = "iso") -> Column:
    """The date in one style (iso, us, eu) with its time kept; null leaves a text as it is.

    Ambiguous dates need an order, dmy or mdy.
    """
    return _bound(inspect(c), lambda i: written(i, order, style))


def spreadsheet_serial(iso: Column) -> Column:
    return F.datediff(iso.cast("date"), F.lit("1970-01-01").cast("date")) + 25569


#: The forms of dates in tables of a page, three parts each.
PLACED = r"^(?:(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})|(\d{1,2})[-/. ]([A-Za-z]{3,9})[-/. ](\d{2,4})|([A-Za-z]{3,9})[-/. ](\d{1,2}),?[-/. ](\d{2,4})|(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4}))$"
NUMERIC = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"
PLACED_PARTS = "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|$11|$12"


def short_month(name: Column) -> Column:
    """The month that a name begins with, by its first three letters (or sept)."""
    key = F.lower(name)
    return F.coalesce(*[F.when(F.substring(key, 1, 3) == month[:3], k) for k, month in enumerate(MONTH_NAMES, 1)])


def _placed_year(raw: Column) -> Column:
    return _full_placed(raw.try_cast("int"))


def _full_placed(n: Column) -> Column:
    return F.when(n >= 100, n).when(n >= 70, 1900 + n).otherwise(2000 + n)


def _placed(c: Column, read) -> Column:
    """read of the parts of a date in a table; null for what is none."""
    # The forms are 6 to 18 characters long.
    value = F.translate(js_trim(c), "\u00a0", " ")
    return _bound(value, lambda v: F.when(F.length(v).between(6, 18) & v.rlike(PLACED), _bound(F.split(F.regexp_replace(v, PLACED, PLACED_PARTS), r"\|", -1), read)))


def _placed_as(p: Column, asked: Column) -> Column:
    """iso, order and ambiguous of a date's parts, read in an order where they leave it open."""
    number = lambda k: p[k].try_cast("int")

    def out(y: Column, m: Column, d: Column, order: str, ambiguous: bool) -> Column:
        iso = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        return F.when(is_real(y, m, d), F.struct(iso.alias("iso"), F.lit(order).alias("order"), F.lit(ambiguous).alias("ambiguous")))

    a, b, y = number(9), number(10), _placed_year(p[11])
    free = (
        F.when((a > 12) & (b <= 12), out(y, b, a, "dmy", False)).when((b > 12) & (a <= 12), out(y, a, b, "mdy", False))
        .when((a > 12) & (b > 12), None).when(asked == "dmy", out(y, b, a, "dmy", True)).when(asked == "mdy", out(y, a, b, "mdy", True))
        .otherwise(F.struct(F.lit(None).cast("string").alias("iso"), F.lit(None).cast("string").alias("order"), F.lit(True).alias("ambiguous")))
    )
    return (
        F.when(F.size(p) != 12, None).when(p[0] != "", out(number(0), number(1), number(2), "ymd", False))
        .when(p[3] != "", out(_placed_year(p[5]), short_month(p[4]), number(3), "dmy", False)).when(p[6] != "", out(_placed_year(p[8]), short_month(p[6]), number(7), "mdy", False)).otherwise(free)
    )


def placed_date(c: Column, order: Column | str | None = None) -> Column:
    """iso, order (ymd, dmy, mdy) and ambiguous of a date in a table; null for what is none. Two digits from 70 on are of the last century."""
    asked = F.lit(order).cast("string") if order is None or isinstance(order, str) else order
    return _placed(c, lambda p: _placed_as(p, asked))


def placed_parts(c: Column) -> Column:
    """y, m, d, order and ambiguous of a date in a trimmed cell of a table; null for what is none. Of an ambiguous one m and d are its numbers as written, null if they are no date in either order."""
    def put(x: Column, m: str, d: str, order: str | None) -> Column:
        return F.struct(x["y"].alias("y"), x[m].alias("m"), x[d].alias("d"), F.lit(order).cast("string").alias("order"), F.lit(order is None).alias("ambiguous"))

    def sure(x: Column, m: str, d: str, order: str) -> Column:
        return F.when(is_real(x["y"], x[m], x[d]), put(x, m, d, order))

    def free(x: Column) -> Column:
        a, b = x["a"], x["b"]
        # Every month has twelve days, so either order is a date or none is.
        real = (a >= 1) & (b >= 1) & x["y"].between(1, 9999)
        none = F.struct(x["y"].alias("y"), F.lit(None).cast("int").alias("m"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("string").alias("order"), F.lit(True).alias("ambiguous"))
        return F.when((a <= 12) & (b <= 12), F.when(real, put(x, "a", "b", None)).otherwise(none)).when(b <= 12, sure(x, "b", "a", "dmy")).when(a <= 12, sure(x, "a", "b", "mdy"))

    of = lambda y, a, b: F.struct(y.alias("y"), a.try_cast("int").alias("a"), b.try_cast("int").alias("b"))
    of_year = lambda raw: _bound(raw.try_cast("int"), _full_placed)
    numeric = lambda p: _bound(of(of_year(p[2]), p[0], p[1]), free)

    def read(p: Column) -> Column:
        year = lambda k: of_year(p[k])
        return (
            F.when(F.size(p) != 12, None).when(p[0] != "", _bound(of(p[0].try_cast("int"), p[1], p[2]), lambda x: sure(x, "a", "b", "ymd")))
            .when(p[3] != "", _bound(of(year(5), short_month(p[4]), p[3]), lambda x: sure(x, "a", "b", "dmy"))).when(p[6] != "", _bound(of(year(8), short_month(p[6]), p[7]), lambda x: sure(x, "a", "b", "mdy")))
            .otherwise(_bound(of(year(11), p[9], p[10]), free))
        )

    spaced = F.when(c.contains("\u00a0"), F.translate(c, "\u00a0", " ")).otherwise(c)
    short = F.split(F.translate(c, "-.", "//"), "/", -1)
    return F.when(~F.length(c).between(6, 18), None).when(c.rlike(NUMERIC), _bound(short, numeric)).otherwise(_bound(spaced, lambda v: F.when(v.rlike(PLACED), _bound(F.split(F.regexp_replace(v, PLACED, PLACED_PARTS), r"\|", -1), read))))


def parts_iso(parts: Column, order: Column) -> Column:
    """iso of the parts of a date, in its column's order if it is ambiguous."""
    def told(m: Column, d: Column) -> Column:
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        return F.concat_ws("-", F.lpad(parts["y"].cast("string"), 4, "0"), two(m), two(d))

    return F.when(parts_fit(parts, order), F.when(parts["ambiguous"] & (order == "dmy"), told(parts["d"], parts["m"])).otherwise(told(parts["m"], parts["d"])))


def parts_fit(parts: Column, order: Column) -> Column:
    """True if parts are a date in their column's order."""
    return F.coalesce(parts["m"].isNotNull() & (~parts["ambiguous"] | order.isin("dmy", "mdy")), F.lit(False))


def column_order(dmy: Column, mdy: Column, ambiguous: Column) -> Column:
    """The order that a column's unambiguous dates vote for (day first on a tie); day first if there are ambiguous ones only."""
    return F.when((dmy > 0) | (mdy > 0), F.when(dmy >= mdy, "dmy").otherwise("mdy")).when(ambiguous > 0, "dmy")


def iso_of_serial(serial: Column) -> Column:
    """A spreadsheet's day number as a date, with its time if there is one."""
    return iso_text(F.timestamp_seconds(F.round((serial - 25569) * 86400)))


def iso_text(at: Column) -> Column:
    """A timestamp as a date, with its time unless it is midnight."""
    return F.when(F.date_trunc("day", at) == at, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def epoch_text(seconds: Column, now: Column) -> Column:
    """at and relative (n, unit): an epoch's time and how far from now it is."""
    from plumbline.functions.text import relative_unit

    return F.struct(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss").alias("at"), relative_unit((seconds - now) * 1000).alias("relative"))
