"""String functions: Column in, Column out.

White space is the wide, Unicode class of the spreadsheet world, spelled out, since SQL's `trim` knows
U+0020 only. A blank is the empty string; null stays null.

Patterns that seldom match begin with a look-ahead for anything but printable ASCII, which costs one
comparison a character where the class itself costs a dozen; runs of white space are matched only where something changes.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.session import small_batches

#: White space, characters that show nothing (tab and line ends aside), and spaces that aren't U+0020.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE_IN_LINE = r"\t\x0B\f \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
INVISIBLE = r"[\x{00}-\x{08}\x0B\x0C\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}-\x{200F}\x{2028}\x{2029}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FFF9}-\x{FFFC}]"
ODD_SPACE = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
#: Placeholders that stand for nothing, and words that stay small inside a title.
SENTINELS = ("N/A", "#N/A", "NA", "NULL", "None", "nil", "NaN", "-", "--", "?")
SMALL_WORDS = tuple("a an and as at but by en for from if in nor of off on or per so the to up v via vs with yet".split())


#: The characters of SPACE; those of it that aren't U+0020; and what the scrubber drops or makes plain, sought fast.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_NOT_PLAIN, _NOT_PLAIN_IN_LINE = SPACE.replace(r"\r ", r"\r"), SPACE_IN_LINE.replace(r"\f ", r"\f")
_RARE = f"(?=[^ -~])(?:{INVISIBLE}|{ODD_SPACE})"


def js_trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return js_trim(c) == ""


def squash(c: Column) -> Column:
    """Runs of white space become one space, the ends are trimmed."""
    return js_trim(F.regexp_replace(c, f"[{_NOT_PLAIN}][{SPACE}]*| [{SPACE}]+", " "))


def is_squashed(c: Column) -> Column:
    """True for texts that squash leaves as they are."""
    return ~(c.startswith(" ") | c.endswith(" ") | c.contains("  ") | c.rlike(f"[{_NOT_PLAIN}]"))


def has_ink(c: Column) -> Column:
    """True for texts that aren't white space alone; most are told by their first letter."""
    return F.when(F.ascii(c).between(33, 126), True).otherwise(F.length(js_trim(c)) > 0)


def has_invisible(c: Column) -> Column:
    return c.rlike(_RARE)


# ---- cell scrubbing, in the order in which the cleaner applies it


def drop_invisible(c: Column) -> Column:
    return F.when(has_invisible(c), F.regexp_replace(F.regexp_replace(c, f"(?=[^ -~]){INVISIBLE}", ""), f"(?=[^ -~]){ODD_SPACE}", " ")).otherwise(c)


def collapse_spaces(c: Column) -> Column:
    """Runs of white space within a line become one space."""
    return F.regexp_replace(c, f"[{_NOT_PLAIN_IN_LINE}][{SPACE_IN_LINE}]*| [{SPACE_IN_LINE}]+", " ")


def flatten_newlines(c: Column) -> Column:
    return F.when(c.contains("\n") | c.contains("\r"), F.regexp_replace(c, f"[{SPACE_IN_LINE}]*+[\\r\\n][{SPACE}]*", " ")).otherwise(c)


def blank_sentinels(c: Column, sentinels=SENTINELS) -> Column:
    """Placeholders, in any case and with white space around, become the empty string."""
    longest, bare = max(map(len, sentinels), default=0), js_trim(c)
    return F.when((F.length(bare) <= longest) & F.lower(bare).isin([s.lower() for s in sentinels]), "").otherwise(c)


def merge_spellings(c: Column, plan: dict[str, str]) -> Column:
    if not plan:
        return c
    table = F.create_map(*[F.lit(x) for pair in plan.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)


# ---- identifiers and case


def tokenize(c: Column) -> Column:
    """Words of an identifier or text: acronyms, camel case, and anything but letters and digits part them."""
    parted = F.regexp_replace(c, r"(\p{Lu}|\p{N})(\p{Lu}\p{Ll})", "$1 $2")
    parted = F.regexp_replace(parted, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")
    return F.filter(F.split(parted, r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def capitalise(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def map_lines(c: Column, change) -> Column:
    """change() applied to each line; line ends of any kind stay."""
    lines = F.split(c, r"(?<=\n)|(?<=\r)(?!\n)", -1)

    def one(line: Column) -> Column:
        end = F.regexp_extract(line, r"(\r?\n|\r)$", 1)
        return F.concat(change(F.substring(line, F.lit(1), F.length(line) - F.length(end))), end)

    return F.array_join(F.transform(lines, one), "")


def _programmer(c: Column, join) -> Column:
    def line(x: Column) -> Column:
        indent, words = F.regexp_extract(x, f"^[{SPACE}]*", 0), tokenize(x)
        return F.when(F.size(words) == 0, x).otherwise(F.concat(indent, join(words)))

    return map_lines(c, line)


def snake_case(c: Column) -> Column:
    return _programmer(c, lambda w: F.array_join(F.transform(w, F.lower), "_"))


def kebab_case(c: Column) -> Column:
    return _programmer(c, lambda w: F.array_join(F.transform(w, F.lower), "-"))


def constant_case(c: Column) -> Column:
    return _programmer(c, lambda w: F.array_join(F.transform(w, F.upper), "_"))


def pascal_case(c: Column) -> Column:
    return _programmer(c, lambda w: F.array_join(F.transform(w, capitalise), ""))


def camel_case(c: Column) -> Column:
    return _programmer(c, lambda w: F.array_join(F.transform(w, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(capitalise(x))), ""))


def toggle_case(c: Column) -> Column:
    """Letters of one case become the other; characters with more than a simple case stay."""
    chars = F.split(c, "", -1)

    def one(x: Column) -> Column:
        low, up = F.lower(x), F.upper(x)
        return F.when((x == low) & (x != up), up).when((x == up) & (x != low), low).otherwise(x)

    return F.array_join(F.transform(chars, one), "")


# ---- headers


def strip_special(c: Column) -> Column:
    """Punctuation becomes a space; currency signs, % and ° keep columns apart and stay."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}\p{Sc}%° _-]+", " ")


def header_snake(c: Column) -> Column:
    out = F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    out = js_trim(F.regexp_replace(out, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2"))
    out = F.regexp_replace(F.regexp_replace(out, f"[{SPACE}-]+", "_"), "_+", "_")
    return F.lower(F.regexp_replace(out, "^_+|_+$", ""))


def essence(c: Column) -> Column:
    """What two headers share that differ in case, spaces, underscores and hyphens only."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\x{FEFF}", "")), f"[{SPACE}_-]+", "")


# ---- fingerprints


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    """Without accents, by compatibility decomposition, which SQL hasn't; ASCII texts come and go as they are."""
    return texts.map(lambda x: x if x is None or x.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", x) if unicodedata.category(ch)[0] != "M"))


def fold_accents(c: Column) -> Column:
    """An Arrow batch function, on batches of few texts: apply it to distinct values. ASCII texts don't go there at all."""
    small_batches(SparkSession.active())
    odd = c.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _folded(F.when(odd, c))).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(fold_accents(F.lower(c)), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def fingerprint(c: Column) -> Column:
    """The distinct words, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(words(c))), " ")


def word_key(c: Column) -> Column:
    """All words, sorted: equal for reorderings."""
    return F.array_join(F.array_sort(words(c)), " ")


def ordered_key(c: Column) -> Column:
    return F.array_join(words(c), " ")


def ngram_fingerprint(folded: Column, size: int = 3) -> Column:
    """The distinct n-grams, sorted, of a text whose accents were folded in a projection before (no batch function can stand in a lambda)."""
    base = F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}]+", "")
    n = F.length(base)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(base, i, F.lit(size)))
    return F.when(n == 0, "").otherwise(F.array_join(F.array_sort(F.array_distinct(grams)), ""))


#: Separators of digits, and signs other than + and -; with them go currencies and percents.
_SEPARATORS, _DASHES, _MONEY = ".,'\u00a0\u202f", "\u2212\u2013\u2014", r"\p{Sc}%"


def amount_signature(c: Column) -> Column:
    """The amounts that a text states, each as its digits with the signs, separators, brackets, currencies and percents that belong to them; sorted, joined by a bar.

    A sign counts before digits (spaces and currencies between) or right after one, a separator between
    two digits, brackets, currencies and percents beside digits. A space ends an amount once it has digits.
    """
    ahead, behind = f"(?=[ {_MONEY}]*[0-9])", f"(?<=[0-9][ {_MONEY}]{{0,40}})"
    one = F.translate(F.translate(c, "\x01", "\x02"), _DASHES, "-" * len(_DASHES))
    one = F.regexp_replace(one, f"(?<=[0-9])[{_SEPARATORS.replace('.', '')}](?=[0-9])", ",")
    one = F.regexp_replace(one, f"[{SPACE}]+", " ")  # one space says as much as several
    kept = "|".join(("[0-9]", f"[+-]{ahead}", "(?<=[0-9])[+-]", "(?<=[0-9])[.,](?=[0-9])", rf"\({ahead}", rf"{behind}\)", f"[{_MONEY}]{ahead}", f"{behind}[{_MONEY}]"))
    shown = F.translate(F.regexp_replace(F.regexp_replace(one, kept, "\x01$0"), "(?<!\x01)[^\x01 ]", "|"), "\x01", "")
    amounts = F.regexp_extract_all(shown, F.lit("(?:[^0-9| ] *)*[0-9][^| ]*|(?:[^0-9| ] *)+"), F.lit(0))
    return F.when(c.rlike("[0-9]"), F.array_join(F.array_sort(F.transform(amounts, lambda a: F.replace(a, F.lit(" "), F.lit("")))), "|")).otherwise("")


# ---- encodings


def base64_text(c: Column, url_safe: bool = False) -> Column:
    plain = F.regexp_replace(F.base64(c.cast("binary")), r"\s", "")
    return F.regexp_replace(F.translate(plain, "+/", "-_"), "=+$", "") if url_safe else plain


def base64_plain(c: Column) -> Column:
    """Decodes either alphabet, with or without padding and white space; null if that's impossible."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(c, "-_", "+/"), f"[{SPACE}]+", ""), "=+$", "")
    padded = F.concat(bare, F.repeat(F.lit("="), ((4 - F.length(bare) % 4) % 4).cast("int")))
    return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def url_component(c: Column) -> Column:
    """Percent-encoding that keeps letters, digits and - _ . ! ~ * ' ( )."""
    form = F.url_encode(c)
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")), form)


def url_plain(c: Column) -> Column:
    """Undoes percent-encoding; a plus stays a plus, and what can't be decoded is null."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def html_escape(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), c)


#: The names of the characters that are decoded; others stay as they are.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "frac12": "½", "frac14": "¼", "frac34": "¾", "sup1": "¹", "sup2": "²", "sup3": "³",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶", "middot": "·", "bull": "•", "dagger": "†", "Dagger": "‡", "permil": "‰",
    "larr": "←", "uarr": "↑", "rarr": "→", "darr": "↓", "harr": "↔", "infin": "∞", "ne": "≠", "le": "≤", "ge": "≥", "asymp": "≈", "equiv": "≡", "radic": "√", "sum": "∑", "prod": "∏",
    "micro": "µ", "ordm": "º", "ordf": "ª", "iexcl": "¡", "iquest": "¿", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ", "uuml": "ü", "ouml": "ö", "auml": "ä",
    "shy": "\u00ad", "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009", "zwj": "\u200d", "zwnj": "\u200c",
}


def html_unescape(c: Column, named: dict[str, str] = NAMED) -> Column:
    """Named and numeric references become characters, in one pass; unknown ones stay."""
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    reference = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});"
    # What stands between references and those themselves, side by side: a lambda that named the whole text would read it again for each.
    between = F.arrays_zip(F.split(c, reference, -1).alias("text"), F.regexp_extract_all(c, F.lit(reference), F.lit(0)).alias("found"))

    def one(p: Column) -> Column:
        name = F.substring(p, F.lit(2), F.length(p) - 2)
        hexa = name.rlike("^#[xX]")
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        number = F.when(F.length(digits) > 9, -1).when(hexa, F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))
        real = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        # A code point as UTF-32, big end first.
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(name.startswith("#"), F.when(real, char).otherwise(p)).otherwise(F.coalesce(F.element_at(table, name), p))

    pieces = F.transform(between, lambda x: F.concat(x["text"], F.coalesce(one(x["found"]), F.lit(""))))
    return F.when(c.contains("&"), F.array_join(pieces, "")).otherwise(c)


# ---- counts and small helpers


def count_text(c: Column) -> Column:
    """characters, characters without spaces, words, lines. Characters are code points."""
    return F.struct(
        F.length(c).cast("long").alias("characters"),
        F.length(F.regexp_replace(c, f"[{SPACE}]", "")).cast("long").alias("characters_no_spaces"),
        F.regexp_count(c, F.lit(r"[\p{L}\p{N}'’]+")).cast("long").alias("words"),
        F.when(c == "", 0).otherwise(F.size(F.split(c, r"\r\n|\n|\r", -1))).cast("long").alias("lines"),
    )


def reading_minutes(c: Column) -> Column:
    n = F.size(F.filter(F.split(js_trim(c), f"[{SPACE}]+", -1), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(n / 225 + 0.5)).cast("long")


def line_shape(c: Column) -> Column:
    """Runs of digits as #, spaces squashed: equal for lines that differ in numbers only."""
    return squash(F.regexp_replace(c, "[0-9]+", "#"))


def base_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(c, r"([^/\\]*)$", 1), r"^.+\.([^.]*)$", 1))


def safe_filename(c: Column) -> Column:
    """Characters that file systems forbid become hyphens; 180 characters at most."""
    return F.substring(js_trim(F.regexp_replace(c, r"[\\/:*?\"<>|\x{00}-\x{1F}]+", "-")), 1, 180)


def would_spreadsheet_change(c: Column) -> Column:
    """True for texts that a spreadsheet rewrites on opening: leading zeros, long digits, 1E5, MAR1, 3-4."""
    first = F.regexp_extract(c, r"^(\d{1,2})[-/](\d{1,2})$", 1).try_cast("int")
    second = F.regexp_extract(c, r"^(\d{1,2})[-/](\d{1,2})$", 2).try_cast("int")
    pair = (first >= 1) & (second >= 1) & (first <= 31) & (second <= 31) & ((first <= 12) | (second <= 12))
    shaped = c.rlike(r"^0\d+$") | c.rlike(r"^\d{16,}$") | c.rlike(r"^\d+[eE]\d+$") | c.rlike(r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)\d{1,2}$")
    return (F.length(c) >= 2) & (shaped | F.coalesce(pair, F.lit(False)))


def needs_formula_escape(c: Column) -> Column:
    """True for texts that a spreadsheet would run as a formula; plain signed numbers aren't."""
    return c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")


# ---- whole texts, line by line

#: What a text cleaner strips (a little less and more than the cell scrubber), and stray controls.
FORMATTING = r"[\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]"
CONTROL = r"[\x{00}-\x{08}\x0B\x0C\x{0E}-\x{1F}\x{7F}]"


def collapse_blank_lines(c: Column, most: int = 1) -> Column:
    """At most so many blank lines in a row; line ends are those of the text."""
    return F.regexp_replace(c, r"((?:^|\n)(?:[ \t]*\r?\n){%d})(?:[ \t]*\r?\n)+" % most, "$1")


@dataclass(frozen=True)
class WhitespaceOptions:
    strip_invisible: bool = True
    plain_spaces: bool = True
    #: off, tabs-to-spaces or spaces-to-tabs
    tabs: str = "off"
    tab_width: int = 2
    trim_trailing: bool = True
    trim_leading: bool = False
    collapse_spaces: bool = False
    #: at most so many blank lines in a row; None keeps them all, and remove_blank takes all
    most_blank: int | None = 1
    remove_blank: bool = False
    #: off (CRLF stays if all are), lf or crlf
    line_ends: str = "off"


def clean_whitespace(text: str, key: str, rows: DataFrame, options: WhitespaceOptions | None = None) -> DataFrame:
    """key, output and notes (id and count of each step that changed something, in order) of the texts of a table.

    Each step is a projection of its own, so the next one holds a name and not the expression. Steps work on the whole
    text with LF line ends and one at the end, so that every line ends in one.
    """
    o = options or WhitespaceOptions()
    c, notes, out = F.col("_t"), [], rows.select(key, F.col(text).alias("_t"))

    def step(frame: DataFrame, after: Column, *noted: tuple[str, Column]) -> DataFrame:
        made = frame.select("*", after.alias("_after"), *[count.cast("long").alias(f"_n_{name}") for name, count in noted])
        notes.extend(name for name, _ in noted)
        return made.drop("_t").withColumnRenamed("_after", "_t")

    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    if o.strip_invisible:
        out = step(out, F.regexp_replace(F.regexp_replace(c, FORMATTING, ""), CONTROL, ""), ("invisible", count(FORMATTING)), ("control", count(CONTROL)))
    if o.plain_spaces:
        out = step(out, F.regexp_replace(c, ODD_SPACE, " "), ("odd-spaces", count(ODD_SPACE)))
    out = out.withColumns({"_crlf": count("\r\n"), "_lf": count("(?<!\r)\n"), "_cr": count("\r(?!\n)")})
    out = step(out, F.concat(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\n")))
    lines = lambda change: F.array_join(F.transform(F.split(c, "\n", -1), change), "\n")
    if o.tabs == "tabs-to-spaces":
        out = step(out, F.when(c.contains("\t"), lines(lambda x: expand_tabs(x, o.tab_width))).otherwise(c), ("tabs", count("\t")))
    elif o.tabs == "spaces-to-tabs":
        out = out.withColumn("_before", c)
        out = step(out, lines(lambda x: contract_indent(x, o.tab_width)))
        out = step(out, c, ("indent", F.size(F.filter(F.arrays_zip(F.split(c, "\n", -1).alias("a"), F.split("_before", "\n", -1).alias("b")), lambda z: z["a"] != z["b"])))).drop("_before")
    for wanted, name, pattern, to in (
        (o.trim_trailing, "trailing", "[ \t]+(?=\n)", ""), (o.trim_leading, "leading", "(?m)^[ \t]+", ""), (o.collapse_spaces, "runs", "(?<=[^ \t\n])[ \t]{2,}", " "),
    ):
        if wanted:
            out = out.withColumn("_before", F.length(c))
            out = step(step(out, F.regexp_replace(c, pattern, to)), c, (name, F.col("_before") - F.length(c))).drop("_before")
    blank = f"[{SPACE_IN_LINE}]*+\n"
    if o.remove_blank or o.most_blank is not None:
        kept = 0 if o.remove_blank else o.most_blank
        out = out.withColumn("_before", count("\n"))
        after = F.regexp_replace(c, f"(?dm)^((?:{blank}){{{kept}}})(?:{blank})+", "$1")
        out = step(step(out, after), c, ("blank" if o.remove_blank else "blank-run", F.col("_before") - count("\n"))).drop("_before")
    out = step(out, F.when(F.length(c) > 0, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c))
    all_crlf = (F.col("_crlf") > 0) & (F.col("_lf") == 0) & (F.col("_cr") == 0)
    mixed = (F.col("_crlf") > 0).cast("int") + (F.col("_lf") > 0).cast("int") + (F.col("_cr") > 0).cast("int") > 1
    keep = F.lit(True) if o.line_ends == "crlf" else all_crlf if o.line_ends == "off" else F.lit(False)
    ends = {"crlf": F.when(~all_crlf, count("\n")), "lf": F.col("_crlf"), "off": F.when(mixed, F.col("_crlf") + F.col("_cr"))}[o.line_ends]
    out = step(out, F.when(keep, F.replace(c, F.lit("\n"), F.lit("\r\n"))).otherwise(c), ("endings", F.coalesce(ends, F.lit(0))))
    told = F.filter(F.array(*[F.struct(F.lit(n).alias("id"), F.col(f"_n_{n}").alias("count")) for n in notes]), lambda x: x["count"] > 0)
    return out.select(key, c.alias("output"), told.alias("notes"))


def contract_indent(line: Column, width: int = 4) -> Column:
    """Indentation as tabs and the spaces that are left; runs within the line stay."""
    indent = F.regexp_extract(line, "^[ \t]+", 0)
    wide = F.length(expand_tabs(indent, width))
    tabs = F.concat(F.repeat(F.lit("\t"), F.floor(wide / width).cast("int")), F.repeat(F.lit(" "), (wide % width).cast("int")))
    return F.when(indent != "", F.concat(tabs, F.substring(line, F.length(indent) + 1, F.length(line)))).otherwise(line)


def split_lines(c: Column) -> Column:
    """The lines; none for the empty text."""
    return F.when(c == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(c, r"\r\n|\n|\r", -1))


def count_lines(c: Column) -> Column:
    return F.size(split_lines(c)).cast("long")


#: Names of characters that show nothing, and of separators.
CHARACTER_NAMES = {
    0xAD: "Soft hyphen", 0xA0: "No-break space", 0x61C: "Arabic letter mark", 0x180E: "Mongolian vowel separator", 0x200B: "Zero-width space", 0x200C: "Zero-width non-joiner",
    0x200D: "Zero-width joiner", 0x200E: "Left-to-right mark", 0x200F: "Right-to-left mark", 0x202F: "Narrow no-break space", 0x2060: "Word joiner", 0x3000: "Ideographic space", 0xFEFF: "Zero-width no-break space (BOM)",
}
SEPARATOR_NAMES = {",": "Comma", ";": "Semicolon", "\t": "Tab", "|": "Pipe", "\x1f": "Unit separator"}


def character_name(char: Column) -> Column:
    return F.coalesce(*[F.when(char == chr(code), name) for code, name in CHARACTER_NAMES.items()], F.lit("Invisible character"))


def separator_name(c: Column) -> Column:
    return F.coalesce(*[F.when(c == mark, name) for mark, name in SEPARATOR_NAMES.items()], F.concat(F.lit('"'), c, F.lit('"')))


def invisible_names(c: Column, most: int = 4) -> Column:
    """The first distinct names of the invisible characters and odd spaces of a text."""
    found = F.regexp_extract_all(c, F.lit(f"({INVISIBLE}|{ODD_SPACE})"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, character_name)), 1, most)


def invisible_places(c: Column, most: int = 20) -> Column:
    """line, column (from 1), code and name of the first invisible or odd characters; a CR is no column, and code points count.

    The text is read once: what lies between two characters moves the place on, and no character looks back at all before it.
    """
    pattern = f"[{FORMATTING[1:-1]}{ODD_SPACE[1:-1]}{CONTROL[1:-1]}]"
    parts = F.split(c, pattern, most + 1)
    read = F.length(c) - F.when(F.size(parts) > most, F.length(F.element_at(parts, most + 1))).otherwise(0)
    chars = F.regexp_extract_all(F.left(c, read), F.lit(f"({pattern})"), F.lit(1))
    told = F.arrays_zip(chars.alias("char"), F.slice(parts, F.lit(1), F.size(chars)).alias("before"))
    start = F.struct(F.lit(1).alias("line"), F.lit(0).alias("width"), F.expr("cast(array() as array<struct<line:bigint,column:bigint,code:string,name:string>>)").alias("out"))

    def put(s: Column, x: Column) -> Column:
        lines = F.length(x["before"]) - F.length(F.replace(x["before"], F.lit("\n"), F.lit("")))
        here = F.length(F.replace(F.substring_index(x["before"], "\n", -1), F.lit("\r"), F.lit("")))
        line, width = s["line"] + lines, F.when(lines > 0, here).otherwise(s["width"] + here) + 1
        code = F.lpad(F.conv(F.hex(F.encode(x["char"], "UTF-32")), 16, 16), 4, "0")
        place = F.struct(line.cast("long").alias("line"), width.cast("long").alias("column"), F.concat(F.lit("U+"), code).alias("code"), character_name(x["char"]).alias("name"))
        return F.struct(line.alias("line"), width.alias("width"), F.array_append(s["out"], place).alias("out"))

    return F.aggregate(told, start, put, lambda s: s["out"])


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(F.format_number(n, 0), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many or one + 's'}")))


def described_pages(ranges: Column, n: Column, most: int | None = None) -> Column:
    """no pages, page 4, pages 1-3, 7; a bare count where that is longer than `most`."""
    told = F.when(n == 0, "no pages").when(n == 1, F.concat(F.lit("page "), ranges)).otherwise(F.concat(F.lit("pages "), ranges))
    return told if most is None else F.when(F.length(told) > most, F.concat(n.cast("string"), F.lit(" pages"))).otherwise(told)


#: Units of time in milliseconds, list markers, faces of type.
TIME_UNITS = {"year": 31_536_000_000, "month": 2_592_000_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000}
MARKER = r"^(?:[•▪●◦⁃·–−o*\-]|\(?[0-9]{1,3}[.)\]]|\(?[a-zA-Z][.)\]]|\(?[ivxlcIVXLC]{1,6}[.)\]])$"
MONO = r"(?i)courier|consolas|monaco|menlo|inconsolata|andale mono|lucida console|lucida sans typewriter|cascadia|fira code|fira mono|source code|roboto mono|ubuntu mono|dejavu sans mono|liberation mono|sf mono|ibm plex mono|jetbrains|mono(space)?$"
SERIF = r"(?i)times|georgia|garamond|cambria|constantia|palatino|book antiqua|bookman|century|baskerville|minion|caslon|didot|utopia|charter|merriweather|playfair|libre baskerville|pt serif|noto serif|liberation serif|droid serif|dejavu serif|free serif|roman|serif"


def relative_unit(delta_ms: Column) -> Column:
    """n and unit: a span of time in the largest unit it fills, rounded, halves up."""
    pick = lambda f: F.coalesce(*[F.when(F.abs(delta_ms) >= ms, f(u, ms)) for u, ms in TIME_UNITS.items()], f("second", 1000))
    return F.struct(pick(lambda u, ms: F.floor(delta_ms / ms + 0.5)).cast("long").alias("n"), pick(lambda u, ms: F.lit(u)).alias("unit"))


def is_list_marker(c: Column, width: Column, size: Column) -> Column:
    """A bullet, number or letter of at most three characters that is no wider than 1.6 of its size."""
    glyph = js_trim(c)
    return F.length(glyph).between(1, 3) & (width <= 1.6 * size) & glyph.rlike(MARKER)


def font_family(name: Column) -> Column:
    """mono, serif or sans by a font's name."""
    clean = js_trim(F.coalesce(name, F.lit("")))
    return F.when(clean.rlike(MONO), "mono").when(clean.rlike(SERIF), "serif").otherwise("sans")


def resolved_part(base: Column, target: Column) -> Column:
    """A relative target as a path beside base; one with a scheme stays as it is."""
    folder = F.when(base.contains("/"), F.regexp_replace(base, "/[^/]*$", "")).otherwise("")
    start = F.when(folder == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(folder, "/"))

    def put(stack: Column, part: Column) -> Column:
        up = F.when(F.size(stack) > 0, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(stack)
        return F.when(part.isin("", "."), stack).when(part == "..", up).otherwise(F.array_append(stack, part))

    path = F.array_join(F.aggregate(F.split(F.regexp_replace(target, "^/", ""), "/"), start, put), "/")
    return F.when(target.rlike("(?i)^[a-z]+:"), target).otherwise(path)


def heading_text(c: Column) -> Column:
    """A Markdown heading without its marks: links by their texts, code bare, emphasis and tags away."""
    out = c
    for pattern, to in ((r"!?\[([^\]]*)\]\([^)]*\)", "$1"), ("`([^`]*)`", "$1"), ("[*_~]{1,3}", ""), ("<[^>]*>", "")):
        out = F.regexp_replace(out, pattern, to)
    return squash(out)


def drawable(char: Column) -> Column:
    """True for characters of the Western code page."""
    return char.rlike("^[\\x{20}-\\x{7E}\\x{A1}-\\x{FF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]$")


#: Scripts by their ranges of code points, the first that holds one.
SCRIPTS = (
    (0x400, 0x52F, "Cyrillic"), (0x370, 0x3FF, "Greek"), (0x590, 0x5FF, "Hebrew"), (0x600, 0x6FF, "Arabic"), (0x900, 0x97F, "Devanagari"), (0x980, 0xDFF, "an Indian script"), (0xE00, 0xE7F, "Thai"),
    (0x3040, 0x30FF, "Japanese"), (0x1100, 0x11FF, "Korean"), (0xAC00, 0xD7AF, "Korean"), (0x3400, 0x9FFF, "Chinese, Japanese or Korean"), (0x1F000, 0x10FFFF, "emoji"), (0x100, 0x24F, "accented Latin"),
)


def script_of(code: Column) -> Column:
    return F.coalesce(*[F.when(code.between(low, high), name) for low, high, name in SCRIPTS], F.lit("symbols"))


def expand_tabs(line: Column, width: int = 4) -> Column:
    """Tabs of one line to the next stop."""
    cells = F.split(line, "\t", -1)

    def padded(text: Column, i: Column) -> Column:
        # A cell begins at a stop, so it is filled up to the next one by its own length.
        return F.when(i < F.size(cells) - 1, F.concat(text, F.repeat(F.lit(" "), (width - F.length(text) % width).cast("int")))).otherwise(text)

    return F.array_join(F.transform(cells, padded), "")


def jwt_part(c: Column, part: int) -> Column:
    """Header (0) or claims (1) of a token as JSON; nothing is verified."""
    return base64_plain(F.get(F.split(c, r"\.", -1), F.lit(part)))


def line_and_column(text: Column, offset: Column) -> Column:
    """line and column, from 1, of an offset from 0."""
    before = F.substring(text, F.lit(1), offset)
    lines, rest = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))), F.length(F.substring_index(before, "\n", -1))
    return F.struct((lines + 1).cast("long").alias("line"), (rest + 1).cast("long").alias("column"))


# ---- pages, formats, notes

#: Dashes and separators that people paste into ranges of pages.
RANGE_DASHES, RANGE_MARKS = "‐‑‒–—―−﹘﹣－", ";，、；"


def parsed_pages(c: Column, pages: Column) -> Column:
    """pages (sorted, distinct) and fault (no-pages, no-numbers, below-1, beyond, unreadable; null if it can be read) of text like 9-4, 2, 11-."""
    plain = js_trim(F.translate(F.translate(c, RANGE_DASHES, "-" * len(RANGE_DASHES)), RANGE_MARKS, "," * len(RANGE_MARKS)))
    tokens = F.filter(F.transform(F.split(plain, ","), js_trim), lambda x: x != "")

    def read(token: Column) -> Column:
        low, high = F.regexp_extract(token, r"^([0-9]*)\s*-", 1), F.regexp_extract(token, r"-\s*([0-9]*)$", 1)
        ranged, single = token.rlike(r"^[0-9]*\s*-\s*[0-9]*$"), token.rlike("^[0-9]+$")
        number = lambda x, empty: F.when(x == "", empty).otherwise(F.coalesce(x.try_cast("long"), F.lit(1 << 62)))
        a = F.when(ranged, number(low, F.lit(1))).when(single, number(token, F.lit(0)))
        b = F.when(ranged, number(high, pages)).when(single, number(token, F.lit(0)))
        fault = (
            F.when(~ranged & ~single, "unreadable").when(ranged & (low == "") & (high == ""), "no-numbers").when(F.least(a, b) < 1, "below-1").when(F.greatest(a, b) > pages, "beyond")
        )
        return F.struct(fault.alias("fault"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))

    def told(parts: Column) -> Column:
        fault = F.get(F.filter(F.transform(parts, lambda p: p["fault"]), lambda f: f.isNotNull()), F.lit(0))
        fault = F.when((F.size(parts) > 0) & (pages <= 0), "no-pages").otherwise(fault)
        numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(p["low"], p["high"])))))
        return F.struct(F.when(fault.isNull(), numbers).alias("pages"), fault.alias("fault"))

    return F.transform(F.array(F.transform(tokens, read)), told)[0]


def page_ranges(pages: Column) -> Column:
    """Sorted distinct whole numbers as 1-3, 7."""
    start = F.expr("cast(array() as array<struct<low:bigint,high:bigint>>)")

    def put(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["low"].alias("low"), p.alias("high"))))
        return F.when(F.size(out) == 0, F.array(F.struct(p.alias("low"), p.alias("high")))).when(last["high"] + 1 == p, grown).otherwise(F.concat(out, F.array(F.struct(p.alias("low"), p.alias("high")))))

    one = lambda r: F.when(r["low"] == r["high"], r["low"].cast("string")).otherwise(F.concat_ws("-", r["low"].cast("string"), r["high"].cast("string")))
    return F.array_join(F.transform(F.aggregate(F.transform(pages, lambda p: p.cast("long")), start, put), one), ", ")


def lone_header(c: Column) -> Column:
    """A column's name by itself: short, without white space."""
    return (c != "") & (F.length(c) <= 64) & ~c.rlike(f"[{SPACE}]")


def sample_lines(c: Column, most: int) -> Column:
    """The whole lines at the start of a text, up to so many characters."""
    head = F.substring(c, 1, most)
    kept = F.when(head.contains("\n"), F.regexp_replace(head, r"[^\n]*\z", "")).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(kept)


def hinted_format(extension_: Column) -> Column:
    known = {"json": "json", "csv": "csv", "tsv": "csv", "tab": "csv", "yaml": "yaml", "yml": "yaml"}
    return F.coalesce(*[F.when(F.lower(extension_) == e, f) for e, f in known.items()])


def merged_lists(a: Column, b: Column) -> Column:
    """Both lists, in order, without repeats."""
    return F.array_distinct(F.concat(a, b))


def counter_text(n: Column, form: Column) -> Column:
    """A list's counter in a form: decimal, decimalZero, lowerLetter, upperLetter, lowerRoman, upperRoman, none."""
    from plumbline.functions.numbers import letters, roman

    plain = n.cast("string")
    low_roman, low_letters = F.coalesce(roman(n), plain), F.when(n > 0, letters(n)).otherwise("")
    return (
        F.when(form == "decimalZero", F.when(n < 10, F.concat(F.lit("0"), plain)).otherwise(plain)).when(form == "lowerLetter", low_letters).when(form == "upperLetter", F.upper(low_letters))
        .when(form == "lowerRoman", low_roman).when(form == "upperRoman", F.upper(low_roman)).when(form == "none", "").otherwise(plain)
    )


def document_title(c: Column, fallback: str = "Document") -> Column:
    """The first top heading of a Markdown text, of either form, outside fences."""
    lines = F.split(c, r"\r?\n", -1)
    start = F.struct(F.lit("").alias("fence"), F.lit(None).cast("string").alias("title"))

    def step(s: Column, i: Column) -> Column:
        line, below = F.get(lines, i), F.get(lines, i + 1)
        mark = F.substring(F.regexp_extract(line, r"^\s{0,3}(`{3,}|~{3,})", 1), 1, 1)
        fence = F.when(mark == "", s["fence"]).when(s["fence"] == "", mark).when(s["fence"] == mark, "").otherwise(s["fence"])
        above = (js_trim(line) != "") & F.coalesce(below.rlike(r"^\s{0,3}={2,}\s*$"), F.lit(False))
        own = F.when(line.rlike(r"^\s{0,3}#\s+\S"), heading_text(F.regexp_extract(line, r"^\s{0,3}#\s+(.+?)\s*#*\s*$", 1)))
        found = F.coalesce(F.when(own != "", own), F.when(above, F.nullif(heading_text(line), F.lit(""))))
        free = (mark == "") & (s["fence"] == "") & s["title"].isNull()
        return F.struct(fence.alias("fence"), F.when(free, found).otherwise(s["title"]).alias("title"))

    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, step, lambda s: s["title"]), F.lit(fallback))
