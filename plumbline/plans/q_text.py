"""Queries of the string functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.functions import words
from plumbline.plans.base import DIRTIED, L, S, dirtied, query, quote, sql_scrub, sql_trim, table

UP = "replace(replace(upper({0}), 'ß', 'SS'), 'ẞ', 'SS')"
CAP = f"({UP.format('w[1:1]')} || lower(w[2:]))"
TOKENS = (
    r"list_filter(string_split_regex(regexp_replace(regexp_replace({0}, '(\p{{Lu}}|\p{{N}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{Ll}}|\p{{N}})(\p{{Lu}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
)


def _lines(expression: str) -> str:
    """SQL that applies an expression of line `x` and tokens `ws` to each line of documents.text."""
    return f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {expression}), chr(10)) AS out FROM documents"""


def _cased(join: str) -> str:
    tokens = TOKENS.format("x")
    return _lines(f"CASE WHEN len({tokens}) = 0 THEN x ELSE regexp_extract(x, {quote(f'^[{S}]*')}, 0) || {join.replace('WS', tokens)} END")


def _case_query(name: str, function, sql: str | None):
    @query(name, sql)
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", function(F.col("text")).alias("out"))

    return run


_case_query("q_F01_upper", F.upper, f"SELECT doc_id, {UP.format('text')} AS out FROM documents")
_case_query("q_F01_lower", F.lower, "SELECT doc_id, lower(text) AS out FROM documents")
_case_query("q_F05_snake_case", t.snake_case, _cased("array_to_string(list_transform(WS, lambda w: lower(w)), '_')"))
_case_query("q_F05_kebab_case", t.kebab_case, _cased("array_to_string(list_transform(WS, lambda w: lower(w)), '-')"))
_case_query("q_F05_constant_case", t.constant_case, _cased(f"array_to_string(list_transform(WS, lambda w: {UP.format('w')}), '_')"))
_case_query("q_F05_pascal_case", t.pascal_case, _cased(f"array_to_string(list_transform(WS, lambda w: {CAP}), '')"))
_case_query("q_F05_camel_case", t.camel_case, _cased(f"array_to_string(list_transform(WS, lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE {CAP} END), '')"))
_case_query("q_F06_toggle_case", t.toggle_case, "SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = 'ß' THEN 'SS' WHEN c = lower(c) AND c <> upper(c) THEN upper(c) WHEN c = upper(c) AND c <> lower(c) THEN lower(c) ELSE c END), '') AS out FROM documents")
_case_query("q_F03_title_case", words.title_case, None)
_case_query("q_F04_sentence_case", words.sentence_case, None)


@query("q_F02_tokenize", f"SELECT doc_id, len(ts)::BIGINT AS n, array_to_string(ts, '|') AS tokens FROM (SELECT doc_id, {TOKENS.format('text')} AS ts FROM documents)")
def tokens(spark, sf_dir):
    found = t.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("tokens"))


@query("q_S52_scrub", f"SELECT doc_id, out, out <> raw AS changed FROM (SELECT doc_id, raw, {sql_scrub('raw')} AS out FROM (SELECT doc_id, {DIRTIED} AS raw FROM documents))")
def scrub(spark, sf_dir):
    raw = dirtied(F.col("text"), F.col("doc_id"))
    tidy = t.js_trim(t.flatten_newlines(t.collapse_spaces(t.drop_invisible(F.col("raw")))))
    staged = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", "raw", tidy.alias("tidy")).select("doc_id", "raw", t.blank_sentinels(F.col("tidy")).alias("out"))
    return staged.select("doc_id", "out", (F.col("out") != F.col("raw")).alias("changed"))


@query("q_S53_invisible", f"SELECT doc_id, regexp_replace(regexp_replace(raw, {quote(t.INVISIBLE)}, '', 'g'), {quote(t.ODD_SPACE)}, ' ', 'g') AS out FROM (SELECT doc_id, {DIRTIED} AS raw FROM documents)")
def invisible(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.drop_invisible(dirtied(F.col("text"), F.col("doc_id"))).alias("out"))


@query("q_S54_S55_spaces", f"""SELECT doc_id, regexp_replace(raw, {quote(f'[{L}]+')}, ' ', 'g') AS collapsed, regexp_replace(raw, '[{L}]*[\\r\\n][{S}]*', ' ', 'g') AS flat, {sql_trim('raw')} AS trimmed FROM (SELECT doc_id, {DIRTIED} AS raw FROM documents)""")
def spaces(spark, sf_dir):
    raw = F.col("raw")
    return table(spark, sf_dir, "documents").select("doc_id", dirtied(F.col("text"), F.col("doc_id")).alias("raw")).select(
        "doc_id", t.collapse_spaces(raw).alias("collapsed"), t.flatten_newlines(raw).alias("flat"), t.js_trim(raw).alias("trimmed"),
    )


@query("q_S57_sentinel", f"SELECT c_custkey, CASE WHEN lower({sql_trim('v')}) IN ({', '.join(quote(s.lower()) for s in t.SENTINELS)}) THEN '' ELSE v END AS out FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN ' Null ' WHEN c_custkey % 11 = 0 THEN '--' ELSE c_mktsegment END AS v FROM customer)")
def sentinels(spark, sf_dir):
    key = F.col("c_custkey")
    raw = F.when(key % 7 == 0, " Null ").when(key % 11 == 0, "--").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.blank_sentinels(raw).alias("out"))


@query("q_S58_J01_merge", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Construction' ELSE c_mktsegment END AS out FROM customer")
def merges(spark, sf_dir):
    plan = {"BUILDING": "Construction", "MACHINERY": "Construction"}
    return table(spark, sf_dir, "customer").select("c_custkey", t.merge_spellings(F.col("c_mktsegment"), plan).alias("out"))


_WORDS = r"list_filter(string_split_regex(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query("q_F25_F26_fingerprint", f"SELECT doc_id, array_to_string(list_sort(list_distinct(ws)), ' ') AS fingerprint, array_to_string(list_sort(ws), ' ') AS word_key, array_to_string(ws, ' ') AS ordered FROM (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents)")
def fingerprints(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.fingerprint(c).alias("fingerprint"), t.word_key(c).alias("word_key"), t.ordered_key(c).alias("ordered"))


@query("q_F27_ngram_fingerprint", r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(len(b) - 2, 1) + 1), lambda i: substr(b, i, 3)))), '') AS out FROM (SELECT p_partkey, regexp_replace(lower(strip_accents(replace(p_name, 'e', chr(233)))), '[^\p{L}\p{N}]+', '', 'g') AS b FROM part)")
def ngrams(spark, sf_dir):
    folded = table(spark, sf_dir, "part").select("p_partkey", t.fold_accents(F.replace("p_name", F.lit("e"), F.lit("\u00e9"))).alias("folded"))
    return folded.select("p_partkey", t.ngram_fingerprint(F.col("folded")).alias("out"))


@query("q_F23_fold_accents", "SELECT doc_id, strip_accents(text) AS out FROM documents")
def folded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.fold_accents(F.col("text")).alias("out"))


@query("q_F35_base64", "SELECT doc_id, to_base64(text::BLOB) AS out, regexp_replace(translate(to_base64(text::BLOB), '+/', '-_'), '=+$', '') AS url_safe, text AS back FROM (SELECT doc_id, encode(text) AS text0, text FROM documents)".replace("text::BLOB", "text0"))
def base64s(spark, sf_dir):
    c = F.col("text")
    safe = t.base64_text(c, url_safe=True)
    return table(spark, sf_dir, "documents").select("doc_id", t.base64_text(c).alias("out"), safe.alias("url_safe"), t.base64_plain(safe).alias("back"))


@query("q_F38_F39_url", "SELECT doc_id, out, text AS back FROM (SELECT doc_id, text, replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS out FROM documents)")
def urls(spark, sf_dir):
    out = t.url_component(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("out"), t.url_plain(out).alias("back"))


@query("q_F40_html_escape", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS out FROM documents")
def escapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.html_escape(F.col("text")).alias("out"))


_NAMES, _CHARS = list(t.NAMED), list(t.NAMED.values())
_REFERENCE = "concat('&', element_at(array({}), cast(page_id % {} + 1 as int)), ';&#', cast(192 + page_id % 60 as string), ';&#x1F600;&bogus;')".format(", ".join(map(quote, _NAMES)), len(_NAMES))


@query("q_F41_html_unescape", "SELECT page_id, replace(replace(replace(replace(html, '&copy;', '\u00a9'), '&middot;', '\u00b7'), '&quot;', '\"'), '&amp;', '&') || ([{}])[page_id % {} + 1] || chr((192 + page_id % 60)::INT) || '\U0001F600&bogus;' || chr(1) || 'x' AS out FROM pages".format(", ".join(map(quote, _CHARS)), len(_CHARS)))
def unescapes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.html_unescape(F.concat("html", F.expr(_REFERENCE), F.lit("\x01x"))).alias("out"))


@query("q_A47_A48_count_text", f"""SELECT doc_id, len(text)::BIGINT AS characters, len(regexp_replace(text, '[{S}]', '', 'g'))::BIGINT AS characters_no_spaces, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}''’]+'))::BIGINT AS words,
CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS lines, greatest(1, floor(len(list_filter(string_split_regex({sql_trim('text')}, '[{S}]+'), lambda w: w <> '')) / 225.0::DOUBLE + 0.5))::BIGINT AS minutes FROM documents""")
def counts(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.count_text(c).alias("n"), t.reading_minutes(c).alias("minutes")).select("doc_id", "n.*", "minutes")


@query("q_F16_F17_F19_headers", f"""SELECT doc_id, special, lower(regexp_replace(regexp_replace(regexp_replace({sql_trim(r"regexp_replace(regexp_replace(special, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu}+)(\p{Lu}\p{Ll})', '\1 \2', 'g')")}, '[{S}-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')) AS snake,
regexp_replace(lower(regexp_replace(text, '^\\x{{FEFF}}', '')), '[{S}_-]+', '', 'g') AS essence FROM (SELECT doc_id, text, regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\p{{Sc}}%° _-]+', ' ', 'g') AS special FROM documents)""")
def headers(spark, sf_dir):
    special = t.strip_special(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", special.alias("special"), t.header_snake(special).alias("snake"), t.essence(F.col("text")).alias("essence"))


@query("q_F46_line_shape", f"SELECT doc_id, {sql_trim(f'''regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '[{S}]+', ' ', 'g')''')} AS shape FROM documents")
def shapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.line_shape(F.col("text")).alias("shape"))


@query("q_F63_F64_F65_names", r"""SELECT page_id, regexp_replace(f, '^(.+)\.[^.]*$', '\1') AS base, lower(regexp_extract(f, '^.+\.([^.]*)$', 1)) AS ext, substr(regexp_replace(url, '[\\/:*?"<>|\x{00}-\x{1F}]+', '-', 'g'), 1, 180) AS safe
FROM (SELECT page_id, url, regexp_extract(url, '([^/\\]*)$', 1) AS f FROM pages)""")
def names(spark, sf_dir):
    c = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", t.base_name(c).alias("base"), t.extension(c).alias("ext"), t.safe_filename(c).alias("safe"))


_CELL = "CASE l_orderkey % 6 WHEN 0 THEN '0' || l_partkey WHEN 1 THEN (l_linenumber + 10) || '-' || (l_linenumber + 9) WHEN 2 THEN l_partkey || 'E' || l_linenumber WHEN 3 THEN 'MAR' || l_linenumber WHEN 4 THEN '=SUM(' || l_partkey || ')' ELSE '-' || l_partkey END"


@query("q_S64_spreadsheet_change", rf"""SELECT l_orderkey, l_linenumber, v, len(v) >= 2 AND (regexp_matches(v, '^0\d+$') OR regexp_matches(v, '^\d{{16,}}$') OR regexp_matches(v, '^\d+[eE]\d+$') OR regexp_matches(v, '(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)\d{{1,2}}$')
OR coalesce(a >= 1 AND b >= 1 AND a <= 31 AND b <= 31 AND (a <= 12 OR b <= 12), false)) AS changes, regexp_matches(v, '^[=+\-@\t\r]') AND NOT regexp_matches(v, '^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$') AS formula
FROM (SELECT *, TRY_CAST(regexp_extract(v, '^(\d{{1,2}})[-/](\d{{1,2}})$', 1) AS INT) AS a, TRY_CAST(regexp_extract(v, '^(\d{{1,2}})[-/](\d{{1,2}})$', 2) AS INT) AS b FROM (SELECT l_orderkey, l_linenumber, {_CELL} AS v FROM lineitem))""")
def excel(spark, sf_dir):
    v = F.col("v")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CELL).alias("v")).select(
        "l_orderkey", "l_linenumber", "v", t.would_spreadsheet_change(v).alias("changes"), t.needs_formula_escape(v).alias("formula"),
    )
