"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought into one canonical form, line by line (`canonical_lines`): lower case, copyright lines away (one that begins with (c) needs a year, as items of lists begin so too), runs of
what is neither letter nor digit, in any script, a single space, equivalent spellings made one. The SHA-256 of the whole
is looked up by a hash join among the digests of known licence texts and notices. Looked up likewise, as texts of
their own, are each line, where a notice mostly stands alone, and each paragraph of several lines of a document
that has blank lines (lines without letters and digits), where a notice is wrapped.

The known table is a parameter; the default lists the texts below. Up to `IN_ROW` digests go to all tasks, and lines and paragraphs
are looked up within the row, so nothing is shuffled; only those of the length of a known text are hashed. A larger
table is joined by a shuffle, on a stored key a document.

Defined results: a null text has a null digest and no lines; an empty text, and one that
is nothing but punctuation, has the digest of the empty text, which is no licence; repeated
rows are documents of their own; a text that several licences share has the name that sorts first; an
empty table gives an empty result; texts of any length are read whole; other columns of the table are left out, whatever their names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import scratch, settled, table

#: Notices with their SPDX names.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Standard headers, and parts of them and of texts that stand as paragraphs.
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
)


def _texts() -> tuple[tuple[str, str], ...]:
    """Whole licence texts, each with and without its title, rights line and appendix."""
    made = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        forms = [text, *(text.split(end)[0] + end for end in ("END OF TERMS AND CONDITIONS",) if end in text)]
        title, _, rest = text.partition("\n\n")
        if title.endswith(" License") and "\n" not in title:
            bare = rest.partition("\n\n")[2]  # the copyright line goes too
            forms += [bare, f"{title}\n\nAll rights reserved.\n\n{bare}", f"All rights reserved.\n\n{bare}", f"The {title}\n\n{bare}", f"The {title} ({path.stem})\n\n{bare}"]
        made += [(path.stem, form) for form in forms]
    return tuple(made)


KNOWN = (*NOTICES, *HEADERS, *_texts())
#: A copyright line and what it can't do without, punctuation, and equivalent spellings, as parts of text in lower case between single spaces.
COPYRIGHT, SIGNS = r"(?m)^[ \t#*/;-]*(copyright(?!\s+(?:notices?|holders?|owners?|laws?|licen[sc]es?|statements?|interest)\b)|\(c\)(?=\s*copyright|[^\n]*\b(?:19|20)\d\d\b)|©)[^\n]*$", ("copyright", "(c)", "©")
MARKS_IN_LINE = r"[^\p{L}\p{M}\p{N}\n]+"
#: The same in ORACLE: it tells only ASCII punctuation and takes wrapped lines and lettered items for copyright lines; the tables hold none of these.
ORACLE_COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*$"
ORACLE_MARKS = r"[^a-z0-9\x{0080}-\x{10FFFF}]+"
SPELLINGS = (
    *((f" {stem}is", f" {stem}iz") for stem in "author capital categor custom emphas general initial maxim minim optim organ real recogn util".split()),
    (" licence", " license"), (" sublicence", " sub license"), (" sublicense", " sub license"), (" noncommercial", " non commercial"),
    *((f" {stem}our", f" {stem}or") for stem in "behavi fav hon lab".split()),
    (" acknowledgement", " acknowledgment"), (" judgement", " judgment"), (" copyright owner", " copyright holder"),
    (" whilst ", " while "), (" per cent ", " percent "), (" centre", " center"), (" https ", " http "),
)


#: Digests that go to all tasks.
IN_ROW = 1000


def _respelled(out: Column, spellings) -> Column:
    for variant, to in spellings:  # plain texts, sought much faster than patterns
        out = F.replace(out, F.lit(variant), F.lit(to))
    return out


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, joined by line ends."""
    lower = F.lower(text)
    signed = F.contains(lower, F.lit(SIGNS[0])) | F.contains(lower, F.lit(SIGNS[1])) | F.contains(lower, F.lit(SIGNS[2]))
    bare = F.when(signed, F.regexp_replace(lower, COPYRIGHT, "")).otherwise(lower)
    apart = F.replace(F.concat(F.lit(" "), F.regexp_replace(bare, MARKS_IN_LINE, " "), F.lit(" ")), F.lit("\n"), F.lit(" \n "))
    return F.trim(F.regexp_replace(_respelled(apart, SPELLINGS), " *\n *", "\n"), F.lit(" "))


def joined(lines: Column) -> Column:
    """Canonical lines as one text; spellings of two words may have stood on two lines."""
    wide = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, "\n+", " ")), F.lit(" "))
    return F.trim(_respelled(wide, [s for s in SPELLINGS if " " in s[0].strip()]))


def canonical(text: Column) -> Column:
    return joined(canonical_lines(text))


def _digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text.cast("binary"), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """license, digest, length (of the canonical form) of each known text, one row a digest."""
    rows = spark.createDataFrame(list(known), "license string, known string").select("license", canonical(F.col("known")).alias("form"))
    return rows.groupBy(_digest(F.col("form")).alias("digest")).agg(F.min("license").alias("license"), F.min(F.length("form")).alias("length"))


def _units(lines: Column) -> Column:
    """Lines, and paragraphs of several lines where there are blank lines."""
    paragraphs = F.filter(F.transform(F.split(lines, "\n\n+", -1), lambda p: F.trim(p, F.lit("\n"))), lambda p: F.contains(p, F.lit("\n")))
    several = F.when(F.contains(lines, F.lit("\n\n")), F.transform(paragraphs, joined)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(F.split(lines, "\n", -1), several)


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, text_license, n_lines, n_notices, notices (sorted names joined by a comma). known: license, digest, length."""
    known = known_digests(docs.sparkSession) if known is None else known
    few = known.limit(IN_ROW + 1).select("digest", "license", "length").collect()
    lined = docs.select("doc_id", canonical_lines(F.col("text")).alias("_lines"))
    digested = lambda rows: rows.withColumn("text_digest", _digest(joined(F.col("_lines")))).withColumn("n_lines", F.coalesce(F.size(F.split("_lines", "\n", -1)), F.lit(0)))
    whole = known.select(F.col("digest").alias("text_digest"), F.col("license").alias("text_license"))
    if 0 < len(few) <= IN_ROW:
        names = F.create_map(*[F.lit(x) for r in few for x in (r["digest"], r["license"])])
        lengths = F.array(*[F.lit(n) for n in sorted({r["length"] for r in few})])
        named = F.transform(F.filter(_units(F.col("_lines")), lambda u: F.array_contains(lengths, F.length(u))), lambda u: F.element_at(names, _digest(u)))
        rows = digested(lined).withColumn("_found", F.coalesce(F.array_compact(named), F.expr("cast(array() as array<string>)")))
        whole = F.broadcast(whole)
    else:
        keyed = settled(lined.withColumn("_key", F.monotonically_increasing_id()), scratch(docs.sparkSession), "lines")
        each = keyed.select("_key", F.explode(_units(F.col("_lines"))).alias("_unit"))
        hits = each.join(known.select("digest", "license"), _digest(F.col("_unit")) == F.col("digest")).groupBy("_key").agg(F.collect_list("license").alias("_found"))
        rows = digested(keyed).join(hits, "_key", "left").withColumn("_found", F.coalesce("_found", F.expr("cast(array() as array<string>)")))
    return rows.join(whole, "text_digest", "left").select(
        "doc_id", "text_digest", "text_license", F.col("n_lines").cast("long").alias("n_lines"), F.size("_found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notices"),
    )


def op3_license_digests(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    """canonical() in DuckDB's words."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"regexp_replace(lower({text}), {quote(ORACLE_COPYRIGHT)}, '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, {quote(ORACLE_MARKS)}, ' ', 'g')) || ' '"
    for variant, to in SPELLINGS:
        out = f"replace({out}, {quote(variant)}, {quote(to)})"
    return f"sha256(trim({out}))"


_ROWS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in NOTICES)
ORACLE = f"""
WITH k AS (SELECT {_sql('known')} AS digest, min(license) AS license FROM (VALUES {_ROWS}) v(license, known) GROUP BY 1),
d AS (SELECT doc_id, text, row_number() OVER () AS r, {_sql('text')} AS text_digest FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
h AS (SELECT r, line, license FROM l LEFT JOIN k ON {_sql('line')} = k.digest),
g AS (SELECT r, count(line) AS n_lines, count(license) AS n_notices, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS notices FROM h GROUP BY r)
SELECT doc_id, text_digest, k.license AS text_license, coalesce(n_lines, 0) AS n_lines, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN g USING (r) LEFT JOIN k ON k.digest = d.text_digest
"""
