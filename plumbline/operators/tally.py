"""Tallies, column verdicts, checks and spelling clusters over the cells of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.operators.graph import components
from plumbline.session import scratch, settled

#: Header words that name references, and shapes of plain numbers and of ids.
REFERENCE_WORDS = tuple("id ids uuid guid key code codes ref refs reference references sku isbn ean barcode account number no num postcode zip phone mobile email url link hash token".split())
PLAIN_NUMBER = r"^[+-]?(?:\d{1,3}(?:,\d{3})*|\d*)(?:\.\d+)?%?$"
ID_SHAPE = r"^(?:[\p{L}\p{N}_/.-]*\d[\p{L}\p{N}_/.-]*)$"
ERRORS = ("#N/A", "#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#NUM!", "#NULL!")


def cells(rows: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """row, name and value of each cell: one scan for statistics over all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.col(row).alias("row"), F.explode(pairs).alias("cell")).select("row", "cell.name", "cell.value")


def tally(values: DataFrame, value: str, row: str) -> DataFrame:
    """value, count, first_row of each value that isn't blank."""
    return values.where(~t.is_blank(F.coalesce(F.col(value), F.lit("")))).groupBy(value).agg(F.count(value).alias("count"), F.min(row).alias("first_row"))


def entries_within(counts: DataFrame, most: int) -> DataFrame:
    """value, count, first_row of the commonest values, the earlier first; all of them if there are no more than `most`."""
    return counts.orderBy(F.desc("count"), "first_row").limit(most)


def scanned(rows: DataFrame, row: str, start: int, most: int) -> DataFrame:
    """The rows that a report with a bound reads, with sampled: whether there are more."""
    more = rows.agg((F.coalesce(F.max(row), F.lit(-1)) >= start + most).alias("sampled"))  # one row
    return rows.where((F.col(row) >= start) & (F.col(row) < start + most)).crossJoin(more)


def assess(long: DataFrame) -> DataFrame:
    """name, values, distinct_values, ratio, reason of each column: null reason if its values are worth clustering.

    Shapes are shares among all distinct values.
    """
    known = long.where(~t.is_blank(F.coalesce("value", F.lit(""))))
    distinct = known.groupBy("name", "value").agg(F.count("value").alias("n"))
    by = distinct.groupBy("name").agg(
        F.sum("n").alias("values"), F.count("value").alias("distinct_values"),
        F.avg(F.col("value").rlike(PLAIN_NUMBER).cast("double")).alias("numeric"),
        F.avg((F.col("value").rlike(ID_SHAPE) & F.col("value").rlike(r"^[\p{L}\p{N}]")).cast("double")).alias("ids"),
    )
    every = long.select("name").distinct()
    ratio = F.col("distinct_values") / F.col("values")
    named = F.arrays_overlap(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), F.array(*[F.lit(w) for w in REFERENCE_WORDS]))
    reason = (
        F.when(F.coalesce("values", F.lit(0)) == 0, "no-values").when(F.col("values") < 6, "too-few-values").when(F.col("numeric") >= 0.8, "looks-numeric")
        .when(named | (F.col("ids") >= 0.8), "looks-like-a-reference").when(ratio >= 0.5, "too-varied")
    )
    return every.join(by, "name", "left").select(
        "name", F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        F.coalesce(ratio, F.lit(0.0)).alias("ratio"), reason.alias("reason"),
    )


def checks(long: DataFrame) -> DataFrame:
    """name, kind, cells, rows: cells a spreadsheet would change, error values, invisible characters."""
    value = F.coalesce(F.col("value"), F.lit(""))
    kinds = F.array_compact(F.array(
        F.when(t.would_spreadsheet_change(value), F.lit("leading-zeros")),
        F.when(F.upper(t.js_trim(value)).isin(list(ERRORS)), F.lit("excel-error-cells")),
        F.when(t.has_invisible(value), F.lit("invisible-characters")),
    ))
    return (
        long.select("name", "row", F.explode(kinds).alias("kind")).groupBy("name", "kind")
        .agg(F.count("row").alias("cells"), F.count_distinct("row").alias("rows"))
    )


def invisible_tally(values: DataFrame, value: str) -> DataFrame:
    """code, action, count of each invisible character or odd space."""
    found = F.regexp_extract_all(F.col(value), F.lit(f"({t.INVISIBLE}|{t.ODD_SPACE})"), F.lit(1))
    char = F.explode(found).alias("char")
    return (
        values.select(char).groupBy("char").agg(F.count("char").alias("count"))
        .select(F.conv(F.hex(F.encode("char", "UTF-32")), 16, 10).cast("long").alias("code"), F.when(F.col("char").rlike(t.ODD_SPACE), "replace").otherwise("delete").alias("action"), "count")
    )


def clusters(counts: DataFrame, value: str = "value", count: str = "count", folder: str | None = None) -> DataFrame:
    """Spellings of one value, a row for each: cluster, reason, suggested, total, rows_affected, value, count.

    Values with the same words in the same order that state the same amounts make a cluster; values with the same
    words in another order make one of their own, whose reason is word-order. The commonest spelling is suggested
    (the first by text, if several are as common). A cluster is named by its words, and by its amounts where the words have
    several. Facts of a cluster are partial aggregates joined back to its spellings, so none is gathered in a row.
    """
    folder = folder or scratch(counts.sparkSession)
    given = counts.select(F.col(value).alias("value"), F.col(count).alias("count"))
    parts = given.withColumn("_words", t.words(F.col("value"))).withColumn("folded", t.fold_accents(t.squash(F.lower("value"))))
    keyed = settled(
        parts.select(
            "value", "count", "folded", F.array_join(F.array_sort("_words"), " ").alias("key"), F.array_join("_words", " ").alias("ordered"), t.amount_signature(F.col("value")).alias("amounts"),
        ).where("key <> ''"),
        folder, "keys",
    )

    def made(by: str, reason: Column, orders: int) -> DataFrame:
        lower = F.lower("value")
        facts = keyed.groupBy(by, "amounts").agg(
            F.count("value").alias("_n"), F.sum("count").alias("total"), F.min_by("value", F.struct(-F.col("count"), "value")).alias("suggested"), F.max("count").alias("_top"),
            (F.min(lower) == F.max(lower)).alias("_case"), (F.min(t.squash(lower)) == F.max(t.squash(lower))).alias("_space"), (F.min("folded") == F.max("folded")).alias("_accents"),
            F.max(F.struct("ordered")).alias("_last"), F.min(F.struct("ordered")).alias("_first"),
        )
        # A cluster is named by its amounts too where its words have several.
        several = keyed.groupBy(by).agg((F.min("amounts") != F.max("amounts")).alias("_several"), (F.min("ordered") != F.max("ordered")).alias("_orders"))
        found = facts.join(several, by).where((F.col("_n") > 1) & ((F.col("_first") != F.col("_last")) if orders > 1 else F.lit(True)))
        return found.join(keyed.select(by, "amounts", "value", "count"), [by, "amounts"]).select(
            F.when(F.col("_several"), F.concat(by, F.lit("#"), "amounts")).otherwise(F.col(by)).alias("cluster"), reason.alias("reason"), "suggested", "total",
            (F.col("total") - F.col("_top")).alias("rows_affected"), "value", "count",
        )

    spelling = F.when(F.col("_case"), "case").when(F.col("_space"), "whitespace").when(F.col("_accents"), "accents").otherwise("punctuation")
    return made("ordered", spelling, 1).unionByName(made("key", F.lit("word-order"), 2))


def allowed_distance(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 5, 0).when(n < 10, 1).otherwise(2)


def loose_clusters(counts: DataFrame, folder: str | None = None) -> DataFrame:
    """cluster, suggested, total, rows_affected, value, count: values that chains of near spellings join, for tallied values (value, count).

    Spellings with the same words in the same order stand together, by their commonest; of groups whose words are reorderings of one another only
    the one of most rows stays; and each chain is parted by the amounts its values state. A cluster is named by its least value.
    """
    folder = folder or scratch(counts.sparkSession)
    given = counts.select("value", "count").withColumn("_words", t.words(F.col("value"))).withColumn("spelled", t.fold_accents(t.squash(F.lower("value"))))
    keyed = settled(
        given.select(
            "value", "count", "spelled", F.array_join("_words", " ").alias("ordered"), F.array_join(F.array_sort("_words"), " ").alias("key"), t.amount_signature(F.col("value")).alias("amounts"),
        ).where("ordered <> ''"),
        folder, "values",
    )
    groups = settled(
        keyed.groupBy("ordered", "key").agg(F.sum("count").alias("rows"), F.min_by("spelled", F.struct(-F.col("count"), "value")).alias("spelled")).withColumn("node", F.monotonically_increasing_id()),
        folder, "groups",
    )
    pairs = near_spellings(groups.select("node", "spelled"), "spelled", "node")
    joined = settled(groups.join(components(pairs.select("a", "b"), f"{folder}/components"), "node"), folder, "joined")
    kept = joined.groupBy("component", "key").agg(F.max_by("ordered", F.struct("rows", -F.col("node"))).alias("ordered"))
    several = kept.groupBy("component").agg(F.count("key").alias("_sets")).where("_sets > 1").select("component")
    members = kept.join(several, "component").select("component", "ordered").join(keyed.select("ordered", "value", "count", "amounts"), "ordered")
    facts = members.groupBy("component", "amounts").agg(
        (F.min("ordered") != F.max("ordered")).alias("_new"), F.sum("count").alias("total"), F.max("count").alias("_top"), F.min("value").alias("cluster"), F.min_by("value", F.struct(-F.col("count"), "value")).alias("suggested"),
    ).where("_new")
    return facts.join(members, ["component", "amounts"]).select("cluster", "suggested", "total", (F.col("total") - F.col("_top")).alias("rows_affected"), "value", "count")


def merge_plan(clusters_: list[tuple[str, list[str]]]) -> dict[str, str]:
    """Accepted clusters (target, members) as a map; later ones win, and chains are followed to their end, cycles aside."""
    plan = {m: target for target, members in clusters_ for m in members if m != target}
    out = {}
    for value in plan:
        seen, at = {value}, plan[value]
        while at in plan and plan[at] not in seen | {at}:
            seen.add(at)
            at = plan[at]
        if at != value:
            out[value] = at
    return out


def near_spellings(values: DataFrame, value: str = "value", node: str | None = None) -> DataFrame:
    """a, b, distance: pairs of values (or of their nodes) within the edit distance that their length allows, which share a 4-gram.

    A pair is left out if either is a plain number or both are equal without their digits. Candidates share one of
    their rarest grams: d edits touch at most 4 d of a text's grams, so of two texts within d one of the 4 d + 1 rarest is
    common to both, if they have as many, and shorter ones enter under all of theirs. So frequent grams pair nothing, and no pair is lost.
    """
    own = node or value
    spelled = values.select(F.col(own).alias("v"), t.squash(F.lower(value)).alias("t")).distinct().withColumn("k", F.regexp_replace("t", r"[^\p{L}\p{N}]+", ""))
    usable = spelled.where((F.length("k") >= 4) & ~F.col("t").rlike(PLAIN_NUMBER)).withColumn("most", allowed_distance(F.col("t")))
    grams = F.transform(F.sequence(F.lit(1), F.length("k") - 3), lambda i: F.substring(F.col("k"), i, F.lit(4)))
    # The second "aaaa" of a text is a gram of its own, as an edit touches occurrences.
    told = F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    each = usable.where("most > 0").select("v", F.explode(told).alias("g"))
    rare = F.slice(F.array_sort(F.collect_list(F.struct("n", "g"))), F.lit(1), F.first("most") * 4 + 1)
    entered = (
        each.join(each.groupBy("g").agg(F.count("v").alias("n")).where("n > 1"), "g").join(usable, "v")
        .groupBy("v", "t", "k").agg(rare.alias("rare")).select("v", "t", "k", F.explode("rare.g").alias("g"))
    )
    a = entered.select(F.col("v").alias("a"), F.col("t").alias("ta"), F.length("k").alias("na"), "g", F.explode(F.sequence(F.length("k"), F.length("k") + 2)).alias("size"))
    b = entered.select(F.col("v").alias("b"), F.col("t").alias("tb"), "g", F.length("k").alias("size"))
    within = F.levenshtein("ta", "tb") <= F.least(allowed_distance(F.col("ta")), allowed_distance(F.col("tb")))
    bare = lambda c: F.regexp_replace(c, r"[0-9]+", "")
    found = a.join(b, ["g", "size"]).where((F.col("na") < F.col("size")) | (F.col("a") < F.col("b"))).where(within & (bare("ta") != bare("tb")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.levenshtein("ta", "tb").alias("distance")).distinct()
