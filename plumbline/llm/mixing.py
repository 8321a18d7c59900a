"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target number of words (`targets`). A document of a source with
target T and S words is expected T / S times: the whole part is certain, and the
fraction f is its inclusion probability. Among the documents of a source the rest of
the target is filled in the order of Pareto's ranks

    q = (u / (1 - u)) / (f / (1 - f)),      u uniform, from md5(seed, doc_id)

which gives a sample of fixed size (here: of words) with those probabilities. The rank
at which a source's words are full is found without sorting a source: words are summed over
256 equal bins of q / (1 + q), then over 256 bins of the bin that crosses the target, and so a third
time; of the last bin, a 16-millionth of the scale, rows of one rank, id and size are counted as one, and
those counts are ordered. So no window holds more than 256 rows of a source, or the counts of that
last bin. Rows that share the rank at the target (as many may that share an id, or have none) are
numbered where they lie.

A document may carry its own `weight`: then f differs within a source too.

Defined results: null and empty texts have size 0 and are taken 0 times; null sources are
a source of their own, last; repeated rows are documents of their own (with one rank
for equal ids, and ordered by size among those); an empty table gives an empty result; very long
texts are only counted; other columns of the table are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, scratch, settled, table

BINS, LEVELS = 256, 3
#: So many sources at most are sent to all tasks (a row each, under a megabyte); more are joined by a shuffle, which parts each source by a salt.
FEW_SOURCES, SALTS = 10_000, 64


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from an id, the same in each run: 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, target: share of all words over the sources by weight, none above limit times its own.

    Water filling in closed form: in the order of limit * size / weight the first sources
    stop at their limits, and the others get a common level times their weights.
    """
    # One row a source from here on; the windows below never see documents.
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(place) - 1) % len(weights)
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(limit)))
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("filled", (F.col("budget") - F.col("before")) / F.col("open"))
        # The first source whose own limit isn't below the level that is left sets that level; later ones would set lower ones.
        .withColumn("water", F.max(F.when(F.col("filled") <= F.col("level"), F.col("filled"))).over(Window.partitionBy()))
        .withColumn("target", F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("water"), F.col("most"))))
        .select("source", "source_size", "target")
    )


def _crossing(rows: DataFrame, bin_name: str) -> DataFrame:
    """source, the first bin whose words pass the rest of the target, and the words before it, of rows with the words `base` before all of them."""
    sums = rows.groupBy("source", bin_name).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    upto = Window.partitionBy("source").orderBy(bin_name)  # at most BINS rows a source
    return (
        sums.withColumn("upto", F.col("base") + F.sum("words").over(upto))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min_by(F.struct(F.col(bin_name).alias("bin"), (F.col("upto") - F.col("words")).alias("before")), F.col(bin_name)).alias("c"))
        .select("source", "c.bin", "c.before")
    )


def _boundary(cell: DataFrame, place: Column) -> DataFrame:
    """source, the place at which its last bin's words pass the rest, and how many of the rows there are still taken."""
    counts = cell.groupBy("source", place.alias("place")).agg(F.count("size").alias("n"), F.first("size").alias("size"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))
    fit = F.when(F.col("size") > 0, F.floor((2 * (F.col("rest") - F.col("before")) - F.col("size")) / (2 * F.col("size"))) + 1).otherwise(F.col("n"))
    return (
        counts.withColumn("before", before).withColumn("fit", F.greatest(F.lit(0), fit)).where("fit < n")
        .groupBy("source").agg(F.min(F.struct("place", "fit")).alias("b")).select("source", F.col("b.place").alias("boundary"), F.col("b.fit").alias("fit"))
    )


def _numbered(rows: DataFrame, folder: str) -> DataFrame:
    """rows with number, from 1 within each source, counted part by part so that no source's rows meet."""
    parted = settled(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), folder, "shared")
    parts = parted.groupBy("source", "part").agg(F.count("at").alias("n"))
    before = parts.withColumn("above", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).select(F.col("source").alias("_s"), F.col("part").alias("_p"), "above")
    here = Window.partitionBy("source", "part").orderBy("at")
    return (
        parted.withColumn("here", F.row_number().over(here)).join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
        .withColumn("number", F.col("above") + F.col("here")).drop("_s", "_p", "above", "here", "part", "at")
    )


def mix(docs: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: str = "mix", weight: str | None = None, folder: str | None = None, key: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, text, source), and its key if a column is named."""
    spark = docs.sparkSession
    folder = folder or scratch(spark)
    own = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    keys = [] if key is None else [key]
    slim = settled(
        docs.select(*keys, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), own.alias("own")),
        folder, "sizes",
    )
    plan = targets(slim, weights, share, limit)
    if weight is not None:
        plan = plan.join(slim.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("own") * F.col("size")).alias("mass")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    else:
        plan = plan.withColumn("mass", F.col("source_size").cast("double"))
    plan = settled(plan, folder, "targets")
    small = plan.count() <= FEW_SOURCES
    expected = F.when(F.col("mass") > 0, F.least(F.lit(float(limit)), F.col("target") * F.col("own") / F.col("mass"))).otherwise(0.0)
    u, f = uniform(F.col("doc_id"), seed), F.col("fraction")
    q = F.when(f > 0, (u / (1 - u)) / (f / (1 - f)))
    rows = _with_source(slim, plan, small).withColumn("expected", expected).withColumn("certain", F.floor("expected").cast("long")).withColumn("fraction", F.col("expected") - F.col("certain"))
    if weight is None:  # all documents of a source have the same whole part
        rows = rows.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    else:
        sure = rows.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
        rows = _with_source(rows, sure.withColumnRenamed("_s", "source"), small).withColumn("rest", F.col("target") - F.col("sure"))
    rows = rows.withColumn("q", q).withColumn("_v", F.col("q") / (1 + F.col("q")))
    bins = [f"bin{k}" for k in range(LEVELS)]
    for name in bins:
        rows = rows.withColumn(name, F.least(F.floor(F.col("_v") * BINS), F.lit(BINS - 1))).withColumn("_v", F.col("_v") * BINS - F.col(name))
    open_, cuts = rows.where(F.col("q").isNotNull()).withColumn("base", F.lit(0.0)), None
    for name in bins:
        cut = settled(_crossing(open_, name).withColumnsRenamed({"bin": f"cut_{name}", "before": "base"}), folder, name)
        cuts = cut if cuts is None else _with_source(cuts.drop("base"), cut, small, "left")
        open_ = _with_source(open_.drop("base"), cut, small).where(F.col(name) == F.col(f"cut_{name}")).drop(f"cut_{name}")
    place = F.struct("q", "doc_id", "size")
    # A source whose words pass its target in no bin at all has no cut: all of its documents are within.
    cuts = settled(_with_source(cuts.drop("base"), _boundary(open_, place), small, "left"), folder, "cuts")
    placed = _with_source(rows, cuts, small, "left")
    at, cut_at = F.struct(*bins), F.struct(*[f"cut_{n}" for n in bins])
    shares = F.coalesce((at == cut_at) & (place == F.col("boundary")), F.lit(False))
    extra = (
        F.when(F.col("q").isNull(), 0)
        .when(F.col("cut_bin0").isNull() | (at < cut_at) | ((at == cut_at) & (F.col("boundary").isNull() | (place < F.col("boundary")))), 1)
        .otherwise(0)
    )
    taken = (F.col("size") * (F.col("certain") + F.col("extra"))).alias("taken")
    out = [*keys, "doc_id", "size", "source_size", "target"]
    decided = placed.where(~shares).withColumn("extra", extra).select(*out, taken)
    last = _numbered(placed.where(shares).select("source", *out, "certain", "fit"), folder).withColumn("extra", (F.col("number") <= F.col("fit")).cast("int"))
    return decided.unionByName(last.select(*out, taken))


def _with_source(rows: DataFrame, facts: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """rows with what is known of their source. Few sources go to all tasks; of more, each is parted by a salt, so that no source's rows meet in one task."""
    facts = facts.withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    if small:
        return rows.join(F.broadcast(facts), same, how).drop("_s")
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return salted.join(facts.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("_salt") == F.col("_salted")), how).drop("_s", "_salt", "_salted")


def op5_pareto_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
  source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, most / weight AS level FROM w),
f AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY level, source COLLATE C NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY level, source COLLATE C NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM l),
t AS (SELECT source, source_size, least(most, coalesce(weight * max(CASE WHEN filled <= level THEN filled END) OVER (), most)) AS target FROM f),
x AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size::DOUBLE) ELSE 0 END AS expected,
  ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, floor(expected)::BIGINT AS certain, expected - floor(expected) AS fr, target - floor(expected) * source_size AS rest FROM x),
z AS (SELECT *, CASE WHEN fr > 0 THEN (u / (1 - u)) / (fr / (1 - fr)) END AS q FROM y),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
SELECT doc_id, size, source_size, target, size * (certain + CASE WHEN q IS NOT NULL AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS taken FROM c
"""
