"""Mixing sources to target weights by entropy balancing.

The mix takes document i at a rate w_i between 0 and MOST. Among all rates under
which each source's tokens come to its target, it has those of least relative
entropy to taking every document once, the sum of w log w - w + 1. Its convex dual
has one multiplier for each source's token constraint; a document's rate is the
exponential tilt exp(multiplier * size), MOST at most. The dual is solved by Newton
iterations: each is one Spark aggregation over all sources' sizes, and a bracket
keeps it safe where the bound bends the dual.

Rates become copies: their whole part for all, and one more for as many documents
of each size as the source's running token error asks for, from the largest size
down, so that the small documents make up for what the large ones leave. Which
documents of a size is settled by the MD5 of their doc_id, so reruns agree. Rows that
are alike are counted before they are ordered, so no task has a third of all rows
because they repeat one doc_id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dims import small
from .shared import drop, quoted, scope, store, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source's target, and no document, exceeds this many times its size.
MOST = 3
#: Newton iterations at most, and the error of a source's tokens that ends them.
ITERATIONS = 80
ERROR = 1e-13
#: Rates are rounded to this part of one, which makes the running errors exact.
UNIT = 1_000_000
#: Documents of one size and source that one task puts in order, about.
CELL_ROWS = 1 << 16
#: Alike rows that one task makes from their count.
RUN_ROWS = 1 << 16


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with weight and target added.

    One row per source goes through one task here: the water level needs the
    order of all of them. Targets share the sum of all sizes by weight; those
    above most times their source's size stop there and the excess goes to the
    rest by weight, until none is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    capped = weighed.withColumn("cap", F.col("source_size") * most)
    # in the order of cap to weight, the capped sources come first
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = capped.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("weight_left"),
    )
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    level = level.withColumn("free", wide("weight") * wide("left") <= wide("cap") * wide("weight_left"))
    first = level.withColumn("level", F.max(F.when(F.col("free"), F.struct(F.col("left"), F.col("weight_left")))).over(everything))
    share = F.col("weight").cast("double") * F.col("level.left") / F.col("level.weight_left")
    return first.select(*[c for c in sizes.columns if c not in ("source", "source_size")], "source", "source_size", "weight", F.when(F.col("free"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def rates(sizes: DataFrame, classes: DataFrame, most: int = MOST) -> DataFrame:
    """(name, source_size, target, tilt) of sizes (name, source_size, target) and
    classes (name, size, n), n documents of a size: a document's rate is
    exp(tilt * size), most at most. tilt is infinite where the target is all that
    the bound allows, and 0 for a source without tokens."""
    spark = sizes.sparkSession
    tokens = F.col("n") * F.col("size").cast("double")
    scale = classes.groupBy("name").agg(F.try_divide(F.sum(tokens * F.col("size")), F.sum(tokens)).alias("scale"))
    start = sizes.join(scale, "name").withColumn("open", (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < most * F.col("source_size")))
    edge = F.when(F.col("open") | (F.col("source_size") == 0) | (F.col("target") <= 0), 0.0).otherwise(float("inf"))
    infinite = lambda sign: F.lit(sign * float("inf"))
    state, path = store(start.select("*", edge.alias("tilt"), infinite(-1).alias("low"), infinite(1).alias("high"), F.col("open").alias("moving")), "tilts")
    for _ in range(ITERATIONS):
        if not state.agg(F.max("moving")).first()[0]:
            break
        # the sums over all documents, a row for each size of a source
        each = classes.join(state.where("moving").select("name", "tilt", "scale"), "name")
        rate = F.exp(F.col("tilt") * F.col("size") / F.col("scale"))
        sums = each.groupBy("name").agg(
            F.sum(tokens * F.least(rate, F.lit(float(most)))).alias("taken"),
            F.sum(F.when(rate < most, tokens * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
        )
        after, after_path = store(_newton(state.join(sums, "name", "left")).select(state.columns), "tilts")
        drop(spark, path)
        state, path = after, after_path
    return state.select("name", "source_size", "target", (F.col("tilt") / F.coalesce("scale", F.lit(1.0))).alias("tilt"))


def _newton(rows: DataFrame) -> DataFrame:
    """One step for each source that moves: Newton on the logarithm of its tokens,
    or half the bracket where that step would leave it."""
    taken, target, tilt = F.col("taken"), F.col("target"), F.col("tilt")
    under = taken < target
    low, high = F.when(under, tilt).otherwise(F.col("low")), F.when(under, F.col("high")).otherwise(tilt)
    newton = tilt - F.log(F.try_divide(taken, target)) * F.try_divide(taken, F.col("slope"))
    wide = F.when(high == float("inf"), 2 * F.abs(low) + 1).when(low == -float("inf"), -2 * F.abs(high) - 1).otherwise((low + high) / 2)
    step = F.when((F.col("slope") > 0) & (taken > 0) & (newton > low) & (newton < high), newton).otherwise(wide)
    stays = ~F.col("moving") | (F.abs(taken - target) <= ERROR * target) | (step == tilt)
    return rows.withColumns({
        "tilt": F.when(stays, tilt).otherwise(step), "low": F.when(stays, F.col("low")).otherwise(low), "high": F.when(stays, F.col("high")).otherwise(high),
        "moving": ~stays,
    })


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, cell_rows: int = CELL_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    size is the number of words, 0 for a null text. A null source is a source
    of its own, the last. Documents without words are taken once. Repeated rows of
    a doc_id are documents of their own that count alike. Empty input gives no
    rows.
    """
    units, _ = store(_mixed(_sized(docs), weights, most, cell_rows), "units")
    # of a unit's rows, some get a copy more than the others
    halves = F.array(F.struct((F.col("whole") + 1).alias("copies"), F.col("more").alias("n")), F.struct(F.col("whole").alias("copies"), (F.col("rows") - F.col("more")).alias("n")))
    parts = units.select("doc_id", "size", "source_size", "target", F.explode(halves).alias("h")).select("*", "h.copies", "h.n").drop("h").where("n > 0")
    out = _repeated(parts, "n", run_rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _repeated(rows: DataFrame, n: str, run_rows: int) -> DataFrame:
    """Each row n times. Rows of large n are dealt out in runs, so one is many tasks' work."""
    few, many = rows.where(F.col(n) <= run_rows), rows.where(F.col(n) > run_rows)
    one = F.lit(1).cast("long")
    begins = many.withColumn("_begin", F.explode(F.sequence(one, F.col(n), F.lit(run_rows).cast("long"))))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = begins.repartition(tasks, "_begin").withColumn(n, F.least(F.lit(run_rows), F.col(n) - F.col("_begin") + 1)).drop("_begin")
    return few.unionByName(runs).withColumn("_i", F.explode(F.sequence(one, F.col(n)))).drop("_i", n)


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size, name, key, *more): name is a source that is never null, key
    an order of documents, for those without doc_id that of their texts."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), name.alias("name"), key.alias("key"), *more)


def _mixed(sized: DataFrame, weights, most: int, cell_rows: int) -> DataFrame:
    """A row for each unit of rows of sized that are alike in all columns, with rows, their
    number, whole, the copies of each, and more, how many of them get one more."""
    docs, _ = store(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("rows")), "sized")
    classes, _ = store(docs.groupBy("name", "source", "size").agg(F.sum("rows").alias("n")), "classes")
    sizes = classes.groupBy("name", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    with scope(docs.sparkSession):
        aims, _ = store(rates(targets(sizes, weights, most), classes, most), "aims", kept=True)
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size"))))
    rated = classes.join(aims, "name").withColumn("units", F.round(rate * UNIT).cast("long"))
    rated = rated.groupBy("name").applyInPandas(_rounded(most), "name string, size long, source_size long, target double, whole long, extra long")
    # a class of many documents is dealt out in cells of keys; a document's place in
    # the class is what the earlier cells hold and its place in its own
    n = classes.agg(F.max("n")).first()[0] or 0
    docs = _dealt(docs, n, cell_rows)
    cells = docs.groupBy("name", "size", "cell").agg(F.sum("rows").alias("n"))
    earlier = Window.partitionBy("name", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    cells = cells.join(rated, ["name", "size"])
    order = [c for c in sized.columns if c not in ("name", "source", "size", "key")]
    inside = Window.partitionBy("name", "size", "cell").orderBy("key", *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("before", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(cells, ["name", "size", "cell"])
    left = F.col("extra") - F.col("ahead") - F.col("before")
    return placed.withColumn("more", F.greatest(F.lit(0), F.least(F.col("rows"), left)))


def _dealt(docs: DataFrame, n: int, cell_rows: int) -> DataFrame:
    """docs with the cell of their class, n rows at most, that they lie in: a prefix of their
    key. Where one key has far more units than a cell should, its cells are prefixes of
    their own digest as well. Cells follow each other in the order of key and digest."""
    digits = lambda cells: max(1, (max(1, cells) - 1).bit_length() // 4 + 1)
    docs = docs.withColumn("cell", F.substring("key", 1, min(32, digits(n // cell_rows))))
    if "alike" not in docs.columns:  # then alike rows of a key are one unit
        return docs
    counts = docs.groupBy("name", "size", "cell").agg(F.count(F.lit(1)).alias("units")).where(F.col("units") > 4 * cell_rows)
    finer = F.ceil(F.log(16.0, F.col("units") / cell_rows)).cast("int")
    heavy, _ = store(counts.select("name", "size", "cell", finer.alias("finer")), "heavy")
    if heavy.isEmpty():
        return docs
    joined = docs.join(small(heavy), ["name", "size", "cell"], "left")
    own = F.concat("key", F.expr("substring(alike, 1, finer)"))
    return joined.withColumn("cell", F.coalesce(own, "cell")).drop("finer")


def _rounded(most: int):
    """For the classes of one source: whole copies of each document of a size, and
    how many of them get one more. A source has no more sizes than its longest
    document has words, so this holds no more than that document does."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, ignore_index=True)
        error, extras = 0, []  # in units of tokens, as whole numbers of any length
        for size, n, units in zip(rows["size"].tolist(), rows["n"].tolist(), rows["units"].tolist()):
            wish = error + units % UNIT * n * size
            most_extra = n if size and units < most * UNIT else 0
            extra = max(0, min(most_extra, (2 * wish + size * UNIT) // (2 * size * UNIT))) if size else 0
            error = wish - extra * size * UNIT
            extras.append(extra)
        rows["whole"], rows["extra"] = rows["units"] // UNIT, extras
        return rows[["name", "size", "source_size", "target", "whole", "extra"]]

    return run


def take(docs: DataFrame, weights=WEIGHTS, most: int = MOST, cell_rows: int = CELL_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it has copies. Rows that are
    alike in all columns share their copies; other rows of a doc_id have an order by
    the MD5 of the row, so a task that runs again gives the same."""
    others = F.to_json(F.struct(*[docs[quoted(c)] for c in docs.columns if c != "text"]))
    alike = F.md5(F.concat_ws(" ", F.md5(F.col("text").cast("binary")), others).cast("binary"))
    sized = _sized(docs.select(F.struct("*").alias("doc"), "doc_id", "source", "text", alike.alias("alike")), "doc", "alike")
    units, _ = store(_mixed(sized.drop("doc"), weights, most, cell_rows), "units")
    rows = sized.select("doc", "alike")
    if not units.where("rows > 1").isEmpty():  # of alike rows one stands for all
        rows = rows.groupBy("alike").agg(F.first("doc").alias("doc"))
    times = units.select("alike", (F.col("rows") * F.col("whole") + F.col("more")).alias("times")).where("times > 0")
    return _repeated(rows.join(times, "alike"), "times", run_rows).select("doc.*")


def sql(documents: str = "documents", result: str = "SELECT doc_id, size, source_size, target, taken FROM mixed") -> str:
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS key FROM {documents}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, list_value({', '.join(map(str, WEIGHTS))})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * {MOST} AS cap FROM sizes),
level AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::BIGINT AS lft,
         (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT *, weight * lft <= cap * weight_left AS open FROM level),
top AS (SELECT max({{'l': lft, 'w': weight_left}}) AS m FROM free WHERE open),
aims AS (
  SELECT coalesce('s' || source, '') AS name, source_size, CASE WHEN open THEN weight::DOUBLE * m.l / m.w ELSE cap::DOUBLE END AS target
  FROM free LEFT JOIN top ON true),
named AS (SELECT *, coalesce('s' || source, '') AS name FROM sized),
classes AS (SELECT name, size, count(*) AS n FROM named GROUP BY ALL),
inside AS (
  SELECT a.*, sum(n * size::DOUBLE * size) / sum(n * size::DOUBLE) AS scale, list({{'s': size::DOUBLE, 't': n * size::DOUBLE}}) AS held
  FROM aims a JOIN classes USING (name) WHERE source_size > 0 AND target > 0 AND target < {MOST} * source_size GROUP BY ALL),
bracket(i, name, target, scale, held, low, high) AS (
  SELECT 0, name, target, scale, held, -4096.0::DOUBLE, 4096.0::DOUBLE FROM inside
  UNION ALL
  SELECT i + 1, name, target, scale, held, CASE WHEN under THEN middle ELSE low END, CASE WHEN under THEN high ELSE middle END FROM (
    SELECT *, list_sum(list_transform(held, lambda c: c.t * exp(least(ln({MOST}.0::DOUBLE), middle * c.s / scale)))) < target AS under
    FROM (SELECT *, (low + high) / 2 AS middle FROM bracket WHERE i < 75))),
tilts AS (SELECT name, (low + high) / 2 / scale AS tilt FROM bracket WHERE i = 75),
rated AS (
  SELECT c.*, source_size, target, CAST(round({UNIT} * CASE WHEN size = 0 OR source_size = 0 OR target <= 0 THEN 1.0 WHEN tilt IS NULL THEN {MOST}.0 ELSE exp(least(ln({MOST}.0::DOUBLE), tilt * size)) END) AS BIGINT) AS units
  FROM classes c JOIN aims USING (name) LEFT JOIN tilts USING (name)),
split AS (SELECT *, units // {UNIT} AS whole, units % {UNIT} AS part, CASE WHEN size > 0 AND units < {MOST * UNIT} THEN n ELSE 0 END AS most, row_number() OVER (PARTITION BY name ORDER BY size DESC) AS i FROM rated),
wished AS (SELECT *, part::HUGEINT * n * size AS own, greatest(1, size)::HUGEINT * {UNIT} AS each FROM split),
walk AS (
  SELECT name, i, size, own AS wish, each, greatest(0, least(most, (2 * own + each) // (2 * each)))::BIGINT AS extra FROM wished WHERE i = 1
  UNION ALL
  SELECT w.name, w.i, w.size, p.wish - p.extra * p.each + own, w.each, greatest(0, least(most, CAST(floor((2 * (p.wish - p.extra * p.each + own) + w.each) / (2 * w.each)) AS HUGEINT)))::BIGINT
  FROM walk p JOIN wished w ON w.name = p.name AND w.i = p.i + 1),
begun AS (SELECT s.*, extra FROM split s JOIN walk USING (name, i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY key, doc_id) AS place FROM named),
mixed AS (
  SELECT p.doc_id, p.source, p.size, source_size, target,
         p.size * (whole + CASE WHEN place <= extra THEN 1 ELSE 0 END) AS taken
  FROM placed p JOIN begun b ON p.name = b.name AND p.size = b.size)
{result}
"""


SQL = sql()
