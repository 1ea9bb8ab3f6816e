"""Prospecting ranks that combine signal, geology and observed ore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .dims import large
from .graph import store
from .ore import ore_observation
from .regions import max_signal
from .rock import upper_rock

RANKS = ("CONFIRMED", "STRONG", "INTERESTING", "WEAK", "UNKNOWN")


def host_compatibility(pairs: DataFrame, compat: DataFrame) -> DataFrame:
    """Verdict of each (request_id, resource) over its observed rock_code rows:
    any COMPATIBLE wins, else any UNKNOWN, else INCOMPATIBLE. compat is the
    user's table (resource, rock_code, verdict); a pair it lacks is UNKNOWN."""
    judged = pairs.join(compat, ["resource", "rock_code"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNKNOWN")))
    worst = F.max(F.when(F.col("verdict") == "COMPATIBLE", 2).when(F.col("verdict") == "UNKNOWN", 1).otherwise(0))
    named = F.element_at(F.array(F.lit("INCOMPATIBLE"), F.lit("UNKNOWN"), F.lit("COMPATIBLE")), worst + 1)
    return judged.groupBy("request_id", "resource").agg(named.alias("compatibility"))


def geology(rock_columns: DataFrame) -> DataFrame:
    """Per request_id: observed, no_rock and unavailable columns and the state:
    OBSERVED with any rock, else UNAVAILABLE with any gap, else NO_ROCK."""
    s = rock_columns.groupBy("request_id").agg(*[F.count_if(F.col("state") == n).alias(c) for n, c in (("OBSERVED", "observed"), ("NO_ROCK", "no_rock"), ("UNAVAILABLE", "unavailable"))])
    return s.withColumn("geology", F.when(F.col("observed") > 0, "OBSERVED").when(F.col("unavailable") > 0, "UNAVAILABLE").otherwise("NO_ROCK"))


def assess(evidence: DataFrame) -> DataFrame:
    """Rank and reasons of each row (observation, geology, signal, compatibility,
    observed, no_rock, unavailable), in the order of the rules, and the place by
    rank and key. The first reason is the rule's, the others tell the evidence."""
    positive = F.coalesce(F.col("signal") > 0, F.lit(False))
    fits, clashes = F.col("compatibility") == "COMPATIBLE", F.col("compatibility") == "INCOMPATIBLE"
    # The sentences of the report.
    rules = (
        (F.col("observation") == "OBSERVED", "CONFIRMED", "actual saved ore block observed"),
        (F.col("geology") == "UNAVAILABLE", "UNKNOWN", "observed geology is unavailable"),
        (positive & fits, "STRONG", "positive worldgen signal has compatible observed geology"),
        (positive & clashes, "WEAK", "positive worldgen signal has incompatible observed geology"),
        (positive, "INTERESTING", "positive worldgen signal is present"),
        (fits, "INTERESTING", "compatible observed geology is present"),
    )
    judged = F.lit(None).cast("struct<rank:string,reason:string>")
    otherwise = F.struct(F.lit("UNKNOWN").alias("rank"), F.lit("no positive supporting evidence is available").alias("reason"))
    judged = F.coalesce(*[F.when(c, F.struct(F.lit(r).alias("rank"), F.lit(t).alias("reason"))) for c, r, t in rules], judged, otherwise)
    ordinal = F.array_position(F.array(*map(F.lit, RANKS)), F.col("rank"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    count = lambda c: F.col(c).cast("string")
    reasons = F.array_compact(F.array(
        F.col("j.reason"),
        F.coalesce(text("worldgen signal=", F.col("signal").cast("string")), F.lit("worldgen signal unavailable")),
        text("observed geology=", F.col("geology")),
        text("geology coverage: observed=", count("observed"), ", no-rock=", count("no_rock"), ", unavailable=", count("unavailable")),
        F.when((F.col("unavailable") > 0) & (F.col("observed") + F.col("no_rock") > 0), "observed geology coverage is partial"),
        text("host compatibility=", F.col("compatibility")),
        F.when(F.col("observation") == "NOT_OBSERVED", "actual ore scan completed without an observation").when(F.col("observation") == "UNAVAILABLE", "actual ore observation is unavailable"),
    ))
    out = evidence.withColumn("j", judged).withColumns({"rank": F.col("j.rank"), "reasons": reasons}).drop("j")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(ordinal, "resource")))


def prospecting(requests: DataFrame, voxels: DataFrame, registry: DataFrame, coverage: DataFrame, signals: DataFrame, compat: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """One row per request and resource: the evidence, rank, reasons and place."""
    areas = requests.select("request_id", "cx", "cz", "radius").distinct()
    cells = G.circle_cells(areas).where(G.in_world(F.col("x"), size[0]) & G.in_world(F.col("z"), size[2])).select("request_id", "x", "z")
    rock, _ = store(cells.join(large(upper_rock(voxels, registry, coverage, cells, 0, size[1] - 1)), ["x", "z"]), "rock")
    pairs = rock.where("state = 'OBSERVED'").select("request_id", "rock_code").distinct().join(requests.select("request_id", "resource"), "request_id")
    keys = ["request_id", "resource"]
    evidence = (
        ore_observation(voxels, registry, requests, coverage, size)
        .join(max_signal(signals, requests), keys)
        .join(host_compatibility(pairs, compat), keys, "left")
        .join(geology(rock), "request_id", "left")
        .withColumn("compatibility", F.coalesce("compatibility", F.lit("UNKNOWN")))
    )
    return assess(evidence)
