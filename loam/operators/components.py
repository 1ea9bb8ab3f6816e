"""Connected deposits of matched surface cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.geometry import to_chunk
from .dims import is_small, large, small
from .graph import components, numbered, scope, store

#: Edges of a graph that one task may finish.
SMALL_EDGES = 200_000
#: One of each pair of opposite neighbours.
HALF = ((1, 0), (0, 1), (1, 1), (1, -1))


def neighbours8(cells: DataFrame) -> DataFrame:
    """Pairs (x, z, x2, z2) of cells that touch, corners included, each once."""
    at = cells.select("x", "z").distinct()
    steps = F.array(*[F.struct((F.col("x") + dx).alias("x2"), (F.col("z") + dz).alias("z2")) for dx, dz in HALF])
    shifted = at.withColumn("n", F.explode(steps)).select("x", "z", "n.x2", "n.z2")
    return shifted.join(large(at.select(F.col("x").alias("x2"), F.col("z").alias("z2"))), ["x2", "z2"], "left_semi").select("x", "z", "x2", "z2")


def tile_labels(cells: DataFrame) -> DataFrame:
    """(x, z, label): connected cells of one mapchunk carry the smallest node
    among them. A group has at most 1,024 cells."""

    def label(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["x", "z"])  # the order of nodes
        left = dict.fromkeys(zip(tile["x"].tolist(), tile["z"].tolist()))
        names = {}
        while left:
            first = next(iter(left))
            queue = [first]
            del left[first]
            while queue:
                x, z = queue.pop()
                names[x, z] = (first[0] << 32) + first[1]
                near = [(x + i, z + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (x + i, z + j) in left]
                for c in near:
                    del left[c]
                queue += near
        return pd.DataFrame([(x, z, n) for (x, z), n in names.items()], columns=["x", "z", "label"])

    at = cells.select(F.col("x").cast("int"), F.col("z").cast("int")).distinct()
    return at.groupBy(to_chunk(F.col("x")).alias("mx"), to_chunk(F.col("z")).alias("mz")).applyInPandas(lambda t: label(t), "x int, z int, label long")


def small_components(edges: DataFrame) -> DataFrame:
    """components() of at most SMALL_EDGES edges (u, v): one task joins them in
    memory, where rounds over stored tables would cost more than the work."""

    def label(batches):
        parent: dict[int, int] = {}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
                a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                parent[max(a, b)] = min(a, b)
        yield pd.DataFrame({"node": list(parent), "component": [root(n) for n in list(parent)]}, dtype="int64")

    return edges.where("u <> v").select("u", "v").coalesce(1).mapInPandas(label, "node long, component long")


def components8(cells: DataFrame) -> DataFrame:
    """(x, z, component) of 8-connected cells; a component is named by its cell
    with the smallest x, then z, as x * 2^32 + z.

    Cells are labelled inside their mapchunk first, so only the labels that meet
    at a border take part in the rounds over the graph; if they are few, one task
    finishes them.
    """
    labels, _ = store(tile_labels(cells), "labels")
    other = labels.select(F.col("x").alias("x2"), F.col("z").alias("z2"), F.col("label").alias("v"))
    apart = (to_chunk(F.col("x")) != to_chunk(F.col("x2"))) | (to_chunk(F.col("z")) != to_chunk(F.col("z2")))
    edge = (F.pmod(F.col("x"), F.lit(32)).isin(0, 31)) | (F.pmod(F.col("z"), F.lit(32)).isin(0, 31))
    border = neighbours8(labels.where(edge)).where(apart)
    pairs = border.join(large(labels.withColumnRenamed("label", "u")), ["x", "z"]).join(large(other), ["x2", "z2"]).select("u", "v").distinct()
    with scope(labels.sparkSession):
        pairs, _ = store(pairs, "pairs")
        find = small_components if is_small(pairs, SMALL_EDGES) else components
        roots, _ = store(find(pairs), "roots", kept=True)
    roots = roots.withColumnRenamed("node", "label")
    return labels.join(large(roots), "label", "left").select("x", "z", F.coalesce("component", "label").alias("component"))


def deposit_stats(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Per component of cells (x, y, z, code): count, codes, bounds, mean x and z."""
    return cells.join(large(labels), ["x", "z"]).groupBy("component").agg(
        F.count(F.lit(1)).alias("cells"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"),
        *[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))], F.avg("x").alias("mean_x"), F.avg("z").alias("mean_z"))


def deposit_order(deposits: DataFrame, marked: int = 20) -> DataFrame:
    """Place by size, then centre; the first are marked; bands at 100 and 25."""
    placed = numbered(deposits, F.desc("cells"), F.col("mean_x"), F.col("mean_z"), F.col("component"))
    band = F.when(F.col("cells") >= 100, "LARGE").when(F.col("cells") >= 25, "MEDIUM").otherwise("SMALL")
    return placed.withColumns({"marked": F.col("place") <= marked, "band": band})


def material_deposits(surface: DataFrame, registry: DataFrame, tokens: list[str]) -> DataFrame:
    """Deposits of the surface cells whose code has every token, in order."""
    dim = registry.where(C.material_match(F.col("code"), F.array(*map(F.lit, tokens)))).select("block_id", "code")
    cells = surface.join(small(dim), "block_id").select("x", "y", "z", "code")
    return deposit_order(deposit_stats(cells, components8(cells)))
