"""Classifiers of block codes and packed values, as column expressions.

They depend on the registry alone, so they are meant for its rows, which are
then joined to the voxels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dims import small

# Code fragments, tiers, families and labels of the data model.
FOLIAGE = (
    "leaves", "foliage", "flower", "mushroom", "sapling", "crop", "tallgrass", "fern", "wildvine", "fruitingbush",
    "berrybush", "tallplant", "cattail", "reed", "bamboo", "cactus", "log-grown",
)
ROCK_LIKE = ("rock", "stone", "ore", "flint", "stalag", "stalact", "looseboulder")
SOIL_LIKE = ("soil", "clay", "peat", "mud")
SURFACE_CODES = {"WATER": 0, "GRASS": 1, "FOREST_FLOOR": 2, "SOIL": 3, "ROCK": 4, "SAND": 5, "GRAVEL": 6, "VEGETATION": 7, "SNOW": 8, "UNKNOWN": 9}
TIERS = {"verylow": "BARREN", "low": "LOW", "medium": "MEDIUM", "high": "HIGH", "compost": "TERRA_PRETA"}
TIER_PERCENT = {"BONY": 0, "BARREN": 5, "LOW": 25, "MEDIUM": 50, "HIGH": 65, "TERRA_PRETA": 80}
FAMILIES = {"looseores": "ORE_BITS", "looseflints": "FLINT", "loosestones": "LOOSE_STONE", "looseboulders": "LOOSE_BOULDER"}
FAMILY_LABELS = {"ORE_BITS": "Ore bits", "FLINT": "Flint", "LOOSE_STONE": "Loose stone", "LOOSE_BOULDER": "Loose boulder"}
PRESETS = {"fireclay": ("fire", "clay"), "fire clay": ("fire", "clay"), "clay": ("clay",), "peat": ("peat",)}
COLD, HOT, ARID, HUMID, OPEN, FORESTED = 85, 170, 85, 170, 0.20, 0.60


def clean(code: Column) -> Column:
    """Trimmed of control characters and spaces, lower-cased."""
    return F.lower(F.regexp_replace(F.coalesce(code, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", ""))


def _any(code: Column, fragments) -> Column:
    return reduce(lambda a, b: a | b, [code.contains(f) for f in fragments])


def is_air(block_id: Column, code: Column) -> Column:
    c = clean(code)
    return (block_id == 0) | (c == "air") | c.endswith(":air")


def is_foliage(block_id: Column, code: Column) -> Column:
    return ~is_air(block_id, code) & _any(clean(code), FOLIAGE)


def code_path(code: Column) -> Column:
    """What follows the first colon, or all."""
    return F.regexp_replace(clean(code), r"^[^:]*:", "")


def is_ore(code: Column) -> Column:
    return code_path(code).startswith("ore-")


def match_ore(code: Column, query: Column) -> Column:
    """An ore code whose path has the trimmed query in it; a blank query never."""
    q = clean(query)
    return is_ore(code) & (q != "") & code_path(code).contains(q)


def match_block(code: Column, query: Column, mode: Column) -> Column:
    return F.when(mode == "ORE_CODE", match_ore(code, query)).otherwise((clean(query) != "") & clean(code).contains(clean(query)))


def surface_class(block_id: Column, code: Column, liquid_id: Column, liquid_code: Column) -> Column:
    """Surface class of a block under a liquid; an unregistered block is UNKNOWN."""
    c = F.lower(code)
    water = lambda i, k: F.coalesce((i != 0) & F.lower(k).contains("water"), F.lit(False))
    return (
        F.when(water(liquid_id, liquid_code), "WATER")
        .when(code.isNull() | (block_id == 0) | code.startswith("unknown:"), "UNKNOWN")
        .when(water(block_id, code), "WATER")
        .when(c.contains("snow"), "SNOW")
        .when(c.contains("forestfloor"), "FOREST_FLOOR")
        .when(is_foliage(block_id, code), "VEGETATION")
        .when(c.contains("grass"), "GRASS")
        .when(_any(c, ROCK_LIKE), "ROCK")
        .when(c.contains("gravel"), "GRAVEL")
        .when(c.contains("sand"), "SAND")
        .when(_any(c, SOIL_LIKE), "SOIL")
        .otherwise("UNKNOWN")
    )


def surface_code(name: Column) -> Column:
    return _lookup(SURFACE_CODES, name)


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def rock_code(code: Column) -> Column:
    """The normalised code of a rock, else null."""
    c = F.lower(F.regexp_replace(code, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.when(c.rlike(r"^([\p{L}\p{Nd}_.-]+:)?rock-[\p{L}\p{Nd}_.-]+$"), c)


def soil_fertility(code: Column) -> Column:
    """struct(tier, source, percent) of a fertile block, else null."""
    path = F.regexp_extract(clean(code), r"^(?:game:)?([^:]+)$", 1)
    soil = F.regexp_extract(path, r"^soil-(verylow|low|medium|high|compost)-(?:none|verysparse|sparse|normal)$", 1)
    farm = F.regexp_extract(path, r"^farmland-(?:dry|moist)-(verylow|low|medium|high|compost)$", 1)
    pick = lambda tier, source: F.struct(tier.alias("tier"), F.lit(source).alias("source"), _lookup(TIER_PERCENT, tier).alias("percent"))
    return (
        F.when(path.rlike(r"^bonysoil(-[1-7])?$"), pick(F.lit("BONY"), "BONY_SOIL"))
        .when(path.rlike(r"^forestfloor-[0-7]$"), pick(F.lit("LOW"), "FOREST_FLOOR"))
        .when(soil != "", pick(_lookup(TIERS, soil), "SOIL"))
        .when(farm != "", pick(_lookup(TIERS, farm), "FARMLAND"))
    )


def object_identity(code: Column) -> Column:
    """struct(namespace, family, key, host_rock, variant) of a loose object."""
    c = clean(code)
    namespace = F.regexp_extract(c, r"^([^:]*):", 1)
    path = F.regexp_extract(c, r"^(?:[^:]+:)?([^:]+)$", 1)
    tokens = F.split(path, "-", -1)
    family = _lookup(FAMILIES, tokens[0])
    n, ore = F.size(tokens), tokens[0] == "looseores"
    variant = F.element_at(tokens, -1)
    key_size = n - 2 - F.when(ore, 1).otherwise(0)
    good = family.isNotNull() & (key_size >= 1) & F.forall(tokens, lambda t: F.trim(t) != "") & variant.isin("free", "snow", "water", "ice")
    key = F.array_join(F.slice(tokens, F.lit(2), F.greatest(key_size, F.lit(0))), "-")
    host = F.when(ore, F.element_at(tokens, -2))
    return F.when(good, F.struct(namespace.alias("namespace"), family.alias("family"), key.alias("key"), host.alias("host_rock"), variant.alias("variant")))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def object_display(key: Column, namespace: Column) -> Column:
    name = capitalised(F.translate(key, "-_", "  "))
    return F.when(namespace.isin("", "game"), name).otherwise(F.concat(name, F.lit(" ["), namespace, F.lit("]")))


def family_labels(families: Column) -> Column:
    """Labels of a set of families, in the order of the families."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.array_contains(families, k), v) for k, v in FAMILY_LABELS.items()])), ", ")


def material_match(code: Column, tokens: Column) -> Column:
    c = clean(code)
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: c.contains(t))


def preset_tokens(name: Column) -> Column:
    """Tokens of a named material; null for another name."""
    return F.create_map(*[x for k, v in PRESETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[clean(name)]


def short_name(key: Column) -> Column:
    return F.regexp_replace(clean(key), r"^.*:", "")


def match_keys(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """Signal keys (key) for each query text (query): those whose full or short
    name is the query, or, without any, those that contain it."""
    asked = queries.select("query", clean(F.col("query")).alias("q")).where("q <> ''").distinct()
    named = keys.select("key").distinct().withColumn("k", clean(F.col("key")))
    by_name = named.select("key", F.explode(F.array_distinct(F.array("k", short_name(F.col("key"))))).alias("q"))
    exact = asked.join(by_name, "q").select("query", "key")
    rest = asked.join(exact.select("query").distinct(), "query", "left_anti")
    within = rest.join(small(named), F.col("k").contains(F.col("q"))).select("query", "key")
    return exact.unionByName(within)


def ore_directory(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each resource a signal key names: match, display, source_key,
    n_codes. The first key of a match, in order of the key, names it."""
    name = short_name(F.col("key"))
    named = keys.where(name != "").withColumn("short", name).withColumn("match", F.when(name.isin("copper", "nativecopper"), "nativecopper").otherwise(name))
    first = named.groupBy("match").agg(F.min_by("short", "key").alias("short"), F.min("key").alias("source_key"))
    title = F.array_join(F.transform(F.filter(F.split(F.translate("short", "-_", "  "), r"\s+"), lambda w: w != ""), capitalised), " ")
    display = F.when(F.col("short").isin("nativecopper", "copper"), "Native Copper").when(F.col("short") == "cassiterite", "Tin / Cassiterite").otherwise(title)
    hits = first.join(registry.where(is_ore(F.col("code"))), match_ore(F.col("code"), F.col("match")), "left")
    return hits.groupBy("match", display.alias("display"), "source_key").agg(F.countDistinct(F.lower("code")).alias("n_codes"))


def climate_bits(raw: Column) -> tuple[Column, Column]:
    """(temperature, rain) of a packed climate value."""
    part = lambda by: F.shiftrightunsigned(raw, by).bitwiseAND(F.lit(255))
    return part(16), part(8)


def forest_density(raw: Column) -> Column:
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / 255.0)))


def mean_density(raw: Column) -> Column:
    """Aggregate: mean density. The sum is of integers, so no order of the rows
    changes it."""
    return F.avg(F.when(raw.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), raw)))) / 255.0


def forest_class(density: Column) -> Column:
    return (
        F.when(density <= 0, "NONE").when(density < 0.2, "SPARSE").when(density < 0.4, "LIGHT")
        .when(density < 0.6, "MODERATE").when(density < 0.8, "DENSE").otherwise("VERY_DENSE")
    )


def environment_labels(temperature: Column, rain: Column, density: Column) -> Column:
    """Labels of averages; a null average gives none."""
    return F.array_compact(F.array(
        F.when(temperature <= COLD, "COLD"), F.when(temperature >= HOT, "HOT"), F.when(rain <= ARID, "ARID"), F.when(rain >= HUMID, "HUMID"),
        F.when(density <= OPEN, "OPEN"), F.when(density >= FORESTED, "FORESTED")))
