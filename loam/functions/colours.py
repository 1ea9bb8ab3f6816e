"""Colours of tiles as integer column expressions, 0xAARRGGBB as a signed int."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base colours of surface classes, rocks and soil tiers.
SURFACE = {
    "WATER": 0x2F6F98, "GRASS": 0x6F9144, "FOREST_FLOOR": 0x5D6D3E, "VEGETATION": 0x3F783A, "SOIL": 0x896440,
    "ROCK": 0x888781, "SAND": 0xD4C28B, "GRAVEL": 0xA39A8C, "SNOW": 0xE8ECEA, "UNKNOWN": 0xB54CC2,
}
ROCK = {
    "game:rock-granite": 0x8B8B8B, "game:rock-basalt": 0x4F555A, "game:rock-limestone": 0xD8CFA8, "game:rock-sandstone": 0xC89455, "game:rock-shale": 0x687A86,
    "game:rock-slate": 0x4D5968, "game:rock-andesite": 0x717B78, "game:rock-marble": 0xE4E1D8, "game:rock-chalk": 0xD9D7C7, "game:rock-chert": 0x9B735F,
}
SOIL = {"BONY": (115, 115, 115), "BARREN": (105, 68, 36), "LOW": (184, 124, 48), "MEDIUM": (166, 178, 58), "HIGH": (56, 163, 76), "TERRA_PRETA": (22, 108, 58)}
SOIL_ALPHA = 190
NO_ROCK, UNAVAILABLE_LIGHT, UNAVAILABLE_DARK = 0x4A4A4A, 0x888888, 0x707070
GRADIENTS = {"SIMPLE": ((47, 82, 35), (183, 171, 92), 0.80), "TOPOGRAPHIC": ((37, 80, 43), (226, 215, 163), 1.15)}
ENVIRONMENT = {"COLD": (45, 105, 210), "HOT": (230, 105, 55), "ARID": (205, 175, 95), "HUMID": (55, 180, 185), "OPEN": (155, 155, 140), "FORESTED": (55, 175, 75)}
ENVIRONMENT_BASE = (110, 125, 110)


def argb(red: Column, green: Column, blue: Column) -> Column:
    """Opaque colour as a signed int."""
    return (red.cast("long") * 65536 + green.cast("long") * 256 + blue.cast("long") - 16777216).cast("int")


def parts(colour: Column) -> list[Column]:
    return [F.shiftright(colour, by).bitwiseAND(F.lit(255)) for by in (16, 8, 0)]


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def _table(values: dict[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])[key]


def shaded(red: Column, green: Column, blue: Column, factor: Column) -> Column:
    return argb(*[F.least(F.lit(255), F.floor(c * factor)) for c in (red, green, blue)])


def hillshade(west: Column, east: Column, north: Column, south: Column) -> Column:
    """Light of a slope; 0 where a neighbour is missing."""
    light = (-(east - west).cast("double") * 0.55 - (south - north).cast("double") * 0.75) / 32.0
    return F.when(light.isNull(), 0.0).otherwise(clamp(light, -0.35, 0.35))  # least and greatest skip nulls


def terrain_argb(height: Column, low: Column, high: Column, shade: Column, style: str = "SIMPLE") -> Column:
    n = F.when(high <= low, 0.5).otherwise(clamp((height - low) / (high - low).cast("double"), 0.0, 1.0))
    if style == "HIGH_CONTRAST":
        contrast = 1.35
        base = [F.when(n >= 0.5, 255).otherwise(21)] * 3
    else:
        a, b, contrast = GRADIENTS[style]
        base = [F.floor(lo + (hi - lo) * n + 0.5) for lo, hi in zip(a, b)]
    return shaded(*base, clamp(0.78 + n * 0.42 + shade * contrast, 0.35, 1.70))


def surface_argb(name: Column, shade: Column) -> Column:
    effect = F.when(name == "WATER", shade * 0.20).when(name == "SNOW", shade * 0.45).otherwise(shade)
    return shaded(*parts(_table(SURFACE, name)), clamp(1.0 + effect, 0.68, 1.32))


def soil_blend(background: Column, tier: Column) -> Column:
    """The tier's colour over the background, by integer alpha."""
    mixed = [
        F.floor((_table({k: v[i] for k, v in SOIL.items()}, tier) * SOIL_ALPHA + back * (255 - SOIL_ALPHA)) / 255) for i, back in enumerate(parts(background))
    ]
    return F.when(tier.isNull(), background).otherwise(argb(*mixed))


def hue_rgb(hue: Column, saturation: float, value: float) -> list[Column]:
    """Red, green, blue of a hue in [0, 1)."""
    h = (hue - F.floor(hue)) * 6
    f = h - F.floor(h)
    v, p = F.lit(value), F.lit(value * (1 - saturation))
    q, t = value * (1 - saturation * f), value * (1 - saturation * (1 - f))
    sector = F.floor(h)
    pick = lambda *by: F.coalesce(*[F.when(sector == i, c) for i, c in enumerate(by)])
    to = lambda c: F.floor(c * 255 + 0.5)
    return [to(pick(v, q, p, p, t, v)), to(pick(t, v, v, q, p, p)), to(pick(p, p, t, v, v, q))]


def rock_argb(state: Column, code: Column, x: Column, z: Column, highlight: str | None = None) -> Column:
    """Known rock colours, a hashed hue for others; with a highlight the other
    rocks are dimmed to a quarter; a checker where data is missing."""
    # the low 32 bits of FNV-1a over the characters
    letters = F.filter(F.split(code, ""), lambda c: c != "")
    hash_ = F.aggregate(letters, F.lit(0x84222325).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 435).bitwiseAND(F.lit(0xFFFFFFFF)))
    hue = hash_ / 4294967296.0
    known = F.coalesce(argb(*parts(_table(ROCK, code))), argb(*hue_rgb(hue, 0.62, 0.78)))
    if highlight is not None:
        known = F.when(code == highlight, known).otherwise(argb(*[F.floor(c / 4) for c in parts(known)]))
    fixed = lambda c: F.lit(c - 0x1000000)
    return F.when(state == "OBSERVED", known).when(state == "NO_ROCK", fixed(NO_ROCK)).otherwise(F.when((x + z) % 2 == 0, fixed(UNAVAILABLE_LIGHT)).otherwise(fixed(UNAVAILABLE_DARK)))


def environment_argb(labels: Column, density: Column, temperature: Column, rain: Column) -> Column:
    """Mean of the label colours, or a tint by forest and climate without labels."""
    has = lambda k: F.array_contains(labels, k).cast("int")
    count = 1 + sum((has(k) for k in ENVIRONMENT), F.lit(0))
    mean = [F.floor((ENVIRONMENT_BASE[i] + sum((has(k) * v[i] for k, v in ENVIRONMENT.items()), F.lit(0))) / count) for i in range(3)]
    r, g, b = (F.lit(c) for c in ENVIRONMENT_BASE)
    r = F.when(density.isNotNull(), F.floor(150 - density * 65 + 0.5)).otherwise(r)
    g = F.when(density.isNotNull(), F.floor(125 + density * 90 + 0.5)).otherwise(g)
    b = F.when(density.isNotNull(), 105).otherwise(b)
    warm, wet = temperature / 255.0, rain / 255.0
    tint = lambda base, add: F.when(temperature.isNotNull(), clamp(F.floor(base + add + 0.5), 0, 255)).otherwise(base)
    return F.when(F.size(labels) > 0, argb(*mean)).otherwise(argb(tint(r, warm * 55), tint(g, wet * 45), tint(b, (1.0 - warm) * 40)))


def province_argb(raw: Column) -> Column:
    """A hue by the golden ratio of an unsigned id."""
    unsigned = F.when(raw < 0, raw.cast("long") + 4294967296).otherwise(raw.cast("long"))
    hue = unsigned * F.lit(0.6180339887498949)
    return argb(*hue_rgb(hue - F.floor(hue), 0.55, 0.95))
