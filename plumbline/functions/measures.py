"""Small measures of pages, pictures and units: Column in, Column out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named papers in points, portrait; resolutions by quality; bounds of columns, pictures and sheets.
PAPERS = {"a4": (595.28, 841.89), "letter": (612.0, 792.0), "legal": (612.0, 1008.0), "a3": (841.89, 1190.55), "a5": (419.53, 595.28)}
QUALITY_DPI = {"screen": 96, "good": 150, "print": 300}
RESIZE = {"web": 1920, "social": 1080, "thumb": 300}
ENCODABLE = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}
NARROWEST, WIDEST, USUAL, PIXEL = 8.0, 400.0, 48.0, 0.75
SHEET_PIXELS, LEAST_DPI, DPI_STEP = 16_777_216, 72, 25
SHORT_EDGE, LONGEST_EDGE, ANY_EDGE = 512, 1024, 320


def half_up(x: Column) -> Column:
    """Rounded, halves towards plus infinity."""
    return F.floor(x + 0.5)


def twips(points: Column) -> Column:
    return half_up(points * 20).cast("long")


def emu(points: Column) -> Column:
    return half_up(points * 12700).cast("long")


def points_of_twips(n: Column) -> Column:
    return n / 20.0


def points_of_emu(n: Column) -> Column:
    return n / 12700.0


def border_eighths(points: Column) -> Column:
    return F.least(F.lit(96), F.greatest(F.lit(2), half_up(points * 8))).cast("int")


def pixels_per_mm(dpi: Column) -> Column:
    return dpi / 25.4


def midpoint(low: Column, high: Column) -> Column:
    """Between two bounds; null if either is missing."""
    return (low + high) / 2


def line_tolerance(body: Column) -> Column:
    return F.greatest(F.lit(1.2), 0.3 * body)


def least_gutter(body: Column) -> Column:
    return F.greatest(F.lit(4.0), 0.7 * body)


def rule_gap(body: Column) -> Column:
    return F.greatest(F.lit(4.0), 0.5 * body)


def crossing_budget(runs: Column) -> Column:
    return F.ceil(0.06 * runs).cast("long")


def page_size(paper: Column, orientation: Column) -> Column:
    """width and height in points; an unknown paper is A4."""
    wide, high = (F.coalesce(*[F.when(paper == name, size[k]) for name, size in PAPERS.items()], F.lit(PAPERS["a4"][k])) for k in (0, 1))
    turned = orientation == "landscape"
    return F.struct(F.when(turned, high).otherwise(wide).alias("width"), F.when(turned, wide).otherwise(high).alias("height"))


def nearest_paper(width: Column, height: Column) -> Column:
    """The named paper whose sides differ least, turned or not; the first if two are as near."""
    short, long = F.least(width, height), F.greatest(width, height)
    ranked = [F.struct((F.abs(F.lit(w) - short) + F.abs(F.lit(h) - long)).alias("gap"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, (w, h)) in enumerate(PAPERS.items())]
    return F.array_min(F.array(*ranked))["name"]


def raster_pixels(width: Column, height: Column, quality: Column) -> Column:
    scale = F.coalesce(*[F.when(quality == name, dpi / 96) for name, dpi in QUALITY_DPI.items()])
    return (half_up(width * scale) * half_up(height * scale)).cast("long")


def column_points(pixels: Column, characters: Column, hidden: Column) -> Column:
    """A column's width: by pixels, else by characters, else the usual one; hidden columns have none."""
    own = F.when(pixels > 0, pixels * PIXEL).when(characters > 0, (characters * 7 + 5) * PIXEL).otherwise(USUAL)
    return F.when(hidden, 0.0).otherwise(F.least(F.lit(WIDEST), F.greatest(F.lit(NARROWEST), own)))


def auto_orientation(total: Column, paper: Column, margin: Column) -> Column:
    """landscape if the columns together are wider than the upright page between its margins."""
    return F.when(total > page_size(paper, F.lit("portrait"))["width"] - 2 * margin, "landscape").otherwise("portrait")


def width_bands(widths: Column, available: float, slack: float = 0.5) -> Column:
    """The band of each column of an array of widths, packed from the left; a column wider than a band fills one."""
    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("band"), F.expr("cast(array() as array<int>)").alias("bands"))

    def put(state: Column, width: Column) -> Column:
        own = F.least(width.cast("double"), F.lit(float(available)))
        over = (F.size(state["bands"]) > 0) & (state["used"] + own > available + slack)
        band = F.when(over, state["band"] + 1).otherwise(state["band"])
        return F.struct(F.when(over, own).otherwise(state["used"] + own).alias("used"), band.alias("band"), F.array_append(state["bands"], band).alias("bands"))

    return F.aggregate(widths, start, put, lambda s: s["bands"])


def longest_edge(width: Column, height: Column, preset: Column, fit_width: Column, fit_height: Column) -> Column:
    """The longest edge that a preset or a custom box allows; null leaves the size alone."""
    longest = F.greatest(width, height)
    scale = F.least(F.lit(1.0), F.when(fit_width > 0, fit_width / width), F.when(fit_height > 0, fit_height / height))
    custom = F.when(scale < 1, F.greatest(F.lit(1), half_up(longest * scale)))
    most = F.coalesce(*[F.when(preset == name, most) for name, most in RESIZE.items()])
    return F.when(longest > 0, F.when(preset == "custom", custom).when(longest > most, most)).cast("long")


def pixel_input(text: Column) -> Column:
    """A positive number of pixels typed by someone, rounded, 20,000 at most; null otherwise."""
    n = F.trim(text).try_cast("double")
    return F.when((n > 0) & (n < float("inf")), F.least(half_up(n), F.lit(20000))).cast("int")


def output_type(source: Column, asked: Column) -> Column:
    return F.when(asked != "original", asked).when(source.isin(*ENCODABLE), source).otherwise("image/png")


def output_extension(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, e) for k, e in ENCODABLE.items()], F.lit("img"))


def sheet_plan(sheet_width: Column, sheet_height: Column, width: Column, height: Column, gap: Column, margin: Column) -> Column:
    """columns, rows, copies of a photo on a sheet, upright or turned, whichever holds more."""
    from plumbline.functions.numbers import count_across

    def grid(w: Column, h: Column) -> Column:
        across, down = count_across(w - 2 * margin, width, gap), count_across(h - 2 * margin, height, gap)
        return F.struct(across.alias("columns"), down.alias("rows"), (across * down).alias("copies"))

    upright, turned = grid(sheet_width, sheet_height), grid(sheet_height, sheet_width)
    return F.when(turned["copies"] > upright["copies"], turned).otherwise(upright)


def working_size(width: Column, height: Column) -> Column:
    """width and height of a picture for a model: short edge 512, long edge 1,024 at most, both multiples of 32."""
    scale = SHORT_EDGE / F.least(width, height)
    w, h = half_up(width * scale), half_up(height * scale)
    longest = F.greatest(w, h)
    shrink = F.when(longest > LONGEST_EDGE, F.lit(float(LONGEST_EDGE)) / longest).otherwise(1.0)
    floored = lambda x: F.greatest(F.lit(32), F.floor(half_up(x * shrink) / 32) * 32).cast("int")
    return F.struct(floored(w).alias("width"), floored(h).alias("height"))


def eye_line(right: Column, left: Column) -> Column:
    """x and y between two points (x, y), and the tilt of the line through them in degrees."""
    return F.struct(
        ((right["x"] + left["x"]) / 2).alias("x"), ((right["y"] + left["y"]) / 2).alias("y"), F.degrees(F.atan2(left["y"] - right["y"], left["x"] - right["x"])).alias("tilt"),
    )


def turned_share(right: Column, left: Column, nose: Column) -> Column:
    """How far the nose lies from the middle between the eyes, as a share of their distance."""
    span = F.hypot(left["x"] - right["x"], left["y"] - right["y"])
    return F.when(span > 0, F.abs(nose["x"] - (right["x"] + left["x"]) / 2) / span).otherwise(0.0)


def hex_colour(text: Column) -> Column:
    """r, g, b (0 to 255) of #abc or #aabbcc; null for anything else."""
    bare = F.regexp_replace(F.trim(text), "^#", "")
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    part = lambda k: F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("int")
    return F.when(full.rlike("^[0-9a-fA-F]{6}$"), F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b")))


def hex_share(text: Column) -> Column:
    """r, g, b from 0 to 1; what is no colour is black."""
    rgb = hex_colour(text)
    return F.struct(*[F.coalesce(rgb[c] / 255.0, F.lit(0.0)).alias(c) for c in "rgb"])


def swatch_distance(r: Column, g: Column, b: Column, swatches: Sequence[str]) -> Column:
    """The distance of a colour from the nearest of the swatches."""

    def away(h: str) -> Column:
        rgb = hex_colour(F.lit(h))
        return F.sqrt(F.pow(r - rgb["r"], 2) + F.pow(g - rgb["g"], 2) + F.pow(b - rgb["b"], 2))

    return F.array_min(F.array(*[away(h) for h in swatches]))


def fitting_dpi(dpi: Column, width: Column, height: Column) -> Column:
    """The greatest resolution at which a sheet in mm keeps below the pixel bound: whole steps down to the least one, then single ones."""
    area = lambda d: half_up(width * pixels_per_mm(d)) * half_up(height * pixels_per_mm(d))
    asked = area(dpi)
    first = F.when(asked > SHEET_PIXELS, F.floor(dpi * F.sqrt(SHEET_PIXELS / asked) / DPI_STEP) * DPI_STEP).otherwise(dpi)
    start = F.greatest(F.lit(LEAST_DPI), first).cast("int")

    def lower(d: Column, _: Column) -> Column:
        return F.when((d > 1) & (area(d) > SHEET_PIXELS), F.when(d > LEAST_DPI, d - DPI_STEP).otherwise(d - 1)).otherwise(d)

    return F.greatest(F.lit(1), F.aggregate(F.sequence(F.lit(1), F.lit(LEAST_DPI + 4)), start, lower))
