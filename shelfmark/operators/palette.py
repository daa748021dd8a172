"""Colour of pictures from pixel tables, and the layout of a timeline strip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.colour import (
    angle_distance, lightness, luminance, mean_angle, with_hsv,
)
from shelfmark.operators.ranking import rank_within

MIN_SATURATION = 0.15
MIN_VALUE = 0.15
BINS = 36

# Fixed values: (hue, colour, muted colour, name) in order of preference.
ANCHORS = [
    (6, "#c35d52", "#9e716c", "terracotta"),
    (18, "#b66745", "#987464", "burnt orange"),
    (28, "#a57142", "#917761", "amber"),
    (40, "#937842", "#887b5f", "ochre"),
    (90, "#68854a", "#718162", "moss"),
    (200, "#51829b", "#67808c", "teal"),
    (212, "#517fb3", "#697e96", "blue"),
    (224, "#627abc", "#717c99", "indigo"),
]
NEUTRAL, NEUTRAL_MUTED = "#9a9086", "#8d8781"

# Sizes of the strip in pixels.
MARK_WIDTH, UNDATED_MARK_WIDTH, SEGMENT_GAP = 3.0, 1.6, 40.0
MIN_MARK, MAX_MARK, ASSUMED_LIGHTNESS = 5.0, 72.0, 0.5


def _parts(pixels: DataFrame, key: str) -> DataFrame:
    """(key, _bin, _under, _over, _n, _sin, _cos, _light): pixels summed per hue bin.

    ``_bin`` is NULL for pixels without a usable hue; ``_under`` and ``_over``
    tell whether a pixel lies within one width of the centre of the bin before
    and after its own, by the distance itself, since rounding decides on the
    boundary. A picture has at most 4 x BINS + 1 rows, combined map-side, so one
    with very many pixels shuffles no more.
    """
    width = 360.0 / BINS
    h = F.col("hue")
    carries = (F.col("saturation") >= MIN_SATURATION) & (F.col("value") >= MIN_VALUE)
    coloured = with_hsv(pixels.select(key, "r", "g", "b")).select(
        key, F.when(carries, h).alias("hue"),
        luminance(F.col("r"), F.col("g"), F.col("b")).alias("_y"),
    ).withColumns({"_bin": F.floor(h / width).cast("int"), "_a": F.radians(h)})

    def within(step: int) -> Column:
        centre = (F.pmod(F.col("_bin") + step, F.lit(BINS)) + 0.5) * width
        return angle_distance(h, centre) <= width

    coloured = coloured.withColumns({"_under": within(-1), "_over": within(1)})
    return coloured.groupBy(key, "_bin", "_under", "_over").agg(
        F.count("*").alias("_n"), F.sum(F.sin("_a")).alias("_sin"),
        F.sum(F.cos("_a")).alias("_cos"), F.sum("_y").alias("_light"))


def palette(pixels: DataFrame, key: str = "id") -> DataFrame:
    """(key, hue, lightness) per picture from pixels (key, r, g, b), in one scan.

    The hue is the circular mean around the fullest of BINS bins, over one bin
    width on both sides of its centre; NULL when every pixel is near grey or
    black. Lightness is that of the mean luminance.
    """
    bin_ = F.col("_bin")
    # At most 4 x BINS + 1 rows per picture, so these windows are small.
    parts = _parts(pixels, key)
    full = F.sum("_n").over(Window.partitionBy(key, "_bin"))
    parts = parts.withColumn(
        "_rank", F.when(bin_.isNotNull(), full * BINS + (BINS - 1 - bin_)))
    best = F.max("_rank").over(Window.partitionBy(key))
    parts = parts.withColumn("_peak", BINS - 1 - F.pmod(best, F.lit(BINS)))
    ahead = F.pmod(bin_ - F.col("_peak"), F.lit(BINS))
    near = (
        (ahead == 0) | ((ahead == 1) & F.col("_under"))
        | ((ahead == BINS - 1) & F.col("_over"))
    )
    return parts.groupBy(key).agg(
        mean_angle(F.sum(F.when(near, F.col("_sin"))), F.sum(F.when(near, F.col("_cos"))))
        .alias("hue"),
        lightness(F.sum("_light") / F.sum("_n")).alias("lightness"),
    )


def dominant_hue(pixels: DataFrame, key: str = "id") -> DataFrame:
    """(key, hue) per picture; see ``palette``."""
    return palette(pixels, key).select(key, "hue")


def mean_lightness(pixels: DataFrame, key: str = "id") -> DataFrame:
    """(key, lightness): perceptual lightness of the mean luminance."""
    light = luminance(F.col("r"), F.col("g"), F.col("b"))
    return pixels.groupBy(key).agg(lightness(F.avg(light)).alias("lightness"))


def nearest_anchor(hue: Column) -> Column:
    """Struct (anchor, color, muted) of the closest anchor; the first wins ties.

    The handful of anchors is an expression, not a join.
    """
    choices = [
        F.struct(
            angle_distance(hue, F.lit(float(at))).alias("distance"), F.lit(i).alias("place"),
            F.lit(name).alias("anchor"), F.lit(color).alias("color"),
            F.lit(muted).alias("muted"),
        )
        for i, (at, color, muted, name) in enumerate(ANCHORS)
    ]
    best = F.array_min(F.array(*choices))
    absent = hue.isNull() | F.isnan(hue)
    return F.struct(
        F.when(~absent, best["anchor"]).alias("anchor"),
        F.when(absent, NEUTRAL).otherwise(best["color"]).alias("color"),
        F.when(absent, NEUTRAL_MUTED).otherwise(best["muted"]).alias("muted"),
    )


def palette_marks(thumbnails: DataFrame, colours: DataFrame, items: DataFrame) -> DataFrame:
    """One mark per thumbnail row: (pos, sha256, hue, lightness, captured).

    Thumbnails lead, so a picture without a colour row keeps its place. The
    last colour row and the first library row of a hash count.
    """
    colour = colours.groupBy("sha256").agg(
        F.max_by(F.struct("hue", "lightness"), "row_no").alias("_c"))
    first = items.groupBy("sha256").agg(F.min_by("captured", "pos").alias("captured"))
    return (
        thumbnails.select("pos", "sha256")
        .join(colour, "sha256", "left").join(first, "sha256", "left")
        .select("pos", "sha256", F.col("_c.hue").alias("hue"),
                F.col("_c.lightness").alias("lightness"), "captured")
    )


def palette_totals(marks: DataFrame) -> DataFrame:
    return marks.agg(
        F.count("*").alias("total"), F.count_if(F.col("captured").isNull()).alias("undated"),
        F.count_if(F.col("hue").isNull()).alias("achromatic"))


def timeline(marks: DataFrame, width: float, highlight: DataFrame | None = None) -> DataFrame:
    """Place marks (pos, sha256, hue, lightness, captured) on a strip.

    Dated marks lie at their share of the time span; undated ones evenly in a
    segment sized by their number, in catalog order. ``highlight`` is
    (sha256) of a result set; without one every mark is lit.
    """
    at = F.unix_millis(F.col("captured").cast("timestamp"))
    dated = F.col("captured").isNotNull()
    # One aggregate row, read into literals.
    totals = marks.agg(
        F.count("*").alias("n"), F.count_if(~dated).alias("undated"),
        F.min(at).alias("first"), F.max(at).alias("last"),
    ).first()
    usable = max(0.0, width - SEGMENT_GAP - MARK_WIDTH)
    undated_width = usable * (totals["undated"] / totals["n"] if totals["n"] else 0.0)
    dated_width = usable - undated_width
    undated_left = dated_width + SEGMENT_GAP
    first = totals["first"] or 0
    span = max(1, (totals["last"] if totals["last"] is not None else 1) - first)
    step = undated_width / (totals["undated"] - 1) if totals["undated"] > 1 else 0.0

    height = F.coalesce("lightness", F.lit(ASSUMED_LIGHTNESS)) * (MAX_MARK - MIN_MARK) + MIN_MARK
    colour = nearest_anchor(F.col("hue"))
    placed = marks.filter(dated).withColumns({
        "x": (at - F.lit(first)) / F.lit(float(span)) * F.lit(dated_width),
        "width": F.lit(MARK_WIDTH), "height": height, "color": colour["color"],
    })
    loose = rank_within(marks.filter(~dated), [], [F.col("pos")], "_i").withColumns({
        "x": F.lit(undated_left) + (F.col("_i") - 1) * F.lit(step),
        "width": F.lit(UNDATED_MARK_WIDTH), "height": height, "color": colour["muted"],
    }).drop("_i")
    strip = placed.unionByName(loose).select(
        "pos", "sha256", "captured", "x", "width", "height", "color")
    if highlight is None:
        return strip.withColumn("lit", F.lit(True))
    shown = highlight.select("sha256").distinct().withColumn("lit", F.lit(True))
    return strip.join(shown, "sha256", "left").withColumn(
        "lit", F.coalesce("lit", F.lit(False)))
