"""Colour expressions over integer channel columns, angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_hsv(pixels: DataFrame) -> DataFrame:
    """Pixels (r, g, b) with real-valued hue (0-360), saturation and value (0-1).

    Built in steps, so that generated code computes each part once.
    """
    shares = pixels.withColumns({
        f"_{c}": F.col(c).cast("double") / 255.0 for c in ("r", "g", "b")})
    r, g, b = F.col("_r"), F.col("_g"), F.col("_b")
    ranged = shares.withColumns({"value": F.greatest(r, g, b), "_low": F.least(r, g, b)})
    ranged = ranged.withColumn("_spread", F.col("value") - F.col("_low"))
    high, spread = F.col("value"), F.col("_spread")
    sector = (
        F.when(spread == 0, 0.0)
        .when(high == r, F.pmod((g - b) / spread, F.lit(6.0)))
        .when(high == g, (b - r) / spread + 2.0)
        .otherwise((r - g) / spread + 4.0)
    )
    coloured = ranged.withColumn("_sector", sector)
    return coloured.withColumns({
        "hue": F.pmod(F.col("_sector") * 60.0, F.lit(360.0)),
        "saturation": F.when(high == 0, 0.0).otherwise(spread / high),
    }).drop("_r", "_g", "_b", "_low", "_spread", "_sector")


def linear_channel(channel: Column) -> Column:
    share = channel.cast("double") / 255.0
    return F.when(share <= 0.04045, share / 12.92).otherwise(
        F.pow((share + 0.055) / 1.055, F.lit(2.4))
    )


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return (
        linear_channel(red) * 0.2126
        + linear_channel(green) * 0.7152
        + linear_channel(blue) * 0.0722
    )


def lightness(mean_luminance: Column) -> Column:
    """Perceptual lightness of a mean luminance, scaled and clamped to 0-1."""
    scaled = F.when(mean_luminance <= 0.008856, mean_luminance * 903.3).otherwise(
        F.pow(mean_luminance, F.lit(1.0 / 3.0)) * 116.0 - 16.0
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled / 100.0))


def angle_distance(left: Column, right: Column) -> Column:
    """Shortest distance between two angles."""
    return F.abs(F.pmod(left - right + 180.0, F.lit(360.0)) - 180.0)


def mean_angle(sin_sum: Column, cos_sum: Column) -> Column:
    """The direction of summed sines and cosines, in 0-360.

    The full turn is always added: the last bits of the sums, which depend on
    the order of the pixels, then drop out of small angles too.
    """
    return (F.degrees(F.atan2(sin_sum, cos_sum)) + 360.0) % 360.0


def circular_mean(degrees: Column) -> Column:
    """Aggregate expression: the mean of angles."""
    return mean_angle(
        F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    )
