"""Colors as #rrggbb, and what a theme derives from its background and accent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import with_value

#: The parts of red, green and blue in a color's luminance.
LUMINANCE = (0.2126, 0.7152, 0.0722)


def is_hex(color: Column) -> Column:
    return F.coalesce(color.rlike("^#[0-9a-fA-F]{6}$"), F.lit(False))


def channels(color: Column) -> Column:
    """array(red, green, blue), 0 to 255; null for what is no color."""
    return F.when(is_hex(color), F.transform(F.array(F.lit(2), F.lit(4), F.lit(6)), lambda at: F.conv(F.substr(color, at, F.lit(2)), 16, 10).cast("double")))


def hexed(rgb: Column) -> Column:
    """The color of three channels, rounded and cut to 0 to 255."""
    two = lambda v: F.lower(F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v + 0.5))).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), F.array_join(F.transform(rgb, two), ""))


def _each(color: Column, f: Callable[[Column], Column]) -> Column:
    return hexed(F.transform(channels(color), f))


def shifted(color: Column, by: Column) -> Column:
    """Towards white, or black if by is negative."""
    return with_value(by, lambda n: _each(color, lambda v: v + n))


def darkened(color: Column, share: float) -> Column:
    return _each(color, lambda v: v * (1 - share))


def blend(a: Column, b: Column, ratio: float) -> Column:
    """A mixture with a share of ratio of a."""
    return hexed(F.zip_with(channels(a), channels(b), lambda x, y: x * ratio + y * (1 - ratio)))


def luminance(color: Column) -> Column:
    """Relative luminance, 0 to 1."""
    linear = F.transform(channels(color), lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))))
    parts = F.zip_with(linear, F.array(*map(F.lit, LUMINANCE)), lambda v, w: v * w)
    return F.when(is_hex(color), F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))


def theme(background: Column, accent: Column, light: Column) -> dict[str, Column]:
    """The colors that a theme derives from its background and accent."""
    by = F.when(light, -10).otherwise(10)
    surface = shifted(background, by)
    text = F.when(light, darkened(background, 0.88)).otherwise(shifted(background, F.lit(180)))
    return {
        "surface": surface,
        "hover": shifted(background, by * 2),
        "border": with_value(surface, lambda s: blend(background, s, 0.4)),
        "text": text,
        "muted": with_value(text, lambda t: blend(t, background, 0.5)),
        "accent_dim": darkened(accent, 0.25),
        "scrim": F.when(luminance(background) > 0.3, "rgba(0,0,0,0.55)").otherwise("rgba(0,0,0,0.72)"),
    }
