"""Colour functions as Column expressions: they stay in the JVM and in code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# OKLab and CIELAB (D65) matrices.
RGB_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _inverse(m: Sequence[Sequence[float]]) -> tuple[tuple[float, ...], ...]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(x / det for x in r) for r in rows)


LAB_TO_LMS, LMS_TO_RGB = _inverse(LMS_TO_LAB), _inverse(RGB_TO_LMS)


def _dot(row: Sequence[float], v: Sequence[Column]) -> Column:
    return F.lit(row[0]) * v[0] + F.lit(row[1]) * v[1] + F.lit(row[2]) * v[2]


def linear(channel: Column) -> Column:
    """A channel of 0 to 255 as linear light of 0 to 1."""
    c = channel.cast("double") / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rgb = [linear(c) for c in (r, g, b)]
    lms = [F.cbrt(_dot(m, rgb)) for m in RGB_TO_LMS]
    return tuple(_dot(m, lms) for m in LMS_TO_LAB)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def oklab_to_rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Channels of 0 to 255, not rounded, clipped to the gamut."""
    lms = [F.pow(_dot(m, (lightness, a, b)), F.lit(3.0)) for m in LAB_TO_LMS]
    out = []
    for m in LMS_TO_RGB:
        x = clip(_dot(m, lms), 0.0, 1.0)
        c = F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)
        out.append(clip(c * 255.0, 0.0, 255.0))
    return tuple(out)


def cielab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rgb = [linear(c) for c in (r, g, b)]
    eps, kappa = 216 / 24389, 24389 / 27
    f = []
    for m, w in zip(RGB_TO_XYZ, WHITE):
        x = _dot(m, rgb) / w
        f.append(F.when(x > eps, F.cbrt(x)).otherwise((kappa * x + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB; halves round to even, values beyond a byte stop at it."""
    return F.format_string("#%02X%02X%02X", *[clip(F.rint(c.cast("double")), 0.0, 255.0).cast("int") for c in (r, g, b)])


def from_hex(code: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(code, i, 2), 16, 10).cast("int") for i in (2, 4, 6))


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def hue(a: Column, b: Column) -> Column:
    """Degrees from 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def hue_gap(x: Column, y: Column) -> Column:
    d = F.pmod(F.abs(x - y), F.lit(360.0))
    return F.least(d, 360.0 - d)


def distance(p: Sequence[Column], q: Sequence[Column]) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(p, q)))


def ramp(x: Column, lo: float, hi: float) -> Column:
    """A smooth step from 0 at ``lo`` to 1 at ``hi``."""
    t = clip((x.cast("double") - lo) / (hi - lo), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def saturation(r: Column, g: Column, b: Column, lightness: Column) -> Column:
    """Purity as in HSV, faded out near black."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(hi > 0, (hi - lo) / hi).otherwise(0.0) * ramp(lightness, 0.12, 0.30)


def neutral_parts(lightness: Column, c: Column, h: Column) -> dict[str, Column]:
    """How grey, dark, light and brown a colour is, each 0 to 1."""
    grey = 1 - ramp(c, 0.025, 0.06)
    warm = F.when(h.between(30.0, 100.0), 1.0).otherwise(0.0)
    return {"grey": grey, "dark": 1 - ramp(lightness, 0.20, 0.34), "light": ramp(lightness, 0.88, 0.96), "brown": warm * (1 - ramp(c, 0.05, 0.10)) * (1 - grey)}


def same_hue(c1: Column, h1: Column, c2: Column, h2: Column) -> Column:
    """1 for two colours of one hue family, fading to 0; 0 if either has little chroma."""
    return F.when(F.least(c1, c2) < 0.05, 0.0).otherwise(1 - ramp(hue_gap(h1, h2), 15.0, 45.0))


def readable_text(code: Column) -> Column:
    """A text colour for a background, by relative luminance."""
    def light(c: Column) -> Column:
        x = c.cast("double") / 255.0
        return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = from_hex(code)
    luminance = 0.2126 * light(r) + 0.7152 * light(g) + 0.0722 * light(b)
    return F.when(luminance > 0.4, "#111111").otherwise("#FFFFFF")
