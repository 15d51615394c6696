"""Point colours as columns. Results are cast to float at the very end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A colour for each level, over and over.
PALETTE = (
    (0.18, 0.95, 0.70), (0.29, 0.67, 1.0), (0.69, 0.43, 1.0), (1.0, 0.46, 0.62),
    (1.0, 0.76, 0.30), (0.83, 0.92, 0.42), (0.25, 0.90, 0.95), (0.95, 0.25, 0.22),
)
#: Height share, then red, green and blue there.
RAMP = (
    (0.00, 0.05, 0.22, 0.28), (0.28, 0.10, 0.55, 0.47), (0.56, 0.45, 0.83, 0.42),
    (0.78, 0.98, 0.73, 0.24), (1.00, 1.00, 0.35, 0.30),
)
EPSILON = 2.0**-52


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def srgb_to_linear(c: Column) -> Column:
    v = _clamped(c)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def fog(c: Column, fog_color: float, density: float, distance: Column) -> Column:
    """Exponential-squared fog: a colour fades to the fog's with distance."""
    seen = F.exp(-F.pow(distance * density, F.lit(2.0)))
    return c * seen + F.lit(fog_color) * (1 - seen)


def elevation(share: Column) -> list[Column]:
    """Red, green and blue of a height share, linear between the stops of RAMP."""
    t = _clamped(share)
    out = []
    for channel in (1, 2, 3):
        c = F.lit(RAMP[-1][channel])
        for left, right in reversed(list(zip(RAMP[:-1], RAMP[1:], strict=True))):
            part = F.lit(left[channel]) + F.lit(right[channel] - left[channel]) * ((t - left[0]) / F.lit(right[0] - left[0]))
            c = F.when(t <= right[0], part).otherwise(c)
        out.append(F.when(t <= RAMP[0][0], F.lit(RAMP[0][channel])).otherwise(c))
    return out


def level_color(level: Column) -> list[Column]:
    return [F.element_at(F.array(*[F.lit(p[k]) for p in PALETTE]), (level % len(PALETTE) + 1).cast("int")) for k in range(3)]


def point_color(mode: str, z_min: float, z_span: float) -> list[Column]:
    """cr, cg, cb from columns red, green, blue (null counts as 0), z and resolution.

    mode: rgb (points without colour fall through to elevation), resolution, or elevation. z_min, z_span: in the integers of z.
    """
    if mode == "resolution":
        out = level_color(F.col("resolution"))
    else:
        out = elevation((F.col("z") - F.lit(float(z_min))) / F.lit(max(float(z_span), EPSILON)))
        if mode == "rgb":
            rgb = [F.coalesce(F.col(c), F.lit(0)) for c in ("red", "green", "blue")]
            lit = (rgb[0] != 0) | (rgb[1] != 0) | (rgb[2] != 0)
            out = [F.when(lit, srgb_to_linear(c / F.lit(65535.0))).otherwise(e) for c, e in zip(rgb, out, strict=True)]
        elif mode != "elevation":
            raise ValueError("mode must be rgb, resolution or elevation")
    return [c.cast("float").alias(n) for c, n in zip(out, ("cr", "cg", "cb"), strict=True)]
