"""Colours of CSS declarations, sorted into named buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = r"(?i)rgba?\(\s*([\d.]+)[\s,]+([\d.]+)[\s,]+([\d.]+)"
# Upper ends of the hue ranges in degrees, and lower ends of the grey ladder.
HUES = ((15, "red"), (45, "orange"), (70, "yellow"), (160, "green"), (195, "teal"), (255, "blue"), (290, "purple"), (335, "pink"))
GREYS = ((0.94, "white"), (0.78, "light"), (0.35, "grey"), (0.14, "dark"))


def channels(css: Column) -> Column:
    """array(r, g, b) in 0..1 of rgb(), rgba(), #rgb or #rrggbb; null otherwise."""
    digits = F.lower(F.regexp_extract(F.trim(css), r"(?i)^#([0-9a-f]{3}|[0-9a-f]{6})$", 1))
    full = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    hexed = F.array(*[F.conv(F.substring(full, i, 2), 16, 10).cast("double") / 255 for i in (1, 3, 5)])
    spelled = F.array(*[F.regexp_extract(css, RGB, i).try_cast("double") / 255 for i in (1, 2, 3)])
    return F.when(css.rlike(RGB), spelled).when(F.length(digits) > 0, hexed)


def named(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once: a lambda variable stands for it, so the expression stays small."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def bucket(css: Column) -> Column:
    """Bucket of a colour: a grey ladder by lightness where there is little chroma, else by hue."""

    def spread(rgb: Column) -> Column:
        r, g, b = (F.get(rgb, i) for i in range(3))
        known = rgb.isNotNull() & ~F.coalesce(F.exists(rgb, lambda x: x.isNull()), F.lit(False))
        fields = {"r": r, "g": g, "b": b, "top": F.greatest(r, g, b), "low": F.least(r, g, b)}
        return F.when(known, F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)]))

    def facts(c: Column) -> Column:
        light, chroma = (c["top"] + c["low"]) / 2, c["top"] - c["low"]
        saturation = F.when(chroma == 0, F.lit(0.0)).otherwise(F.try_divide(chroma, 1 - F.abs(2 * light - 1)))
        part = lambda x, y: F.try_divide(x - y, chroma)
        sixth = F.when(c["top"] == c["r"], part(c["g"], c["b"]) % 6).when(c["top"] == c["g"], part(c["b"], c["r"]) + 2).otherwise(part(c["r"], c["g"]) + 4)
        fields = {"light": light, "grey": (saturation < 0.15) | (chroma < 0.06), "hue": (sixth * 60 + 360) % 360}
        return F.when(c.isNotNull(), F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)]))

    def name(f: Column) -> Column:
        grey = F.coalesce(*[F.when(f["light"] > at, F.lit(n)) for at, n in GREYS], F.lit("black"))
        tint = F.coalesce(*[F.when(f["hue"] < at, F.lit(n)) for at, n in HUES], F.lit("red"))
        return F.when(f["grey"], grey).when(f.isNotNull(), tint)

    return named(channels(css), lambda rgb: named(spread(rgb), lambda c: named(facts(c), name)))
