"""Reaction recipes for a liquid handler: volumes, wells, times and materials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def well(no: Column) -> Column:
    """Name of the 0-based well, down the columns of a 96-well plate: A1, B1 ... H1, A2 ..."""
    return F.concat(F.substr(F.lit("ABCDEFGH"), (no % 8 + 1).cast("int"), F.lit(1)), (F.floor(no / 8) + 1).cast("string"))


def tenth(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def pcr_recipe(n: Column, product_bp: Column, volume: float = 25.0, parts: tuple[float, ...] = (12.5, 1.25, 1.25, 1.0)) -> dict[str, Column]:
    """Reactions (1 to 96), water, extension time, master mix with a tenth more, template with three twentieths, and tip racks."""
    count = F.greatest(F.lit(1), F.least(F.lit(96), n)).cast("long")
    total = sum(parts)
    return {
        "reactions": count,
        "water_ul": tenth(F.lit(volume - total)),
        "extension_s": F.greatest(F.lit(15), F.ceil(product_bp / 1000.0 * 30)).cast("long"),
        "mix_ul": tenth(count * parts[0] * 1.1),
        "template_ul": tenth(count * parts[3] * 1.15),
        "tip_racks": F.ceil(count * (len(parts) + 1) / 96.0).cast("long"),
        "last_well": well(count - 1),
        "error_code": F.when(F.lit(total > volume), "VOLUME_EXCEEDED"),
    }
