"""Scalar rules of reconciliation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AREA_TOLERANCE = 0.005
ROUNDING_SLACK = 1e-9


def fixed(x: Column, places: int = 2) -> Column:
    """Text with `places` decimals and a decimal point; null stays null."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def signed(x: Column) -> Column:
    """Two decimals with a sign, also for zero and above."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), fixed(x))


def comma(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit(","))


def whole_tenth(x: Column) -> Column:
    return F.abs(x * 10 - F.rint(x * 10)) < 1e-6


def precision_unit(a: Column, b: Column) -> Column:
    """The step both values were recorded to."""
    return F.when(whole_tenth(a) & whole_tenth(b), F.lit(0.1)).otherwise(F.lit(0.01))


def equal_within(a: Column, b: Column, relative: float) -> Column:
    """Equal, or different by at most the share `relative` of a, or by one recording step."""
    gap = F.abs(b - a)
    return (gap <= AREA_TOLERANCE) | ((a != 0) & (gap <= relative * F.abs(a))) | (gap <= precision_unit(a, b) + ROUNDING_SLACK)


def neighbour(number: Column, step: int) -> Column:
    """The number before or after, of the same prefix and at least the same width; null without trailing digits or at zero."""
    digits = F.regexp_extract(number, "([0-9]+)$", 1)
    value = digits.try_cast("bigint")
    moved = (value + step).cast("string")
    padded = F.lpad(moved, F.greatest(F.length(digits), F.length(moved)), F.lit("0"))
    return F.when(value > 0, F.concat(F.substr(number, F.lit(1), F.length(number) - F.length(digits)), padded))


def numbered(number: Column) -> tuple[Column, Column]:
    """What stands before the trailing digits, and their value; the value is null without digits."""
    digits = F.regexp_extract(number, "([0-9]+)$", 1)
    return F.substr(number, F.lit(1), F.length(number) - F.length(digits)), digits.try_cast("bigint")


def natural_key(number: Column) -> list[Column]:
    """Sort keys of table order: dotted numbers by their parts, then everything else by its text."""
    numeric = number.rlike("^[0-9]+([.][0-9]+)*$")
    parts = F.when(numeric, F.transform(F.split(number, "[.]"), lambda p: p.cast("bigint")))
    return [~numeric, parts, number]


def room_name(name: Column) -> Column:
    """Spelling variants folded together: case, ё, punctuation and common abbreviations."""
    # Abbreviations of explication tables.
    known = {
        "тех": "техническое",
        "пом": "помещение",
        "су": "санузел",
        "кл": "клетка",
        "лк": "лестничная клетка",
        "пуи": "помещение уборочного инвентаря",
    }
    text = F.translate(F.lower(F.trim(name)), "ё", "е")
    text = F.regexp_replace(text, r"(?U)с\s*/\s*у\b", "санузел")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def box_normalized(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """struct<x0,y0,x1,y1> in [0, 1], corners in order; a page without area is an error."""

    def unit(v: Column, size: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size))

    ax, bx, ay, by = unit(x0, width), unit(x1, width), unit(y0, height), unit(y1, height)
    box = F.struct(F.least(ax, bx).alias("x0"), F.least(ay, by).alias("y0"), F.greatest(ax, bx).alias("x1"), F.greatest(ay, by).alias("y1"))
    return F.when((width <= 0) | (height <= 0), F.raise_error(F.lit("page without area")).cast(BOX)).otherwise(box)


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))

    def area(x: Column) -> Column:
        return (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])

    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, tolerance: float) -> Column:
    return (a0 <= b1 + tolerance) & (b0 <= a1 + tolerance)


def parsed_number(text: Column) -> Column:
    """Number with thousands spaces and a decimal comma or point."""
    joined = F.regexp_replace(F.translate(text, "\u00a0\u202f", "  "), r"(?<=[0-9])\s+(?=[0-9]{3}([^0-9]|$))", "")
    return F.replace(joined, F.lit(","), F.lit(".")).try_cast("double")


#: Unit spellings, and the families of those that are converted.
UNITS = ("м²", "кв.м", "м2", "м³", "куб.м", "м3", "%", "доли", "ед.", "ед", "шт.", "шт", "чел.", "чел", "мм", "м")
UNIT_FAMILIES = {"м²": "area", "кв.м": "area", "м2": "area", "м³": "volume", "куб.м": "volume", "м3": "volume", "%": "percent", "доли": "fraction"}


def unit_of(text: Column) -> Column:
    """The unit that the text starts with, longest spelling first; null if none."""
    longest = sorted(UNITS, key=len, reverse=True)
    pattern = "|".join(u.replace(".", "[.]") for u in longest)
    return F.nullif(F.lower(F.regexp_extract(F.ltrim(text), f"^(?iu)({pattern})", 1)), F.lit(""))


def unit_factor(wanted: Column, found: Column) -> Column:
    """What a value in `found` is multiplied by to be one in `wanted`; null if they don't fit."""
    table = F.create_map(*[F.lit(x) for kv in UNIT_FAMILIES.items() for x in kv])
    a, b = F.try_element_at(table, F.trim(wanted)), F.try_element_at(table, found)
    return (
        F.when(a.isNull() | b.isNull() | (a == b), F.lit(1.0))
        .when((a == "percent") & (b == "fraction"), F.lit(100.0))
        .when((a == "fraction") & (b == "percent"), F.lit(0.01))
    )


def wilson(successes: Column, n: Column) -> Column:
    """struct<lo,hi> of the 95 % interval of a share; null without observations."""
    z = 1.96
    p = successes / n
    d, c = 1 + z * z / n, p + z * z / (2 * n)
    m = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (c - m) / d).alias("lo"), F.least(F.lit(1.0), (c + m) / d).alias("hi")))


def ids_digest(ids: Column) -> Column:
    """sha256 of an array of ids, sorted as strings and joined by newlines."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)
