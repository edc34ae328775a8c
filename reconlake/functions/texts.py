"""What people read: titles, labels, times, percentages, and small parsers of codes and replies."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reconlake.functions import scalars

DASH = "—"
#: How subjects are read.
ROOMS, ROOM, TOTAL, FUNCTION = "помещения ", "помещение ", "итог по этажу", "назначение помещения "
#: Relative times.
JUST_NOW, MINUTES, HOURS, DAYS = "только что", " мин назад", " ч назад", " дн назад"


def subject_label(subject: Column) -> Column:
    part = lambda pattern, i=1: F.regexp_extract(subject, pattern, i)
    return (
        F.when(subject.rlike(r"^rooms .+\.\..+$"), F.concat(F.lit(ROOMS), part(r"^rooms (.+)\.\.(.+)$"), F.lit("–"), part(r"^rooms (.+)\.\.(.+)$", 2)))
        .when(subject.rlike("^room .+$"), F.concat(F.lit(ROOM), part("^room (.+)$"))).when(subject == "floor total", TOTAL)
        .when(subject.rlike("^function .+$"), F.concat(F.lit(FUNCTION), part("^function (.+)$"))).otherwise(subject)
    )


def finding_title(name: Column, code: Column, subject: Column) -> Column:
    """The parameter's name, or its code, and what within it the finding is about."""
    return F.concat_ws(f" {DASH} ", F.coalesce(name, code), F.when(subject != "", subject_label(subject)))


def norm_reference(sp: Column, gost: Column) -> Column:
    return F.nullif(F.concat_ws("; ", F.nullif(sp, F.lit("")), F.nullif(gost, F.lit(""))), F.lit(""))


def labelled(code: Column, labels: Mapping[str, str], fallback: Column | None = None) -> Column:
    """The label of a code; what has none is the fallback, or the code itself."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), code if fallback is None else fallback)


def relative_time(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(minutes < 1, JUST_NOW).when(minutes < 60, text(minutes, MINUTES)).when(hours < 24, text(hours, HOURS)).when(days < 7, text(days, DAYS))
        .otherwise(F.date_format(then, "dd.MM.yyyy HH:mm"))
    )


def percent(x: Column) -> Column:
    return F.coalesce(F.concat(scalars.fixed(x * 100, 1), F.lit("%")), F.lit(DASH))


def trend(x: Column) -> Column:
    """Change of a share in percentage points, with a sign if it rose."""
    return F.coalesce(F.concat(F.when(x > 0, "+").otherwise(""), scalars.fixed(x * 100, 1), F.lit(" п.п.")), F.lit(DASH))


def storage_key(sha: Column) -> Column:
    return F.concat_ws("/", F.lit("documents"), F.substr(sha, F.lit(1), F.lit(2)), F.substr(sha, F.lit(3), F.lit(2)), sha)


def scan_reply(raw: Column) -> Column:
    """struct<outcome,detail>: clean, infected with a signature, or unavailable with what came."""
    text = F.trim(F.translate(raw, "\x00", ""))
    found = F.regexp_extract(text, r"^stream:\s*(.+?)\s+FOUND$", 1)
    return (
        F.when(text.endswith("OK"), F.struct(F.lit("clean").alias("outcome"), F.lit(None).cast("string").alias("detail")))
        .when(found != "", F.struct(F.lit("infected").alias("outcome"), found.alias("detail")))
        .otherwise(F.struct(F.lit("unavailable").alias("outcome"), F.coalesce(F.nullif(text, F.lit("")), F.lit("empty response")).alias("detail")))
    )


def percent_rect(box: Column) -> Column:
    """struct<left,top,width,height> of a box, in percent of its page."""
    return F.struct(
        (box["x0"] * 100).alias("left"), (box["y0"] * 100).alias("top"), ((box["x1"] - box["x0"]) * 100).alias("width"), ((box["y1"] - box["y0"]) * 100).alias("height")
    )


def fitted(panel_w: Column, panel_h: Column, w: Column, h: Column) -> Column:
    """struct<width,height> of an image that is scaled into a panel; zero where either has no area."""
    scale = F.when(F.least(panel_w, panel_h, w, h) > 0, F.least(F.try_divide(panel_w, w), F.try_divide(panel_h, h))).otherwise(0.0)
    return F.struct((w * scale).alias("width"), (h * scale).alias("height"))


def raster_dpi(long_side_pt: Column, dpi: float = 200.0, most_px: float = 4000.0) -> Column:
    return F.least(F.lit(dpi), F.try_divide(F.lit(most_px * 72), long_side_pt))


def picked(evidence: Column, role: str) -> Column:
    """Of an array of structs with `role`, the first of that role, or else the first; null if it is empty."""
    return F.coalesce(F.get(F.filter(evidence, lambda e: e["role"] == role), F.lit(0)), F.get(evidence, F.lit(0)))


def stage_flags(status: Column) -> Column:
    """struct<parsing_done,parsing_active> of a process."""
    done = ~status.isin("PENDING", "PARSING")
    return F.struct(done.alias("parsing_done"), (~done).alias("parsing_active"))


@F.pandas_udf(StringType())
def normalized_for_cer(texts: pd.Series) -> pd.Series:
    """Composed characters and single spaces; Spark has no built-in of the former."""
    return texts.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip())
