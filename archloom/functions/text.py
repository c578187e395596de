"""Text, format and small general functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import html_decode, lower, trim  # noqa: F401  html_decode belongs to both


def bytes_human(n: Column, most: str = "TB", grouped: bool = True) -> Column:
    """1536 as 1.50 KB: whole bytes, two decimals below ten of a unit, one above, rounded half up.

    No unit above most is taken; grouped puts commas between thousands.
    """
    units = ("KB", "MB", "GB", "TB")
    value, out = n.cast("double"), F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units[: units.index(most) + 1], 1):
        v = value / (1024.0**k)
        text = F.when(v < 10, F.format_number(F.round(v.cast("decimal(30,10)"), 2), 2)).otherwise(F.format_number(F.round(v.cast("decimal(30,10)"), 1), 1))
        text = text if grouped else F.replace(text, F.lit(","))
        out = F.when(n >= 1024**k, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def html_escape(c: Column) -> Column:
    for t, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(t), F.lit(e))
    return c


def hms(seconds: Column) -> Column:
    """Elapsed time: 59s, 1m 05s, 2h 03m."""
    s = seconds.cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(s < 60, F.concat(r.cast("string"), F.lit("s"))).when(s < 3600, F.concat(m.cast("string"), F.lit("m "), two(r), F.lit("s"))).otherwise(F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m")))


def skip_list(c: Column) -> Column:
    """Lower-cased entries of a comma list."""
    return F.filter(F.transform(F.split(c, ","), lambda x: lower(trim(x))), lambda x: x != "")


def to_bool(c: Column) -> Column:
    return lower(trim(c)).isin("1", "true", "on", "yes")


def to_int(c: Column, default: int) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(default).cast("long"))


def job_id_valid(c: Column) -> Column:
    return c.rlike(r"^[0-9]{8}-[0-9]{6}-[0-9a-f]{6}$")


def meta_generator(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?i)<meta\s[^>]*name\s*=\s*[\"']?generator[\"']?[^>]*>", 0)
    return trim(F.regexp_extract(tag, r"(?i)content\s*=\s*[\"']([^\"']*)", 1))


def fingerprint(values: Column) -> Column:
    """The entries of a map that say something."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & (v != ""))


def dos_time(ts: Column) -> tuple[Column, Column]:
    """Time and date words of a ZIP entry for epoch seconds, none before 1980."""
    t = F.timestamp_seconds(F.greatest(ts, F.lit(315532800).cast("long")))
    time = F.shiftleft(F.hour(t), 11).bitwiseOR(F.shiftleft(F.minute(t), 5)).bitwiseOR(F.floor(F.second(t) / 2).cast("int"))
    date = F.shiftleft(F.year(t) - 1980, 9).bitwiseOR(F.shiftleft(F.month(t), 5)).bitwiseOR(F.dayofmonth(t))
    return time, date


def sql_literal(c: Column, kind: str) -> Column:
    """SQL text of a value of a Spark type."""
    if kind == "boolean":
        text = F.when(c, "1").otherwise("0")
    elif kind == "binary":
        text = F.when(F.length(c) == 0, "''").otherwise(F.concat(F.lit("0x"), F.lower(F.hex(c))))
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        text = c.cast("string")
    else:
        s = c.cast("string")
        for t, e in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\x00", "\\0")):
            s = F.replace(s, F.lit(t), F.lit(e))
        text = F.concat(F.lit("'"), s, F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(text)


def strip_definer(ddl: Column) -> Column:
    """A view's text without who defined it and whose rights it takes."""
    ddl = F.regexp_replace(ddl, r"(?i)\sDEFINER\s*=\s*(?:`[^`]*`@`[^`]*`|\S+)", "")
    return F.regexp_replace(ddl, r"(?i)\sSQL\s+SECURITY\s+(?:DEFINER|INVOKER)", "")
