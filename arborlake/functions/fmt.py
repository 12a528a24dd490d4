"""Texts for sizes, changes and shares, from whole numbers only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units of sizes.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

_WIDE = "decimal(38,0)"


def _whole(x: Column, y: Column) -> Column:
    """The floor of x / y for decimals without a fraction, y > 0. A plain division rounds to six digits first, which can reach the next whole number."""
    return F.call_function("div", x - F.pmod(x, y), y)


def format_bytes(size: Column) -> Column:
    """`1.5 KB`: the largest unit that the size reaches, two decimals at most, trailing zeros dropped.

    The unit is chosen before rounding (1048575 is `1024 KB`), and sums stay exact over all longs.
    """
    n = F.abs(size.cast(_WIDE))
    unit, name = F.lit(1).cast(_WIDE), F.lit(UNITS[0])
    for k in range(1, len(UNITS)):
        at = F.lit(1024**k).cast(_WIDE)
        unit, name = F.when(n >= at, at).otherwise(unit), F.when(n >= at, UNITS[k]).otherwise(name)
    hundredths = _whole(n * 200 + unit, unit * 2)
    whole, rest = F.call_function("div", hundredths, F.lit(100)), (hundredths % 100).cast("int")
    decimals = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), 2, "0"), "0$", "")))
    out = F.concat(whole.cast("string"), decimals, F.lit(" "), name)
    return F.concat(F.when(size < 0, "-").otherwise(""), out)


def signed_bytes(delta: Column) -> Column:
    """`+1 KB` or `-1 KB`; no change is `+0 B`."""
    text = format_bytes(delta)
    return F.when(delta < 0, text).otherwise(F.concat(F.lit("+"), text))


def size_change(old: Column, new: Column) -> Column:
    """The new size if there was none, the old if there is none left, else both."""
    return F.when(old == 0, format_bytes(new)).when(new == 0, format_bytes(old)).otherwise(F.concat(format_bytes(old), F.lit(" → "), format_bytes(new)))


def basis_points(part: Column, total: Column) -> Column:
    """The share in hundredths of a per cent, rounded half up; 0 if the total is not positive."""
    p, t = part.cast(_WIDE), total.cast(_WIDE)
    return F.when(total > 0, _whole(p * 20000 + t, t * 2)).otherwise(F.lit(0).cast("bigint"))


def percent_text(points: Column, decimals: int = 2) -> Column:
    """Basis points as `12.34`, or with one decimal (rounded half up) as `12.3`."""
    if decimals == 1:
        tenths = F.floor((points + 5) / 10).cast("bigint")
        return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.concat(F.floor(points / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((points % 100).cast("string"), 2, "0"))


def bar_width(points: Column, full: int = 60) -> Column:
    """Hundredths of a bar of `full` units."""
    return F.floor(F.least(F.greatest(points, F.lit(0)), F.lit(10000)) * full / 100).cast("bigint")


def pad_counter(n: Column, digits: int) -> Column:
    """Left-pads with zeros to at least so many digits, never cutting any off."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))


def type_label(is_directory: Column) -> Column:
    return F.when(is_directory, "Folder").otherwise("File")


def icon(is_directory: Column, denied: Column) -> Column:
    return F.when(denied, "lock").when(is_directory, "folder").otherwise("file")


def modified_text(modified: Column) -> Column:
    """In UTC, to the minute; a dash if unknown."""
    return F.coalesce(F.date_format(modified, "yyyy-MM-dd HH:mm"), F.lit("—"))


def html_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def csv_cell(text: Column) -> Column:
    """Quoted only if it holds a comma, quote or line break; quotes are doubled."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\n\\r]'), quoted).otherwise(text)


def parse_megabytes(text: str | None) -> int | None:
    """Bytes of a text in megabytes; blank is no bound. Raises ValueError if it is no number or negative."""
    if text is None or not text.strip():
        return None
    try:
        value = float(text.strip().replace(",", ""))
    except ValueError:
        raise ValueError(f"not a size in MB: {text!r}") from None
    if not 0 <= value < float("inf"):
        raise ValueError(f"a size cannot be negative: {text!r}")
    return int(value * 1024 * 1024)


def elapsed_text(seconds: float) -> str:
    if seconds >= 60:
        return f"{int(seconds // 60)}m {int(seconds % 60)}s"
    return f"{int(seconds)}s" if seconds >= 1 else "<1s"


def totals_line(files: Column, size: Column) -> Column:
    return F.concat(files.cast("string"), F.lit(" files, "), format_bytes(size), F.lit(" total"))
