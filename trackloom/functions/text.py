"""Scalar columns: times, sizes, names, dates, log lines, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two(c: Column) -> Column:
    """A number with two digits at least."""
    text = c.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def fixed(value: Column, digits: int) -> Column:
    """A number with that many digits behind the point, rounded by its exact value, halves to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def clock(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on, of rounded seconds; negative counts as 0."""
    s = F.greatest(F.round(seconds), F.lit(0.0)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.concat(two(h), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(two(m), F.lit(":"), two(s % 60)))


def clock_hundredths(seconds: Column) -> Column:
    """mm:ss.ff of a time; nothing counts as 0."""
    t = F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))
    m = F.floor(t / 60)
    return F.concat(two(m), F.lit(":"), F.lpad(fixed(t - m * 60, 2), 5, "0"))


def duration_ms(ms: Column) -> Column:
    """Milliseconds as m:ss or h:mm:ss, cut to whole seconds."""
    s = F.floor(ms / 1000)
    h = F.floor(s / 3600)
    return F.when(h > 0, F.concat(two(h), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))).otherwise(F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60)))


def byte_size(n: Column) -> Column:
    """Bytes in the largest of B, KB, MB, GB that makes them 1 or more."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1024.0**power, F.concat(fixed(n / 1024.0**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def folder_size(n: Column) -> Column:
    """Bytes in MB, or in GB from one on."""
    return F.when(n >= 1024.0**3, F.concat(fixed(n / 1024.0**3, 2), F.lit(" GB"))).otherwise(F.concat(fixed(n / 1024.0**2, 1), F.lit(" MB")))


# The characters that names may not have, and how long names may be, in cache_name and export_name.
def cache_name(stem: Column) -> Column:
    """A folder name: letters, digits, dot, underscore, hyphen; the first 48."""
    return F.left(F.regexp_replace(stem, r"[^\p{L}\p{N}._-]+", "_"), F.lit(48))


def export_name(title: Column, default: str = "rallies") -> Column:
    """A file name without characters that file systems forbid; the default for a blank title; the first 80."""
    name = F.trim(title)
    return F.left(F.regexp_replace(F.when(name == "", default).otherwise(name), r'[\\/:*?"<>|]+', "_"), F.lit(80))


def numbered_names(name: Column, taken: Column) -> Column:
    """The name, or with -2, -3, .. after it the first that is not taken (an array)."""
    tried = F.concat(F.array(name), F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda k: F.concat(name, F.lit("-"), k.cast("string"))))
    return F.get(F.array_except(tried, taken), F.lit(0))


def cache_key(path: Column, size: Column, modified_ms: Column) -> Column:
    """Ten hex digits that change with a file's path, size or time."""
    return F.left(F.sha1(F.concat(path, size.cast("string"), modified_ms.cast("string"))), F.lit(10))


# The two forms of a recording time in a file name.
DATES = (
    r"(?:^|\D)((?:19|20)\d{2})(\d{2})(\d{2})[_-]?(\d{2})(\d{2})(\d{2})(?:\D|$)",
    r"(?:^|\D)((?:19|20)\d{2})[-_.](\d{2})[-_.](\d{2})[_ -](\d{2})(\d{2})(\d{2})(?:\D|$)",
)


def name_date(name: Column) -> Column:
    """Recording time in a file name; the first form that is a valid date, else null."""

    def read(pattern: str) -> Column:
        digits = F.concat(*(F.regexp_extract(name, pattern, k) for k in range(1, 7)))
        return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))

    return F.coalesce(*map(read, DATES))


def progress_line(line: Column) -> Column:
    """Share done and remaining seconds of a progress line; nulls in other lines."""
    get = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    share = F.least(F.greatest(get(r"percent=([0-9.]+)").cast("double") / 100.0, F.lit(0.0)), F.lit(1.0))
    told = line.startswith("PROGRESS ")
    return F.struct(F.when(told, share).alias("share"), F.when(told, get(r"eta=([0-9.]+)s?").cast("double")).alias("eta"))


def encoder_share(line: Column, duration_ms: Column) -> Column:
    """Share of an encoding that is written, 0.99 at most until it ends; null in other lines."""
    micro = F.nullif(F.regexp_extract(line, r"^out_time_[^=]*=(-?\d+)\s*$", 1), F.lit("")).cast("double")
    return F.when(duration_ms > 0, F.least(F.greatest(micro / 1000.0 / duration_ms, F.lit(0.0)), F.lit(0.99)))


def media_warnings(width: Column, height: Column, fps: Column, nominal: Column, counted: Column) -> Column:
    """What speaks against a source: not 3840 by 2160, not 60 frames a second, a rate that may vary."""
    steady = (F.abs(fps - nominal) < 0.001) & ((counted == 0) | (F.abs(fps - counted) < 0.05))
    return F.array_compact(F.array(F.when((width != 3840) | (height != 2160), "size"), F.when(F.abs(fps - 60) > 0.5, "rate"), F.when(~steady, "variable")))


def media_verdict(width: Column, height: Column, fps: Column, realtime: Column) -> Column:
    """PASS, PASS_WITH_WARNING or FAIL of a source and how fast it decodes."""
    exact = (width == 3840) & (height == 2160) & (F.abs(fps - 60) <= 0.5)
    return F.when(realtime < 1, "FAIL").when(exact, "PASS").otherwise("PASS_WITH_WARNING")
