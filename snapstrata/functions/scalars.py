"""Scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an author and a storage name look like.
AUTHOR = r"^[A-Za-z]+(?: [A-Za-z]+)+(?: )?<[^@ ]+@[^@ ]+\.[^@ >]+>$"
STORAGE_NAME = r"^[A-Za-z0-9_-]*$"
PAGE = 10


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def backup_hash(message: Column, author: Column, timestamp: Column) -> Column:
    """A snapshot's name comes from who, what and when, not from its content."""
    return F.sha2(F.concat(message, F.lit(":"), author, F.lit(":"), timestamp.cast("string")), 256)


def short(h: Column) -> Column:
    return F.substring(h, 1, 8)


def chunk_path(key: str, h: Column) -> Column:
    return F.concat_ws("/", F.lit(key), F.lit("chunks"), F.substring(h, 1, 2), F.substring(h, 3, 64))


def relative_path(path: Column, root: str) -> Column:
    """Without the root, with / for \\, and without one leading /."""
    cut = F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 2**31 - 1)).otherwise(path)
    slashes = F.replace(cut, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(slashes, F.lit("/")), F.substring(slashes, 2, 2**31 - 1)).otherwise(slashes)


def safe_path(path: Column) -> Column:
    """Whether a path is relative and stays below its root: no part is empty, . or .."""
    return F.coalesce(~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", "..")), F.lit(False)) & ~F.contains(path, F.lit("\0"))


def normalise_only(raw: Column) -> Column:
    """A requested path: trimmed, / for \\, without leading ./ or / and without trailing /."""
    x = F.replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), F.lit("\\"), F.lit("/"))
    x = F.regexp_replace(x, r"^(\./)+", "")
    return F.regexp_replace(F.regexp_replace(x, "^/+", ""), "/+$", "")


def normalise_only_text(raw: str) -> str:
    """The same on the driver; an empty request is an error."""
    x = raw.strip().replace("\\", "/")
    x = re.sub("/+$", "", re.sub("^/+", "", re.sub(r"^(\./)+", "", x)))
    if not x:
        raise ValueError("empty path")
    return x


def rfc3339(seconds: Column) -> Column:
    """Epoch seconds in UTC to the second, whatever the session's time zone."""
    rest = F.pmod(seconds, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / F.lit(86400)).cast("int"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit("Z"))


def local_time(seconds: Column, zone: str) -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds(seconds).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def percent(processed: Column, total: Column) -> Column:
    """Whole percent; 0 of nothing is 0."""
    return F.when(total == 0, F.lit(0)).otherwise(F.call_function("div", processed * 100, total)).cast("bigint")


def page_count(n: Column, size: int = PAGE) -> Column:
    return F.call_function("div", n + size - 1, F.lit(size)).cast("bigint")


def mode_bits(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o777))


#: Extensions of files that count as programs where a file system has no permission bits.
PROGRAMS = ("exe", "bat", "cmd", "com", "msi", "ps1")


def fallback_mode(path: Column, readonly: Column) -> Column:
    """Permissions of a file on a system without permission bits."""
    program = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)).isin(*PROGRAMS)
    write = F.when(readonly, F.lit(0)).otherwise(F.lit(0o200))
    return F.lit(0o444) + write + F.when(program, F.lit(0o111)).otherwise(F.lit(0))


def human_size(n: Column) -> Column:
    """For display only: decimal units with two digits, rounded half up in whole numbers."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB"), (4, "TB"), (5, "PB")):
        step = 10 * 1000 ** (power - 1)  # a hundredth of the unit
        h = F.call_function("div", n + step // 2, F.lit(step))
        out = F.when(n >= 1000**power, F.concat(F.call_function("div", h, F.lit(100)).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_size(text: str) -> int:
    """Bytes of a text such as '5 MB' or '64 KiB'; anything else is a ValueError."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kKmMgGtTpP]?)(i?)[bB]?\s*", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * (1024 if m[3] else 1000) ** " kmgtp".index(m[2].lower() or " "))


def display_path(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def valid_author(x: Column) -> Column:
    return F.rlike(x, F.lit(AUTHOR))


def valid_storage_name(x: Column) -> Column:
    return F.rlike(x, F.lit(STORAGE_NAME))
