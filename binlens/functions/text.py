"""String helpers used by extraction steps (path names, years, tokens, escapes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Last path component (``os.path.split`` tail); spaces are kept."""
    return F.regexp_extract(path, r"([^/]+)$", 1)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def label_from_path(path: Column, positive: str = "malware", negative: str = "benign") -> Column:
    """1 when the path names the positive folder, 0 for the negative one, else null (reject)."""
    return (F.when(path.contains(positive), F.lit(1))
            .when(path.contains(negative), F.lit(0))
            .otherwise(F.lit(None).cast("int")))


def year_from_epoch_seconds(seconds: Column) -> Column:
    """Year of a 32-bit epoch stamp, in the session time zone (UTC in this engine)."""
    return F.year(F.timestamp_seconds(seconds))


def year_from_bracketed_stamp(text: Column) -> Column:
    """Year of a ``'0x5F1FC6E4 [Tue Jul 28 08:23:32 2020 UTC]'``-style value.

    The text between the brackets is parsed with the weekday removed (Spark's parser has no
    day-of-week input pattern).
    """
    inner = F.regexp_extract(text, r"\[(.*?)\]", 1)
    no_weekday = F.regexp_replace(inner, r"^[A-Za-z]{3} ", "")
    ts = F.try_to_timestamp(no_weekday, F.lit("MMM d HH:mm:ss yyyy z"))
    return F.year(ts)


def escape_linebreaks(s: Column) -> Column:
    """CR LF pairs become the literal four characters ``\\r\\n`` (keeps CSV rows on one line)."""
    return F.replace(s, F.lit("\r\n"), F.lit("\\r\\n"))
