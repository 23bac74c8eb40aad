"""Text expressions, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Unicode counts as whitespace when stripping.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def preview(text: Column, length: int) -> Column:
    """The first characters, always followed by an ellipsis."""
    return F.concat(F.left(text, F.lit(length)), F.lit("..."))


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 in UTC; the fraction appears only where it is not zero."""
    micros = F.unix_micros(ts) % F.lit(1_000_000)
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.when(micros == 0, whole).otherwise(fraction), F.lit("+00:00"))


def utc_instant(wall_clock: Column) -> Column:
    """The instant at which clocks in UTC showed a time without zone."""
    return F.from_utc_timestamp(wall_clock.cast("timestamp"), F.current_timezone())


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two instants, truncated."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return (micros / F.lit(1000)).cast("int")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of one text as an array of raw (unstripped) strings.

    Windows start every `size - overlap` code points. After the first, a start is used only
    while at least `max(overlap, 1)` code points remain from it, so a tail that the previous
    window already holds is not repeated. An empty text gives one empty window.

    The text is cut into step-sized pieces in one pass and each window is glued from the few
    pieces it covers, so the work is linear in the length even for very long texts.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    per_window = -(-size // step)
    last = F.greatest(F.lit(0), F.floor((F.length(text) - max(overlap, 1)) / F.lit(step)))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    # Wrapping the pieces in a one-element array binds them once for the inner lambda.
    return F.transform(
        F.array(pieces),
        lambda bound: F.transform(
            F.sequence(F.lit(1), last.cast("int") + 1),
            lambda n: F.left(F.array_join(F.slice(bound, n, per_window), ""), F.lit(size)),
        ),
    )[0]
