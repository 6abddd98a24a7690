"""Dates, intervals and numbers. All functions take and return Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import blank


def iso_date(c: Column) -> Column:
    """Date of a y-m-d text (short months and days allowed), else null."""
    return F.try_to_timestamp(c, F.lit("yyyy-M-d")).cast("date")


def valid_date(c: Column) -> Column:
    return iso_date(c).isNotNull()


def year_of(c: Column) -> Column:
    return F.left(c, F.lit(4)).try_cast("int")


def cycle_key(start: Column, end: Column) -> Column:
    return F.concat(F.left(F.coalesce(start, F.lit("")), F.lit(4)), F.lit("-"), F.left(F.coalesce(end, F.lit("")), F.lit(4)))


def span(start: Column, end: Column, window: Column | None = None) -> Column:
    """A closed interval of date texts, read once: days, years, cycle label, texts."""
    key = cycle_key(start, end)
    return F.struct(
        iso_date(start).alias("d1"), iso_date(end).alias("d2"), year_of(start).alias("y1"), year_of(end).alias("y2"), key.alias("key"),
        (key if window is None else F.when(blank(window), key).otherwise(window)).alias("label"), F.coalesce(start, F.lit("")).alias("t1"), F.coalesce(end, F.lit("")).alias("t2"),
    )


def _known(a: Column, b: Column, unit: str) -> Column:
    return reduce(lambda x, y: x & y, [x[f"{unit}{i}"].isNotNull() for x in (a, b) for i in (1, 2)])


def spans_meet(a: Column, b: Column) -> Column:
    """Spans overlap by days, or by years if a day cannot be read; false if a year cannot."""
    meet = lambda u: F.greatest(a[f"{u}1"], b[f"{u}1"]) <= F.least(a[f"{u}2"], b[f"{u}2"])
    return F.when(_known(a, b, "d"), meet("d")).when(_known(a, b, "y"), meet("y")).otherwise(False)


def span_gap(a: Column, b: Column) -> Column:
    """Days between spans, 0 if they meet, years times 365 if only years are known, else null."""
    by_day = F.when(b["d1"] > a["d2"], F.date_diff(b["d1"], a["d2"])).otherwise(F.date_diff(a["d1"], b["d2"]))
    by_year = F.when(b["y1"] > a["y2"], b["y1"] - a["y2"]).otherwise(a["y1"] - b["y2"]) * 365
    return F.when(spans_meet(a, b), 0).when(_known(a, b, "d"), by_day).when(_known(a, b, "y"), by_year)


def spans_agree(a: Column, b: Column) -> Column:
    """Equal labels, equal ends, or equal years; blank equals blank."""
    return (a["label"] == b["label"]) | ((a["t1"] == b["t1"]) & (a["t2"] == b["t2"])) | (a["key"] == b["key"])


def spans_adjacent(a: Column, b: Column, most: int = 730) -> Column:
    return ~spans_meet(a, b) & F.coalesce(span_gap(a, b) <= most, F.lit(False))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return spans_meet(span(s1, e1), span(s2, e2))


def gap_days(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return span_gap(span(s1, e1), span(s2, e2))


def same_cycle(s1: Column, e1: Column, s2: Column, e2: Column, w1: Column | None = None, w2: Column | None = None) -> Column:
    return spans_agree(span(s1, e1, w1), span(s2, e2, w2))


def adjacent(s1: Column, e1: Column, s2: Column, e2: Column, most: int = 730) -> Column:
    return spans_adjacent(span(s1, e1), span(s2, e2), most)


def date_in(c: Column, required: bool = True) -> Column:
    """First 20yy-mm-dd in a text; an error (or null) if there is none."""
    found = F.nullif(F.regexp_extract(c, r"20\d{2}-\d{2}-\d{2}", 0), F.lit(""))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no date in "), c))) if required else found


def compact_date(c: Column) -> Column:
    """yyyymmdd in a text as y-m-d, else unknown-date."""
    d = F.regexp_extract(c, r"(20\d{2})(\d{2})(\d{2})", 0)
    return F.when(d == "", "unknown-date").otherwise(F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def years_in(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), lambda y: y.cast("int"))


def joined_dates(c: Column, sep: str = "; ") -> Column:
    """Dates found in the parts of a delimited text, distinct, sorted, joined."""
    parts = F.transform(F.split(c, ";"), lambda x: F.regexp_extract(x, r"20\d{2}-\d{2}-\d{2}", 0))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), sep)


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.expr("current_timezone()")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def percent(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(100 * ratio(a, b), 4), F.lit(0.0))


def smoothed(successes: Column, n: Column, prior: Column, strength: float = 25.0) -> Column:
    return (successes + strength * prior) / (n + strength)


def log_scale(c: Column, top: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0))) / F.log1p(top)


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """Sum of weight times part, left to right."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * c for w, c in parts])


def bands(c: Column, edges: list[tuple[float, object]], default) -> Column:
    """Value of the first edge that ``c`` reaches; edges fall."""
    out = None
    for edge, value in edges:
        out = F.when(c >= edge, value) if out is None else out.when(c >= edge, value)
    return out.otherwise(default)


def quarter_band(c: Column, top: Column) -> Column:
    """0, then 1 to 4 by quarters of the maximum."""
    r = ratio(c, top)
    return F.when(c.isNull() | (c <= 0) | top.isNull() | (top <= 0), 0).when(r <= 0.25, 1).when(r <= 0.5, 2).when(r <= 0.75, 3).otherwise(4)


def score_band(c: Column) -> Column:
    return F.when(c == 0, "0").when(c.between(1, 25), "1_25").when(c.between(26, 50), "26_50").when(c.between(51, 75), "51_75").when(c.between(76, 100), "76_100").otherwise("invalid")


def standard_error(c: Column) -> Column:
    """Aggregate: standard error of the mean, 0 for one value."""
    n = F.count(c)
    return F.when(n <= 1, 0.0).otherwise(F.stddev_samp(c) / F.sqrt(n))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def estimated_cost(tokens_in: Column, tokens_out: Column, reasoning: Column, price_in: Column, price_out: Column, price_reasoning: Column, mode: Column) -> Column:
    """Reasoning tokens are part of the output, billed as output besides, or billed at a price of their own; null where a price or the mode is missing."""
    return (
        F.when(mode == "included_in_output", token_cost(tokens_in, tokens_out, price_in, price_out))
        .when(mode == "billed_as_output", token_cost(tokens_in, tokens_out + reasoning, price_in, price_out))
        .when(mode == "separate", token_cost(tokens_in, tokens_out, price_in, price_out) + reasoning * price_reasoning / 1_000_000)
    )


def ring_area(xs: Column, ys: Column) -> Column:
    """Signed area of a ring (shoelace); a hole has the other sign."""
    n = F.size(xs)
    cross = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(xs, i) * F.element_at(ys, i % n + 1) - F.element_at(xs, i % n + 1) * F.element_at(ys, i))
    return F.aggregate(cross, F.lit(0.0), lambda a, b: a + b) / 2


def projected(lon: Column, lat: Column, frame: tuple[float, float, float, float], size: tuple[float, float]) -> tuple[Column, Column]:
    """Longitude and latitude in a frame (west, south, east, north) as x to the right and y down."""
    west, south, east, north = frame
    return (lon - west) / (east - west) * size[0], (north - lat) / (north - south) * size[1]
