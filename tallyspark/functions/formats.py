"""Numbers and times as the pages and the command line write them, as column expressions."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import costs, times


def fixed(x: Column, digits: int) -> Column:
    """With so many digits and commas for thousands; what lies halfway between two goes up."""
    half = (x * (2.0 ** (digits + 1))) % 2 == 1  # only such multiples of powers of two are halfway
    return F.format_number(F.when(half, x + 10.0 ** -(digits + 2)).otherwise(x.cast("double")), digits)


def whole(x: Column) -> Column:
    return F.format_number(costs.half_up(x), 0)


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), fixed(x, 2))


def small_cost(x: Column) -> Column:
    """Costs of an analysis: three digits under ten cents."""
    return F.when(x == 0, "$0.00").otherwise(F.concat(F.lit("$"), F.when(x >= 0.1, fixed(x, 2)).otherwise(fixed(x, 3))))


def tokens(n: Column) -> Column:
    """As the command line writes them."""
    return F.when(n >= 1_000_000, F.concat(fixed(n / 1_000_000, 1), F.lit("M"))).when(n >= 1_000, F.concat(costs.half_up(n / 1_000).cast("long").cast("string"), F.lit("K"))).otherwise(F.format_number(n, 0))


def token_count(n: Column) -> Column:
    """As the pages write them."""
    scaled = F.format_number(n, 0)
    for unit, name in ((1_000, "K"), (1_000_000, "M"), (1_000_000_000, "B")):
        scaled = F.when(n >= unit, F.concat(fixed(n / unit, 1), F.lit(name))).otherwise(scaled)
    return scaled


def percent(x: Column) -> Column:
    return F.concat(F.when(x >= 10, costs.half_up(x).cast("long").cast("string")).otherwise(fixed(x, 1)), F.lit("%"))


def estimated_tokens(tokens_in: Column, message_count: Column) -> Column:
    """What an analysis will read, roughly; nothing where that is unknown."""
    n = costs.estimated_input(tokens_in, message_count)
    whole_of = lambda x: costs.half_up(x).cast("long").cast("string")
    return F.when(n == 0, "").when(n >= 1000, F.concat(F.lit("~"), whole_of(n / 1000), F.lit("K tokens"))).otherwise(F.concat(F.lit("~"), whole_of(n), F.lit(" tokens")))


def relative_date(ts: Column, at: datetime) -> Column:
    """How long ago, up to a week; then the day."""
    minutes = (F.unix_micros(times.moment(at)) - F.unix_micros(ts)) / 60_000_000
    n = lambda x: costs.half_up(x).cast("long").cast("string")
    return (
        F.when(minutes < 60, F.concat(F.greatest(F.lit(1), costs.half_up(minutes)).cast("long").cast("string"), F.lit("m ago")))
        .when(minutes < 24 * 60, F.concat(n(minutes / 60), F.lit("h ago")))
        .when(minutes < 2 * 24 * 60, "yesterday")
        .when(minutes < 7 * 24 * 60, F.concat(n(minutes / 1440), F.lit("d ago")))
        .otherwise(F.date_format(ts, "MMM d"))
    )


def date_group(ts: Column, today: date) -> Column:
    """Today, Yesterday, or the day's name; the year too where it is another one."""
    day = F.to_date(ts)
    named = F.when(F.year(day) == today.year, F.date_format(day, "EEEE, MMM d")).otherwise(F.date_format(day, "EEEE, MMM d, yyyy"))
    return F.when(day == F.lit(today), "Today").when(day == F.lit(today - timedelta(days=1)), "Yesterday").otherwise(named)


def date_bounds(preset: str, today: date, start: str | None = None, end: str | None = None) -> tuple[str | None, str | None]:
    """The range that a preset such as `30d`, `custom` or `all` means, as texts to compare starts with."""
    if preset == "custom":
        return start or None, end or None
    days = preset.removesuffix("d")
    return ((today - timedelta(days=int(days))).isoformat(), None) if days.isdigit() else (None, None)


def request_budget(window: int, reserved: int, margin: int) -> int:
    """Tokens that a request to a model may have."""
    return max(1, window - reserved - margin)


def request_tokens(text: Column, base: int, per_message: int, chars_per_token: int = 4) -> Column:
    """Estimated tokens of a request, an aggregate over the texts of its messages."""
    return F.sum(per_message + F.ceil(F.length(text) / chars_per_token)) + base
