"""Column expressions. All are built-in Spark SQL, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "SCHEME_WEEK3",
    "SCHEME_WEEK4",
    "SEASONS",
    "add_all",
    "age_bucket",
    "age_days",
    "back_transform",
    "clamp",
    "date_to_epoch_days",
    "effective_launch",
    "epoch_days_to_date",
    "exact_sum",
    "line_margin",
    "line_value",
    "log_offset",
    "month_name",
    "pos_discount_flag",
    "ratio_of_sums",
    "recode",
    "relative_price",
    "season_of",
    "solid_flag",
    "to_date_col",
    "web_discount_flag",
    "weighted_mean",
]

# Age buckets as (tag, first day). A bucket ends where the next begins.
SCHEME_WEEK3 = (
    ("1W", 0), ("2W", 7), ("3W", 14), ("2M", 21), ("3M", 60),
    ("4M", 90), ("5M", 120), ("6M", 150), (">6M", 180),
)
SCHEME_WEEK4 = (
    ("1W", 0), ("2W", 7), ("3W", 14), ("4W", 21), ("2M", 28), ("3M", 60),
    ("4M", 90), ("5M", 120), ("6M", 150), (">6M", 180),
)
# First letter of a season code and the season it stands for.
SEASONS = (("M", "Summer"), ("S", "Spring"), ("W", "Winter"), ("F", "Fall"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- dates -------------------------------------------------------------------

def to_date_col(c: Column | str, fmt: str | None = None) -> Column:
    """Date from text; text that does not parse gives NULL.

    Without a format the date is the leading year-month-day of the text, with or
    without leading zeros, and whatever follows, such as a time, is left aside.
    """
    if fmt is not None:
        return F.try_to_date(_col(c), fmt)
    return F.try_to_date(F.regexp_extract(_col(c), r"^\s*(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d")


def epoch_days_to_date(c: Column | str) -> Column:
    return F.date_from_unix_date(_col(c).cast("int"))


def date_to_epoch_days(c: Column | str) -> Column:
    return F.unix_date(_col(c))


def effective_launch(master: Column | str, first_sale: Column | str) -> Column:
    """Master launch date, or the first sale when that is earlier or the master is NULL."""
    return F.least(_col(master), _col(first_sale))


def age_days(sale_date: Column | str, launch: Column | str) -> Column:
    return F.datediff(_col(sale_date), _col(launch))


def age_bucket(days: Column | str, scheme: Sequence[tuple[str, int]] = SCHEME_WEEK3) -> Column:
    """Left-closed age bucket; NULL for a NULL or negative age."""
    d = _col(days)
    bucket = F.when(d < scheme[0][1], F.lit(None).cast("string"))
    for (tag, _), (_, following) in zip(scheme, scheme[1:]):
        bucket = bucket.when(d < following, tag)
    return bucket.when(d >= scheme[-1][1], scheme[-1][0])


def month_name(d: Column | str) -> Column:
    return F.date_format(_col(d), "MMMM")


# --- sales lines ---------------------------------------------------------------

def line_margin(amount: Column | str, standard_cost: Column | str) -> Column:
    """Margin of a line. The cost is taken once per line, not per unit."""
    return _col(amount) - _col(standard_cost)


def line_value(retail_price: Column | str, quantity: Column | str) -> Column:
    """List value of a line."""
    return _col(retail_price) * _col(quantity)


def web_discount_flag(discount: Column | str) -> Column:
    """0 for a NULL or zero discount, else 1 (also for a negative one)."""
    d = _col(discount)
    return F.when(d.isNull() | (d == 0), 0).otherwise(1)


def pos_discount_flag(sale: Column | str, misc: Column | str) -> Column:
    """1 when the two discounts add to more than 0; a NULL in either gives 0."""
    return F.when(_col(sale) + _col(misc) > 0, 1).otherwise(0)


# --- labels ----------------------------------------------------------------------

def season_of(code: Column | str, seasons: Sequence[tuple[str, str]] = SEASONS) -> Column:
    """Season from the first letter of a code, upper or lower case; NULL for other codes."""
    c = _col(code)
    (first, label), *rest = seasons
    out = F.when(c.ilike(f"{first}%"), label)
    for letter, name in rest:
        out = out.when(c.ilike(f"{letter}%"), name)
    return out


def solid_flag(family: Column | str, other: str = "Non-Solid") -> Column:
    """'Solid' or the other label, which also covers NULL."""
    return F.when(_col(family) == "Solid", "Solid").otherwise(other)


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Swap listed values, keep the rest."""
    c = _col(c)
    out = c
    for old, new in mapping.items():
        out = F.when(c == old, new).otherwise(out)
    return out


# --- arithmetic --------------------------------------------------------------------

def exact_sum(c: Column | str) -> Column:
    """Sum that does not depend on row order: whole parts and fractions, in units of 1e-10, are added up as whole numbers.

    NULL is left out. A total that no long holds (beyond 9.2e18, or fractions of
    more than 9e8 rows in one group), NaN and infinities give the plain sum of doubles.
    The expression is kept short, as it stands in every aggregate: long code is not compiled.
    """
    x = _col(c).cast("double")
    whole, part, plain = F.try_sum(F.floor(x)), F.try_sum(F.floor((x - F.floor(x)) * 1e10 + 0.5)), F.sum(x)
    total = whole.cast("decimal(19,0)") + part.cast("decimal(19,0)") * F.lit(Decimal("0.0000000001"))
    return F.when(F.abs(plain) < 9e18, F.coalesce(total.cast("double"), plain)).otherwise(plain)


def ratio_of_sums(num: Column | str, den: Column | str) -> Column:
    """Sum over sum; NULL when the denominator adds to 0."""
    return F.try_divide(exact_sum(num), exact_sum(den))


def add_all(cols: Iterable[Column | str]) -> Column:
    """Plain sum of columns; a NULL part makes it NULL."""
    return reduce(lambda a, b: a + b, [_col(c) for c in cols])


def weighted_mean(pairs: Sequence[tuple[Column | str, Column | str]]) -> Column:
    """Mean of values by weights, given (weight, value) pairs."""
    weights = [_col(w) for w, _ in pairs]
    return F.try_divide(add_all([w * _col(v) for w, (_, v) in zip(weights, pairs)]), add_all(weights))


def relative_price(price: Column | str, comparator: Column | str) -> Column:
    """Price over the comparator's price; 1 when the comparator is 0."""
    q = _col(comparator)
    return F.when(q == 0, F.lit(1.0)).otherwise(F.try_divide(_col(price), q))


def log_offset(c: Column | str, offset: float = 0.0) -> Column:
    """Natural log after adding an offset; NULL where that is not positive."""
    return F.log(_col(c) + F.lit(float(offset)))


def back_transform(c: Column | str, offset: float = 0.0) -> Column:
    """Exponential. The default takes no offset back out."""
    return F.exp(_col(c)) - F.lit(float(offset))


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Value kept inside [low, high]; NULL stays NULL."""
    c = _col(c)
    return F.when(c < low, F.lit(float(low))).when(c > high, F.lit(float(high))).otherwise(c)
