"""Column expressions: numbers, strings, sequences."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = {name: k + 1 for k, name in enumerate("January February March April May June July August September October November December".split())}
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def round_n(value: Column, digits: int) -> Column:
    return F.round(value, digits)


def square(value: Column) -> Column:
    return value * value


def log_normpdf(x: Column, mean: Column, sd: Column) -> Column:
    """Log density of a normal distribution; null where sd isn't positive."""
    return F.when(sd > 0, F.lit(-0.5 * math.log(2 * math.pi)) - F.log(sd) - 0.5 * F.pow((x - mean) / sd, 2))


def lookup(column: Column, mapping: Mapping) -> Column:
    """The mapped value, null for keys that the mapping lacks; a small mapping, part of the plan."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), column)


def path_leaf(name: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(name, "/", -1)


def parse_number(text: Column) -> Column:
    """A number with thousands commas; null where it can't be read."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def percent_or_range(text: Column) -> Column:
    """12%, 10-14 (the mean of the bounds) or a plain number."""
    bare = F.trim(F.regexp_replace(text, "%", ""))
    bounds = F.transform(F.split(bare, r"(?<=\d)\s*-\s*(?=\d)"), lambda x: x.try_cast("double"))
    return F.aggregate(bounds, F.lit(0.0), lambda t, x: t + x) / F.size(bounds)


def bracketed_number(text: Column) -> Column:
    """The number before a bracket, 12 of '12 [9-14]'."""
    return F.split_part(F.trim(F.substring_index(text, "[", 1)), F.lit(" "), F.lit(1)).try_cast("double")


def unit_in_parens(name: Column) -> Column:
    """The text in the first parentheses, null without any."""
    return F.nullif(F.regexp_extract(name, r"\(([^()]*)\)", 1), F.lit(""))


def without_parens(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s*\([^()]*\)", ""))


def strip_markup(name: Column) -> Column:
    """Without <br> and a duplicate column's numeric suffix."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"<br\s*/?>", " "), r"\.\d+$", ""))


def simplify_label(name: Column, depth: int) -> Column:
    """The last `depth` parts of a path, with spaces for underscores."""
    return F.translate(F.substring_index(name, "/", -depth), "_", " ")


def camel_words(name: Column) -> Column:
    """CamelCase as separate words."""
    return F.array_join(F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+)"), F.lit(1)), " ")


def month_index(year: Column, month: Column) -> Column:
    return 12 * year + month - 1


def steps_between(start: Column, end: Column, level: str = "MONTHLY") -> Column:
    """Months or years from one date to another, days ignored."""
    if level == "YEARLY":
        return F.year(end) - F.year(start)
    return month_index(F.year(end), F.month(end)) - month_index(F.year(start), F.month(start))


def num_timesteps(start: Column, end: Column, inclusive: bool = True) -> Column:
    return steps_between(start, end) + (1 if inclusive else 0)


def wrap_theta(theta: Column) -> Column:
    """Folds an angle into (-pi/2, pi/2] by pi; null beyond three times that."""
    half = math.pi / 2
    return F.when(F.abs(theta) > 3 * half, None).when(theta > half, theta - math.pi).when(theta <= -half, theta + math.pi).otherwise(theta)


def uniform(*key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 of the key's texts: the same wherever and whenever it is computed."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(*key: Column, seed: int = 0) -> Column:
    """A standard normal number from two hashes of the key."""
    return F.sqrt(-2 * F.log(uniform(*key, seed=2 * seed))) * F.cos(2 * math.pi * uniform(*key, seed=2 * seed + 1))
