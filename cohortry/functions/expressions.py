"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(date: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(date)


def age_at(date: Column, year_of_birth: Column) -> Column:
    """Age in whole calendar years."""
    return F.year(date) - year_of_birth


def proportion(count: Column, total: Column) -> Column:
    return F.try_divide(count.cast("double"), total.cast("double"))


def bulk_sd(count: Column, total: Column) -> Column:
    """sqrt((n*f - f^2) / (n*(n-1))); NULL for n = 1."""
    spread = (total * count - count * count).cast("double")
    return F.sqrt(F.try_divide(spread, (total * (total - 1)).cast("double")))


def sequential_sd(count: Column, total: Column) -> Column:
    """sqrt((n*s + s) / n^2), the formula of the one-cohort-at-a-time form."""
    return F.sqrt(F.try_divide((total * count + count).cast("double"), (total * total).cast("double")))


def censor_below(value: Column, minimum: Column) -> Column:
    """Min-cell rule: a non-zero value below ``minimum`` becomes ``-minimum``."""
    return F.when((value < minimum) & (value != 0), -minimum).otherwise(value)


def truncate_name(name: Column) -> Column:
    """Covariate names are kept to 512 characters."""
    return F.substring(name, 1, 512)


def last_digit(covariate_id: Column) -> Column:
    """Time window id: the last digit of a covariate id."""
    return F.right(covariate_id.cast("string"), F.lit(1)).cast("int")


def compare(value: Column, operator: str, bound) -> Column:
    """``value <operator> bound`` for the operators settings files use."""
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    return {
        "=": lambda: value == bound,
        "<": lambda: value < bound,
        "<=": lambda: value <= bound,
        ">": lambda: value > bound,
        ">=": lambda: value >= bound,
    }[operator]()
