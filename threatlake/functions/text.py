"""String helpers shared by extraction, scoring and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import catalog

EMPTY_STRINGS = "array<string>"


def collect_when(pairs: list[tuple[Column, Column]], array_type: str) -> Column:
    """Array of the values whose condition holds, in the given order.

    Built from `concat`, which stays inside whole-stage code generation; the
    higher-order `filter` would not.
    """
    empty = F.array().cast(array_type)
    return F.concat(*[F.when(cond, F.array(value)).otherwise(empty) for cond, value in pairs])


def fixed(value: Column, places: int) -> Column:
    """Number with a fixed count of decimals, rounded half-even on the exact binary value."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def basename(path: Column) -> Column:
    """Last component of a Windows or POSIX path."""
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1 << 30)))


def truncate(content: Column, length: int, mark: str = "") -> Column:
    """First `length` characters; `mark` is appended only when something was cut off."""
    cut = F.left(content, F.lit(length))
    if not mark:
        return cut
    return F.when(F.length(content) > length, F.concat(cut, F.lit(mark))).otherwise(cut)


def has_any(lowered: Column, literals: tuple[str, ...]) -> Column:
    cond = F.lit(False)
    for i, literal in enumerate(literals):
        hit = lowered.contains(literal)
        cond = hit if i == 0 else cond | hit
    return cond


def is_plain_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def regex(pattern: str) -> str:
    """Case-insensitive search pattern."""
    return catalog.FLAGS + pattern


def unicode_regex(pattern: str) -> str:
    """The same with Unicode meaning of the classes; slower, for lines that are not plain ASCII."""
    return catalog.UNICODE_FLAGS + pattern


def by_alphabet(column: Column, make: Callable[[Callable[[str], str]], Column]) -> Column:
    """`make` of the ASCII patterns for plain values, of the Unicode ones for all others.

    `make` takes the function that turns a pattern into a regex.  White space, digits and word
    characters beyond ASCII count as such, so no-break spaces do not hide a match.
    """
    return F.when(is_plain_ascii(column), make(regex)).otherwise(make(unicode_regex))


def matches(column: Column, pattern: str) -> Column:
    return by_alphabet(column, lambda form: column.rlike(form(pattern)))


def non_empty(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter on costly derived columns that is not pushed below them.

    The optimizer would inline such columns into a pushed filter, and so compute
    them twice; a generator over a zero- or one-element array stays in place.
    """
    return df.withColumn("_kept", F.explode(F.when(condition, F.array(F.lit(True))))).drop("_kept")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that later filters and projections refer to, not repeat.

    The value stands in a projection of its own, which is compiled; a generator is interpreted in large stages.
    """
    kept = [c for c in df.columns if c != name]
    staged = df.select(*kept, value.alias("_once"))
    return staged.select(*kept, F.explode(F.array("_once")).alias(name))
