"""String helpers built from native functions only."""

from pyspark.sql import Column, functions as F


def replace_first(text: Column, needle: str, value: Column) -> Column:
    """Replace the first occurrence of a literal."""
    at = F.instr(text, needle)
    return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), value,
                                   text.substr(at + len(needle), F.length(text)))).otherwise(text)


def occurrences(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace (blank, tab, newline, return, form feed, vertical tab)."""
    return F.trim(text, F.lit(" \t\n\r\f\u000b"))


def truthy(text: Column) -> Column:
    """Null for null or empty text, else the text."""
    return F.when(F.length(text) > 0, text)


def joined(items: Column, sep: str = ",") -> Column:
    """Array as one string, for reports and comparisons."""
    return F.array_join(items.cast("array<string>"), sep)


def digest(items: Column) -> Column:
    """md5 of an array written with commas."""
    return F.md5(joined(items))
