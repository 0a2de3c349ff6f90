"""JSON kept as text. Values are re-spaced, never re-ordered."""

from pyspark.sql import Column, functions as F

# A string literal, a run of other characters, or a separator.
TOKEN = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"\s,:]++|[,:])'


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def spaced(text: Column) -> Column:
    """Same JSON with one blank after each separator outside strings and no other blanks."""
    pieces = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    return F.array_join(F.transform(pieces, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), "")


def quoted(text: Column) -> Column:
    """Text as a JSON string literal."""
    whole = F.to_json(F.array(text))
    return whole.substr(F.lit(2), F.length(whole) - 2)


def items(text: Column) -> Column:
    """Elements of a JSON array (a single value counts as a one-element array), each as JSON text."""
    wrapped = F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return F.from_json(wrapped, "array<string>")


def field(text: Column, name: str) -> Column:
    """A field of a JSON object as text; objects keep their key order."""
    return F.get_json_object(text, f"$.{name}")
