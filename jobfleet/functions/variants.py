"""Small helpers over VARIANT values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_at(value: Column, path: str, kind: str) -> Column:
    """The value at a path cast to ``kind``; null when absent or of another kind."""
    return F.try_variant_get(value, path, kind)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def text_at(value: Column, path: str) -> Column:
    """A string value at a path; numbers, booleans and the like give null."""
    found = value_at(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", found.cast("string"))


def text_of(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def strict_json(text: Column) -> Column:
    """JSON text as a variant; null when it is malformed or more than one value.

    The parser stops after the first value, so the text is read as the only
    element of an array and as the only member of an object. Text that closes
    one of the two early is an error in the other.
    """
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"only":'), text, F.lit("}")))
    alone = value_at(element, "$[1]", "variant").isNull() & member.isNotNull()
    return F.when(alone, value_at(element, "$[0]", "variant"))
