"""Reading untrusted JSON with strict types: the number 5 is not the string '5'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """VARIANT of a JSON text, NULL if it is not JSON."""
    return F.try_parse_json(text)


def kind_at(variant: Column, path: str) -> Column:
    """Type name of the value at a path; NULL where there is none."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def is_object_text(text: Column) -> Column:
    """Whether a JSON text is an object; cheaper than the schema of a large value."""
    return F.coalesce(text.rlike(r"^[ \t\n\r]*\{"), F.lit(False))


def members(df: DataFrame, variant: str) -> DataFrame:
    """One row per member of an object (``key`` set) or element of an array (``key`` NULL)."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(variant).outer()))


def string_at(variant: Column, path: str) -> Column:
    """The value at a path if it is a JSON string, else NULL."""
    value = F.try_variant_get(variant, path, "string")
    return F.when(kind_at(variant, path) == "STRING", value)


def number_at(variant: Column, path: str) -> Column:
    """The value at a path as a double if it is a JSON number, else NULL."""
    kind = kind_at(variant, path)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(numeric, F.try_variant_get(variant, path, "double"))


def error_envelope(body: Column) -> Column:
    """STRUCT<code, message> of a response body's error, each NULL unless it is a string."""
    parsed = parse(body)
    return F.struct(
        string_at(parsed, "$.error.code").alias("code"),
        string_at(parsed, "$.error.message").alias("message"),
    )


def created_id(body: Column) -> Column:
    """Non-empty string ``id`` of a response body, else NULL."""
    return F.nullif(string_at(parse(body), "$.id"), F.lit(""))
