"""Values of JSON read as VARIANT, each only where the JSON has it in its type.

from_json would null a whole array for one bad element and coerce numbers to text; extraction from a variant alone
would coerce text to numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(v: Column, path: str) -> Column:
    """A JSON number as double; null for anything else."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, path, "double"))


def string(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def boolean(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def items(v: Column, path: str) -> Column:
    """A JSON array's elements, each a variant; null where there is no array."""
    return F.try_variant_get(v, path, "array<variant>")


def kind(v: Column, path: str) -> Column:
    """The type of what is there: VOID for a JSON null, null where nothing is."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def whole(v: Column, path: str) -> Column:
    """A JSON integer from 0 to 2^64 - 1 as decimal(20, 0); null for anything else."""
    n = F.try_variant_get(v, path, "decimal(20,0)")
    return F.when(kind(v, path).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$") & (n >= 0) & (n <= F.lit("18446744073709551615").cast("decimal(20,0)")), n)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it and filters are pushed below it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
