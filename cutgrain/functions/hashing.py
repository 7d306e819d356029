"""64-bit FNV-1a without a UDF. Spark has no unsigned 64-bit integer, so hashes are decimal(20, 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASIS = "14695981039346656037"
PRIME = 1099511628211


def fnv1a(data: Column, start: str = BASIS) -> Column:
    """Of a binary column. Only the low byte meets the next one in the xor; the product is taken modulo 2^64."""
    hexes = F.hex(data)
    wide = "decimal(38,0)"
    two32 = F.lit("4294967296").cast(wide)

    def step(h: Column, i: Column) -> Column:
        b = F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        low = (h % 256).cast("int")
        x = (h - low + low.bitwiseXOR(b)).cast(wide)
        # x * (2^40 + 435): both halves stay below 38 digits
        top = (x % F.lit("16777216").cast(wide)).cast("decimal(20,0)") * F.lit("1099511627776").cast("decimal(14,0)")
        return ((top.cast(wide) + (x.cast("decimal(20,0)") * F.lit(435).cast("decimal(3,0)")).cast(wide)) % (two32.cast("decimal(10,0)") * two32.cast("decimal(10,0)")).cast(wide)).cast("decimal(20,0)")

    n = F.octet_length(data)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(places, F.lit(start).cast("decimal(20,0)"), step)
