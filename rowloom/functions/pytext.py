"""Values as the text a Python format call would print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALLEST_NORMAL = 2.2250738585072014e-308
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _shortest(value: Column) -> Column:
    """The shortest digits that read back as the same double, as ``d.ddde+xx``.

    Up to 15 digits are unique where doubles have full precision. With 16, rounding may end beside a power of two or beside the
    digits that read back, so the neighbours are tried as well; 17 always read back. Below the smallest
    normal double fewer digits do, and each length is tried.
    """

    def back(digits: Column) -> Column:
        return F.when(digits.try_cast("double") == value, digits)

    def rounded(digits: int) -> Column:
        return F.format_string(f"%.{digits - 1}e", value)

    sixteen = rounded(16)
    whole = F.regexp_replace(sixteen, r"[-.]|e.*", "").try_cast("bigint")
    power = F.substring_index(sixteen, "e", -1).try_cast("int")
    sign = F.when(value < 0, "-").otherwise("")

    def written(digits: Column, exponent: Column) -> Column:
        return F.concat(sign, F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 17), F.format_string("e%+03d", exponent))

    def beside(by: int) -> Column:
        text = (whole + by).cast("string")
        return written(text, power + F.length(text) - 16)

    # Whole numbers of 17 to 19 digits are rounded exactly; half-way between two texts the even one is taken.
    size = F.abs(value)
    integer = (size >= 1e17) & (size < 1e21)
    # By way of a whole number, as a decimal is made from the digits that the JVM prints; from 2^62 on doubles are multiples of 1,024.
    small_number, large_number = size < 9e18, (size / 1024).cast("bigint").cast("decimal(20,0)") * F.lit(1024).cast("decimal(4,0)")
    exact = F.when(integer & small_number, size.cast("bigint").cast("decimal(24,0)")).when(integer, large_number.cast("decimal(24,0)"))
    length = F.length(exact.cast("string"))

    def whole_rounded(digits: int) -> Column:
        tens = F.element_at(F.array(*[F.lit(10**k).cast("decimal(6,0)") for k in range(6)]), length - digits + 1)
        text = F.bround(exact / tens, 0).cast("decimal(24,0)").cast("string")
        return written(text, F.length(text) - 1 + length - digits)

    near = F.when(integer, whole_rounded(16)).otherwise(sixteen)
    last = F.when(integer, whole_rounded(17)).otherwise(rounded(17))
    normal = F.coalesce(back(rounded(15)), back(near), back(sixteen), back(beside(1)), back(beside(-1)), last)
    small = F.coalesce(*[back(rounded(n)) for n in range(1, 17)], rounded(17))
    return F.when(F.abs(value) < SMALLEST_NORMAL, small).otherwise(normal)


def _float_text(value: Column) -> Column:
    plain, size = value.cast("string"), F.abs(value)
    digits = _shortest(value)
    # The JVM writes an exponent from 1e7 on and below 1e-3, where Python still writes all digits.
    whole = F.regexp_replace(digits.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.replace(F.lower(F.regexp_replace(digits, r"\.?0*e", "e")), F.lit("infinity"), F.lit("inf"))
    return (
        F.when((size >= 1e-3) & (size < 1e7) & (F.length(plain) < 16) | (value == 0), plain)
        .when((size >= 1e-4) & (size < 1e16), whole)
        .when(value.isNotNull(), power)
    )


def pystr(value: Column, kind: T.DataType) -> Column:
    """``str(value)``: None for null, True/False for booleans, Python's float notation."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "True").otherwise("False")
        return F.when(value.isNull(), "None").otherwise(text)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _float_text(value.cast("double"))
    elif isinstance(kind, (T.StringType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)) or isinstance(
        kind, _WHOLE
    ):
        text = value.cast("string")
    else:
        raise TypeError(f"no text form for a placeholder of type {kind.simpleString()}")
    return F.coalesce(text, F.lit("None"))
