"""Widths and costs of the compact forms, as Column expressions and as Python twins for the planner.

Sizes follow the packet format: a prefix varint, zigzagged signed numbers, packed integers of one width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: largest number of each varint width.
VARINT_LIMITS = ((191, 1), (8383, 2), (1056959, 3), (4294967295, 5))
VARINT_WIDEST = 9
#: Fixed values of the format: (low, high, bytes) of a tagged whole number.
INTEGER_COSTS = ((0, 31, 1), (-128, 255, 2), (-32768, 65535, 3), (-2147483648, 4294967295, 5))
INTEGER_WIDEST = 10
#: Fixed values of the format: widest packed integer, bounds of the numbers that forms accept, bytes that name a form in a plan.
WIDEST_PACKED = 45
LARGEST_DIFFERENCED = 2**52
SAFE_INTEGER = 2**53
DEFINITION_BYTES = 4
#: Fixed values of the format: steps that have a one-byte code after the powers of ten.
EXTRA_PRECISIONS = (0.5, 0.25, 0.2, 0.05, 0.025, 0.02, 0.005, 0.0025, 0.002)


# --- Columns --------------------------------------------------------------------------------------------------


def zigzag(x: Column) -> Column:
    return F.when(x < 0, -2 * x - 1).otherwise(2 * x)


def unzigzag(z: Column) -> Column:
    return F.when(F.pmod(z, F.lit(2)) == 1, -F.shiftright(z, 1) - 1).otherwise(F.shiftright(z, 1))


def bits_for(span: Column) -> Column:
    """Bits that hold 0..span, at least one; exact at powers of two."""
    return F.greatest(F.lit(1), F.length(F.bin(span.cast("long")))).cast("long")


def bits_for_count(count: Column) -> Column:
    """Bits of an id below ``count``, at least one."""
    return bits_for(F.greatest(count - 1, F.lit(0)))


def varint_width(x: Column) -> Column:
    out = F.lit(VARINT_WIDEST)
    for limit, width in reversed(VARINT_LIMITS):
        out = F.when(x <= limit, width).otherwise(out)
    return out.cast("long")


def zigzag_width(x: Column) -> Column:
    return varint_width(zigzag(x))


def integer_cost(x: Column) -> Column:
    out = F.lit(INTEGER_WIDEST)
    for low, high, width in reversed(INTEGER_COSTS):
        out = F.when((x >= low) & (x <= high), width).otherwise(out)
    return out.cast("long")


def packed_bytes(count: Column, bits: Column) -> Column:
    """Whole bytes of ``count`` numbers of ``bits`` bits; integer arithmetic only."""
    return F.floor((count * bits + 7) / 8).cast("long")


def round_half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(-x + 0.5))


def number_tag(x: Column) -> Column:
    """Narrowest exact form of a double."""
    whole = F.floor(x) == x
    ranges = ((0, 31, "small"), (0, 255, "u8"), (0, 65535, "u16"), (0, 4294967295, "u32"), (0, SAFE_INTEGER, "varint"), (-128, -1, "i8"), (-32768, -1, "i16"), (-2147483648, -1, "i32"), (-SAFE_INTEGER, -1, "neg_varint"))
    out = F.when(x.cast("float").cast("double") == x, "f32").otherwise("f64")
    for low, high, name in reversed(ranges):
        out = F.when(whole & (x >= low) & (x <= high), name).otherwise(out)
    out = F.when((x == 0) & (x.cast("string") == "-0.0"), "neg_zero").otherwise(out)
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "neg_inf").otherwise(out)


def quantize(x: Column, step: float) -> Column:
    return round_half_away(x / F.lit(step)).cast("long")


def dequantize(q: Column, step: float) -> Column:
    return q * F.lit(step)


def field_changed(a: Column, b: Column, fractional: bool = True) -> Column:
    """Null-safe inequality; of fractional numbers it tells 0 from -0 and takes NaN as equal to itself."""
    if not fractional:
        return ~a.eqNullSafe(b)
    sign = (a == 0) & (b == 0) & (a.cast("string") != b.cast("string"))
    return ~a.eqNullSafe(b) | F.coalesce(sign, F.lit(False))


def worthwhile(x: Column, step: float) -> Column:
    """A quantized number pays if it is finite and its zigzag varint is shorter than four bytes."""
    scaled = x / F.lit(step)
    sound = ~F.isnan(x) & (F.abs(scaled) < float(SAFE_INTEGER))
    return F.coalesce(sound & (zigzag_width(F.when(sound, F.floor(F.abs(scaled) + 0.5)).cast("long")) < 4), F.lit(False))


def vector_worthwhile(parts: list[Column], step: float) -> Column:
    """A vector is quantized only if each of its components pays."""
    out = F.lit(True)
    for x in parts:
        out = out & worthwhile(x, step)
    return out


def integral_components(parts: list[Column]) -> Column:
    """All components are whole and take at most three bytes."""
    out = F.lit(True)
    for x in parts:
        out = out & F.coalesce((F.floor(x) == x) & (F.abs(x) <= VARINT_LIMITS[2][0]), F.lit(False))
    return out


def color_bytes(parts: list[Column]) -> Column:
    """Components in 0..1 as bytes, or null if one does not come back exactly at 32-bit precision."""
    exact, out = F.lit(True), []
    for x in parts:
        byte = round_half_away(x.cast("double") * 255)
        exact = exact & F.coalesce((byte >= 0) & (byte <= 255) & ((byte / 255.0).cast("float") == x.cast("float")), F.lit(False))
        out.append(byte.cast("int"))
    return F.when(exact, F.array(*out))


# --- Python twins ---------------------------------------------------------------------------------------------


def py_zigzag(x: int) -> int:
    return -2 * x - 1 if x < 0 else 2 * x


def py_bits(span: int) -> int:
    return max(1, int(span).bit_length())


def py_varint_width(x: int) -> int:
    return next((w for limit, w in VARINT_LIMITS if x <= limit), VARINT_WIDEST)


def py_zigzag_width(x: int) -> int:
    return py_varint_width(py_zigzag(x))


def py_integer_cost(x: int) -> int:
    return next((w for low, high, w in INTEGER_COSTS if low <= x <= high), INTEGER_WIDEST)


def py_packed_bytes(count: int, bits: int) -> int:
    return (count * bits + 7) // 8


def precision_code(step: float) -> int | None:
    """One-byte code of a step: 10^-n for n 0..12, then the extra ones."""
    for n in range(13):
        if 10.0**-n == step:
            return n
    return 13 + EXTRA_PRECISIONS.index(step) if step in EXTRA_PRECISIONS else None


def precision_from_code(code: int) -> float:
    if code < 13:
        return 10.0**-code
    if code - 13 >= len(EXTRA_PRECISIONS):
        raise ValueError(f"unknown precision code {code}")
    return EXTRA_PRECISIONS[code - 13]


def quantize_worthwhile(x: float, step: float) -> bool:
    """Python twin of ``worthwhile``."""
    scaled = x / step
    return x == x and abs(scaled) < SAFE_INTEGER and py_zigzag_width(int(abs(scaled) + 0.5)) < 4
