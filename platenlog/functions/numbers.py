"""Integer rules: wrap-around, units, paging, big-endian bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platenlog.functions.codes import PAGE_SIZE


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def wrap_i32(n: Column | str) -> Column:
    """The low 32 bits of a BIGINT read as a signed integer (a cast would raise under ANSI)."""
    low = _col(n).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return (low - low.bitwiseAND(F.lit(0x80000000)) * 2).cast("int")


def as_u32(n: Column | str) -> Column:
    """The low 32 bits of a BIGINT read as an unsigned integer."""
    return _col(n).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))


def k_octets(n: Column | str) -> Column:
    """Size in K octets: whole kibibytes, at least one."""
    size = _col(n).cast("bigint")
    return F.when(size.isNotNull(), F.greatest(F.lit(1).cast("bigint"), F.shiftright(size, 10)))


def pages(n: Column | str, size: int = PAGE_SIZE) -> Column:
    """Number of listing pages, never less than one."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(_col(n) / F.lit(size)).cast("bigint"))


def human_size(n: Column | str) -> Column:
    """Whole bytes, KB or MB; there is no larger unit."""
    size = _col(n).cast("bigint")
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.shiftright(size, 10).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.shiftright(size, 20).cast("string"), F.lit(" MB")))
    )


def be_uint(value: Column | str) -> Column:
    """Unsigned big-endian integer held in one, two or four bytes."""
    return F.conv(F.hex(_col(value)), 16, 10).cast("bigint")


def be_int(value: Column | str, width: int = 4) -> Column:
    """Signed (two's complement) big-endian integer held in ``width`` bytes."""
    unsigned = be_uint(value)
    return F.when(unsigned >= 1 << (8 * width - 1), unsigned - (1 << (8 * width))).otherwise(unsigned)


def code_hex(n: Column | str) -> Column:
    """Name for a code that has none."""
    return F.format_string("unknown-0x%04x", _col(n))
