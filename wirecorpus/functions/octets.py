"""Reading big-endian integers in octets, writing them as hex text, and the internet checksum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def quotient(value: Column, divisor: Column | int) -> Column:
    """Integer division in BIGINT; ``/`` would go through DOUBLE."""
    return F.call_function("div", value, divisor if isinstance(divisor, Column) else F.lit(divisor))


def uint_at(binary: Column, start: Column | int, octets: int) -> Column:
    """Unsigned integer of ``octets`` octets at a 0-based octet offset; the octets must reach that far.

    A cut of octets costs the same at any place, where a cut of text counts its characters first.
    """
    start = start if isinstance(start, Column) else F.lit(start)
    return F.conv(F.hex(F.substr(binary, start + 1, F.lit(octets))), 16, 10).cast("bigint")


def words_at(name: str, binary: Column, start: Column, n: int, given: Column) -> dict[str, Column]:
    """Columns of ``n`` successive unsigned integers of four octets, null unless ``given``; for ``part_of``."""
    return {f"{name}{4 * i}": F.when(given, uint_at(binary, start + 4 * i, 4)) for i in range(n)}


def part_of(name: str, start: int, octets: int) -> Column:
    """Unsigned integer of octets that lie in one word of ``words_at``."""
    word = F.col(f"{name}{start // 4 * 4}")
    if octets == 4:
        return word
    return F.shiftright(word, 8 * (4 - start % 4 - octets)).bitwiseAND(F.lit((1 << 8 * octets) - 1))


def hex_digits(value: Column, octets: int) -> Column:
    """Zero-padded hex of a non-negative integer, in upper case."""
    return F.lpad(F.hex(value.cast("bigint")), octets * 2, "0")


def bit(value: Column, position: int) -> Column:
    return F.shiftright(value, position).bitwiseAND(F.lit(1)).cast("int")


def ipv4_text(word: Column) -> Column:
    """Dotted text of an address as an unsigned integer."""
    octet = lambda i: F.shiftright(word, 24 - 8 * i).bitwiseAND(F.lit(255))
    return F.concat_ws(".", *[octet(i).cast("string") for i in range(4)])


def ipv4_hex(parts: Column) -> Column:
    """Hex of an address whose dotted text is split into ``parts``."""
    return F.concat(*[hex_digits(parts[i].cast("int"), 1) for i in range(4)])


def mac_text(octets: Column) -> Column:
    """Lower-case text of the first six octets."""
    return F.lower(F.concat_ws(":", *[F.hex(F.substring(octets, 1 + i, 1)) for i in range(6)]))


def halves(value: Column) -> Column:
    """Sum of the two 16-bit halves of a 32-bit integer."""
    return F.shiftright(value, 16) + value.bitwiseAND(F.lit(65535))


def address_words(parts: Column) -> Column:
    """Sum of the two 16-bit words of an IPv4 address, split as for ``ipv4_hex``."""
    octet = lambda i: parts[i].cast("bigint")
    return (octet(0) + octet(2)) * 256 + octet(1) + octet(3)


def words_sum(hex_text: Column) -> Column:
    """Sum of the 16-bit words of a hex text of whole words."""
    words = F.regexp_extract_all(hex_text, F.lit("(.{4})"), 1)
    add = lambda total, word: total + F.conv(word, 16, 10).cast("bigint")
    return F.aggregate(words, F.lit(0).cast("bigint"), add)


# A sum of words folded with end-around carry is congruent modulo 65535; the fold of a positive
# sum is never zero. Written this way the sum is evaluated once.
def internet_checksum(total: Column) -> Column:
    """One's complement of a folded positive sum of 16-bit words."""
    return F.lit(65534) - (total - 1) % 65535


def udp_checksum(total: Column) -> Column:
    """The same, with a result of zero sent as all ones."""
    return F.lit(65535) - total % 65535


def seconds_text(micros: Column) -> Column:
    """Microseconds as decimal seconds with nine digits after the point."""
    size = F.abs(micros)
    whole = quotient(size, 1_000_000).cast("string")
    part = F.lpad((size % 1_000_000).cast("string"), 6, "0")
    return F.concat(F.when(micros < 0, "-").otherwise(""), whole, F.lit("."), part, F.lit("000"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    A projection may be merged into every expression and filter above it, which multiplies the
    work when a value is read many times; a generator is not.
    """
    made = [c.alias(name) for name, c in columns.items()]
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*made))))
