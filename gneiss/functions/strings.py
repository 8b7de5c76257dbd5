"""Strings and bits of one value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.lists import clamped


def getrange(c: Column, start: int, end: int) -> Column:
    """GETRANGE, SUBSTR: bytes start to end, inclusive; negative positions count from the end. The result is a string
    of exactly these bytes, which may begin or end within a character."""
    raw = c.cast("binary")
    n = F.octet_length(raw)
    low, high = clamped(start, n), F.least(F.lit(end) if end >= 0 else n + end, n - 1)
    empty = F.lit(start < 0 and end < 0 and start > end) | (low > high)
    return F.when(empty, "").otherwise(F.substring(raw, low + 1, high - low + 1).cast("string"))


def setrange(c: Column, offset: int, value: str | bytes) -> Column:
    """SETRANGE: the value's bytes over what is there from a byte on; what is missing before it is zero bytes."""
    value = value.encode() if isinstance(value, str) else value
    if not value:
        return c
    raw = F.coalesce(c.cast("binary"), F.lit(b""))
    start = F.rpad(F.substring(raw, 1, offset), offset, F.lit(b"\0"))
    return F.concat(start, F.lit(value), F.substring(raw, offset + len(value) + 1, 2**30)).cast("string")


def append(c: Column, value: str | Column) -> Column:
    """APPEND; a missing string is empty."""
    return F.concat(F.coalesce(c, F.lit("")), F.lit(value) if isinstance(value, str) else value)


def strlen(c: Column) -> Column:
    """STRLEN: bytes; 0 if missing."""
    return F.coalesce(F.octet_length(c), F.lit(0))


def lcs_of(a: str, b: str) -> str:
    """The longest common subsequence. Rows of the table are bit sets, so it takes len(b) big-integer steps."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows, v = [full], full
    for y in b:
        hit = v & places.get(y, 0)
        v = ((v + hit) | (v - hit)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    length = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


def matches_of(a: str, b: str, min_length: int = 0) -> list[tuple[int, int, int, int, int]]:
    """The stretches of lcs_of as (a from, a to, b from, b to, length), the last one first."""
    common, out, i, j = lcs_of(a, b), [], len(a), len(b)
    k = len(common)
    while k:
        i, j = a.rindex(common[k - 1], 0, i), b.rindex(common[k - 1], 0, j)
        n = 1
        while k - n and i - n >= 0 and j - n >= 0 and a[i - n] == b[j - n] == common[k - n - 1]:
            n += 1
        i, j, k = i - n + 1, j - n + 1, k - n
        if n >= min_length:
            out.append((i, i + n - 1, j, j + n - 1, n))
    return out


def lcs(a: Column, b: Column) -> Column:
    """LCS: the common subsequence; F.length of it is LCS ... LEN. Null if either is."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else lcs_of(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def lcs_idx(a: Column, b: Column, min_length: int = 0) -> Column:
    """LCS ... IDX MINMATCHLEN: the stretches, as structs (a_from, a_to, b_from, b_to, length)."""

    @F.pandas_udf("array<struct<a_from:int,a_to:int,b_from:int,b_to:int,length:int>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        names = ("a_from", "a_to", "b_from", "b_to", "length")
        return pd.Series([None if p is None or q is None else [dict(zip(names, m, strict=True)) for m in matches_of(p, q, min_length)] for p, q in zip(x, y, strict=True)])

    return run(a, b)


def getbit(c: Column, offset: int) -> Column:
    """GETBIT of a string: bits of its bytes, the high bit of a byte first; 0 beyond its end."""
    byte = F.conv(F.hex(F.substring(c.cast("binary"), offset // 8 + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 7 - offset % 8).bitwiseAND(F.lit(1)), F.lit(0))


def setbit(c: Column, offset: int, bit: int) -> Column:
    """SETBIT of a string, as binary, zero bytes added as needed."""
    raw, at = F.coalesce(F.hex(c.cast("binary")), F.lit("")), offset // 8
    padded = F.rpad(raw, 2, "0") if at == 0 else F.when(F.length(raw) < 2 * at + 2, F.rpad(raw, 2 * at + 2, "0")).otherwise(raw)
    padded = F.when(F.length(raw) >= 2 * at + 2, raw).otherwise(padded)
    byte = F.conv(F.substring(padded, 2 * at + 1, 2), 16, 10).cast("int")
    mask = 1 << (7 - offset % 8)
    changed = byte.bitwiseOR(F.lit(mask)) if bit else byte.bitwiseAND(F.lit(0xFF ^ mask))
    return F.unhex(F.concat(F.substring(padded, 1, 2 * at), F.lpad(F.hex(changed), 2, "0"), F.substring(padded, 2 * at + 3, 2**30)))


def bits(c: Column) -> Column:
    """A string's bits as text of 0 and 1."""
    pairs = F.regexp_extract_all(F.hex(c.cast("binary")), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")), "")


def bit_range(c: Column, start: int, end: int, unit: str) -> tuple[Column, Column]:
    """(bits from start to end, bits before them); start and end count bytes or bits, negative ones from the end."""
    own, size = bits(c), 8 if unit == "byte" else 1
    n = F.length(own) if size == 1 else F.octet_length(c.cast("binary"))
    low, high = clamped(start, n), F.least(F.lit(end) if end >= 0 else n + end, n - 1)
    return F.when(low <= high, F.substring(own, low * size + 1, (high - low + 1) * size)).otherwise(""), low * size


def bitpos(c: Column, bit: int, start: int = 0, end: int | None = None, unit: str = "byte") -> Column:
    """BITPOS: the first 0 or 1 bit from start to end; -1 if there is none. Without an end a string of ones goes on with
    zeros."""
    own, before = bit_range(c, start, -1 if end is None else end, unit)
    at = F.instr(own, str(bit)) - 1
    none = F.octet_length(c.cast("binary")) * 8 if bit == 0 and end is None else F.lit(-1)
    return F.when(at >= 0, at + before).otherwise(none)


def bitcount(c: Column, start: int = 0, end: int = -1, unit: str = "byte") -> Column:
    """BITCOUNT of a string, or of its bytes or bits from start to end."""
    return F.length(F.replace(bit_range(c, start, end, unit)[0], F.lit("0"), F.lit("")))


def bytes_of(c: Column) -> Column:
    """A string's bytes as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.coalesce(c.cast("binary"), F.lit(b""))), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def of_bytes(c: Column) -> Column:
    """The binary value of an array of numbers."""
    return F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def bitop(op: str, *columns: Column) -> Column:
    """BITOP AND, OR, XOR, NOT over byte strings, as binary; shorter ones, and missing ones, go on with zero bytes."""
    if op.lower() == "not":
        if len(columns) != 1:
            raise ValueError("not takes one string")
        return of_bytes(F.transform(bytes_of(columns[0]), lambda x: 255 - x))
    own = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "xor": Column.bitwiseXOR}[op.lower()]
    out = bytes_of(columns[0])
    for c in columns[1:]:
        out = F.zip_with(out, bytes_of(c), lambda x, y: own(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
    return of_bytes(out)


def field_type(kind: str) -> tuple[bool, int]:
    """(signed, width) of u1 to u63 and i1 to i64."""
    width = int(kind[1:])
    if kind[0] not in "iu" or not 1 <= width <= (64 if kind[0] == "i" else 63):
        raise ValueError(f"no bit field type {kind}")
    return kind[0] == "i", width


def field_get(c: Column, kind: str, offset: int) -> Column:
    """BITFIELD GET of a byte string, the high bit of the first byte at offset 0; bits beyond the end are 0."""
    signed, width = field_type(kind)
    own = F.rpad(F.substring(F.coalesce(bits(c), F.lit("")), offset + 1, width), width, "0")
    raw = F.conv(own, 2, 10).cast("decimal(20,0)")
    return (F.when(raw >= big(1 << (width - 1)), raw - big(1 << width)).otherwise(raw) if signed else raw).cast("long")


def field_set(c: Column, kind: str, offset: int, value: Column | int) -> Column:
    """BITFIELD SET of a byte string, as binary; it is made longer by zero bytes if need be."""
    _, width = field_type(kind)
    size = -(-(offset + width) // 8) * 8
    own, value = F.coalesce(bits(c), F.lit("")), F.lit(value) if isinstance(value, int) else value
    own = F.when(F.length(own) < size, F.rpad(own, size, "0")).otherwise(own)
    wanted = F.substring(F.lpad(F.bin(value.cast("long")), 64, "0"), 65 - width, width)
    changed = F.concat(F.substring(own, 1, offset), wanted, F.substring(own, offset + width + 1, 2**30))
    return of_bytes(F.transform(F.regexp_extract_all(changed, F.lit("(.{8})"), F.lit(1)), lambda x: F.conv(x, 2, 10).cast("int")))


def field_incr(c: Column, kind: str, offset: int, by: int, overflow: str = "wrap") -> tuple[Column, Column]:
    """BITFIELD INCRBY with OVERFLOW wrap, sat or fail: (binary, value after, null if it fails, which changes nothing)."""
    signed, width = field_type(kind)
    value = bitfield_incr(field_get(c, kind, offset), by, width, overflow, signed)
    return F.when(value.isNull(), F.coalesce(c.cast("binary"), F.lit(b""))).otherwise(field_set(c, kind, offset, value)), value


def tokens(c: Column, separator: str) -> Column:
    """The parts of a text between separators, without empty ones."""
    return F.filter(F.split(c, separator_pattern(separator)), lambda x: x != "")


def token(c: Column, separator: str, n: int) -> Column:
    """The n-th part from 0, empty ones counted; the empty text if there are fewer."""
    return F.coalesce(F.get(F.split(c, separator_pattern(separator)), n), F.lit(""))


def separator_pattern(separator: str) -> str:
    return "".join(x if x.isalnum() else "\\" + x for x in separator)


def join(parts: Column, separator: str) -> Column:
    """The parts as one text."""
    return F.array_join(parts, separator)


def trim(c: Column, characters: str = " ") -> Column:
    """Without these characters at both ends."""
    return F.btrim(c, F.lit(characters))


def bitfield_get(c: Column, width: int, offset: int, signed: bool = False) -> Column:
    """BITFIELD GET of an integer column, the low bit at offset 0."""
    raw = F.shiftright(c.cast("long"), offset).bitwiseAND(F.lit((1 << width) - 1))
    return F.when(raw >= 1 << (width - 1), raw - (1 << width)).otherwise(raw) if signed else raw


def bitfield_set(c: Column, width: int, offset: int, value: int) -> Column:
    """BITFIELD SET of an integer column."""
    mask = ((1 << width) - 1) << offset
    return c.cast("long").bitwiseAND(F.lit(~mask)).bitwiseOR(F.lit((value & ((1 << width) - 1)) << offset))


def bitfield_incr(c: Column, by: int, width: int, overflow: str = "wrap", signed: bool = True) -> Column:
    """BITFIELD INCRBY of a value of this width: wrap around, stay at the limit (sat), or null (fail)."""
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    to = c.cast("decimal(38,0)") + big(by)
    low, high, size = big(low), big(high), big(1 << width)
    out = {"wrap": F.pmod(to - low, size) + low, "sat": F.greatest(low, F.least(high, to)), "fail": F.when((to >= low) & (to <= high), to)}
    return out[overflow].cast("long")


def big(n: int) -> Column:
    """A whole number of any size up to 38 digits."""
    return F.lit(str(n)).cast("decimal(38,0)")
