"""Keyed hashes and time codes as native columns (RFC 2104, 4226, 6238), and the check of signed messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def _hash(data: Column, kind: str) -> Column:
    """Hash of bytes, as bytes."""
    return F.unhex(F.sha1(data) if kind == "sha1" else F.sha2(data, 256))


def _padded(key: Column, kind: str, mask: int) -> Column:
    """The key, hashed if it is longer than a block, filled up with zeros and with each byte XORed."""
    short = F.when(F.octet_length(key) > BLOCK, _hash(key, kind)).otherwise(key)
    digits = F.rpad(F.hex(short), 2 * BLOCK, "0")
    byte = lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(mask))), 2, "0")), ""))


def hmac(key: Column, message: Column, kind: str = "sha256") -> Column:
    """HMAC of a message, as bytes; key and message are bytes, ``kind`` is sha256 or sha1."""
    inner = _hash(F.concat(_padded(key, kind, 0x36), message), kind)
    return _hash(F.concat(_padded(key, kind, 0x5C), inner), kind)


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def counter_code(key: Column, counter: Column, digits: int = 6, kind: str = "sha1") -> Column:
    """The decimal code of a counter: four bytes at the place that the last nibble names, without the sign."""
    code = F.hex(hmac(key, F.unhex(F.lpad(F.hex(counter.cast("long")), 16, "0")), kind))
    at = F.conv(F.right(code, F.lit(1)), 16, 10).cast("int")
    number = F.conv(F.substr(code, at * 2 + 1, F.lit(8)), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    return F.lpad((number % 10**digits).cast("string"), digits, "0")


def time_code(key: Column, seconds: Column, digits: int = 6, period: int = 30, kind: str = "sha1") -> Column:
    """The code of a moment, in seconds since 1970."""
    return counter_code(key, F.floor(seconds / period), digits, kind)


def time_code_valid(key: Column, given: Column, seconds: Column, drift: int = 1, digits: int = 6, period: int = 30) -> Column:
    """Whether a code is that of the moment or of one of ``drift`` periods beside it."""
    step = F.floor(seconds / period)
    found = F.lit(False)
    for d in range(-drift, drift + 1):
        found = found | (given == counter_code(key, step + d, digits))
    return F.coalesce(found, F.lit(False))


def signed(header: Column, body: Column, key: Column, now: Column, most_age: int = 300) -> Column:
    """Whether a header ``ts=...;h1=...`` signs a body: HMAC-SHA256 of ``ts:body``, not too far from now; h1 may come more than once."""
    parts = F.transform(F.split(header, ";"), lambda p: F.split(p, "="))
    of = lambda name: F.transform(F.filter(parts, lambda p: F.trim(p[0]) == name), lambda p: F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))))
    ts = F.coalesce(F.try_element_at(of("ts"), F.lit(-1)), F.lit(""))
    young = F.abs(now - ts.try_cast("long")) <= most_age
    expected = F.lower(F.hex(hmac(key, F.concat(utf8(ts), utf8(F.lit(":")), utf8(body)))))
    return F.coalesce(ts.rlike("^[0-9]+$") & young & (F.octet_length(key) > 0) & F.exists(of("h1"), lambda h: F.lower(h) == expected), F.lit(False))
