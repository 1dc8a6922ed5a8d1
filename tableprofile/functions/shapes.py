"""Format of a text value: well-known formats first, else its symbolic shape."""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Formats and labels that define the result.
IPV4 = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
MAC = r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"
EMAIL = r"^([a-zA-Z0-9_.+-]+)\@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)$"
FQDN = r"^(?!-)[A-Za-z0-9-]{1,63}(?<!-)(\.[A-Za-z]{2,})+$"
INTERNAL_IP, EXTERNAL_IP = "Internal IP", "External IP"

_ASCII = "".join(chr(i) for i in range(128))


def _ascii_symbol(c: str) -> str:
    if c in string.ascii_uppercase:
        return "A"
    if c in string.ascii_lowercase:
        return "a"
    if c in string.digits:
        return "9"
    if c.isspace() or c == "_":
        return "?"
    return "@"


_ASCII_SYMBOLS = "".join(_ascii_symbol(c) for c in _ASCII)


# White space of every kind; the ASCII separators 28-31 belong to it.
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"


@lru_cache
def _other_digits() -> str:
    """Digits that are not decimal digits, such as superscripts."""
    every = map(chr, range(sys.maxunicode + 1))
    return "".join(c for c in every if c.isdigit() and unicodedata.category(c) != "Nd")


@lru_cache
def _spaces() -> str:
    """The characters of _SPACE."""
    every = map(chr, range(sys.maxunicode + 1))
    return "".join(c for c in every if c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c).startswith("Z"))


def trimmed(value: Column) -> Column:
    """Strip white space of every kind from both ends; plain `trim` only strips blanks."""
    return F.btrim(value, F.lit(_spaces()))


def is_internal_ip(ip: Column) -> Column:
    """10/8, 172.16/12, 192.168/16, 127/8 and 169.254/16."""
    parts = F.split(ip, r"\.")
    a, b = parts[0].cast("int"), parts[1].cast("int")
    return ((a == 10) | (a == 127) | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)))


def known_format(value: Column) -> Column:
    """Label of a trimmed value, null when no format fits.

    Cheap substring tests come before each regex, so that ordinary text pays for none of them.
    """
    short = F.length(value) <= 320
    has_dot = value.contains(".")
    return (
        F.when(has_dot & value.rlike(IPV4),
               F.when(is_internal_ip(value), INTERNAL_IP).otherwise(EXTERNAL_IP))
        .when((F.length(value) == 17) & value.rlike(MAC), "MAC Address")
        .when(has_dot & value.contains("@") & value.rlike(EMAIL), "Email")
        .when(has_dot & (short | ~value.contains(" ")) & value.rlike(FQDN), "FQDN")
    )


def shape(value: Column) -> Column:
    """A per upper-case letter, a per lower-case letter, 9 per digit, @ per symbol, ? for the rest.

    ASCII text (one byte per character) takes a single `translate`; other text a chain of
    character-class replacements, digits first because some digits are neither letters nor
    decimal digits.
    """
    plain = F.translate(value, _ASCII, _ASCII_SYMBOLS)
    cased = r"\p{IsUppercase}\p{IsLowercase}"
    other = F.regexp_replace(value, rf"[\p{{Nd}}{_other_digits()}&&[^{cased}]]", "9")
    other = F.regexp_replace(other, rf"[^\p{{L}}\p{{N}}_{_SPACE}{cased}]", "@")
    other = F.regexp_replace(other, r"\p{IsUppercase}", "A")
    other = F.regexp_replace(other, r"\p{IsLowercase}", "a")
    other = F.regexp_replace(other, r"[^Aa9@]", "?")
    return F.when(F.octet_length(value) == F.length(value), plain).otherwise(other)


def value_pattern(value: Column) -> Column:
    """Pattern of a value: its known format, else its shape."""
    t = trimmed(value)
    return F.coalesce(known_format(t), shape(t))
