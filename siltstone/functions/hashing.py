"""Keys and pseudo-random units that any engine can compute: MD5 of joined strings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rowwise import rowwise
from .text import squashed

SEPARATOR = "\x1f"


def content_key(text: Column) -> Column:
    """What copies have in common: the MD5 of the lower-cased text with its white space squashed."""
    return F.md5(squashed(F.lower(text)).cast("binary"))


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of their MD5."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digits = F.substring(F.md5(F.concat_ws(SEPARATOR, *columns).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def unit_sql(*parts: str) -> str:
    joined = " || chr(31) || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def hash60(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts as a number that arithmetic can't overflow."""
    digits = F.substring(F.md5(F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts]).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def blake_unit(*parts: str) -> float:
    """The same idea with BLAKE2b of eight bytes, for data whose sample was drawn with it."""
    raw = hashlib.blake2b(SEPARATOR.join(parts).encode(), digest_size=8).digest()
    return int.from_bytes(raw, "little") / 2**64


#: BLAKE2b (16 bytes, hex) of the lower-cased, squashed text.
blake_key = rowwise(StringType(), lambda t: hashlib.blake2b(" ".join(t.lower().split()).encode(), digest_size=16).hexdigest())
