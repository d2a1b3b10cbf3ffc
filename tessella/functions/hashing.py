"""Stable ids and sampling keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(*parts: Column | str, digits: int = 64, sep: str = ":") -> Column:
    """The first hexadecimal digits of SHA-256 over the joined parts."""
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, digits)


def sampling_key(seed: str, value: Column) -> Column:
    """SHA-256 of ``seed:value``: an order that looks random and never changes."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID of version 5."""
    head = uuid.UUID(namespace).bytes.hex()
    digest = F.sha1(F.concat(F.unhex(F.lit(head)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )
