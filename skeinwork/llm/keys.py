"""Short reversible forms of identifiers, so that shuffles carry 16 bytes instead of 36 characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def pack(key: Column) -> Column:
    """Binary form of a text key: 16 bytes for a lower-case UUID, else a marker and the UTF-8 bytes (never 16 long)."""
    key = key.cast("string")
    other = F.concat(F.when(F.octet_length(key) == 15, F.unhex(F.lit("0202"))).otherwise(F.unhex(F.lit("01"))), F.encode(key, "UTF-8"))
    return F.when(key.rlike(_UUID), F.unhex(F.translate(key, "-", ""))).otherwise(other)


def unpack(packed: Column) -> Column:
    """The text key of a packed one."""
    h = F.lower(F.hex(packed))
    uuid = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    marker = F.when(h.substr(1, 2) == "02", 2).otherwise(1)
    return F.when(F.octet_length(packed) == 16, uuid).otherwise(F.decode(F.substring(packed, marker + 1, F.octet_length(packed)), "UTF-8"))
