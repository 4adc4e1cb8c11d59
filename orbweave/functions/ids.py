"""Identifiers as values: UUIDs in any notation, cleaned registry codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX32 = "^[0-9a-f]{32}$"
CANONICAL = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def squeeze(c: Column) -> Column:
    """Text without white space (no-break and zero-width included) at either end."""
    return F.regexp_replace(c, r"^[\s ​﻿]+|[\s ​﻿]+$", "")


def uuid_value(c: Column) -> Column:
    """The lower-case hyphenated form of a UUID in any notation (braces, urn:uuid:, no hyphens, spaces); null for other text."""
    # most are in that form already, and the rest of the work is done for the others only
    h = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s ​﻿]*(urn:uuid:)?\{?|\}?[\s ​﻿]*$", ""), "-", "")
    parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(c.rlike(CANONICAL), c).when(h.rlike(HEX32), parts)


def reference_key(c: Column) -> Column:
    """A reference as a comparable key: the UUID's value, else the squeezed lower-case text; null if blank."""
    text = F.lower(squeeze(c))
    return F.when(c.rlike(CANONICAL), c).when(text != "", F.coalesce(uuid_value(c), text))
