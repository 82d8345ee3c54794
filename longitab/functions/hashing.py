"""Seeded hashes of row keys, in place of ``rand``.

``rand(seed)`` depends on how rows fall into partitions, so a retried or re-planned stage
could draw other numbers. A hash of the key gives the same draw wherever the row is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(key, seed) -> Column:
    """md5 of ``key|seed`` as 32 hex digits; ``key`` is a name or a list of names.

    Of several keys, ``\\`` and ``|`` inside a part are escaped and a null part is ``\\N``, so that
    no two lists of keys read the same."""
    keys = [key] if isinstance(key, (str, Column)) else list(key)
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    if len(parts) > 1:
        parts = [F.coalesce(F.regexp_replace(p, r"([\\|])", r"\\$1"), F.lit("\\N")) for p in parts]
    else:
        parts = [F.coalesce(p, F.lit("\\N")) for p in parts]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def unit_hash(key, seed) -> Column:
    """Uniform draw in [0, 1) from the first eight hex digits of ``hash_hex``."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


