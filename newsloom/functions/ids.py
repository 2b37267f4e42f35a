"""Ids that follow from keys, so that a run repeated gives the same ones."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_id(*parts: Column) -> Column:
    """A 60-bit id: the first 15 hex digits of the parts' SHA-256, joined by `|`."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def key_id_sql(*parts: str) -> str:
    """The same as DuckDB SQL."""
    return f"('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 15))::bigint"
