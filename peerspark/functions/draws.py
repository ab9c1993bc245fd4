"""Seeded draws that any engine can repeat: the first 52 bits of an MD5 over seed and key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw(seed: int | str, *keys: Column | str) -> Column:
    """Pseudo-random number in [0, 2**52) for a key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def draw_sql(seed: int | str, *keys: str) -> str:
    """The same number in DuckDB."""
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"
