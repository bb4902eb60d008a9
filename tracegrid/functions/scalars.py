"""Small column functions for metadata, channel maps and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("long")


def unsigned_to_signed(c: Column, bits: int = 16) -> Column:
    return c.cast("long") - (1 << (bits - 1))


def region_code(electrode: Column) -> Column:
    """-1 for none, else 0 to 3 by the cut points 64, 128 and 192."""
    return F.when(electrode.isNull() | (electrode <= 0), -1).when(electrode <= 64, 0).when(electrode <= 128, 1).when(electrode <= 192, 2).otherwise(3)


def parse_delay(c: Column) -> Column:
    """Empty and random delays are 0; n/a and other words are null."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("", "random"), 0.0).otherwise(F.regexp_extract(t, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"))


def rename_segment(c: Column) -> Column:
    return F.regexp_replace(c, "^base_(nan|0|100|200)_(neg|pos)$", "base_$2_$1")


def channel_name(electrode: Column, nsp: Column) -> Column:
    return F.format_string("UAe%03d_NSP%03d", electrode, nsp)


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def region_group(code: Column) -> Column:
    """The area of a region code, null for none."""
    return F.when(code.isin(0, 1), "M1i+M1s").when(code == 2, "PMd").when(code == 3, "SMA")


def anchor_ms(meta: Column) -> Column:
    """The anchor in ms from a JSON text: its own field, or else its sample by the rate (30 kHz if that is missing)."""
    m = F.from_json(meta, "anchor_ms double, anchor_sample double, fs double")
    return F.coalesce(m["anchor_ms"], m["anchor_sample"] * 1000.0 / F.coalesce(m["fs"], F.lit(30000.0)))


def parse_channel_name(c: Column) -> tuple[Column, Column]:
    """Electrode and NSP channel of a name like UAe001_NSP130."""
    return tuple(F.regexp_extract(c, rf"{k}(\d+)", 1).try_cast("int") for k in ("UAe", "NSP"))
