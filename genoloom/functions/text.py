"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genoloom.operators.calls import info_value

UNITS = ["B", "KB", "MB", "GB", "TB"]


def split_at(text: Column, places: Column) -> Column:
    """Pieces between ascending 0-based places."""
    ends = F.concat(F.array(F.lit(0)), places, F.array(F.length(text)))
    return F.transform(F.sequence(F.lit(0), F.size(places)), lambda i: F.substring(text, F.get(ends, i) + 1, F.get(ends, i + 1) - F.get(ends, i)))


def positions(text: Column, literal: str) -> Column:
    """0-based places of a literal, none overlapping another: one fold over the lengths of what lies between them."""
    parts = F.split(text, f"\\Q{literal}\\E", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))

    def step(done: Column, part: Column) -> Column:
        at = done["at"] + F.length(part)
        return F.struct((at + len(literal)).alias("at"), F.array_append(done["places"], at).alias("places"))

    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["places"]


def pretty_size(size: Column) -> Column:
    """Whole units of 1,000, the largest that leaves 1 or more."""
    out = F.concat(size.cast("string"), F.lit(UNITS[0]))
    for i, unit in enumerate(UNITS[1:], 1):
        out = F.when(size >= 1000**i, F.concat(F.floor(size / 1000**i).cast("string"), F.lit(unit))).otherwise(out)
    return out


def expected_window(depth: Column, length: Column, target: Column) -> Column:
    return F.round(target / depth * 2 * length).cast("long")


def duplication(info: Column) -> Column:
    """Type, copies and positions of a duplication's INFO."""
    return F.struct(info_value(info, "DUP_TYPE").alias("type"), info_value(info, "ICN").cast("int").alias("copies"), F.transform(F.split(info_value(info, "DUP_POS"), ","), lambda x: x.cast("long")).alias("positions"))


def inversion(info: Column) -> Column:
    """Type of an inversion's INFO: PERFECT or COMPLEX."""
    return F.struct(info_value(info, "INV_TYPE").alias("type"))


def set_duplication(info: Column, kind: Column, copies: Column, places: Column) -> Column:
    """INFO with a duplication's entries in place of those it has, behind all others."""
    kept = F.filter(F.split(info, ";"), lambda t: (t != "") & ~F.rlike(t, F.lit("^(DUP_TYPE|ICN|DUP_POS)=")))
    own = [F.concat(F.lit(f"{k}="), v) for k, v in (("DUP_POS", F.array_join(F.transform(places, lambda x: x.cast("string")), ",")), ("DUP_TYPE", kind), ("ICN", copies.cast("string")))]
    return F.array_join(F.concat(kept, F.array(*own)), ";")


def translocation(info: Column) -> Column:
    return F.struct(info_value(info, "TRA_TYPE").alias("type"), info_value(info, "CHR2").alias("contig"), info_value(info, "POS2").cast("long").alias("s"), info_value(info, "END2").cast("long").alias("e"))


def contig_style(name: Column, prefixed: Column) -> Column:
    """A contig name with or without ``chr``."""
    bare = F.regexp_replace(name, "^chr", "")
    return F.when(prefixed, F.concat(F.lit("chr"), bare)).otherwise(bare)
