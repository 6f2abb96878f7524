"""Bisulfite strands and converted alphabets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strand(flag: Column, xg: Column, single_end_forward_is_top: bool = False) -> Column:
    """1 original top, 2 original bottom, 3 and 4 their complements, 0 unknown. Odd ones are read C to T, even ones G to A.

    single_end_forward_is_top: an unpaired forward read without XG counts as 1 and not as 0.
    """
    has = lambda mask, value=None: flag.bitwiseAND(mask) == (mask if value is None else value)
    single = F.when(has(0x10), 2).otherwise(1 if single_end_forward_is_top else 0)
    paired = F.when(has(0x50), 2).when(has(0x40), 1).when(has(0x90), 1).when(has(0x80), 2).otherwise(0)

    def tagged(same: int, opposite: int) -> Column:
        first = F.when(has(0x51, 0x41), same).when(has(0x51), opposite)
        return first.when(has(0x91, 0x81), opposite).when(has(0x91), same).when(has(0x10), opposite).otherwise(same)

    return F.when(xg.isNull(), F.when(has(0x1), paired).otherwise(single)).when(xg.startswith("C"), tagged(1, 3)).otherwise(tagged(4, 2))


def conversion(strand_: Column) -> Column:
    return F.when(strand_ % 2 == 1, "CT").otherwise("GA")


def c_to_t(seq: Column) -> Column:
    """Upper case, C as T; what isn't A, T or G then is N."""
    return F.regexp_replace(F.translate(F.upper(seq), "C", "T"), "[^ATG]", "N")


def g_to_a(seq: Column) -> Column:
    """Upper case, G as A; what isn't A, C or T then is N."""
    return F.regexp_replace(F.translate(F.upper(seq), "G", "A"), "[^ACT]", "N")


def converted(seq: Column, kind: Column) -> Column:
    return F.when(kind == "CT", c_to_t(seq)).otherwise(g_to_a(seq))


def reduced(seq: Column) -> Column:
    """A converted sequence in the alphabet 0 (A), 1 (C or G), 2 (T), 3 (anything else), as digits."""
    return F.regexp_replace(F.translate(seq, "ACGT", "0112"), "[^012]", "3")
