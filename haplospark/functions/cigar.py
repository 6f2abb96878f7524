"""CIGAR strings as columns: operations, read positions on the reference, spans, edit distance, tags.

Coordinates count from 0.  All functions take and give Columns and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "(\\d+)([MIDNSHP=XB])"


def operations(cigar: Column) -> Column:
    """array<struct<op: string, len: int>> in order."""
    lengths, ops = (F.regexp_extract_all(cigar, F.lit(PATTERN), F.lit(k)) for k in (1, 2))
    return F.zip_with(ops, lengths, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def on_reference(op: Column) -> Column:
    return op.isin("M", "D", "N", "=", "X")


def on_query(op: Column) -> Column:
    return op.isin("M", "I", "S", "=", "X")


def on_both(op: Column) -> Column:
    return op.isin("M", "=", "X")


def total(ops: Column, test) -> Column:
    """Sum of the lengths of the operations that pass."""
    return F.aggregate(ops, F.lit(0), lambda acc, o: acc + F.when(test(o["op"]), o["len"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    return total(operations(cigar), on_reference)


def clipped_start(pos: Column, cigar: Column) -> Column:
    """The start before a leading soft clip, 0 at least; a hard clip before it hides it."""
    return F.greatest(F.lit(0), pos - F.coalesce(F.try_to_number(F.regexp_extract(cigar, "^(\\d+)S", 1), F.lit("999999999")).cast("int"), F.lit(0)))


def last_position(pos: Column, cigar: Column) -> Column:
    """The last reference position; a read without any is at its start."""
    return pos + F.greatest(reference_length(cigar), F.lit(1)) - 1


def base_positions(pos: Column, cigar: Column) -> Column:
    """The reference position of each base; inserted and clipped bases have the next one not yet consumed."""
    empty = F.struct(pos.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        at, n, op = acc["at"], o["len"], o["op"]
        bases = F.when(on_both(op) & (n > 0), F.sequence(at, at + n - 1)).when(op.isin("I", "S"), F.array_repeat(at, n)).otherwise(F.array().cast("array<int>"))
        after = F.when(on_reference(op), at + n).when(op == "B", at - n).otherwise(at)
        return F.struct(after.alias("at"), F.concat(acc["out"], bases).alias("out"))

    return F.aggregate(operations(cigar), empty, step)["out"]


def indels(pos: Column, cigar: Column) -> Column:
    """array<struct<start: int, end: int>>, one for each contiguous run of insertions and deletions.

    A run starts where the reference stands before it and is as wide as its longest operation.
    """
    none = F.lit(-1)
    empty = F.struct(pos.alias("at"), none.alias("start"), F.lit(0).alias("width"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def closed(acc: Column) -> Column:
        span = F.struct(acc["start"].alias("start"), (acc["start"] + acc["width"]).alias("end"))
        return F.when(acc["start"] >= 0, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])

    def step(acc: Column, o: Column) -> Column:
        inside = o["op"].isin("I", "D")
        return F.struct(
            F.when(on_reference(o["op"]), acc["at"] + o["len"]).otherwise(acc["at"]).alias("at"),
            F.when(~inside, none).when(acc["start"] >= 0, acc["start"]).otherwise(acc["at"]).alias("start"),
            F.when(inside, F.greatest(acc["width"], o["len"])).otherwise(0).alias("width"),
            F.when(inside, acc["out"]).otherwise(closed(acc)).alias("out"),
        )

    return F.aggregate(operations(cigar), empty, step, closed)


def bounds(pos: Column, cigar: Column, lo: Column, hi: Column) -> Column:
    """struct<i0, i1, p0, p1>: the first and last base at a position from lo to before hi, and their positions; -1 without one.

    A step for each operation, not for each base: inside one, bases and positions go on together, or the position stands.
    """
    none, zero = F.lit(-1), F.lit(0)
    empty = F.struct(pos.alias("at"), zero.alias("base"), none.alias("i0"), none.alias("i1"), none.alias("p0"), none.alias("p1"))

    def step(acc: Column, o: Column) -> Column:
        at, base, n, op = acc["at"], acc["base"], o["len"], o["op"]
        moves, stays = on_both(op) & (n > 0), op.isin("I", "S") & (n > 0)
        first, last = F.when(moves, F.greatest(at, lo)).otherwise(at), F.when(moves, F.least(at + n, hi) - 1).otherwise(at)
        inside = (moves & (first <= last)) | (stays & (at >= lo) & (at < hi))
        opens = inside & (acc["i0"] < 0)
        return F.struct(
            F.when(on_reference(op), at + n).when(op == "B", at - n).otherwise(at).alias("at"),
            F.when(on_query(op), base + n).otherwise(base).alias("base"),
            F.when(opens, base + first - at).otherwise(acc["i0"]).alias("i0"),
            F.when(inside, F.when(moves, base + last - at).otherwise(base + n - 1)).otherwise(acc["i1"]).alias("i1"),
            F.when(opens, first).otherwise(acc["p0"]).alias("p0"),
            F.when(inside, last).otherwise(acc["p1"]).alias("p1"),
        )

    return F.aggregate(operations(cigar), empty, step, lambda acc: F.struct(*(acc[c].alias(c) for c in ("i0", "i1", "p0", "p1"))))


def mismatches(pos: Column, cigar: Column, seq: Column, reference: Column) -> Column:
    """Bases that differ from the upper-case reference, over operations that consume both."""
    empty = F.struct(pos.alias("at"), F.lit(1).alias("base"), F.lit(0).alias("n"))
    whole = F.upper(reference)

    def step(acc: Column, o: Column) -> Column:
        a, b = F.split(F.substring(seq, acc["base"], o["len"]), ""), F.split(F.substring(whole, acc["at"] + 1, o["len"]), "")
        differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
        return F.struct(
            F.when(on_reference(o["op"]), acc["at"] + o["len"]).otherwise(acc["at"]).alias("at"),
            F.when(on_query(o["op"]), acc["base"] + o["len"]).otherwise(acc["base"]).alias("base"),
            (acc["n"] + F.when(on_both(o["op"]), differ).otherwise(0)).alias("n"),
        )

    return F.aggregate(operations(cigar), empty, step)["n"]


def covered(cigar: Column) -> Column:
    return total(operations(cigar), on_both)


def keeps_old(old_distance: Column, new_distance: Column, old_covered: Column, new_covered: Column) -> Column:
    """Whether a new alignment is no gain: farther by at least as much as it covers more."""
    return (new_distance > old_distance) & (new_distance - old_distance >= new_covered - old_covered)


def original_position(old: Column, new: Column, tag: Column) -> Column:
    """OP: the old position, counted from 1, where it changes; one that is there stays."""
    return F.when(old != new, F.coalesce(tag, old + 1)).otherwise(tag)


def original_cigar(old: Column, new: Column, tag: Column) -> Column:
    """OC: the old CIGAR where it changes; one that is there stays."""
    return F.when(old != new, F.coalesce(tag, old)).otherwise(tag)
