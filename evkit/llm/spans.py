"""Places of pattern matches in a text, by SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def match_spans(text: Column, pattern: Column, size, context: int = 0) -> Column:
    """Array of (start, end, found, before), one per leftmost non-overlapping match of `pattern`.

    `size` measures a piece of text; starts and ends are sums of it. `before` has up to `context` characters ahead of
    the match, back to the match before it. Patterns must not match the empty text.
    The text is cut at its matches, and running sums of the pieces' sizes give the places.
    """
    kind = "array<struct<start:bigint,end:bigint,found:string,before:string>>"
    empty = F.array().cast(kind)
    state = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def add(s: Column, piece: Column) -> Column:
        start = s["at"] + size(piece["gap"])
        end = start + size(piece["found"])
        before = F.right(piece["gap"], F.lit(context)) if context else F.lit("")
        span = F.struct(start.alias("start"), end.alias("end"), piece["found"].alias("found"), before.alias("before"))
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(span)).alias("spans"))

    def shifted(sums: Column, block: Column) -> Column:
        spans = F.transform(block["spans"], lambda s: F.struct(
            (s["start"] + sums["at"]).alias("start"), (s["end"] + sums["at"]).alias("end"), s["found"].alias("found"),
            s["before"].alias("before")))
        return F.struct((sums["at"] + block["at"]).alias("at"), F.concat(sums["blocks"], F.array(spans)).alias("blocks"))

    def spans(args: Column) -> Column:
        pieces = F.zip_with(
            args["found"], F.slice(args["gaps"], F.lit(1), F.size(args["found"])),
            lambda found, gap: F.struct(gap.alias("gap"), found.alias("found")),
        )
        return F.transform(F.array(pieces), in_blocks)[0]

    def in_blocks(pieces: Column) -> Column:
        # Arrays grow by copying, so only BLOCK matches are summed at a time, and then the blocks.
        firsts = F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda i: F.aggregate(F.slice(pieces, i, F.lit(BLOCK)), state, add))
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("blocks"))
        return F.flatten(F.aggregate(blocks, none, shifted)["blocks"])

    args = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")
    )
    # As an element of an array, matches are found once.
    return F.when(F.regexp_like(text, pattern), F.transform(F.array(args), spans)[0]).otherwise(empty)
