"""Packing by concatenate and cut (operator 5).

Texts are encoded once and written, each with its place in its partition. Prefix sums over the partitions'
token totals turn places into global offsets: all documents form one stream of ids, cut into windows of
`window` ids. A document that crosses a cut gives one boundary record per window. Only the last
window is not full. Ids never shuffle, and a document's windows follow from its offset alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.llm.tokens import VOCABULARY, encoded, with_starts
from evkit.session import write_once

WINDOW = 2048
END_ID = 1


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW,
         end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, padded_length, ids.

    `ids` are little-endian unsigned 32-bit integers. `padded_length` is what the sequence is padded to:
    `window`, or its own length where that is a power of two. Null and empty texts are the end id alone.
    Repeated rows and rows without an id are packed like others; other columns are not read. An empty table
    gives no pieces.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = write_once(encoded(rows, "text", end_id, vocabulary, ("doc_id",)), "pack-ids")
    end = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    placed = with_starts(table)
    first = F.floor(F.col("global_start") / window)
    last = F.floor((F.col("global_start") + F.col("n_tokens") - 1) / window)
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("global_start"), F.col("sequence_id") * window)
    high = F.least(F.col("global_start") + F.col("n_tokens"), (F.col("sequence_id") + 1) * window)
    cut = cut.withColumns({
        "start": low - F.col("global_start"), "length": high - low,
        "offset": low - F.col("sequence_id") * window,
    })
    filled = F.least(F.lit(window).cast("long"), F.lit(end) - F.col("sequence_id") * window)
    power = F.bit_count(filled) == 1
    return cut.select(
        "doc_id", "start", "length", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset",
        F.when(power, filled).otherwise(F.lit(window)).cast("long").alias("padded_length"),
        F.substr("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
    )
