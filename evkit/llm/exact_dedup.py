"""Exact dedup by two-pass Bloom filtering (operator 10).

Pass 1 counts, for each position of a Bloom filter, how many rows hash there, and keeps the positions
with two or more rows as a bitmap: the filter of possibly repeated hashes. Pass 2 probes it. Rows with
a probe of zero are certainly unique and pass straight through, with all their columns; only the others
shuffle, where their full SHA-256 decides.

* The bitmap has BITS_PER_ROW bits a row up to `max_bits` (default 2**30, 128 MB): that is the bound of its
  broadcast. An input too large for it has more false alarms, so more rows shuffle; the result is the same.
* Hashes are written once (pass 1); the counts of pass 1 and of the groups read them instead of the texts.
* A group of copies of any size: groups are aggregated (map-side first) to one row each. Groups of more
  than rows / HOT_GROUPS rows number at most HOT_GROUPS, so their rows meet a broadcast; rows of the
  others are joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evkit.llm.common import lower_ascii, whole_row, with_new
from evkit.session import write_once

PROBES = 2
BITS_PER_ROW = 16
MAX_BITS = 1 << 30
# Bits of one row of the bitmap table, as bitmap_bucket_number() has them.
BUCKET_BITS = 32768
HOT_GROUPS = 2000


def text_sha256(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case, in UTF-8, as lowercase hex; null counts as empty."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _filter_bits(rows: int, max_bits: int) -> int:
    wanted = max(BUCKET_BITS, rows * BITS_PER_ROW)
    return max(BUCKET_BITS, min(max_bits, 1 << (wanted - 1).bit_length()))


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def _bit(bitmap: Column, position: Column) -> Column:
    """The bit at a position of its bucket's bitmap, false where there is no bitmap."""
    place = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substr(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10)
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8).cast("int") + 1)
    return F.coalesce(byte.cast("int").bitwiseAND(mask) > 0, F.lit(False))


def repeated_positions(keyed: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, bitmap) of the filter positions that two or more rows hash to."""
    places = keyed.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("place"))
    twice = places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")
    )


def _marked(docs: DataFrame, text: str, doc_id: str, max_bits: int) -> DataFrame:
    """row, id, text_sha256, keep_id, group_size."""
    keyed = docs.select(
        whole_row(docs), F.col(doc_id).alias("id"), text_sha256(F.col(text)).alias("text_sha256")
    )
    hashes = write_once(keyed.select("id", "text_sha256"), "text-hashes")
    rows = hashes.count()
    bits = _filter_bits(rows, max_bits)
    maps = write_once(repeated_positions(hashes, "text_sha256", bits), "repeated-bits")

    def probed(table: DataFrame) -> DataFrame:
        table = table.withColumn("suspect", F.lit(True))
        for place in _positions(F.col("text_sha256"), bits):
            table = table.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("bucket"), "left")
            table = table.withColumn("suspect", F.col("suspect") & _bit(F.col("bitmap"), place))
            table = table.drop("bucket", "bitmap")
        return table

    groups = probed(hashes).filter("suspect").groupBy(F.col("text_sha256").alias("sha")).agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = write_once(groups, "copy-groups")
    limit = max(1, rows // HOT_GROUPS)
    hot = groups.filter(F.col("group_size") > limit).select(
        F.col("sha").alias("hot_sha"), F.col("keep_id").alias("hot_id"),
        F.col("group_size").alias("hot_size"),
    )
    marked = probed(keyed).join(F.broadcast(hot), F.col("text_sha256") == F.col("hot_sha"), "left")
    out = ["row", "id", "text_sha256"]
    hot_or_alone = marked.filter("NOT suspect OR hot_size IS NOT NULL").select(
        *out, F.when(F.col("suspect"), F.col("hot_id")).otherwise(F.col("id")).alias("keep_id"),
        F.when(F.col("suspect"), F.col("hot_size")).otherwise(F.lit(1).cast("long")).alias("group_size")
    )
    in_small = (
        marked.filter("suspect AND hot_size IS NULL")
        .join(groups.filter(F.col("group_size") <= limit), F.col("text_sha256") == F.col("sha"))
        .select(*out, "keep_id", "group_size")
    )
    return hot_or_alone.unionByName(in_small)


def mark_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS
) -> DataFrame:
    """All rows and columns of `docs` plus `text_sha256`, `keep_id`, `group_size`, `kept`.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, so null and empty texts
    are copies of each other. The row with the largest id stays (kept). Ids are taken to be unique: rows
    repeated with the same id are all kept or all dropped. A row without an id counts, and stays only if
    no row of its group has an id; keep_id is null then. Columns of `docs` with the new names are
    replaced. An empty table gives an empty table.
    """
    marked = _marked(docs, text, doc_id, max_bits)
    marked = marked.withColumn("kept", F.col("keep_id").eqNullSafe(F.col("id")))
    return with_new(marked, ["text_sha256", "keep_id", "group_size", "kept"])


def drop_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows that stay, with the columns of `docs` as they are."""
    marked = _marked(docs, text, doc_id, max_bits)
    return with_new(marked.filter(F.col("keep_id").eqNullSafe(F.col("id"))), [])
