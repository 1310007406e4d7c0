"""Document fingerprints by a homomorphic multiset hash (operator 11, DataFrame and SQL functions only).

A paragraph is a line. Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors modulo 2**60, lane by lane. So the order of paragraphs does not matter, and a paragraph is
added or taken away by adding or subtracting its vector (`combined`, `without`). Lanes:

* EQUAL_LANES lanes of 60 bits each of the paragraph's SHA-256: equal documents have equal lanes, and others
  practically never.
* One lane counts the paragraph's clauses.
* HASHES * PLANES lanes hold FIELDS counters of 30 bits each: how many clauses have a certain bit of their hash
  set. Twice a counter less the number of clauses is a sum of random signs, and such sums keep inner products: the
  cosine of two documents' sums estimates that of their multisets of clauses (`likeness`), with a standard error of
  at most 1 / sqrt(120). A clause and its end take two bytes, so no text has as many clauses as a counter holds.

`neighbours` finds the next document in descending id order: ids alone are sorted in ranges, and texts then move by
id, which is unique, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evkit.session import write_once

LANE_BITS = 60
MASK = (1 << LANE_BITS) - 1
EQUAL_LANES = 4
HASHES = 2
PLANES = 30
FIELDS = 2
# One bit at the start of each counter of a lane.
FIELD_BITS = sum(1 << (PLANES * i) for i in range(FIELDS))
# Clauses end with one of these marks and spaces.
CLAUSE_END = r"(?<=[.!?;:,|])\x20+"
COUNT_LANE = EQUAL_LANES
LANES = EQUAL_LANES + 1 + HASHES * PLANES


def _with(value: Column, build) -> Column:
    """build(value), with the value made once: as an element of an array it is a variable."""
    return F.transform(F.array(value), build)[0]


def _modular_sum(items: Column, lane) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda total, x: (total + lane(x)).bitwiseAND(F.lit(MASK)))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as an array of LANES longs below 2**60; null counts as empty.

    The empty text has one empty paragraph. Empty clauses are not counted.
    """
    digits = LANE_BITS // 4

    def of_digests(digests: Column) -> list[Column]:
        def part(k: int):
            return lambda s: F.conv(F.substring(s, 1 + digits * k, digits), 16, 10).cast("long")

        return F.array(*[_modular_sum(digests, part(k)) for k in range(EQUAL_LANES)])

    def of_hashes(hashes: Column) -> Column:
        def plane(j: Column) -> Column:
            # Fewer than 2**30 clauses, so the sum stays below 2**60 by itself.
            bits = lambda h: F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(FIELD_BITS))
            return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: total + bits(h))

        return F.transform(F.sequence(F.lit(0), F.lit(PLANES - 1)), plane)

    def of_clauses(clauses: Column) -> Column:
        def hashed(k: int) -> Column:
            return _with(F.transform(clauses, lambda c: F.xxhash64(F.lit(k), c)), of_hashes)

        return F.concat(F.array(F.size(clauses).cast("long")), *[hashed(k) for k in range(HASHES)])

    def of_paragraphs(paragraphs: Column) -> Column:
        digests = F.transform(paragraphs, lambda p: F.sha2(p.cast("binary"), 256))
        clauses = F.flatten(F.transform(paragraphs, lambda p: F.split(p, CLAUSE_END)))
        return F.concat(_with(digests, of_digests), _with(F.filter(clauses, lambda c: c != ""), of_clauses))

    return _with(F.split(F.coalesce(text, F.lit("")), "\n"), of_paragraphs)


def combined(a: Column, b: Column) -> Column:
    """The fingerprint of both documents' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MASK)))


def without(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs less those of b, which a must hold."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def fingerprint_text(vector: Column) -> Column:
    """15 hexadecimal digits per lane."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), LANE_BITS // 4, "0")), "")


def _signs(vector: Column) -> Column:
    """Twice each counter less the number of clauses; after `without` counters may have wrapped, so modulo 2**31."""
    whole, half = 1 << (PLANES + 1), 1 << PLANES
    clauses = F.element_at(vector, COUNT_LANE + 1)
    counters = F.slice(vector, COUNT_LANE + 2, HASHES * PLANES)

    def signed(lane: Column, i: int) -> Column:
        counter = F.shiftrightunsigned(lane, PLANES * i).bitwiseAND(F.lit(half - 1))
        return (F.pmod(counter * 2 - clauses + half, F.lit(whole)) - half).cast("double")

    return F.flatten(F.transform(counters, lambda lane: F.array(*[signed(lane, i) for i in range(FIELDS)])))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1: 1 if equal, else the cosine of their sums of signs, at least 0.

    A document without clauses is like none but its equals. Null if one is null.
    """
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, p: total + p)

    def cosine(sums: Column) -> Column:
        x, y = sums["x"], sums["y"]
        return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0))

    measured = _with(F.struct(_signs(a).alias("x"), _signs(b).alias("y")), cosine)
    bounded = F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), measured)))
    return F.when(a.isNotNull() & b.isNotNull(), bounded)


def neighbours(ids: DataFrame) -> DataFrame:
    """`ids` (id, unique and not null; further columns stay) plus `next_id`: the next smaller id, and for the
    smallest the greatest.

    Ids are sorted in ranges; a window sees one range, and the windows over ranges see one row each.
    """
    placed = ids.repartitionByRange(F.col("id").desc()).withColumn("part", F.spark_partition_id())
    placed = write_once(placed, "id-ranges")
    edges = placed.groupBy("part").agg(F.max("id").alias("first"))
    every = Window.orderBy("part")
    after = F.lead("first").over(every)
    whole = F.first("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = write_once(edges.select(F.col("part").alias("of"), F.coalesce(after, whole).alias("edge")), "id-edges")
    inside = F.lead("id").over(Window.partitionBy("part").orderBy(F.col("id").desc()))
    found = placed.withColumn("inside", inside).join(edges, F.col("part") == F.col("of"))
    return found.select(*ids.columns, F.coalesce("inside", "edge").alias("next_id"))


def edited_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, text, `vector`, `edited` and `next_vector` (null without a next document).

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of the next
    document. Null texts are empty. Rows without an id have no next document, which then counts as empty. Rows
    with one id share the next document; if several rows have the next id, the greatest text counts.
    Other columns are not read. An empty table gives an empty table.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), full.alias("text"), fingerprint(full).alias("vector"))
    half = F.floor(F.length("text") / 2)
    sizes = docs.select(F.col(doc_id).alias("id"), full.alias("text")).filter("id IS NOT NULL")
    sizes = sizes.groupBy("id").agg(F.max(half).alias("half"))
    asked = neighbours(sizes).select(F.col("id").alias("asker"), "half", "next_id")
    # Both joins deal the rows out by id, so they share one shuffle of the texts.
    known = rows.filter("id IS NOT NULL")
    heads = known.join(asked, F.col("id") == F.col("next_id")).select(
        "asker", F.struct(F.expr("left(text, cast(half AS int))").alias("head"), F.col("vector").alias("next_vector")).alias("next"))
    heads = heads.groupBy("asker").agg(F.max("next").alias("next"))
    met = known.join(heads, F.col("id") == F.col("asker")).drop("asker")
    alone = rows.filter("id IS NULL").withColumn("next", F.lit(None).cast("struct<head:string,next_vector:array<bigint>>"))
    n = F.length("text")
    kept = F.expr("left(text, length(text) - cast(floor(length(text) / 2) AS int))")
    taken = F.expr("left(next.head, cast(floor(length(text) / 2) AS int))")
    return met.unionByName(alone).select(
        "id", "text", n.cast("long").alias("n_chars"), "vector",
        F.concat(kept, F.coalesce(taken, F.lit(""))).alias("edited"), F.col("next.next_vector").alias("next_vector"))


def compare_edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`edited_documents` plus `edited_vector`, `near_edited` and `near_next` (null without a next document)."""
    rows = edited_documents(docs, text, doc_id).withColumn("edited_vector", fingerprint(F.col("edited")))
    return rows.withColumns({
        "near_edited": likeness(F.col("vector"), F.col("edited_vector")),
        "near_next": likeness(F.col("vector"), F.col("next_vector")),
    })
