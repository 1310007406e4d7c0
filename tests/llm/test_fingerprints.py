"""Fingerprints against a plain version of the same hash, and their algebra."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evkit.llm import fingerprints as fp

MASK = (1 << 60) - 1


def plain_vector(text):
    paragraphs = (text or "").split("\n")
    clauses = [c for p in paragraphs for c in re.split(r"(?<=[.!?;:,|])\x20+", p) if c]
    out = [sum(int(hashlib.sha256(p.encode()).hexdigest()[15 * k:15 * k + 15], 16) for p in paragraphs) & MASK
           for k in range(4)]
    out.append(len(clauses))
    for k in range(2):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", k), seed=42)
        hashes = [xxhash.xxh64_intdigest(c.encode(), seed=seed) for c in clauses]
        out += [sum((h >> j) & fp.FIELD_BITS for h in hashes) for j in range(30)]
    return out


def plain_signs(vector):
    out = []
    for lane in vector[5:]:
        out += [2 * ((lane >> (30 * i)) & ((1 << 30) - 1)) - vector[4] for i in range(2)]
    return np.array(out, dtype="float64")


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = plain_signs(a), plain_signs(b)
    size = np.sqrt(x @ x) * np.sqrt(y @ y)
    return float(np.clip(x @ y / size, 0, 1)) if size else 0.0


def plain_edits(data):
    """(id, text) with unique ids -> id: (edited, next text)."""
    order = sorted(data, reverse=True)
    out = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        out[i] = (text[:len(text) - half] + after[:half], after)
    return out


TEXTS = ["One. Two, three; four.\nFive: six!", "Five: six!\nOne. Two, three; four.", None, "", "a", "\n\n", "é𝄞ü ñ. ß",
         "no mark at all " * 40, "x. " * 3000, "Ten | eleven | twelve.", "Ten | eleven | twelve."]


@pytest.fixture(scope="module")
def compared(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(50)]
    texts = TEXTS + [". ".join(" ".join(rng.choice(words, 4)) for _ in range(rng.integers(1, 30))) for _ in range(60)]
    data = [(i * 7 - 100, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    return data, {r["id"]: r for r in fp.compare_edited(frame).collect()}


def test_rows_equal_the_plain_version(compared):
    data, got = compared
    edits = plain_edits(data)
    assert set(got) == {i for i, _ in data}
    for i, text in data:
        row, (edited, after) = got[i], edits[i]
        assert row["edited"] == edited and row["n_chars"] == len(text or "")
        mine = plain_vector(text)
        assert row["vector"] == mine and row["edited_vector"] == plain_vector(edited)
        assert row["next_vector"] == plain_vector(after)
        assert row["near_edited"] == pytest.approx(plain_likeness(mine, plain_vector(edited)), abs=1e-9)
        assert row["near_next"] == pytest.approx(plain_likeness(mine, plain_vector(after)), abs=1e-9)


def test_order_of_paragraphs_does_not_matter_and_equal_texts_agree(compared):
    data, got = compared
    by_text = [got[i]["vector"] for i, _ in data]
    assert by_text[0] == by_text[1] and by_text[2] == by_text[3] and by_text[9] == by_text[10]
    assert len({tuple(v) for v in by_text[:11]}) == 8


def test_paragraphs_are_added_and_taken_away(spark):
    frame = spark.createDataFrame([("A b. C!\nD", "E, f.\nD\nD")], "a string, b string")
    vectors = frame.select(
        fp.fingerprint(F.col("a")).alias("a"), fp.fingerprint(F.col("b")).alias("b"),
        fp.fingerprint(F.concat_ws("\n", "b", "a")).alias("both"))
    row = vectors.select("*", fp.combined(F.col("a"), F.col("b")).alias("sum"),
                         fp.without(F.col("both"), F.col("b")).alias("less")).first()
    assert row["sum"] == row["both"] and row["less"] == row["a"]
    assert len(fp_text(vectors)) == 15 * fp.LANES


def fp_text(vectors):
    return vectors.select(fp.fingerprint_text(F.col("a")).alias("t")).first()["t"]


def test_likeness_follows_the_share_of_common_clauses(spark):
    shared = [f"common clause {i}." for i in range(300)]
    data = [(n, " ".join(shared[:n] + [f"own {n} {i}." for i in range(300 - n)])) for n in (0, 75, 150, 225, 300)]
    frame = spark.createDataFrame(data, "n int, text string").select("n", fp.fingerprint(F.col("text")).alias("v"))
    whole = frame.filter("n = 300").select(F.col("v").alias("w"))
    for row in frame.join(whole).select("n", fp.likeness(F.col("v"), F.col("w")).alias("s")).collect():
        assert abs(row["s"] - row["n"] / 300) < 0.3
        assert (row["s"] == 1) == (row["n"] == 300)


def test_a_very_long_text(spark):
    """A million clauses, all the same: as like one of them as can be, but not equal to it."""
    frame = spark.range(1).select(F.array_join(F.array_repeat(F.lit("a."), 1 << 20), " ").alias("text"))
    frame = frame.select(fp.fingerprint(F.col("text")).alias("v"), fp.fingerprint(F.lit("a.")).alias("w"))
    row = frame.select(F.element_at("v", 5).alias("n"), fp.likeness(F.col("v"), F.col("w")).alias("s"), (F.col("v") == F.col("w")).alias("same")).first()
    assert row["n"] == 1 << 20 and row["s"] == pytest.approx(1.0) and not row["same"]


def test_rows_without_id_repeated_ids_and_empty_tables(spark):
    data = [(None, "abcd", "x"), (None, None, "x"), (2, "abcdef", "y"), (2, "abcdef", "y"), (1, "uvwxyz", "z"), (1, "zz", "z")]
    frame = spark.createDataFrame(data, "doc_id long, text string, vector string")
    rows = [(r["id"], r["text"], r["edited"], r["near_next"] is None) for r in fp.compare_edited(frame).collect()]
    # The greatest text of id 1 is "zz": all of it replaces three characters.
    assert sorted(rows, key=repr) == sorted([
        (None, "abcd", "ab", True), (None, "", "", True), (2, "abcdef", "abczz", False), (2, "abcdef", "abczz", False),
        (1, "uvwxyz", "uvwabc", False), (1, "zz", "za", False)], key=repr)
    assert fp.compare_edited(frame.limit(0)).count() == 0
    alone = fp.compare_edited(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone["edited"] == "abab" and alone["near_next"] == 1.0


def test_neighbours_cross_ranges(spark):
    ids = spark.range(0, 1000, 3).withColumn("extra", F.col("id") * 2).repartition(7)
    got = {r["id"]: r["next_id"] for r in fp.neighbours(ids).collect()}
    want = {i: i - 3 for i in range(3, 1000, 3)} | {0: 999}
    assert got == want
