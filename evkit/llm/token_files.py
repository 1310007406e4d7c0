"""Token ids in compressed binary blocks (operator 2): an adaptive context-mixing range coder.

An id is a few digits of four bits, as many as the largest id of its block's batch needs. For each digit, three
models (by the digits so far alone, with the id before, and with the two ids before) hold cumulative
frequencies of its 16 values; a mixer whose weights adapt to what each model expected of the values seen joins them, and
the result drives a range coder. A block of BLOCK ids starts with fresh models and carries the CRC-32
of its ids, so it decodes alone. LANES blocks are coded side by side, in integers only, so every
machine gets the same bits, and a task's models stay the same size however long a text is.

Tables are coded by `java/BlockCoder.java`, which gives the same bits as the functions here some ten times as fast, one
block at a time; tests hold it against them.

Files are Parquet with one row per chunk: part, local_start, doc_ids, sizes, blocks (n, crc, digits, payload).
Rows are in ascending id order: parts, then local starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evkit.llm import jvm
from evkit.llm.tokens import VOCABULARY, encoded, with_starts
from evkit.session import write_once

BLOCK = 2048
LANES = 1024
CHUNK = BLOCK * LANES
DIGIT = 4
VALUES = 1 << DIGIT
SLOTS = 1024
END_ID = 2
BLOCKS = "array<struct<n:int,crc:bigint,digits:int,payload:binary>>"
CHUNKS = f"part int, local_start long, doc_ids array<bigint>, sizes array<bigint>, blocks {BLOCKS}"
JOINED = "part int, local_start long, doc_ids array<bigint>, sizes array<bigint>, ids binary"
DECODED = "array<struct<doc_id:bigint,n_tokens:bigint,ids:binary,local_start:bigint>>"

# Frequencies add up to TOTAL, weights to UNIT.
TOTAL = 1 << 15
UNIT = 1 << 14
# The coder's interval: LOW_BITS wide, put out in words of 16 bits, and at least 1 << SPARE wide when a digit is coded.
LOW_BITS = 48
LOW_MASK = (1 << LOW_BITS) - 1
SPARE = 24
# How much a row moves towards a value when it has been seen so often: a shift.
RATES = np.array([1, 1, 2, 2, 3, 3, 4, 4, 5], dtype="int32")
# Levels of trust in a row by how often it has been seen.
TRUST = np.array([0, 1, 1, 2, 2, 2, 3, 3, 3])
STEPS = np.arange(VALUES + 1, dtype="int32")
# Cumulative frequencies below each value (row) once one (column) alone is expected: 0 up to it, then TOTAL.
AIMS = np.where(STEPS[:VALUES, None] > STEPS[:VALUES], TOTAL, 0).astype("int32")


class _Models:
    """Models of all lanes (blocks): `expect` the next digit, then `learn` it.

    A row has the cumulative frequencies below the values 1 to 15; in the place of value 0, always 0, it counts its uses.
    """

    def __init__(self, lanes: int) -> None:
        fresh = (STEPS[:VALUES] * (TOTAL // VALUES)).astype("int16")
        # One item per row, so that rows are fetched and stored whole.
        self.table = np.tile(fresh, 3 * lanes * SLOTS).view(f"V{2 * VALUES}")
        self.bases = (np.arange(3 * lanes, dtype="int64") * SLOTS).reshape(3, lanes)
        self.weights = np.tile(np.array([[UNIT // 4], [UNIT // 4], [UNIT // 2]], "int32"), (1, lanes * 16))
        self.lanes = np.arange(lanes) * 16

    def context(self, one: np.ndarray, two: np.ndarray) -> None:
        self.hashes = np.stack([np.zeros_like(one), one + 1, (one + 1) * 65599 + two + 7]) * 2654435761 & 0xFFFFFFFF

    def expect(self, node: np.ndarray) -> np.ndarray:
        """Cumulative frequencies (17, n) of the next digit of each of n lanes."""
        n = len(node)
        mixed = (self.hashes + node * 40503) * 2246822519 & 0xFFFFFFFF
        self.at = (self.bases[:, :n] + ((mixed >> 9 ^ mixed >> 19) & SLOTS - 1)).ravel()
        # Values first: the lanes are the long side of every array.
        self.rows = np.empty((VALUES + 1, 3, n), "int32")
        self.rows[:VALUES] = self.table.take(self.at).view("int16").reshape(3 * n, VALUES).T.reshape(VALUES, 3, n)
        self.rows[VALUES] = TOTAL
        self.uses = self.rows[0].copy()
        self.rows[0] = 0
        trust = TRUST.take(self.uses[1:])
        self.set = self.lanes[:n] + trust[0] * 4 + trust[1]
        self.mix = self.weights.take(self.set, axis=1)
        cum = self.rows[:, 0] * self.mix[0]
        cum += self.rows[:, 1] * self.mix[1]
        cum += self.rows[:, 2] * self.mix[2]
        cum >>= 14
        # Every value keeps a frequency of at least 1.
        cum *= TOTAL - VALUES
        cum >>= 15
        cum += STEPS[:, None]
        return cum

    def learn(self, value: np.ndarray) -> None:
        n = len(value)
        flat, at = self.rows.ravel(), value * (3 * n) + np.arange(3 * n).reshape(3, n)
        expected = (flat.take(at + 3 * n) - flat.take(at)).astype("int64")
        # A weight grows as its model expected the value more than the mixture did.
        gain = self.mix * expected
        aim = gain * UNIT // np.maximum(gain.sum(0), 1)
        mix = np.clip(self.mix + (aim - self.mix >> 4), 128, UNIT // 2 - 64)
        mix[0] = UNIT - mix[1] - mix[2]
        self.weights[:, self.set] = mix
        moved = AIMS.take(value, axis=1)[:, None] - self.rows[:VALUES]
        moved >>= RATES.take(self.uses)
        moved += self.rows[:VALUES]
        moved[0] = np.minimum(self.uses + 1, len(RATES) - 1)
        rows = moved.reshape(VALUES, 3 * n).T.astype("int16", order="C")
        self.table[self.at] = rows.view(self.table.dtype).ravel()


def _contexts(grid: np.ndarray, t: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    zero = np.zeros(n, "int64")
    return grid[:n, t - 1] if t else zero, grid[:n, t - 2] if t > 1 else zero


def _narrowed(low: np.ndarray, width: np.ndarray, below: np.ndarray, above: np.ndarray) -> None:
    """Narrow intervals in place to the shares from `below` to `above`."""
    step = width >> 15
    low += step * below
    width[:] = step * (above - below)


def _due(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Lanes that put out a word: its bits are settled, or the interval gets too narrow."""
    return ((low ^ (low + width)) >> (LOW_BITS - 16) == 0) | (width >> SPARE == 0)


def _shifted(low: np.ndarray, width: np.ndarray, due: np.ndarray) -> None:
    """Put the first word of the lanes `due` out of their intervals."""
    at, wide = low[due], width[due]
    # An interval that is narrow but not settled ends where its first word changes, so no carry reaches that word.
    open_ = (at ^ (at + wide)) >> (LOW_BITS - 16) != 0
    wide = np.where(open_, -at & ((1 << SPARE) - 1), wide)
    low[due], width[due] = at << 16 & LOW_MASK, wide << 16


def _encode_batch(ids: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    lanes = -(-len(ids) // BLOCK)
    digits = max(1, -(-int(ids.max()).bit_length() // DIGIT))
    padded = np.zeros(lanes * BLOCK, dtype="int64")
    padded[: len(ids)] = ids
    grid = padded.reshape(lanes, BLOCK)
    last = len(ids) - (lanes - 1) * BLOCK
    models, low, width = _Models(lanes), np.zeros(lanes, "int64"), np.full(lanes, LOW_MASK, "int64")
    out, used = np.zeros((lanes, BLOCK + 64), "uint16"), np.zeros(lanes, "int64")
    for t in range(BLOCK):
        n = lanes if t < last else lanes - 1
        if not n:
            break
        models.context(*_contexts(grid, t, n))
        node, symbol, lane = np.ones(n, "int64"), grid[:n, t], np.arange(n)
        for place in range(DIGIT * (digits - 1), -1, -DIGIT):
            value = symbol >> place & VALUES - 1
            cum = models.expect(node)
            _narrowed(low[:n], width[:n], cum[value, lane], cum[value + 1, lane])
            models.learn(value)
            node = node * VALUES + value
            due = np.nonzero(_due(low[:n], width[:n]))[0]
            while len(due):
                if used.max() >= out.shape[1] - 4:
                    out = np.concatenate([out, np.zeros_like(out)], axis=1)
                out[due, used[due]] = low[due] >> (LOW_BITS - 16)
                used[due] += 1
                _shifted(low, width, due)
                due = due[_due(low[due], width[due])]
    blocks = []
    for i in range(lanes):
        n = BLOCK if i < lanes - 1 else last
        payload = out[i, : used[i]].astype(">u2").tobytes() + int(low[i]).to_bytes(LOW_BITS // 8, "big")
        blocks.append((n, crc32(grid[i, :n].astype("<u4").tobytes()), digits, payload))
    return blocks


def encode_blocks(ids: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(n, crc, digits, payload) of each block of BLOCK ids; ids are unsigned 32-bit integers."""
    return [b for i in range(0, len(ids), CHUNK) for b in _encode_batch(ids[i : i + CHUNK])]


def _decode_batch(blocks: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    lanes, last, digits = len(blocks), blocks[-1][0], blocks[0][2]
    data = np.zeros((lanes, max(len(b[3]) for b in blocks) // 2 + 4), "int64")
    for i, block in enumerate(blocks):
        words = np.frombuffer(block[3], ">u2")
        data[i, : len(words)] = words
    code = data[:, 0] << 32 | data[:, 1] << 16 | data[:, 2]
    used, grid = np.full(lanes, 3, "int64"), np.zeros((lanes, BLOCK), "int64")
    models, low, width = _Models(lanes), np.zeros(lanes, "int64"), np.full(lanes, LOW_MASK, "int64")
    for t in range(BLOCK):
        n = lanes if t < last else lanes - 1
        if not n:
            break
        models.context(*_contexts(grid, t, n))
        node, symbol, lane = np.ones(n, "int64"), np.zeros(n, "int64"), np.arange(n)
        for _ in range(digits):
            cum = models.expect(node)
            share = (code[:n] - low[:n]) // (width[:n] >> 15)
            value = (cum[1:VALUES] <= share).sum(0)
            _narrowed(low[:n], width[:n], cum[value, lane], cum[value + 1, lane])
            models.learn(value)
            node, symbol = node * VALUES + value, symbol * VALUES + value
            due = np.nonzero(_due(low[:n], width[:n]))[0]
            while len(due):
                _shifted(low, width, due)
                code[due] = (code[due] << 16 & LOW_MASK) | data[due, np.minimum(used[due], data.shape[1] - 1)]
                used[due] += 1
                due = due[_due(low[due], width[due])]
        grid[:n, t] = symbol
    ids = grid.astype("<u4")
    for i, (n, crc, _, _) in enumerate(blocks):
        if crc32(ids[i, :n].tobytes()) != crc:
            raise ValueError(f"checksum of block {i} differs")
    return ids.reshape(-1)[: (lanes - 1) * BLOCK + last]


def decode_blocks(blocks: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    """The ids of blocks, all full but the last; a wrong checksum raises."""
    parts = [_decode_batch(blocks[i : i + LANES]) for i in range(0, len(blocks), LANES)]
    return np.concatenate([np.zeros(0, "<u4"), *parts])


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of CHUNK ids or a little more, whole documents each."""

    def chunk(rows: list) -> pd.DataFrame:
        return pd.DataFrame([{
            "part": rows[0].part, "local_start": rows[0].local_start, "doc_ids": [r.doc_id for r in rows],
            "sizes": [r.n_tokens for r in rows], "ids": b"".join(r.ids for r in rows)}])

    rows, size = [], 0
    for frame in frames:
        for row in frame.itertuples(index=False):
            rows.append(row)
            size += row.n_tokens
            if size >= CHUNK:
                yield chunk(rows)
                rows, size = [], 0
    if rows:
        yield chunk(rows)


def _coder(spark: SparkSession, name: str, returns: str):
    library = jvm.library(spark, "token-blocks", ("BlockCoder", "EncodeBlocks", "DecodeBlocks"))
    return jvm.function(spark, library, name, T._parse_datatype_string(returns))


def coded(spark: SparkSession, ids: Column) -> Column:
    """`encode_blocks` of little-endian ids, in the JVM."""
    return _coder(spark, "EncodeBlocks", BLOCKS)(ids, F.lit(BLOCK), F.lit(CHUNK))


def write_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID,
                 vocabulary: str = VOCABULARY) -> None:
    """Write the ids of all texts, `end_id` after each, in ascending id order. Null texts are empty.

    Rows without an id are left as errors to the caller: ids must not be null. Repeated rows are written each.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).orderBy("doc_id")
    joined = encoded(rows, "text", end_id, vocabulary, ("doc_id",)).mapInPandas(_chunks, JOINED)
    blocks = coded(docs.sparkSession, F.col("ids")).alias("blocks")
    joined.select("part", "local_start", "doc_ids", "sizes", blocks).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), start (ids of all rows before it).

    A wrong checksum raises.
    """
    decode = _coder(spark, "DecodeBlocks", DECODED)
    rows = spark.read.schema(CHUNKS).parquet(path)
    table = rows.select("part", F.inline(decode("doc_ids", "sizes", "blocks", "local_start")))
    placed = with_starts(write_once(table, "decoded"))
    return placed.select("doc_id", "n_tokens", "ids", F.col("global_start").alias("start"))
