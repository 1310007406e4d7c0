"""The JVM's block coder against the plain one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evkit.llm import token_files
from evkit.llm.token_files import BLOCK, CHUNKS, coded, encode_blocks, read_tokens


def cases():
    rng = np.random.default_rng(5)
    several = rng.integers(0, 50_000, 3 * BLOCK + 7)
    several[-1] = 1 << 20
    return [c.astype("<u4") for c in (
        np.zeros(0), np.zeros(1), np.arange(BLOCK), several, np.tile([7, 50_000, 9], 3000), rng.integers(0, 16, BLOCK + 1),
        rng.zipf(1.3, 20_000).clip(0, 50_000), np.full(3000, (1 << 32) - 1), rng.integers(0, 1 << 32, 4100))]


@pytest.mark.parametrize("chunk", [token_files.CHUNK, 2 * BLOCK])
def test_the_jvm_gives_the_same_bits_and_reads_them(spark, monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(token_files, "CHUNK", chunk)
    ids = cases()
    rows = spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(ids)], "part int, ids binary")
    size = (F.length("ids") / 4).cast("long")
    half = (size / 2).cast("long")
    table = rows.select(
        "part", F.lit(0).cast("long").alias("local_start"), F.array(F.col("part").cast("long"), F.lit(-1).cast("long"), F.lit(None).cast("long")).alias("doc_ids"),
        F.array(half, F.lit(0).cast("long"), size - half).alias("sizes"), coded(spark, F.col("ids")).alias("blocks"))
    table.write.parquet(f"{tmp_path}/files")
    blocks = {r["part"]: [(b["n"], b["crc"], b["digits"], bytes(b["payload"])) for b in r["blocks"]]
              for r in spark.read.schema(CHUNKS).parquet(f"{tmp_path}/files").collect()}
    assert blocks == {i: encode_blocks(c) for i, c in enumerate(ids)}
    found = {(r["start"], r["doc_id"], r["n_tokens"]): bytes(r["ids"]) for r in read_tokens(spark, f"{tmp_path}/files").collect()}
    want, at = {}, 0
    for i, c in enumerate(ids):
        for doc, part in ((i, c[: len(c) // 2]), (-1, c[:0]), (None, c[len(c) // 2 :])):
            want[at, doc, len(part)] = part.tobytes()
            at += len(part)
    assert found == want


def test_a_damaged_file_is_noticed(spark, tmp_path):
    for name, change in (("crc", lambda n, crc, digits, p: (n, crc ^ 1, digits, p)),
                         ("payload", lambda n, crc, digits, p: (n, crc, digits, bytes([p[0] ^ 64]) + p[1:])),
                         ("short", lambda n, crc, digits, p: (n, crc, digits, p[:3]))):
        block = change(*encode_blocks(np.arange(500, dtype="<u4"))[0])
        spark.createDataFrame([(0, 0, [1], [500], [block])], CHUNKS).write.parquet(f"{tmp_path}/{name}")
        with pytest.raises(Exception, match="checksum of block 0 differs"):
            read_tokens(spark, f"{tmp_path}/{name}").collect()
