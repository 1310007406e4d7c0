"""Operators against brute force on planted cases, and on nulls, empty texts, ties and clashing columns."""

from __future__ import annotations

import numpy as np
import pytest

from evkit.llm.licenses import scan
from evkit.llm.ngram_join import join_near
from evkit.llm.packing import pack
from evkit.llm.personal import find_personal, span_text
from evkit.llm import token_files
from evkit.llm.token_files import decode_blocks, encode_blocks
from evkit.llm.vector_dedup import link_vectors, nearest_cells


def test_vectors_link_as_in_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = np.concatenate([base, base[:20] + 0.2 * rng.normal(size=(20, 16)), base[:5], base[:5]])
    data = [(i, [float(x) for x in row], "x") for i, row in enumerate(rows)]
    data += [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [], "x")]
    got = link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, row string")).collect()
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found = {r["vec_id"]: r for r in got}
    assert len(found) == len(data) and all(r["row"] == "x" for r in got)
    assert sum(found[i]["n_links"] for i in range(len(rows))) >= 0.9 * near.sum() > 0
    assert all(found[i]["n_links"] <= near[i].sum() for i in range(len(rows)))
    assert sum(found[i]["n_links"] for i in range(len(rows))) % 2 == 0
    assert all(found[i]["component_id"] == i % 80 for i in range(80, 85))
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(900, 904))


def test_vectors_of_several_lengths_link_within_their_length(spark):
    rng = np.random.default_rng(9)
    data = []
    for width, start in ((4, 0), (9, 100)):
        base = rng.normal(size=(12, width))
        rows = np.concatenate([base, base * 2.0])
        data += [(start + i, [float(x) for x in row]) for i, row in enumerate(rows)]
    data += [(None, data[0][1]), (None, data[30][1]), (500, [3.0]), (501, [7.0]), (502, [-1.0])]
    got = {r["vec_id"]: r for r in link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect() if r["vec_id"] is not None}
    for width, start in ((4, 0), (9, 100)):
        unit = np.array([v for i, v in data if i is not None and start <= i < start + 24])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        near = unit @ unit.T >= 0.95
        for i in range(24):
            assert got[start + i]["n_links"] == near[i].sum() - 1
            assert got[start + i]["component_id"] <= start + i % 12
    assert (got[501]["n_links"], got[501]["component_id"], got[502]["n_links"]) == (1, 500, 0)


def test_nearest_cells_are_those_of_a_full_sort():
    rng = np.random.default_rng(2)
    rows, books = rng.normal(size=(40, 6)), [rng.normal(size=(9, 3)), rng.normal(size=(7, 3))]
    far = ((rows[:, None, :3] - books[0]) ** 2).sum(-1)[:, :, None] + ((rows[:, None, 3:] - books[1]) ** 2).sum(-1)[:, None, :]
    for visits in (1, 5, 20, 63):
        want = np.argsort(far.reshape(40, -1), axis=1)[:, :visits]
        assert (nearest_cells(rows, books, visits) == want).all()


def test_near_texts_share_a_component(spark):
    words = [f"w{i}" for i in range(100)]
    data = [(5, " ".join(words)), (3, " ".join(words).upper()), (9, " ".join(words[:-2] + ["y", "z"])),
            (1, None), (2, ""), (4, "one"), (6, "One"), (7, " ".join(words[:50] + words[:10]))]
    got = {r["doc_id"]: r for r in join_near(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {5: 3, 3: 3, 9: 3, 1: 1, 2: 2, 4: 4, 6: 4, 7: 7}
    assert got[1]["n_shingles"] == 0 and got[4]["n_shingles"] == 1 and got[5]["n_shingles"] == 97


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 5000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 65536, n).astype("<u4")
    assert (decode_blocks(encode_blocks(ids)) == ids).all()


def test_any_32_bit_ids_and_long_runs_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 1 << 32, 4100), np.full(3000, (1 << 32) - 1), np.zeros(9000), np.tile([7, 50_000, 9], 2000)):
        ids = ids.astype("<u4")
        assert (decode_blocks(encode_blocks(ids)) == ids).all()
    # Repeats cost little, and noise hardly more than itself.
    assert sum(len(b[3]) for b in encode_blocks(np.tile([7, 50_000, 9], 2000).astype("<u4"))) < 6000 / 4
    noise = rng.integers(0, 65536, 6000).astype("<u4")
    assert sum(len(b[3]) for b in encode_blocks(noise)) < 2 * 6000 * 1.2


def test_blocks_of_several_batches_round_trip(monkeypatch):
    monkeypatch.setattr(token_files, "LANES", 2)
    monkeypatch.setattr(token_files, "CHUNK", 2 * token_files.BLOCK)
    ids = np.random.default_rng(2).integers(0, 50_000, 5 * token_files.BLOCK + 3).astype("<u4")
    assert (decode_blocks(encode_blocks(ids)) == ids).all()


def test_damaged_block_is_noticed():
    (n, crc, digits, payload), = encode_blocks(np.arange(50, dtype="<u4"))
    with pytest.raises(ValueError):
        decode_blocks([(n, crc ^ 1, digits, payload)])


def test_licenses_and_personal_data(spark):
    data = [(1, "MIT License. mit license\nGNU General Public License version 3"), (2, None), (3, "")]
    got = {r["doc_id"]: r for r in scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 4, "gpl,mit")
    assert "gpl-3" in got[1]["labels"] and got[2]["n_words"] == 0 and got[3]["labels"] == ""
    data = [(1, "é mail a.b@c.org, 1.2.3.4 1.2.3.999 +49 (30) 1234567 or 4111 1111 1111 1111"), (2, None)]
    found = find_personal(spark.createDataFrame(data, "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", span_text("base_spans").alias("s")).collect()}
    assert got == {1: "email:7:16,ip:18:25,card:56:75,phone:36:52", 2: ""}


def test_pieces_leave_no_gap(spark):
    data = [(1, "word " * 3000), (2, None), (3, ""), (3, "")]
    rows = pack(spark.createDataFrame(data, "doc_id long, text string")).orderBy("sequence_id", "offset").collect()
    at = [r["sequence_id"] * 2048 + r["offset"] for r in rows]
    assert at == list(np.cumsum([0] + [r["length"] for r in rows[:-1]]))
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
