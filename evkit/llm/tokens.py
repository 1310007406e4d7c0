"""Token ids of whole texts by a public tokenizer, as little-endian unsigned 32-bit integers."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evkit.llm import jvm
from evkit.llm.common import give_back
from evkit.session import write_once

VOCABULARY = "byte_bpe_50k.json"
# Texts encoded in one call.
BATCH = 256
# Pieces whose ids a task keeps, none longer than KEPT_CHARS: about 100 MB at most.
KEPT_PIECES = 1 << 19
KEPT_CHARS = 64

# Pieces end between another sign and white space, and between a word of Latin letters and an ASCII sign: there
# the vocabulary's own rule always ends a word, whatever stands around.
_SPACE = " \n\r\t"
_PIECE = re.compile(rf"[{_SPACE}]*(?:[A-Za-zÀ-ÖØ-öø-ʯ]++(?=[{_SPACE}!-/:-@\[-`{{-~])|[^{_SPACE}]+)|[{_SPACE}]+")
# Other white space: the two notions of it may differ, so texts that hold it are encoded in one piece.
_ODD = re.compile(rf"[^\S{_SPACE}]")


def load_tokenizer(vocabulary: str = VOCABULARY):
    # One thread per task: tasks share the cores already. Read when the library first encodes.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def _pieces(text: str) -> list[str]:
    return [text] if _ODD.search(text) else _PIECE.findall(text)


class PieceEncoder:
    """Ids of texts, which the tokenizer finds once per piece as long as the piece is kept."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.known: dict[str, bytes] = {}
        names = tokenizer.get_vocab()
        # Bytes of each id: names have one sign per byte.
        self.lengths = np.zeros(max(names.values()) + 1, "int64")
        self.lengths[list(names.values())] = [len(n) for n in names]

    def _found(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces. Those with white space before and none behind are put together into one text, whose ids
        their lengths in bytes part again."""
        joined = [p for p in pieces if p[0] in _SPACE and p[-1] not in _SPACE and len(p) <= KEPT_CHARS]
        alone = list(pieces.difference(joined))
        out = dict(zip(alone, [ids.tobytes() for ids in self._found(alone)]))
        # The library's own time and memory grow with the length of a text, so a text is some hundred pieces.
        for low in range(0, len(joined), 512):
            some = joined[low : low + 512]
            ids = self._found(["".join(some)])[0]
            ends = np.cumsum([len(p.encode()) for p in some])
            upto = np.cumsum(self.lengths[ids])
            at = np.searchsorted(upto, ends) + 1
            if not (upto[at - 1] == ends).all():
                raise ValueError("an id crosses two pieces")
            packed, at = ids.tobytes(), (4 * at).tolist()
            out.update(zip(some, map(packed.__getitem__, map(slice, [0, *at], at))))
        return out

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, and `end`."""
        parts = [_pieces(t) for t in texts]
        wanted = set().union(*parts)
        if len(self.known) + len(wanted) > KEPT_PIECES:
            self.known.clear()
        new = self._learn(wanted.difference(self.known))
        self.known.update(new)
        found = [b"".join(map(self.known.__getitem__, p)) + end for p in parts]
        for piece in new:
            if len(piece) > KEPT_CHARS:
                del self.known[piece]
        return found


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in the names of a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def _kinds() -> bytes:
    """Of each code point below U+0250: sign 0, letter 1, number 2, white space 3, or 4: for the library alone."""
    found = bytearray()
    for point in range(0x250):
        group = unicodedata.category(chr(point))[0]
        odd = group in "CZ" and point != 0x20 or point < 0x20
        found.append(3 if chr(point) in _SPACE else 4 if odd else {"L": 1, "N": 2}.get(group, 0))
    return bytes(found)


def packed_vocabulary(vocabulary: str = VOCABULARY) -> bytes | None:
    """What EncodeText reads, or None if the vocabulary is not of the one kind it knows: byte pairs by rank of bytes,
    cut into words by the usual rule."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        whole = json.load(file)
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    known = (model.get("type") == "BPE" and not whole.get("normalizer") and not whole.get("truncation")
             and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                "ignore_merges", "byte_fallback")))
    ids, added = model["vocab"] if known else {}, [t["content"].encode() for t in whole.get("added_tokens") or []]
    if not known or not all(s in ids for s in _byte_signs()) or not all(t and t[0] < 128 for t in added):
        return None
    out = [_kinds(), struct.pack(">i", len(added))]
    out += [struct.pack(">i", len(t)) + t for t in added]
    out.append(struct.pack(">256i", *[ids[s] for s in _byte_signs()]))
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    out.append(struct.pack(">i", len(pairs)))
    out += [struct.pack(">3i", ids[a], ids[b], ids[a + b]) for a, b in pairs]
    return b"".join(out)


# By application and vocabulary: the library of jvm.py, or None.
_PACKED: dict[tuple[str, str], object] = {}


def plain_ids(spark: SparkSession, text: Column, end_id: int, vocabulary: str = VOCABULARY) -> Column:
    """Ids of texts and the end id, found in the JVM; null where only the tokenizers library knows them."""
    key = (spark.sparkContext.applicationId, vocabulary)
    name = f"{vocabulary}.bin"
    if key not in _PACKED:
        packed = packed_vocabulary(vocabulary)
        classes = ("EncodeTextTables", "EncodeText")
        _PACKED[key] = packed and jvm.library(spark, f"text-{vocabulary}", classes, {name: packed})
    if not _PACKED[key]:
        return F.lit(None).cast("binary")
    encode = jvm.function(spark, _PACKED[key], "EncodeText", T.BinaryType())
    return encode(F.coalesce(text, F.lit("")).cast("binary"), F.lit(end_id), F.lit(name))


def encoded(docs: DataFrame, text: str, end_id: int, vocabulary: str = VOCABULARY,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` plus `ids` (binary, with the end id), `n_tokens`, and the place in the input: `part` and
    `local_start` (ids of the rows before it in its part). Null texts are empty.

    Places are those of one run of each task, so write the result before using it twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = None, end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        start = 0
        for frame in frames:
            for low in range(0, len(frame), BATCH):
                some = frame.iloc[low : low + BATCH]
                rows = some["found_"].tolist()
                left = [i for i, r in enumerate(rows) if r is None]
                if left:
                    encoder = encoder or PieceEncoder(load_tokenizer(vocabulary))
                    texts = some["text_"].iloc[left]
                    texts = [t if isinstance(t, str) else "" for t in texts]
                    for i, row in zip(left, encoder.encode(texts, end)):
                        rows[i] = row
                sizes = np.array([len(r) // 4 for r in rows], dtype="int64")
                out = some.drop(columns=["text_", "found_"])
                out["ids"] = rows
                out["n_tokens"] = sizes
                out["part"] = part
                out["local_start"] = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield out
        del encoder
        give_back()

    rows = docs.select(*keep, F.col(text).alias("text_"))
    rows = rows.withColumn("found_", plain_ids(docs.sparkSession, F.col("text_"), end_id, vocabulary))
    # Texts whose ids are found stay behind.
    rows = rows.withColumn("text_", F.when(F.col("found_").isNull(), F.col("text_")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text_", "found_").schema]
    fields += ["ids binary", "n_tokens long", "part int", "local_start long"]
    return rows.mapInPandas(run, ", ".join(fields))


def with_starts(table: DataFrame) -> DataFrame:
    """`table` (written: part, local_start, n_tokens) plus `global_start`: ids of all rows before it.

    The window sees one row per partition of the input, never documents.
    """
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(F.col("part").alias("of"), F.coalesce(before, F.lit(0)).alias("base"))
    bases = write_once(bases, "token-bases")
    joined = table.join(bases, F.col("part") == F.col("of"))
    return joined.withColumn("global_start", F.col("base") + F.col("local_start")).drop("of", "base")
