"""Quality classifier by nearest-neighbour voting (operator 6).

Texts become tf-idf vectors of hashed terms (words' shapes and short character runs, line and word
statistics), projected by a truncated SVD to latent-semantic vectors. The labelled vectors are broadcast:
at most `max_labelled` rows (default 4,000) of `RANK` numbers, so at most 2 MB, whatever the corpus.
Every document meets all of them in blocked exact cosine products; its `neighbours` nearest vote, weighted
by similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.llm.common import give_back, whole_row, with_new

MAX_LABELLED = 4000
TERMS = 2048
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 4
BLOCK = 256
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def _shape(word: str) -> str:
    """Letters as a, digits as 9, other signs as they are, each run once."""
    kinds = ["a" if c.isalpha() else "9" if c.isdigit() else c for c in word]
    return "".join(k for k, _ in groupby(kinds))


def _hashed(term: str) -> int:
    return crc32(term.encode("utf-8", "replace")) % (TERMS - 128)


# Terms of words seen by this task, at most KEPT_WORDS of them.
_KNOWN_WORDS: dict[str, tuple[int, int]] = {}
KEPT_WORDS = 1 << 16


def _word_terms(word: str) -> tuple[int, int]:
    """Terms of a word: itself and its shape."""
    found = _KNOWN_WORDS.get(word)
    if found is None:
        found = _hashed("w" + word.lower()), _hashed("s" + _shape(word))
        # Long words are rare and would fill the memory.
        if len(word) <= 32:
            if len(_KNOWN_WORDS) >= KEPT_WORDS:
                _KNOWN_WORDS.clear()
            _KNOWN_WORDS[word] = found
    return found


def _terms(text: str) -> Counter:
    """Counts of hashed terms of a whole text."""
    words = text.split()
    distinct = Counter(words)
    hashed: Counter = Counter()
    for word, n in distinct.items():
        own, shape = _word_terms(word)
        hashed[own] += n
        hashed[shape] += n
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(1, len(text))
    signs = Counter(text)

    def share(test) -> float:
        return sum(m for c, m in signs.items() if test(c)) / chars

    measures = (
        len(distinct) / n, len(set(lines)) / max(1, len(lines)), sum(map(len, words)) / n / 12,
        share(lambda c: c.isalpha() or c.isspace()), share(str.isdigit) * 4, share(str.isupper) * 4,
        np.log1p(n) / 10, n / max(1, len(lines)) / 40,
    )
    # Each measure is a term of its own per sixteenth; its weight grows with the text, as others do.
    for i, value in enumerate(measures):
        hashed[TERMS - 128 + 16 * i + min(15, int(value * 16))] += n
    return hashed


def _weights(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, 1 + log of counts) of each text: at most TERMS of them."""
    for text in texts:
        found = _terms(text)
        places = np.fromiter(found.keys(), dtype="int32", count=len(found))
        yield places, 1.0 + np.log(np.fromiter(found.values(), dtype="float32", count=len(found)))


def _matrix(rows: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    out = np.zeros((n, TERMS), dtype="float32")
    for i, (places, weights) in enumerate(rows):
        out[i, places] = weights
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest values, in place order; of equal values the first places count."""
    limit = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
    above = cosine > limit
    equal = cosine == limit
    room = k - above.sum(1, keepdims=True)
    picked = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return np.nonzero(picked)[1].reshape(len(cosine), k)


@dataclass(frozen=True)
class Voters:
    """What a fit learned: term weights, projection, labelled vectors, and their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = []
        k = min(NEIGHBOURS, len(self.labels))
        for low in range(0, len(texts), BLOCK):
            some = texts[low : low + BLOCK]
            rows = _unit(_unit(_matrix(_weights(some), len(some)) * self.idf) @ self.basis)
            cosine = rows @ self.vectors.T
            near = _nearest(cosine, k)
            weight = np.clip(np.take_along_axis(cosine, near, 1).astype("float64"), 1e-6, 1) ** SHARPNESS
            out.append((weight * self.labels[near]).sum(1) / weight.sum(1))
        return np.clip(np.concatenate(out), 0.0, 1.0) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
        label: str = "quality", max_labelled: int = MAX_LABELLED) -> Voters:
    """Learn from labelled rows outside the held-out fold: the `max_labelled` of smallest id hash."""
    fold = F.crc32(F.col("key").cast("string").cast("binary")) % FOLDS
    marks = labels.select(F.col(doc_id).alias("key"), F.col(label).alias("mark"))
    marks = marks.filter((fold != HELD_OUT) & F.col("mark").isNotNull())
    marks = marks.groupBy("key").agg(F.max("mark").alias("mark"))
    marks = marks.orderBy(F.xxhash64("key"), "key").limit(max_labelled)
    texts = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))

    @F.pandas_udf("places array<int>, weights array<float>")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _weights([t if isinstance(t, str) else "" for t in batch])
            yield pd.DataFrame(list(found), columns=["places", "weights"])

    # One row per labelled id: at most max_labelled rows of TERMS pairs reach the driver, and no text.
    rows = texts.join(marks, "key").groupBy("key").agg(F.max("text").alias("text"), F.max("mark").alias("mark"))
    rows = rows.select("key", "mark", weigh("text").alias("terms")).select("key", "mark", "terms.*")
    rows = sorted(rows.collect(), key=lambda r: r["key"])
    counts = _matrix(((np.array(r["places"]), np.array(r["weights"])) for r in rows), len(rows))
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype("float32") + 1
    weighted = _unit(counts * idf)
    values, vectors = np.linalg.eigh((weighted.T @ weighted).astype("float64"))
    basis = vectors[:, np.argsort(-values)[:RANK]].astype("float32")
    return Voters(idf, basis, _unit(weighted @ basis), np.array([float(r["mark"]) for r in rows]))


def score(docs: DataFrame, voters: Voters, text: str = "text", doc_id: str = "doc_id",
          threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of `docs` plus `held_out`, `score`, `predicted`.

    Null texts are scored as empty ones; the whole text counts. Without any labels each score is 0.5. Of labelled
    rows equally near, those of smaller id vote; of several labels of one id the greatest counts.
    Rows without an id are not held out. Columns with the new names are replaced. An empty table gives an
    empty table.
    """
    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(voters.scores([t if isinstance(t, str) else "" for t in batch]))
        give_back()

    held = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT
    rows = docs.select(whole_row(docs), F.coalesce(held, F.lit(False)).alias("held_out"), vote(F.col(text)).alias("score"))
    rows = rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return with_new(rows, ["held_out", "score", "predicted"])
