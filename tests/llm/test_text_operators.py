"""Licences, personal data, mixing, exact dedup, packing, token files and quality against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from evkit.llm import quality as Q
from evkit.llm.exact_dedup import drop_copies, mark_copies
from evkit.llm.licenses import scan, signature_rules
from evkit.llm.mixing import mix, mixed_rows
from evkit.llm.packing import pack
from evkit.llm.personal import find_personal, span_text
from evkit.llm.token_files import read_tokens, write_tokens
from evkit.llm.tokens import load_tokenizer

DOCS = "doc_id long, text string, row string, found string"


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, f"r{i}", "clash") for i, t in enumerate(texts)], DOCS).repartition(parts)


# Licences

PHRASES = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by",
           ("mit", "license"): "mit"}


def plain_licences(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    starts = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if tuple(words[i:i + len(phrase)]) == phrase]
    places = [i for i, _ in starts]
    return (len(words), len(starts), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in starts})))


def licence_texts():
    rng = random.Random(1)
    pieces = ["GNU", "gnu", "general", "public", "license", "License,", "Apache", "apache license", "cc", "by", "CC-BY", "MIT", "mit license",
              "lesser", "affero", "version 3", "é", "x_y", "…", "\n", "licensed under the", "2.0", "or later"]
    return ["", None, "cc by cc by cc", "GNU GENERAL PUBLIC LICENSE", "mit license " * 3000, "word " * 100_000] + [
        " ".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(300)]


def test_licences_equal_the_plain_scan(spark):
    texts = licence_texts()
    rows = {r["doc_id"]: r for r in scan(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licences(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["row"] == f"r{i}" and r["found"] == "clash"
    assert scan(frame(spark, texts).limit(0)).count() == 0


def test_lesser_licences_are_no_base_phrase(spark):
    texts = ["gnu lesser general public license version 2.1 or later", "GNU Affero General Public License v3"]
    rows = {r["doc_id"]: r for r in scan(frame(spark, texts)).collect()}
    assert [rows[i]["n_base"] for i in (0, 1)] == [0, 0]
    assert "lgpl-2-1-or-later" in rows[0]["labels"] and "agpl-3" in rows[1]["labels"]


def test_no_rule_matches_without_the_words_of_its_group():
    """What the gate leaves out would have found nothing."""
    rng = random.Random(5)
    groups = signature_rules()
    known = sorted({w for words, _ in groups for w in words}) + ["2", "0", "v3", "version 3", "or later", "two clause", "c", "1999", "style"]
    hits = 0
    for words, rules in groups:
        for _, _, pattern in rules:
            plain = re.sub(r"\(\?<= \)|\(\?= \)", "", pattern)
            for choice in (0, -1):
                # One wording of the rule: each group's first or last choice, optional groups left out or in.
                text, before = plain, None
                while before != text:
                    before, text = text, re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] and choice else m[1].split("|")[choice], text)
                text = text.replace("[0-9]{2}", "21").replace("v?", "v" if choice else "")
                text = f" {' '.join(text.split())} "
                assert re.search(pattern, text), (pattern, text)
                assert set(words) <= set(text.split()), (words, text)
    for _ in range(500):
        text = f" {' '.join(rng.choices(known, k=60))} "
        for words, rules in groups:
            found = any(re.search(x, text) for _, _, x in rules)
            hits += found
            assert not found or set(words) <= set(text.split())
    assert hits


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def personal_texts():
    rng = random.Random(2)
    signs = "ab9@..--_%+ +()1234567890  éx\n"
    texts = ["".join(rng.choices(signs, k=rng.randrange(120))) for _ in range(400)]
    parts = ["a@b.c", "a@b.c_d@e.f", "x.y@z", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "001.2.3.256", "4111 1111 1111 1111", "4111-1111-1111-1111-2",
             "+49 (30) 1234567", "+1+1 234 567 89", "7", "-", " ", "𝄞", "mail", "é", "12345678901234567890123"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(400)]
    return [None, "", *texts]


def test_personal_spans_equal_the_plain_ones(spark):
    texts = personal_texts()
    found = find_personal(frame(spark, texts))
    rows = {r["doc_id"]: r for r in found.select("*", span_text("base_spans").alias("s"), span_text("all_spans").alias("a")).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["s"] == plain_spans(text), repr(text)
        kept = rows[i]["s"].split(",")
        assert not rows[i]["s"] or set(kept) <= set(rows[i]["a"].split(","))
        assert [rows[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in kept) for k in BASE]
    assert find_personal(frame(spark, texts).limit(0)).count() == 0


def test_long_number_tables_and_runs_of_letters(spark):
    """No recursion per repeat, and no second try of a run from each of its characters."""
    table = " ".join(str(i % 10) for i in range(500_000))
    texts = [table, "a" * 1_000_000, "a." * 300_000 + "@", "a@" + "b." * 300_000 + "c", "1." * 100_000, "+1 " * 100_000]
    start = time.time()
    found = find_personal(frame(spark, texts, 6)).select("doc_id", span_text("base_spans").alias("s"))
    rows = {r["doc_id"]: r["s"] for r in found.collect()}
    assert rows[0] == "" and rows[1] == "" and rows[2] == "" and rows[3] == f"email:0:{2 + 600_000 + 1}"
    assert time.time() - start < 120


def test_many_matches_in_one_text(spark):
    text = "a@b.c 1.2.3.4\n" * 10_000
    found = find_personal(frame(spark, [text]))
    row = found.select("n_email", "n_ip", span_text("base_spans").alias("s")).first()
    assert (row["n_email"], row["n_ip"], row["s"]) == (10_000, 10_000, plain_spans(text))


# Mixing

def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, rest, full = {}, share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 2 * sizes[s] + 1e-9] if total else []
        if not over:
            for s in open_:
                target[s] = rest * weight[s] / total
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            full.add(s)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c", None, "é"]
    data = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])) if i % 17 else None, rng.choice(sources[:1] * 6 + sources), "x")
            for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, taken string").repartition(4)
    rows = {r["doc_id"]: r for r in mix(df).collect()}
    words = {i: len((t or "").split()) for i, t, _, _ in data}
    sizes = {}
    for i, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + words[i]
    targets = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for i, _, s, _ in data:
        r = rows[i]
        assert (r["size"], r["source_size"]) == (words[i], sizes[s]) and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 2 * words[i]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 20 + 1e-6 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mix(df.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in rows.items()}
    copies = {r["doc_id"]: r["count"] for r in mixed_rows(df).groupBy("doc_id").count().collect()}
    assert copies == {i: r["copies"] for i, r in rows.items() if r["copies"]}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0 and mixed_rows(df).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], df.schema)
    assert sorted((r["size"], r["taken"]) for r in mix(empty).collect()) == [(0, 0), (0, 0)]


# Exact dedup

def test_copies_equal_the_plain_groups(spark):
    rng = random.Random(3)
    texts = [rng.choice(["Same", "same", "SAME", "", None, "É", "é", "x" * 300_000]) if rng.random() < 0.5 else f"Only {rng.randrange(400)}"
             for _ in range(900)]
    df = frame(spark, texts, 5).withColumn("kept", F.lit("clash"))
    groups = {}
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    for i, t in enumerate(texts):
        groups.setdefault(low(t), []).append(i)
    for bits in (1 << 30, 1 << 15):
        rows = {r["doc_id"]: r for r in mark_copies(df, max_bits=bits).collect()}
        for i, t in enumerate(texts):
            own = groups[low(t)]
            assert rows[i]["text_sha256"] == hashlib.sha256(low(t).encode()).hexdigest()
            assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (max(own), len(own), i == max(own))
    stay = sorted(r["doc_id"] for r in drop_copies(df).collect())
    assert stay == sorted(max(g) for g in groups.values())
    assert mark_copies(df.limit(0)).count() == 0


# Packing and token files

TEXTS = [None, "", "One text.", "one " * 3000, "é𝄞 ü\n" * 50, "One text.", "x" * 20_000, "last words"]


@pytest.fixture(scope="module")
def tokenizer():
    return load_tokenizer()


def plain_ids(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_pieces_hold_each_id_once(spark, tokenizer):
    rows = pack(frame(spark, TEXTS)).collect()
    want = {i: plain_ids(tokenizer, t, 1) for i, t in enumerate(TEXTS)}
    found = {i: {} for i in want}
    sequences = {}
    for r in rows:
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["length"] > 0
        found[r["doc_id"]][r["start"]] = r["ids"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_length"]))
    for i, pieces in found.items():
        assert b"".join(pieces[s] for s in sorted(pieces)) == want[i].tobytes()
    total = sum(map(len, want.values()))
    assert sorted(sequences) == list(range(-(-total // 2048)))
    for k, pieces in sequences.items():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == min(2048, total - 2048 * k)
        (padded,) = {p for _, _, p in pieces}
        assert padded == (at if at & (at - 1) == 0 else 2048)
    assert pack(frame(spark, TEXTS).limit(0)).count() == 0


def test_token_files_give_back_all_ids(spark, tokenizer, tmp_path):
    docs = frame(spark, TEXTS).withColumn("start", F.lit("clash"))
    write_tokens(docs, f"{tmp_path}/tokens")
    rows = {r["doc_id"]: r for r in read_tokens(spark, f"{tmp_path}/tokens").collect()}
    at = 0
    for i, text in enumerate(TEXTS):
        ids = plain_ids(tokenizer, text, 2)
        assert (rows[i]["start"], rows[i]["n_tokens"], bytes(rows[i]["ids"])) == (at, len(ids), ids.tobytes())
        at += len(ids)
    write_tokens(docs.limit(0), f"{tmp_path}/none")
    assert read_tokens(spark, f"{tmp_path}/none").count() == 0


# Quality

def test_nearest_takes_ties_in_place_order():
    rng = np.random.default_rng(1)
    cosine = np.round(rng.random((50, 40)), 1)
    got = Q._nearest(cosine, 7)
    want = np.sort(np.argsort(-cosine, axis=1, kind="stable")[:, :7], axis=1)
    assert (got == want).all()
    assert (Q._nearest(cosine[:, :3], 3) == np.arange(3)).all()


def test_scores_equal_a_plain_vote_and_tell_junk_apart(spark):
    rng = random.Random(5)
    words = ["river", "stone", "under", "light", "follow", "gather", "and", "the", "of"]
    good = [" ".join(rng.choices(words, k=60)).capitalize() + "." for _ in range(150)]
    junk = ["".join(rng.choices("$#@!%^&*0123456789 ", k=300)) for _ in range(150)]
    texts = good + junk + [None, "", "river " * 50_000]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    voters = Q.fit(docs, labels)
    rows = {r["doc_id"]: r for r in Q.score(docs, voters).collect()}
    held = {i: crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))}
    assert all(rows[i]["held_out"] == held[i] for i in held)
    assert len(voters.labels) == sum(not held[i] for i in range(300))
    assert all((rows[i]["score"] >= 0.7) == (i < 150) == (rows[i]["predicted"] == 1) for i in range(300) if held[i])
    # The vote over again, one text at a time.
    for i in (0, 7, 160, 302):
        places, weights = next(Q._weights([texts[i] or ""]))
        row = np.zeros(Q.TERMS, dtype="float32")
        row[places] = weights
        vector = Q._unit(Q._unit((row * voters.idf)[None]) @ voters.basis)[0]
        cosine = voters.vectors @ vector
        near = np.argsort(-cosine, kind="stable")[: Q.NEIGHBOURS]
        vote = np.clip(cosine[near].astype("float64"), 1e-6, 1) ** Q.SHARPNESS
        assert rows[i]["score"] == pytest.approx((vote * voters.labels[near]).sum() / vote.sum(), abs=1e-4)
    assert Q.score(docs.limit(0), voters).count() == 0
    unlabelled = Q.fit(docs, labels.limit(0))
    assert {r["score"] for r in Q.score(docs.limit(5), unlabelled).collect()} == {0.5}
