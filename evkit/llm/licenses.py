"""License scan by ordered signature rules (operator 1, DataFrame functions only).

A text is reduced to its words in lower case, joined by single spaces. Each rule is a regular expression over
them with a label and a priority (its place in the list). Rules of one name form a group with the words that each of
its matches holds: they run only on texts that have all of these. Detections of all rules are resolved by priority: one that lies within the interval of
another is suppressed, and of equal intervals the earlier rule's stays. Base rules are reported in any case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evkit.llm.common import lower_ascii, whole_row, with_new
from evkit.llm.spans import match_spans

# Phrases of the base rules and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Families (label, keyword, name as pattern, versions). Each version gives rules from the most
# to the least explicit wording.
FAMILIES = (
    ("agpl", "affero", "(?:gnu )?affero general public license", ("3 0", "3", "1 0", "1")),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license", ("3 0", "3", "2 1", "2")),
    ("lgpl", "library", "(?:gnu )?library general public license", ("2 0", "2")),
    ("gpl", "general", "(?:gnu )?general public license", ("3 0", "3", "2 0", "2", "1")),
    ("gfdl", "documentation", "(?:gnu )?free documentation license", ("1 3", "1 2", "1 1")),
    ("apache", "apache", "apache(?: software)? license", ("2 0", "2", "1 1", "1 0")),
    ("mpl", "mozilla", "mozilla public license", ("2 0", "1 1", "1 0")),
    ("epl", "eclipse", "eclipse public license", ("2 0", "1 0")),
    ("cddl", "distribution", "common development and distribution license", ("1 1", "1 0")),
    ("eupl", "european", "european union public license", ("1 2", "1 1", "1 0")),
    ("artistic", "artistic", "artistic license", ("2 0", "1 0")),
    ("osl", "open", "open software license", ("3 0", "2 1", "2 0", "1 0")),
    ("afl", "academic", "academic free license", ("3 0", "2 1", "2 0")),
    ("bsl", "boost", "boost software license", ("1 0",)),
    ("zpl", "zope", "zope public license", ("2 1", "2 0")),
    ("psf", "python", "python software foundation license", ("2",)),
    ("ofl", "font", "(?:sil )?open font license", ("1 1", "1 0")),
    ("odbl", "database", "open database license", ("1 0",)),
    ("wtfpl", "want", "do what the fuck you want to public license", ("2",)),
    ("zlib", "zlib", "zlib(?: libpng)? license", ()),
    ("isc", "isc", "isc license", ()),
    ("bsd", "bsd", "(?:(?:2|3|4|two|three|four) clause )?bsd(?: style)? license", ()),
    ("mit", "mit", "mit license", ()),
    ("unlicense", "unlicense", "unlicense", ()),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc-by-nc-nd", "nd", "cc by nc nd", ("4 0", "3 0", "2 0")),
    ("cc-by-nc-sa", "sa", "cc by nc sa", ("4 0", "3 0", "2 0")),
    ("cc-by-nc", "nc", "cc by nc", ("4 0", "3 0", "2 0")),
    ("cc-by-nd", "nd", "cc by nd", ("4 0", "3 0", "2 0")),
    ("cc-by-sa", "sa", "cc by sa", ("4 0", "3 0", "2 0")),
    ("cc-by", "cc", "cc by", ("4 0", "3 0", "2 0")),
)
# Wordings of whole notices.
NOTICES = (
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "binary", "redistribution and use in source and binary forms with or without modification"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("cc", "creative", "creative commons attribution(?: noncommercial)?(?: noderivatives| sharealike)?"),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("rights-reserved", "reserved", "all rights reserved"),
)


def needed_words(pattern: str) -> list[str]:
    """Words that every match of a pattern holds: those outside of its groups that stand between spaces."""

    def without(group: re.Match) -> str:
        inside, optional = group.groups()
        # A dropped group must not join what is left and right of it to a word.
        return "" if optional and (inside.startswith(" ") or inside.endswith(" ")) else "?"

    before = None
    while before != pattern:
        before, pattern = pattern, re.sub(r"\(\?:([^()]*)\)(\??)", without, pattern)
    return sorted({word for word in pattern.split(" ") if re.fullmatch("[a-z0-9]+", word)})


def signature_rules() -> list[tuple[list[str], list[tuple[int, str, str]]]]:
    """Groups (words, rules); rules are (priority, label, pattern). First come notices, then the families' explicit
    wordings, plain names, and names with an introduction."""
    groups = [(keyword, pattern, [(label, pattern)]) for label, keyword, pattern in NOTICES]
    groups += [(keyword, name, []) for _, keyword, name, _ in FAMILIES]
    families = list(zip(FAMILIES, [rules for _, _, rules in groups[len(NOTICES):]]))
    for (label, _, name, versions), rules in families:
        for version in versions:
            major = version.replace(" ", "-")
            rules.append((f"{label}-{major}-or-later",
                          f"{name}(?: as published by the free software foundation either)? v?(?:ersion )?{version} or"
                          "(?: at your option)? (?:any )?later"))
            rules.append((f"{label}-{major}", f"{name} v?(?:ersion )?{version}"))
    explicit = sum(len(rules) for _, _, rules in groups)
    table, priority = [], 0
    for place, (keyword, pattern, rules) in enumerate(groups):
        ordered = [(priority + i, label, x) for i, (label, x) in enumerate(rules)]
        priority += len(rules)
        if place >= len(NOTICES):
            family = place - len(NOTICES)
            label = FAMILIES[family][0]
            ordered.append((explicit + family, label, pattern))
            ordered.append((explicit + len(FAMILIES) + family, label, f"licensed under the {pattern}"))
        words = sorted({keyword, *needed_words(pattern)})
        table.append((words, [(i, name, rf"(?<= )(?:{x})(?= )") for i, name, x in ordered]))
    return table


def _words(piece: Column) -> Column:
    """Words in a piece that is cut at word edges."""
    return F.size(F.filter(F.split(piece, " "), lambda w: w != "")).cast("long")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of `docs` plus n_words, n_base, first_word, last_word, base_labels, labels, score,
    and `detections` (label, priority, start, end in words), resolved.

    Null texts are empty ones: no words, no labels, score 0. The score is the share of words in detections,
    raised to at least 0.5 by any base phrase. Repeated rows are scanned alike; columns with the new names
    are replaced; an empty table gives an empty table.
    """
    parts = F.filter(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), NO_WORD), lambda w: w != "")
    base = [(phrase.split(), [(i, label, f"(?<= ){phrase}(?= )")]) for i, (phrase, label) in enumerate(BASE.items())]
    groups = signature_rules()
    asked = F.array(*[F.lit(w) for w in sorted({w for words, _ in [*base, *groups] for w in words})])
    rows = docs.select(whole_row(docs), parts.alias("words"))
    rows = rows.select("row", F.size("words").cast("long").alias("n_words"),
                       F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("plain"),
                       F.array_intersect("words", asked).alias("present"))

    def group_table(groups) -> Column:
        return F.array(*[F.struct(F.array(*map(F.lit, words)).alias("words"), F.array(*[F.struct(
            F.lit(p).alias("priority"), F.lit(name).alias("label"), F.lit(x).alias("pattern"),
        ) for p, name, x in rules]).alias("rules")) for words, rules in groups])

    def detect(groups) -> Column:
        """Spans of the rules of all groups whose words the text has."""
        due = F.filter(group_table(groups), lambda g: F.forall(g["words"], lambda w: F.array_contains("present", w)))
        return F.flatten(F.transform(F.flatten(F.transform(due, lambda g: g["rules"])), lambda r: F.transform(
            match_spans(F.col("plain"), r["pattern"], _words),
            lambda s: F.struct(r["priority"].alias("priority"), r["label"].alias("label"),
                               s["start"].alias("start"), s["end"].alias("end")),
        )))

    rows = rows.select("row", "n_words", detect(base).alias("base"), detect(groups).alias("found"))
    # Ordered by start, longest first, then priority: only what began earlier or there can contain a span, and of
    # those the one that reaches furthest, so one pass suffices. Among spans kept so far that is the last one.
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["priority"].alias("priority"), s["label"].alias("label"))))
    none = F.array().cast("array<struct<start:bigint,back:bigint,priority:int,label:string>>")

    def keep(kept: Column, s: Column) -> Column:
        top = F.try_element_at(kept, F.lit(-1))
        inside = F.coalesce(top["back"] <= s["back"], F.lit(False))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(s)))

    rows = rows.withColumn("kept", F.aggregate(ordered, none, keep))
    detections = F.transform("kept", lambda s: F.struct(
        s["label"].alias("label"), s["priority"].alias("priority"), s["start"].alias("start"), (-s["back"]).alias("end")))
    names = F.transform("base", lambda s: s["label"])
    covered = F.aggregate("kept", F.lit(0).cast("long"), lambda n, s: n - s["back"] - s["start"])
    share = F.coalesce(covered / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0))
    starts = F.transform("base", lambda s: s["start"])
    rows = rows.withColumns({
        "n_base": F.size("base").cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(names)), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(
            F.concat(names, F.transform("kept", lambda s: s["label"])))), ","),
        "score": F.least(F.lit(1.0), F.when(F.size("base") > 0, F.greatest(F.lit(0.5), share)).otherwise(share)),
        "detections": detections,
    })
    return with_new(rows, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
