"""Personal data by weak supervision (operator 9, DataFrame and SQL functions only).

Candidate spans come from patterns. Three kinds of labelers vote on each: a regex labeler (the strict form of the
kind), a gazetteer labeler (known providers, reserved examples and prefixes), and a context labeler (words right
before the span). Votes are -1, 0 (abstains) or 1. Expectation-maximisation over the table of vote patterns
estimates how reliable each labeler is; the final span classifier adds the log odds of the votes and of the
span's kind. Base spans stay in any case; the classifier decides on the wider candidates.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evkit.llm.common import whole_row, with_new
from evkit.llm.spans import match_spans

# Base kinds and patterns, written so that Java neither recurses per repeat nor tries a run again
# from each of its characters. Nothing follows the last group, and no class holds the sign after it, so taking runs
# whole (possessively) finds the same matches; a match starts at a run's start or where the one before ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# The dealt pattern `[0-9]([\x20-]?[0-9])+`, with runs of digits in one step; at least two digits match.
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
# Wider candidates: kinds of the method.
WIDER = {
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z][A-Za-z0-9_]{2,29}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}\b",
    "local_phone": r"(?<![0-9+.-])\(?0?[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9.-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
STRICT = {
    "email": r".*\.[A-Za-z]{2,24}", "ip": r"(?!0\.)[0-9.]+", "card": r"[3-6].*", "phone": r"\+[1-9].*",
    "handle": r"@[a-z]+[._]?[a-z0-9]+", "iban": r"[A-Z]{2}[0-9]{2}.*", "local_phone": r"\(?0.*",
    "national_id": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
}
KNOWN = r"(?i).*(gmail|yahoo|hotmail|outlook|proton|icloud|mail)\..*|\+(1|33|34|39|44|49).*|(DE|FR|GB|ES|IT|NL|CH).*|4.*|5[1-5].*"
RESERVED = r"(127|0|255)\..*|192\.168\..*|10\..*|(?i)(no-?reply|example|test)@.*"
HINTS = r"(?i)(mail|contact|phone|tel|call|mobile|card|visa|iban|account|ssn|ip|address|host|reach|write)[^A-Za-z0-9]{0,3}(me|at|us|no|number)?[^A-Za-z0-9]{0,4}$"
CONTEXT = 24
ROUNDS = 50
LABELERS = ("by_regex", "by_gazetteer", "by_context")
THRESHOLD = 0.5


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    digits = F.reverse(_digits(found))

    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    n = F.length(_digits(found))
    if kind == "ip":
        parts = F.split(found, r"\.")
        return F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            parts, lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(found)).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _candidates(text: Column) -> Column:
    """Array of (kind, order, start, end, found, before, base)."""
    patterns = {**dict(zip(BASE_KINDS, (EMAIL, IP, CARD, PHONE))), **WIDER}
    return F.concat(*[_of_kind(text, i, kind, pattern) for i, (kind, pattern) in enumerate(patterns.items())])


def _of_kind(text: Column, order: int, kind: str, pattern: str) -> Column:
    spans = match_spans(text, F.lit(pattern), lambda piece: F.length(piece).cast("long"), CONTEXT)
    return F.transform(F.filter(spans, lambda s: _valid(kind, s["found"])), lambda s: F.struct(
        F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
        s["found"].alias("found"), F.lit(kind in BASE_KINDS).alias("base"),
        s["before"].alias("before")))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _votes(s: Column) -> Column:
    strict = F.lit(False)
    for kind, pattern in STRICT.items():
        strict = F.when(s["kind"] == kind, F.regexp_like(s["found"], F.lit(f"^(?:{pattern})$"))).otherwise(strict)
    gazetteer = F.when(F.regexp_like(s["found"], F.lit(f"^(?:{RESERVED})$")), -1).when(
        F.regexp_like(s["found"], F.lit(f"^(?:{KNOWN})$")), 1).otherwise(0)
    return F.struct(F.when(strict, 1).otherwise(-1).alias("by_regex"), gazetteer.alias("by_gazetteer"),
                    F.when(F.regexp_like(s["before"], F.lit(HINTS)), 1).otherwise(0).alias("by_context"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability that a candidate is personal data, by kind and votes, from counts of both, by EM.

    Each labeler has a vote distribution for true and for false spans; each kind has a share of true ones.
    One pseudo-count per vote keeps them off 0; labelers start out as right in 7 of 10 votes.
    """
    shares = {kind: 0.5 for kind, _, _ in patterns}
    odds = [{v: (0.7, 0.3) if v > 0 else (0.3, 0.7) if v < 0 else (0.5, 0.5) for v in (-1, 0, 1)} for _ in LABELERS]
    belief: dict = {}
    for _ in range(ROUNDS):
        for kind, votes, _n in patterns:
            logit = log(shares[kind] / (1 - shares[kind]))
            logit += sum(log(odds[i][v][0] / odds[i][v][1]) for i, v in enumerate(votes))
            belief[kind, votes] = 1 / (1 + exp(-max(-30.0, min(30.0, logit))))
        for kind in shares:
            own = [(belief[k, v], n) for k, v, n in patterns if k == kind]
            shares[kind] = (1 + sum(b * n for b, n in own)) / (2 + sum(n for _, n in own))
        for i in range(len(LABELERS)):
            true = {v: 1.0 for v in (-1, 0, 1)}
            false = dict(true)
            for kind, votes, n in patterns:
                true[votes[i]] += belief[kind, votes] * n
                false[votes[i]] += (1 - belief[kind, votes]) * n
            odds[i] = {v: (true[v] / sum(true.values()), false[v] / sum(false.values())) for v in true}
    return belief


def find_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of `docs` plus n_email, n_ip, n_card, n_phone, `base_spans`, `all_spans`.

    Spans are arrays of (order, start, end, kind), in code points, end exclusive, ordered by kind and start.
    Null texts are empty and have none. Repeated rows are read alike; columns with the new names are
    replaced. An empty table gives an empty table.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(whole_row(docs), F.transform(_candidates(full), lambda s: F.struct(
        s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["base"].alias("base"), _votes(s).alias("votes"))).alias("found"))
    # One row per kind and vote pattern: at most 8 * 27, whatever the corpus.
    counted = rows.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    patterns = sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in counted)
    believed = [key for key, p in reliabilities(patterns).items() if p >= THRESHOLD]
    key = lambda s: F.concat_ws(":", s["kind"], *[s["votes"][n].cast("string") for n in LABELERS])
    names = [":".join([kind, *map(str, votes)]) for kind, votes in believed]
    chosen = F.array(*map(F.lit, names)).cast("array<string>")
    short = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(
        s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = rows.withColumns({
        "base_spans": short(F.filter("found", lambda s: s["base"])),
        "all_spans": short(F.filter("found", lambda s: s["base"] | F.array_contains(chosen, key(s)))),
        **{f"n_{kind}": _count("found", kind) for kind in BASE_KINDS},
    })
    return with_new(rows, [*[f"n_{kind}" for kind in BASE_KINDS], "base_spans", "all_spans"])


def span_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
