"""Merkle manifest of a dataset by nested-interval labels (operator 12).

Rows are leaves of one tree per group, ordered by id; every FAN consecutive nodes become one node of the next level.
The groups' roots, in the order of the groups, are the leaves of a last tree, whose root stands for the dataset.

A node's label is the interval [lo, hi) of the leaf ranks that it covers, with its level and tree.

* Ranks: narrow rows (group, id, digest) are sorted in ranges; counts per range and group, summed up before it,
  turn places into ranks. Texts never shuffle.
* Ancestors: level by level from the root down, a node joins the node of the next level whose interval contains its
  own. Intervals of one level start at multiples of FAN ** level, so that multiple is the bucket of the join.
* Siblings: the parent's interval less the node's own; those left of it and right of it are kept apart. A leaf's
  proof is the chain of these pairs up to the root, and folding a digest up the chain must give the root.

A parent has at most FAN children, so no join key is hot, however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evkit.operators.ranks import ranked
from evkit.session import write_once

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels of the highest tree that ranks of 63 bits allow.
MOST_LEVELS = 21
CHAIN = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 as lowercase hex."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of values, each as its UTF-8 byte count, a colon and itself, or as a hyphen if null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*parts))


def _ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """`leaves` (tree, digest, ...) plus lo, hi (rank in its tree by `order`, then digest) and `height` of its tree."""
    placed = ranked(leaves, ["tree"], [*order, "digest"], "lo")
    powers = F.array(*[F.lit(FAN**k) for k in range(MOST_LEVELS)])
    sizes = leaves.groupBy(F.col("tree").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    sizes = write_once(sizes.select("of", F.size(F.filter(powers, lambda p: p < F.col("size"))).alias("height")), "trees")
    placed = placed.join(sizes, F.col("tree") == F.col("of"))
    return placed.select(*leaves.columns, "lo", (F.col("lo") + 1).alias("hi"), "height")


def build_levels(leaves: DataFrame, order: Sequence[str]) -> list[DataFrame]:
    """Level by level, the nodes of all trees over `leaves` (tree, not null; digest; further columns stay).

    Nodes have tree, lo, hi, height, digest and, above the leaves, `kids` (lo, hi, digest; at most FAN). A tree has
    nodes up to the level of its height, where one is left.
    """
    levels = [write_once(_ranked(leaves, order), "leaves")]
    highest = levels[0].agg(F.max("height").alias("n")).first()["n"] or 0
    for level in range(1, highest + 1):
        bucket = F.floor(F.col("lo") / F.lit(FAN**level)).cast("long")
        runs = levels[-1].filter(F.col("height") >= level).groupBy("tree", bucket.alias("bucket"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"),
                        F.first("height").alias("height"))
        levels.append(write_once(runs.select(
            "tree", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "height",
            digest(F.array_join(F.col("kids.digest"), "")).alias("digest"), "kids"), f"level-{level}"))
    return levels


def attach_proofs(levels: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """The leaves plus `subroot` (of their tree), `root` and `chain`: siblings (left, right) up to the root.

    `crowns` has one row per tree: of, chain, root: what lies above the tree's own root.
    """
    above = None
    for level in reversed(range(len(levels))):
        nodes = levels[level]
        tops = nodes.filter(F.col("height") == level).join(crowns, F.col("tree") == F.col("of")).drop("of")
        tops = tops.withColumn("subroot", F.col("digest"))
        if above is None:
            above = tops
            continue
        width = FAN ** (level + 1)
        parents = above.select(
            F.col("tree").alias("p_tree"), F.floor(F.col("lo") / F.lit(width)).cast("long").alias("p_bucket"),
            F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "kids", F.col("chain").alias("p_chain"), "root", "subroot")
        bucket = F.floor(F.col("lo") / F.lit(width)).cast("long")
        inside = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
        below = nodes.filter(F.col("height") > level)
        own_kids = ["kids"] if "kids" in below.columns else []
        below = below.withColumnsRenamed({k: f"own_{k}" for k in own_kids})
        below = below.join(parents, (F.col("tree") == F.col("p_tree")) & (bucket == F.col("p_bucket")) & inside)
        left = F.filter("kids", lambda kid: kid["hi"] <= F.col("lo"))
        right = F.filter("kids", lambda kid: kid["lo"] >= F.col("hi"))
        pair = F.struct(F.array_join(left["digest"], "").alias("left"), F.array_join(right["digest"], "").alias("right"))
        below = below.withColumn("chain", F.concat(F.array(pair), F.col("p_chain")))
        below = below.drop("p_tree", "p_bucket", "p_lo", "p_hi", "p_chain", "kids")
        below = below.withColumnsRenamed({f"own_{k}": k for k in own_kids})
        above = tops.unionByName(below)
    return above


def proof_digest(chain: Column) -> Column:
    """Digest of all siblings of a chain, level by level, left to right."""
    return digest(F.array_join(F.transform(chain, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, chain: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its chain."""
    return F.aggregate(chain, leaf, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def manifest(docs: DataFrame, seen: Column | None = None, columns: Sequence[str] = COLUMNS, group: str = "lang",
             doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: id, leaf, subroot, root, chain, proof_sha256, folded_root, verified.

    Leaves are the digests of `columns`; groups are ordered bytewise, null first, rows of a group by id (a whole
    number), null first, and rows of one id by their digest. `seen` is the leaf digest as found now, by default
    the leaf itself: folded up the chain it must give the root (verified). Repeated rows are leaves each. A row
    alone in its group is its group's root, and alone in the table the root. Columns that are not named are not
    read. An empty table gives an empty table.
    """
    leaf = leaf_digest(*[F.col(f"`{c}`") for c in columns])
    # Null is the empty key, others begin with a sign, so keys sort as groups do.
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(doc_id).alias("id"), leaf.alias("digest"),
                       (leaf if seen is None else seen).alias("seen"))
    levels = build_levels(rows, ["id"])
    tops = [nodes.filter(F.col("height") == k).select("tree", "digest") for k, nodes in enumerate(levels)]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    last = build_levels(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    crown = last[-1].select(F.col("tree").alias("of"), F.array().cast(CHAIN).alias("chain"), F.col("digest").alias("root"))
    crowns = attach_proofs(last, crown).select(F.col("name").alias("of"), "chain", "root")
    proved = attach_proofs(levels, write_once(crowns, "crowns"))
    proved = proved.withColumn("folded_root", folded(F.col("seen"), F.col("chain")))
    return proved.select(
        "id", F.col("digest").alias("leaf"), "subroot", "root", "chain", proof_digest(F.col("chain")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
