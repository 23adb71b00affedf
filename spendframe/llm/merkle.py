"""A Merkle manifest of a dataset: one tree per group of rows, one over the groups, a proof for every row.

Each level is a table of nodes ``(tree, idx, n, digest)`` with ``n`` the nodes of that tree on this level.
Nodes meet their siblings by an equijoin of the level with itself, shifted to the computed sibling
index (exclusive or for pairs, slot offsets otherwise); rows of slot zero then emit the parents.  Keys
are unique, so no group of rows, however large, is in one task.  Levels shrink by the arity and are
written once.  Proofs go the other way: a node's path is its own siblings and its parent's path; what
they are made of is kept as bytes, half as long as the hex text that is hashed.

Places of leaves come from ranges of the order: rows are dealt by range, counted by range, and
numbered within; no tree's rows are sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.llm.base import cut

#: Levels joined in one plan on the way down, between tables that are written.
STRIDE = 4
SIZE = 32
NO_STEPS = "array<binary>"


def digest(*parts: Column | str) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated as UTF-8."""
    return F.sha2(F.concat(*parts), 256)


def text(digests: Column | str) -> Column:
    """The hex text of one or more digests kept as bytes."""
    return F.lower(F.hex(digests))


def leaf(*values: Column) -> Column:
    """The digest of a row: ``-`` for each null, else the bytes of its text form, ``:`` and that text."""
    forms = [value.cast("string") for value in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in forms])


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in its tree by ``order`` (nulls first), and ``n``, the tree's rows.

    ``rows`` must be read from files (see ``cut``), so that its tie-breaking column is settled."""
    parts = cut(rows.repartitionByRange(tree, *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(tree, "_part").agg(F.count("*").alias("_rows"))  # a row a tree and range
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_of"), before.alias("_before"), F.sum("_rows").over(whole).alias("n"))
    within = F.row_number().over(Window.partitionBy(tree, "_part").orderBy(*order)) - 1
    placed = parts.withColumn("_inner", within).join(counts, (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_of")))
    return placed.withColumn("idx", F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_tree", "_of", "_before")


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Each node with ``step``: its slot as one byte, then the digests of its run's other nodes from left to right."""
    slot, level, none = F.pmod(F.col("idx"), F.lit(arity)), nodes, F.lit(b"")
    left, right = none, none
    for offset in range(1, arity):  # rising offsets meet the slots to the right, then those to the left
        theirs = F.pmod(slot + offset, F.lit(arity))
        place = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + theirs
        shifted = level.select(*[F.col(name).alias(f"_{name}{offset}") for name in ("tree", "idx", "digest")])
        nodes = nodes.withColumn("_place", place).join(
            shifted, (F.col("tree") == F.col(f"_tree{offset}")) & (F.col("_place") == F.col(f"_idx{offset}")), "left"
        )
        nodes = nodes.drop("_place", f"_tree{offset}", f"_idx{offset}")
        other = F.coalesce(f"_digest{offset}", none)
        left = F.concat(left, F.when(theirs < slot, other).otherwise(none))
        right = F.concat(right, F.when(theirs > slot, other).otherwise(none))
    step = F.concat(F.unhex(F.lpad(F.hex(slot), 2, "0")), left, right)
    return nodes.withColumn("step", step).drop(*[f"_digest{k}" for k in range(1, arity)])


def _sides(step: Column) -> tuple[Column, Column]:
    """The hex text of a step's digests to the left and to the right."""
    size = F.conv(F.hex(F.substring(step, 1, 1)), 16, 10).cast("int") * SIZE
    return text(F.substring(step, F.lit(2), size)), text(F.substring(step, size + 2, F.octet_length(step)))


def levels(leaves: DataFrame, arity: int = 2) -> list[DataFrame]:
    """The tables of all levels, leaves first: ``tree, idx, n, digest, step`` (the first keeps other columns too)."""
    if not 2 <= arity <= 256:
        raise ValueError("arity must be 2 to 256")
    leaves = cut(leaves)
    n = leaves.agg(F.max("n")).first()[0] or 1
    nodes, out = leaves, []
    while True:
        linked = cut(_siblings(nodes, arity))
        out.append(linked)
        if n == 1:
            return out
        n = -(-n // arity)
        nodes = linked.where((F.col("n") > 1) & (F.pmod(F.col("idx"), F.lit(arity)) == 0)).select(
            "tree",
            F.expr(f"idx div {arity}").alias("idx"),
            F.ceil(F.col("n") / arity).alias("n"),
            F.unhex(digest(text("digest"), _sides(F.col("step"))[1])).alias("digest"),
        )


def roots(tables: Sequence[DataFrame]) -> DataFrame:
    """(tree, digest): the single node that each tree ends in."""
    ends = [t.where("n = 1").select("tree", "digest") for t in tables]
    found = ends[0]
    for more in ends[1:]:
        found = found.union(more)
    return found


def paths(tables: Sequence[DataFrame], arity: int = 2) -> DataFrame:
    """The first level with ``path``: the steps from each leaf to its root; a lone leaf has none."""
    below, nothing = None, F.array().cast(NO_STEPS)
    for number, table in reversed(list(enumerate(tables))):
        own = F.when(F.col("n") > 1, F.array("step")).otherwise(nothing)
        if below is None:
            joined = table.withColumn("path", own)
        else:
            parents = below.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("path").alias("_path"))
            joined = table.withColumn("_parent", F.expr(f"idx div {arity}")).join(
                parents, (F.col("tree") == F.col("_tree")) & (F.col("_parent") == F.col("_idx")) & (F.col("n") > 1), "left"
            )
            joined = joined.withColumn("path", F.concat(own, F.coalesce("_path", nothing))).drop("_parent", "_tree", "_idx", "_path")
        below = joined.drop("step")
        if number and number % STRIDE == 0:
            below = cut(below)
    return below


def fold(start: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) leads to along its path."""

    def climb(held: Column, step: Column) -> Column:
        left, right = _sides(step)
        return digest(left, held, right)

    return F.aggregate(path, start, climb)


def siblings(path: Column) -> Column:
    """The hex text of all siblings on a path, in order."""
    return F.aggregate(path, F.lit(""), lambda held, step: F.concat(held, text(F.substring(step, F.lit(2), F.octet_length(step)))))


def proof(path: Column) -> Column:
    """The digest of all siblings on a path, in order."""
    return digest(siblings(path))


def manifest(
    docs: DataFrame,
    *,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree_col: str = "lang",
    id_col: str = "doc_id",
    arity: int = 2,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root`` (hex), ``path`` (see ``fold``) and the columns of ``extra``.

    Leaves are digests of ``columns``; those with equal ``tree_col`` make a tree, in ascending order of
    ``id_col`` (null first); of equal ids, the lower digest first, and repeated rows are leaves of their
    own.  The trees' roots, in bytewise order of ``tree_col`` with null first, make the upper tree, whose
    root is ``root``.  Nulls and empty texts have digests of their own.  ``extra`` is computed on the
    input's rows and carried along (a digest of what someone claims a row to be, for ``fold``).  Other
    columns are ignored; an empty table gives no rows.
    """
    extra = extra or {}
    own = leaf(*[F.col(f"`{c}`") for c in columns])
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit("-"))  # "-" sorts before "="
    carried = [value.alias(f"_extra_{name}") for name, value in extra.items()]
    rows = docs.select(group.alias("tree"), F.col(f"`{id_col}`").alias("doc_id"), F.unhex(own).alias("digest"), *carried)
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))  # settled: it tells repeated rows apart
    lower = levels(numbered(rows, "tree", ["doc_id", "digest", "_row"]).drop("_row"), arity)
    ends = cut(roots(lower).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"))
    upper = levels(numbered(ends, "tree", ["of"]), arity)
    top = roots(upper).select(F.col("tree").alias("_top"), text("digest").alias("root"))
    groups = paths(upper, arity).join(top, F.col("tree") == F.col("_top"))
    groups = groups.select(F.col("of").alias("_of"), text("digest").alias("subroot"), "root", F.col("path").alias("_above"))
    found = paths(lower, arity).join(groups, F.col("tree") == F.col("_of"))
    names = [F.col(f"_extra_{name}").alias(name) for name in extra]
    return found.select("doc_id", text("digest").alias("leaf"), "subroot", "root", F.concat("path", "_above").alias("path"), *names)
