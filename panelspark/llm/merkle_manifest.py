"""Merkle manifest of a dataset: per-group hash trees, one root over them, and a proof for every row.

A row's leaf is the digest of its fields. Inside a group (a language) leaves ascend by id, then by leaf;
at each level an equijoin of the nodes with their computed sibling indices (exclusive-or with 1 for binary
trees, slot offsets otherwise) brings a node's siblings to it, and the rows in slot 0 emit the parents. The
subroots, ordered by group, form the top tree in the same way. Proofs come down the levels again: a node's
proof is its own siblings followed by its parent's proof, so every join is as large as its level.

Digests are the lower-case hex SHA-256 of the concatenated inputs. Null fields are ``-``, others their
number of UTF-8 bytes, a colon and the value. Null ids come first, null groups are a group of their own
that comes first. Equal rows are leaves next to each other. An empty table gives no rows. Only the named
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import stage_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that a proof descends between two written tables.
STRIDE = 4


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields, each as length and value, or a mark for null."""

    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*[framed(c) for c in fields])


def placed(rows: DataFrame, group: str, order: Sequence[str], numbered: bool = True) -> DataFrame:
    """Rows with ``idx``, their place in the group under ``order``, ``n``, its rows, and ``gid``, the group's place.

    Rows are dealt out by ranges of (group, order), so a large group spreads over many partitions. A row's
    place is its place in the partition plus the rows of earlier partitions, which are counted per partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    laid = stage_table(laid.withColumn("at", F.monotonically_increasing_id()), "placed")
    laid = laid.withColumn("part", F.shiftright("at", 33))
    counts = stage_table(laid.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")), "spans")
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select(
        F.col(group).alias("_g"), F.col("part").alias("_p"), (F.coalesce(F.sum("c").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("c").over(Window.partitionBy(group)).alias("n"),
    )
    if numbered:
        groups = placed(counts.select(group).distinct().withColumn("_all", F.lit(0)), "_all", [group], numbered=False)
        groups = groups.select(F.col(group).alias("_h"), F.col("idx").alias("gid"))
        spans = spans.join(groups, F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    at_home = laid[group].eqNullSafe(spans["_g"]) & (laid["part"] == spans["_p"])
    return laid.join(spans, at_home).select(*[laid[c] for c in rows.columns], *["gid"][: int(numbered)], (F.col("at") + F.col("shift")).alias("idx"), "n")


def siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (gid, idx, n, node, ...) with ``entry``: the slot as one byte, then the siblings' digests, left to right."""
    slot = F.col("idx") % arity
    out = nodes
    for offset in range(1, arity):
        other = nodes.select("gid", F.col("idx").alias("_at"), F.col("node").alias(f"_s{offset}"))
        sibling = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("idx") - slot + (slot + offset) % arity
        out = out.withColumn("_at", sibling).join(other, ["gid", "_at"], "left").drop("_at")
    brought = F.array(*[F.col(f"_s{o}") for o in range(1, arity)])
    at = lambda j: F.coalesce(F.get(brought, (F.pmod(F.lit(j) - slot, F.lit(arity)) - 1).cast("int")), F.lit(""))
    beside = F.concat(*[F.when(slot != j, at(j)).otherwise("") for j in range(arity)])
    entry = F.unhex(F.concat(F.lpad(F.hex(slot), 2, "0"), beside))
    return out.withColumn("entry", F.when(F.col("n") > 1, entry)).drop(*[f"_s{o}" for o in range(1, arity)])


def parents(level: DataFrame, arity: int) -> DataFrame:
    """What the slot-zero rows emit: the digest of the run, in which this row is the first."""
    beside = F.lower(F.hex(F.substring("entry", 2, 32 * arity)))
    up = level.filter((F.col("n") > 1) & (F.col("idx") % arity == 0))
    count = F.expr(f"(n + {arity - 1}) div {arity}")
    return up.select("gid", F.expr(f"idx div {arity}").alias("idx"), count.alias("n"), digest(F.col("node"), beside).alias("node"))


def climb(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The levels from the leaves up, each a written table with its siblings; every group ends in one node."""
    levels = [stage_table(siblings(leaves, arity), "level")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(stage_table(siblings(parents(levels[-1], arity), arity), "level"))
        most = -(-most // arity)
    return levels


def descend(levels: list[DataFrame], above: DataFrame | None, arity: int) -> DataFrame:
    """The leaves with ``subroot`` and ``proof``, the entries up to the root.

    ``above`` (gid, subroot, proof) says how the proofs of the groups go on; None: every group ends the proof.
    """
    found = None
    for k, level in reversed(list(enumerate(levels))):
        rows = level.filter("n = 1")
        if above is None:
            rows = rows.withColumns({"subroot": F.col("node"), "proof": F.array().cast("array<binary>")})
        else:
            rows = rows.join(above, "gid")
        if found is not None:
            up = found.select("gid", F.col("idx").alias("_up"), "subroot", F.col("proof").alias("_proof"))
            below = level.filter("n > 1").withColumn("_up", F.expr(f"idx div {arity}")).join(up, ["gid", "_up"])
            rows = below.withColumn("proof", F.concat(F.array("entry"), "_proof")).drop("_up", "_proof").unionByName(rows)
        found = rows if k == 0 or k % STRIDE else stage_table(rows.select("gid", "idx", "subroot", "proof"), "proofs")
    return found


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the entries of its proof give."""

    def step(node: Column, entry: Column) -> Column:
        left = F.conv(F.hex(F.substring(entry, 1, 1)), 16, 10).cast("int") * 64
        beside = F.lower(F.hex(entry))
        return digest(F.substring(beside, F.lit(3), left), node, F.substring(beside, left + 3, F.length(beside)))

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings' digests, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda e: F.lower(F.hex(F.substring(e, F.lit(2), F.length(e))))), ""), 256)


def manifest(
    docs: DataFrame, tampered: dict[str, Column] | None = None, *, fields: Sequence[str] = FIELDS, id_col: str = "doc_id",
    group_col: str = "lang", arity: int = 2,
) -> DataFrame:
    """Per row doc_id, leaf, subroot, root, its proof (binary entries) and the leaf as found.

    ``tampered`` maps fields to columns over ``docs`` that take their place in the leaf as found, so that
    folding it with the proof shows which rows were changed since the manifest was made.
    """
    if not 2 <= arity <= 255:
        raise ValueError("arity must be between 2 and 255")
    found = leaf_of([(tampered or {}).get(c, docs[c]) for c in fields])
    leaves = docs.select(docs[id_col].alias("doc_id"), docs[group_col].alias("_group"), leaf_of([docs[c] for c in fields]).alias("node"), found.alias("found"))
    levels = climb(placed(leaves, "_group", ["doc_id", "node"]), arity)
    subroots = reduce(DataFrame.unionByName, [x.filter("n = 1").select("gid", "node") for x in levels])
    subroots = stage_table(subroots, "subroots")
    group = F.lit(0).cast("long").alias("gid")
    top = climb(subroots.select(group, F.col("gid").alias("idx"), F.lit(subroots.count()).cast("long").alias("n"), "node"), arity)
    root = top[-1].filter("n = 1").select("node").first()
    above = descend(top, None, arity).select(F.col("idx").alias("gid"), F.col("node").alias("subroot"), "proof")
    rows = descend(levels, stage_table(above, "above"), arity)
    return rows.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root[0] if root else "").alias("root"), "proof", "found")


def verified(rows: DataFrame) -> DataFrame:
    """The manifest's rows with proof_sha256, folded_root and whether it is the root."""
    out = rows.withColumns({"proof_sha256": proof_digest(F.col("proof")), "folded_root": fold(F.col("found"), F.col("proof"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("proof", "found")
