"""A Merkle manifest of a table, its upper levels built by a butterfly exchange.

Rows are leaves; the leaves of each group (a language) form a tree of fanout 8,
and the groups' roots, in order, form the tree above them.

1. Leaves are numbered inside their group by range partitions (a group may hold
   any share of the rows, a row may be repeated any number of times).
2. Aligned blocks of at most 8^4 neighbouring leaves are gathered; a block's
   levels are hashed where it lies and written.
3. Blocks then swap roots round by round. In round r the blocks whose numbers
   differ only in their r-th octal digit (8 at most) meet; each learns the roots
   of the 8 neighbouring subtrees, keeps its siblings as the next step of its
   proof, and hashes the parent itself. So all blocks under one ancestor hash it
   redundantly, each has the upper part of its proof when the last round ends,
   and nothing is passed down. A last subtree with fewer blocks sends its root
   to as many meetings as the full ones have.
4. The groups' roots go through the same steps; a block's proof is extended by
   its group's.

A proof is a list of steps from the bottom, each with the joined digests of the
siblings on the left and on the right. Everything is DataFrame expressions.

Defined results: a null field is ``-``; a null group is a group of its own, the
first one; null keys come first in a group, rows with equal keys are ordered by
their leaves (equal rows are all kept); a group of one row has its leaf as
root; an empty table gives no rows. Only the named fields are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

FANOUT = 8
#: Levels that are hashed inside a block: blocks of at most 4,096 leaves.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of the fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    as_text = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in as_text)))


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """The rows with ``position`` (from 0, inside the group) and ``n`` (rows of the group).

    Range partitions are written in order; a group's rows before a partition
    are the sum of its counts in those before. Equal rows are told apart by a
    row id, so that they spread over partitions too. ``rows`` must be a stored
    table, so that a task that is run again sees the same ids.
    """
    key = [group, *order, "_id"]
    ranged = rows.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key)
    ranged = staged(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_id"), f"{name}-ranged")
    part = F.shiftright("_at", 33)
    own = ranged.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each group and partition that meet
    own = own.withColumns({"_shift": F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"), "n": F.sum("_n").over(of_group)})
    own = staged(own.select(F.col(group).alias("_group"), "_part", "_shift", "n"), f"{name}-counts")
    joined = ranged.join(own, ranged[group].eqNullSafe(own["_group"]) & (part == own["_part"]))
    return joined.withColumn("position", F.col("_at") + F.col("_shift")).drop("_group", "_part", "_shift", "_at")


def _levels_inside(n: Column) -> Column:
    """Levels above the leaves inside a block, where the group has n leaves."""
    return sum((F.when(n > FANOUT ** k, 1).otherwise(0) for k in range(BLOCK_LEVELS)), F.lit(0))


def blocks(rows: DataFrame, group: str, members: Sequence[str], name: str) -> DataFrame:
    """Per aligned block of numbered rows: group, block, n_blocks, members, levels (digests of each level) and node (the root)."""
    size = FANOUT ** BLOCK_LEVELS
    dealt = rows.groupBy(group, F.expr(f"position div {size}").alias("block"), "n").agg(  # at most 4,096 rows
        F.array_sort(F.collect_list(F.struct("position", *members))).alias("members"))

    def parents(nodes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")),
                           lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))

    leaves = F.transform("members", lambda m: m["leaf"])
    inside = F.filter(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), lambda k: k <= F.col("inner"))
    levels = F.aggregate(inside, F.array(leaves), lambda done, k: F.concat(done, F.array(parents(F.element_at(done, -1)))))
    made = dealt.withColumn("inner", _levels_inside(F.col("n"))).withColumn("levels", levels)
    return staged(made.select(group, "block", F.expr(f"(n - 1) div {size} + 1").alias("n_blocks"), "members", "levels"), f"{name}-blocks")


def butterfly(state: DataFrame, group: str, rounds: int, name: str) -> DataFrame:
    """Per block: node (now the group's root) and proof, from its own root (``node``) by ``rounds`` rounds of exchange.

    What a round leaves is written (one row per block, a 4,096th of the leaves), as the next one reads it twice.
    """
    state = staged(state.withColumn("proof", F.array().cast(PROOF)), f"{name}-round")
    for r in range(rounds):
        width = FANOUT ** r  # blocks under a full subtree
        block, total = F.col("block"), F.col("n_blocks")
        low, digit = block % width, F.expr(f"(block div {width}) % {FANOUT}")
        own = F.least(F.lit(width), total - block + low)  # blocks under this subtree
        meetings = F.when((own < width) & (digit > 0), F.sequence(low, F.lit(width - 1).cast("bigint"), own)).otherwise(F.array(low))
        active = state.where(total > width).withColumns({"low": low, "digit": digit, "upper": F.expr(f"block div {width * FANOUT}")})
        sent = active.withColumn("meeting", F.explode(meetings))
        here = F.col("meeting") == F.col("low")  # elsewhere the root alone is sent
        sent = sent.select(group, "upper", "meeting", "n_blocks", F.struct(
            "digit", "node", F.when(here, F.col("block")).alias("block"), F.when(here, F.col("proof")).alias("proof")).alias("m"))
        met = sent.groupBy(group, "upper", "meeting", "n_blocks").agg(F.array_sort(F.collect_list("m"), _by_digit).alias("_met"))  # 8 at most
        met = met.withColumn("_own", F.explode(F.filter("_met", lambda m: m["block"].isNotNull())))
        side = lambda test: F.array_join(F.transform(F.filter("_met", test), lambda m: m["node"]), "")
        step = F.struct(side(lambda m: m["digit"] < F.col("_own.digit")).alias("left"), side(lambda m: m["digit"] > F.col("_own.digit")).alias("right"))
        next_state = met.select(
            group, F.col("_own.block").alias("block"), "n_blocks", digest(F.array_join(F.transform("_met", lambda m: m["node"]), "")).alias("node"),
            F.concat("_own.proof", F.array(step)).alias("proof"))
        state = staged(state.where(total <= width).select(*next_state.columns).unionByName(next_state), f"{name}-round")
    return state


def _by_digit(a: Column, b: Column) -> Column:
    return (a["digit"] - b["digit"]).cast("int")


def tree(rows: DataFrame, group: str, order: Sequence[str], members: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks with their members and levels, and per block the group's root (``node``) with the proof from the block's root.

    ``rows`` has the columns ``group``, ``order``, ``members`` and ``leaf`` (a member too).
    """
    placed = numbered(rows, group, order, name)
    made = blocks(placed, group, members, name)
    most = made.agg(F.max("n_blocks")).first()[0] or 1
    rounds = next(r for r in range(64) if FANOUT ** r >= most)
    roots = made.select(group, "block", "n_blocks", F.element_at(F.element_at("levels", -1), 1).alias("node"))
    return made, butterfly(roots, group, rounds, name)


def _steps_inside(i: Column, levels: Column) -> Column:
    """The proof of the i-th member inside its block."""
    steps = []
    for k in range(BLOCK_LEVELS):
        nodes, at = F.get(levels, F.lit(k)), F.floor(i / FANOUT ** k).cast("int")
        first = at - at % FANOUT
        step = F.struct(F.array_join(F.slice(nodes, first + 1, at - first), "").alias("left"),
                        F.array_join(F.slice(nodes, at + 2, first + (FANOUT - 1) - at), "").alias("right"))
        steps.append(F.when(F.size(levels) > k + 1, step))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, node, lambda a, s: digest(F.concat(s["left"], a, s["right"])))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS,
             changed: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof (steps) and folded_root.

    ``changed`` is the digest of a row as it is now, null where it is as in the manifest; ``folded_root`` is
    what this digest (or the manifest's) and the manifest's proof lead to, computed for every row.
    """
    own = leaf([F.col(f) for f in fields])
    rows = docs.select(F.col(group_col).alias("lang"), F.col(id_col).alias("doc_id"), own.alias("leaf"),
                       (F.lit(None).cast("string") if changed is None else changed).alias("now"))
    rows = staged(rows, "merkle-leaves")
    made, lower = tree(rows, "lang", ["doc_id", "leaf"], ["doc_id", "leaf", "now"], "merkle")
    roots = lower.where("block = 0").select(F.lit(0).alias("all"), F.col("lang").alias("name"), F.col("node").alias("leaf"))
    over, top = tree(staged(roots, "merkle-subroots"), "all", ["name"], ["name", "leaf"], "merkle-top")

    # the proof of each group's root: its steps inside the top tree's block, then those of the block
    tops = over.join(top.select(F.col("block").alias("_b"), F.col("node").alias("root"), "proof"), over["block"] == F.col("_b"))
    groups = tops.select("root", F.inline(F.transform("members", lambda m, i: F.struct(
        m["name"].alias("name"), F.concat(_steps_inside(i, F.col("levels")), F.col("proof")).alias("above")))))
    upper = lower.join(groups, lower["lang"].eqNullSafe(groups["name"])).select(
        F.col("lang").alias("_lang"), F.col("block").alias("_block"), F.col("node").alias("subroot"), "root", F.concat("proof", "above").alias("above"))
    both = made.join(upper, made["lang"].eqNullSafe(upper["_lang"]) & (made["block"] == upper["_block"]))

    def row(m: Column, i: Column) -> Column:
        return F.struct(m["doc_id"].alias("doc_id"), m["leaf"].alias("leaf"), m["now"].alias("now"),
                        F.concat(_steps_inside(i, F.col("levels")), F.col("above")).alias("proof"))

    each = both.select("subroot", "root", F.inline(F.transform("members", row)))
    return each.select("doc_id", "leaf", "subroot", "root", "proof", folded(F.coalesce("now", "leaf"), F.col("proof")).alias("folded_root"))


def tampered(id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = FIELDS) -> Column:
    """Digest of the row with A-Z of its text lower-cased where 3 divides the crc32 of the id, else null."""
    lower = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0,
                  leaf([lower if f == text_col else F.col(f) for f in fields]))


def digests(rows: DataFrame) -> DataFrame:
    """The query's columns."""
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
