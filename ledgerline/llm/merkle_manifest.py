"""Merkle manifest of a dataset as a postorder append log.

A tree's nodes are logged when they are complete: each leaf, then every run that it completes. What lies before a node
follows from the sizes of the subtrees before it, so that a node's place is closed-form in (level, index, number of leaves), and a
builder that holds an aligned block of leaves knows the places of all its nodes without the other builders. Builders of the next
tier take the blocks' tops as leaves. Proofs address siblings by their places, from the top tier down: what a block needs above itself
is the same for all its leaves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

#: A builder holds at most 2**BITS leaves and their inner nodes.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOG = "tree string, leaves long, level int, index long, position long, digest string, id long, note string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Level of the root: runs of two, until one node remains."""
    return (leaves - 1).bit_length()


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in its tree's log.

    Before leaf i lie i leaves and the runs that they have completed, 2 i - popcount(i) nodes in all; a full node comes ``level`` places after its last leaf.
    Nodes that the last leaf leaves short close after everything else, from below; the lowest of them is above the lowest set bit of the count.
    """
    last = ((index + 1) << level) - 1
    if last < leaves:
        return 2 * last - last.bit_count() + level
    return 2 * leaves - leaves.bit_count() + level - (leaves & -leaves).bit_length()


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Each value as its count of UTF-8 bytes, a colon and the value, '-' for null, all one after another, hashed."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def indexed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``index``, the place within its ``tree`` in the given order, and ``leaves``, the tree's count.

    Rows are dealt by ranges of the order, so that a large tree is many ranges; a range numbers its rows and the counts of ranges give offsets.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(nodes.repartitionByRange(n, "tree", *order).withColumn("range_no", F.spark_partition_id()), "leaves")
    by_tree = Window.partitionBy("tree")  # a row for each range of the tree
    before = F.sum("in_range").over(by_tree.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranges.groupBy("range_no", "tree").agg(F.count(F.lit(1)).alias("in_range")).select("range_no", "tree", F.coalesce(before, F.lit(0)).alias("before"), F.sum("in_range").over(by_tree).alias("leaves"))
    inside = F.row_number().over(Window.partitionBy("range_no", "tree").orderBy(*order)) - 1
    return ranges.join(counts, ["range_no", "tree"]).withColumn("index", F.col("before") + inside).drop("range_no", "before")


def _builder(level: int, bits: int):
    """From a block's nodes of one level to the log rows of what stands above them, up to ``bits`` levels; leaves of level 0 are logged too."""

    def build(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("index")
        tree, leaves = nodes.column("tree")[0].as_py(), nodes.column("leaves")[0].as_py()
        top, log, open_nodes = min(level + bits, height(leaves)), [], []

        def add(at: int, index: int, value: str, id: int | None = None, note: str | None = None) -> None:
            log.append((tree, leaves, at, index, position(at, index, leaves), value, id, note))

        for index, value, id, note in zip(*(nodes.column(c).to_pylist() for c in ("index", "digest", "id", "note")), strict=True):
            if not level:
                add(0, index, value, id, note)
            at = level
            while at < top and index & 1:  # the second of its run completes it
                value, index, at = digest(open_nodes.pop()[2], value), index >> 1, at + 1
                add(at, index, value)
            open_nodes.append((at, index, value))
        at, index, value = open_nodes.pop()
        while at < top:  # the last leaf leaves these short: they close from below
            value, index, at = digest(open_nodes.pop()[2], value) if index & 1 else digest(value), index >> 1, at + 1
            add(at, index, value)
        columns = list(zip(*log, strict=True)) or [()] * 8
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in LOG.split(", ")])

    return build


def _height(leaves: str = "leaves") -> Column:
    return F.when(F.col(leaves) > 1, F.length(F.bin(F.col(leaves) - 1))).otherwise(0)


@dataclass(frozen=True)
class Log:
    """nodes: the log of all trees (``LOG``), a node's ``position`` being its place in its tree's. tiers: of builders, to the top of the highest tree."""

    nodes: DataFrame
    tiers: int
    bits: int

    def roots(self) -> DataFrame:
        return self.nodes.filter(F.col("level") == _height())


def append_log(leaves: DataFrame, *order: str, bits: int = BITS) -> Log:
    """The log of a forest. ``leaves``: tree, digest, id, note and the columns of ``order``. Each tier is written before the next one reads it."""
    ready = indexed(leaves, *order)
    block = lambda level: F.shiftright("index", bits).alias("block")
    first = ready.select("tree", "leaves", "index", "digest", "id", "note").groupBy("tree", block(0)).applyInArrow(_builder(0, bits), LOG)
    nodes = staged(first, "merkle")
    highest = nodes.agg(F.max(_height()).alias("h")).first()["h"] or 0  # one row
    tiers = max(1, -(-highest // bits))
    last = nodes
    for tier in range(1, tiers):
        low = tier * bits
        tops = last.filter((F.col("level") == low) & (_height() > low))
        last = staged(tops.groupBy("tree", block(low)).applyInArrow(_builder(low, bits), LOG), "merkle")
        nodes = nodes.unionByName(last)
    return Log(nodes, tiers, bits)


#: A step up: 'L' or 'R' and the sibling's digest, by the side it stands on, or '.' for a node alone in its run.
def steps(path: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(path):
        wide = 1 if path[at] == "." else 65
        out.append((path[at], path[at + 1 : at + wide]))
        at += wide
    return out


def folded(value: str, path: list[tuple[str, str]]) -> str:
    for side, sibling in path:
        value = digest(sibling, value) if side == "L" else digest(value, sibling)
    return value


def _paths(level: int, bits: int, finish):
    """From a block's logged nodes and what its tree needs above it to each member's path; ``finish`` makes rows of members."""

    def extract(nodes: pa.Table, above: pa.Table) -> pa.Table:
        (tree, top, rest), leaves = (above.column(c)[0].as_py() for c in ("tree", "top", "path")), nodes.column("leaves")[0].as_py()
        held = dict(zip(nodes.column("position").to_pylist(), nodes.column("digest").to_pylist(), strict=True))
        up, out = min(level + bits, height(leaves)), []
        for at, index, value, id, note in zip(*(nodes.column(c).to_pylist() for c in ("level", "index", "digest", "id", "note")), strict=True):
            if at == level:
                path, i = "", index
                for k in range(level, up):
                    count = -(-leaves >> k)  # nodes of the level
                    path += "L" + held[position(k, i - 1, leaves)] if i & 1 else "R" + held[position(k, i + 1, leaves)] if i + 1 < count else "."
                    i >>= 1
                out.append((tree, top, index, value, id, note, path))
        return finish(out, rest)

    return extract


PATHS = "tree string, block long, top string, path string"


def _members(rows: list[tuple], rest: str) -> pa.Table:
    """A member is a block of the tier below, with the same tree above."""
    return pa.table({"tree": pa.array([r[0] for r in rows], pa.string()), "block": pa.array([r[2] for r in rows], pa.int64()), "top": pa.array([r[1] for r in rows], pa.string()), "path": pa.array([r[6] + rest for r in rows], pa.string())})


def walked_down(log: Log, tops: DataFrame, finish, schema: str) -> DataFrame:
    """Rows of ``finish`` for all leaves. ``tops``: tree, leaves, top and the path above it for each tree."""
    carried = None
    for tier in range(log.tiers - 1, -1, -1):
        low = tier * log.bits
        begin = tops.filter(F.greatest(F.floor((_height() - 1) / log.bits), F.lit(0)) == tier).select(F.lit(0).cast("long").alias("block"), *[F.col(c).alias(c) for c in ("tree", "top", "path")]).select("tree", "block", "top", "path")
        above = begin if carried is None else begin.unionByName(carried)
        here = log.nodes.filter((F.col("level") >= low) & (F.col("level") < low + log.bits) & ((F.col("level") < _height()) | ((_height() == 0) & F.lit(low == 0))))
        here = here.withColumn("block", F.expr(f"shiftright(index, {low + log.bits} - level)"))
        carried = here.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_paths(low, log.bits, finish if tier == 0 else _members), schema if tier == 0 else PATHS)
        carried = carried if tier == 0 else staged(carried, "paths")
    return carried


AUDIT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_steps int"


def audit(docs: DataFrame, altered: dict[str, Column] | None = None, when: Column | None = None, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, leaf, subroot (of its tree), root (over all subroots), proof_sha256, folded_root, verified, n_steps.

    The proof is the siblings on the way from the leaf by its subroot to the root. ``folded_root`` is computed from it and the leaf, or, where
    ``when`` holds, the leaf with the columns of ``altered`` in place of its own; ``verified`` says whether that is the root.

    Trees are ordered by ``tree_col``, null first, then by bytes; leaves by id, null first, then by their digest, so ties have one order and
    repeated rows are leaves of their own. A row alone in its tree is the subroot, a tree alone is the root; a proof without siblings is
    the digest of an empty text. A null value hashes as '-', which no value does. An empty table gives no rows; extra columns are ignored.
    """
    columns = {c: F.col(f"`{c}`") for c in fields}
    leaf, id = leaf_digest(columns), F.col(f"`{id_col}`")
    changed = F.when(when, leaf_digest(columns | (altered or {}))) if when is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    log = append_log(docs.select(tree.alias("tree"), id.cast("long").alias("id"), leaf.alias("digest"), changed.alias("note")), "id", "digest", bits=bits)
    subroots = log.roots().select("tree", "leaves", F.col("digest").alias("top"))
    above = append_log(subroots.select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("id"), F.col("top").alias("digest"), F.col("tree").alias("note")), "note", bits=bits)
    found = above.roots().first()  # one row, or none
    root = found["digest"] if found else ""

    def named(rows: list[tuple], rest: str) -> pa.Table:
        return pa.table({"tree": pa.array([r[5] for r in rows], pa.string()), "path": pa.array([r[6] + rest for r in rows], pa.string())})

    def proven(rows: list[tuple], rest: str) -> pa.Table:
        shared, out = steps(rest), []
        for _, top, _, value, id, note, path in rows:
            way = steps(path) + shared
            got = folded(note or value, way)
            out.append((id, value, top, root, digest(*(sibling for _, sibling in way)), got, got == root, sum(side != "." for side, _ in way)))
        names = [x.split()[0] for x in AUDIT.split(", ")]
        types = (pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int32())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    start = above.roots().select("tree", "leaves", F.col("digest").alias("top"), F.lit("").alias("path"))
    tops = subroots.join(staged(walked_down(above, start, named, "tree string, path string"), "tops"), "tree")
    return walked_down(log, tops, proven, AUDIT)
