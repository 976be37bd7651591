"""A Merkle tree over the rows of a dataset: a root for each group of rows, one over all groups, and a proof for each row.

Bottom-up: a group's leaves are numbered in order; every two neighbours become a node of the next level until one is left (a last
node without a neighbour is hashed alone). ``bits`` levels are built and written together, as blocks of ``2 ** bits`` nodes, each
holding its nodes of these levels; a block's top is a node of the next table. Top-down: each table is joined to what its
parents' proofs are from their table on, the suffix; every child of a block prepends its own siblings. Proofs thus move along the
network for each block, not for each row, and no task sees more than a block.

A proof is an array with a step for each level: ``L`` or ``R``, the sibling's side, and its hash; an empty string where there is no
sibling.

Defined results: leaves ascend by doc_id, nulls last, then by their hash, so repeated rows are leaves of their own. A null lang is a group of
its own, the first. A null column is ``-``, told from any value by its missing length. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Hash of a row, with some columns changed."""
    return digest(*(field(changed.get(c, F.col(c))) for c in COLUMNS))


def _above(level: Column) -> Column:
    """Nodes over a level's nodes."""
    pair = lambda i: digest(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)


def _upto(n: Column) -> Column:
    """1 to n; nothing for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def build(nodes: DataFrame, bits: int = 8) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks, lowest first, and roots (g, h), of nodes (g, idx, n, h, item): idx from 0 in each group g of n nodes.

    A block is (g, blk, items, levels): its nodes in order, and their hashes level by level up to the one on top.
    """
    tables, most = [], nodes.agg(F.max("n")).first()[0] or 0
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    for k in range(max(-(-max(most - 1, 0).bit_length() // bits), 1)):
        blocks = nodes.groupBy("g", F.shiftright("idx", bits).alias("blk")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "h", "item"))).alias("items"))
        rounds = F.greatest(F.least(height - bits * k, F.lit(bits)), F.lit(0)).cast("int")
        hashes = F.array(F.transform("items", lambda x: x["h"]))
        levels = F.aggregate(_upto(rounds), hashes, lambda done, _: F.concat(done, F.array(_above(F.element_at(done, -1)))))
        blocks = written(blocks.select("g", "blk", "n", "items", levels.alias("levels")), "blocks")
        tables.append(blocks)
        nodes = blocks.select("g", F.col("blk").alias("idx"), "n", F.element_at("levels", -1)[0].alias("h"), F.lit(None).cast("string").alias("item"))
    return tables, nodes.select("g", "h")


def _own(at: Column, levels: Column) -> Column:
    """A node's steps within its block."""

    def step(r: Column) -> Column:
        here = F.call_function("shiftright", at, r - 1)
        side = F.when(here.bitwiseAND(F.lit(1)) == 1, "L").otherwise("R")
        return F.coalesce(F.concat(side, F.get(F.get(levels, r - 1), here.bitwiseXOR(F.lit(1)))), F.lit(""))

    return F.transform(_upto(F.size(levels) - 1), step)


def push(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Proofs (g, idx, h, item, proof) of the lowest nodes, from the suffixes (g, suffix) of the roots."""
    tops = tops.withColumn("blk", F.lit(0).cast("long"))
    for blocks in reversed(tables):
        told = blocks.join(tops, ["g", "blk"]).select("g", "levels", "suffix", F.posexplode("items").alias("at", "x"))
        nodes = told.select("g", F.col("x.idx").alias("idx"), F.col("x.h").alias("h"), F.col("x.item").alias("item"), F.concat(_own(F.col("at"), F.col("levels")), "suffix").alias("proof"))
        if blocks is tables[0]:
            return nodes
        tops = written(nodes.select("g", F.col("idx").alias("blk"), F.col("proof").alias("suffix")), "suffixes")
    raise ValueError("no tables")


def fold(node: Column, proof: Column) -> Column:
    """The root that a node's hash and its proof give."""
    join = lambda h, s: digest(F.when(s.startswith("L"), F.substring(s, 2, 64)).otherwise(""), h, F.when(s.startswith("R"), F.substring(s, 2, 64)).otherwise(""))
    return F.aggregate(proof, node, join)


def siblings(proof: Column) -> Column:
    """The siblings' hashes of a proof, lowest first."""
    return F.transform(F.filter(proof, lambda s: s != ""), lambda s: F.substring(s, 2, 64))


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = 8) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof, other (the hash ``tampered``, an expression over the documents' columns).

    ``fold(leaf, proof)`` is the root for each row; with any change to a row's columns it is not.
    """
    other = tampered if tampered is not None else F.lit(None).cast("string")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"), leaf().alias("h"), other.alias("other"))
    leaves = written(kept, "leaves")
    item = F.struct("doc_id", F.nullif("other", "h").alias("other"))
    placed = numbered(leaves, [F.asc_nulls_last("doc_id"), F.col("h")], "g").select("g", "idx", "n", "h", item.alias("item"))
    tables, roots = build(placed, bits)
    groups = numbered(written(roots, "roots"), [F.col("g")]).select(F.lit("").alias("g"), "idx", "n", "h", F.col("g").alias("item"))
    over, top = build(groups, bits)
    root = top.select(F.col("h").alias("root"))
    tops = written(push(over, over[-1].select("g", F.array().cast("array<string>").alias("suffix"))).select(F.col("item").alias("g"), F.col("h").alias("subroot"), F.col("proof").alias("suffix")).crossJoin(F.broadcast(root)), "tops")
    heads = tops.select("g", "subroot", "root")
    heads = F.broadcast(heads) if heads.count() <= 100_000 else heads
    out = push(tables, tops.select("g", "suffix")).join(heads, "g")
    return out.select("item.doc_id", F.col("h").alias("leaf"), "subroot", "root", "proof", F.coalesce("item.other", "h").alias("other"))
