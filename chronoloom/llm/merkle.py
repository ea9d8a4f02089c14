"""A Merkle manifest of a dataset: leaves by row, a tree a group, a tree over the groups' roots, and each leaf's proof.

The trees are walked in supersteps over RDDs whose vertices are blocks of LEVELS levels. Upward, children message their block; a
block that has all its messages hashes them, level by level, and is a child in the next superstep. Downward, every block sends its
own path to the root to its children, each of which gets the digests beside it in front. A superstep shuffles digests alone, never
texts, and a block has at most ARITY ** LEVELS children, so there is no hot key however large a group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark import RDD, SparkContext, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import cut, prefix_sums, scratch_folder

ARITY = 3
LEVELS = 4  # of one superstep
WIDTH = ARITY**LEVELS
FEW_NODES, NODES = 1_000, 50_000  # of one task, while there are fewer tasks than cores, and after that
PROOF = "array<struct<slot:int,siblings:array<string>>>"


def hashed(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of strings, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as a leaf's digest takes it: its count of UTF-8 bytes, a colon, the value; `-` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(children: Iterable[bytes]) -> bytes:
    """A node's digest: of its children's digests in hexadecimal, left to right."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give: level by level, the digest takes its slot among its siblings."""

    def step(acc: Column, level: Column) -> Column:
        others, slot = level["siblings"], level["slot"]
        return F.sha2(F.concat(F.array_join(F.slice(others, F.lit(1), slot), ""), acc, F.array_join(F.slice(others, slot + 1, F.lit(ARITY)), "")), 256)

    return F.aggregate(proof, leaf, step)


def _tasks(sc: SparkContext, nodes: int) -> int:
    return max(min(sc.defaultParallelism, 1 + nodes // FEW_NODES), nodes // NODES)


def _kept(tops: RDD) -> RDD:
    """Cuts the lineage between a tree and the next: tops are computed once, and written to the checkpoint folder."""
    tops.persist(StorageLevel.DISK_ONLY)
    tops.checkpoint()
    tops.count()
    return tops


def block_levels(digests: list[bytes], whole: bool) -> list[list[bytes]]:
    """The digests of a block's nodes by level, the children first; the last level is the block's top.

    A block that is its `whole` group ends where one node is left; others go up LEVELS levels, as their group has further nodes.
    """
    levels = [digests]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([digest_of(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def block_path(levels: list[list[bytes]], slot: int) -> tuple:
    """Of a block's child, for each level under its top, its slot among its siblings and their digests."""
    path = []
    for nodes in levels[:-1]:
        first = slot // ARITY * ARITY
        path.append((slot - first, [nodes[i] for i in range(first, min(first + ARITY, len(nodes))) if i != slot]))
        slot //= ARITY
    return tuple(path)


def climb(nodes: RDD, count: int, most: int) -> tuple[list[RDD], RDD]:
    """From nodes ((group, place), (digest, last, payload)) up to each group's top.

    `last` marks the node with the greatest place of its group. Gives, for each superstep, the RDD of ((group, block's place),
    (children [(digest, payload)] by place, whether they are their whole group)), and the RDD of (group, digest, payload, height)
    of tops: one that is itself a leaf has height 0 and keeps its payload. A group whose only node is left drops out with it.
    `count` nodes in all and the `most` of one group give the numbers of tasks and of supersteps.
    """
    sc, steps, tops = nodes.context, [], []

    def block(messages: Iterable[tuple]) -> tuple:
        children = sorted(messages, key=lambda m: m[0])
        return [(digest, payload) for _, digest, _, payload in children], any(last for _, _, last, _ in children)

    def top(key: tuple, held: tuple) -> tuple:
        children, last = held
        levels = block_levels([d for d, _ in children], last and key[1] == 0)
        return key, (levels[-1][0], last, None)

    alone = lambda node: node[0][1] == 0 and node[1][1]
    while most:
        tops.append(nodes.filter(alone).map(lambda node, height=len(steps): (node[0][0], node[1][0], node[1][2], height)))
        if most == 1:
            break
        up = nodes.filter(lambda node: not alone(node)).map(lambda node: ((node[0][0], node[0][1] // WIDTH), (node[0][1] % WIDTH, *node[1])))
        blocks = up.groupByKey(_tasks(sc, count)).mapValues(block)
        steps.append(blocks.map(lambda b: (b[0], (b[1][0], b[1][1] and b[0][1] == 0)), preservesPartitioning=True))
        nodes = blocks.map(lambda b: top(*b))
        count, most = max(1, count // ARITY), -(-most // WIDTH)  # a block has two children at least
    return steps, sc.union(tops) if tops else sc.emptyRDD()


def _down(message: tuple) -> list[tuple]:
    """A block's messages: to each child its path, which ends with the block's own, and what goes along."""
    (group, place), ((children, whole), (above, rest)) = message
    levels = block_levels([d for d, _ in children], whole)
    return [((group, place * WIDTH + slot), ((*block_path(levels, slot), *above), rest), digest, payload) for slot, (digest, payload) in enumerate(children)]


def descend(steps: list[RDD], paths: RDD) -> RDD:
    """From each top's (group, height, (path, rest)) down to its leaves: (key, (path, rest), digest, payload); `rest` goes along.

    Groups of one node are in no step and have no row here.
    """
    told = paths.context.emptyRDD()
    for height in range(len(steps), 0, -1):
        begin = paths.filter(lambda p, height=height: p[1] == height).map(lambda p: ((p[0], 0), p[2]))
        blocks = steps[height - 1]
        n = blocks.getNumPartitions()
        own = told.map(lambda t: (t[0], t[1])).union(begin).partitionBy(n)  # dealt like the blocks, which stay where they are
        told = blocks.join(own, n).flatMap(_down)
    return told


def _proof_row(payload: tuple, digest: bytes, path: tuple, subroot: bytes, root: bytes) -> tuple:
    return (*payload, digest.hex(), subroot.hex(), root.hex(), [(slot, [d.hex() for d in siblings]) for slot, siblings in path])


def _checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch_folder(spark))


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, source, claim, leaf, subroot, root, proof for leaves of doc_id, source, leaf (a SHA-256 in hexadecimal) and claim.

    A source's leaves are in the order of doc_id (null first), rows that share an id in the order of their digests and claims; ids
    are numbers. Sources are in the order of their UTF-8 bytes, null first; a null source is one. `proof` has, for each level from
    the leaf to the root, the slot of the node and the digests beside it, left to right; a level where a node stood alone in its
    group of ARITY has no siblings, but is one. A single leaf of a source is its subroot, a single source's subroot the root. `claim`
    goes along. An empty table gives no rows.
    """
    spark = leaves.sparkSession
    sc = spark.sparkContext
    _checkpoints(spark)
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_of")  # null before all others
    rows = cut(leaves.select("doc_id", "source", "leaf", "claim", named))
    placed = cut(prefix_sums(rows, "doc_id", ["leaf", "claim"], {"_place": F.lit(1).cast("long")}, ["_of"]))
    ends = placed.groupBy("_of").agg(F.max("_place").alias("_place")).withColumn("_last", F.lit(True))
    told = placed.join(ends, ["_of", "_place"], "left").select("_of", "_place", "leaf", F.coalesce("_last", F.lit(False)), "doc_id", "source", "claim")
    nodes = told.rdd.map(lambda r: ((r[0], r[1]), (bytes.fromhex(r[2]), r[3], (r[4], r[5], r[6]))))
    n_leaves, sources = placed.count(), ends.agg(F.count("*"), F.coalesce(F.max("_place") + 1, F.lit(0))).first()
    steps, tops = climb(nodes, n_leaves, sources[1])
    tops = _kept(tops.coalesce(_tasks(sc, sources[0]), shuffle=True))  # picked where the nodes are
    last = sources[0] - 1
    ordered = tops.sortBy(lambda t: t[0].encode(), numPartitions=_tasks(sc, sources[0])).zipWithIndex()
    groups = ordered.map(lambda t: (("", t[1]), (t[0][1], t[1] == last, (t[0][0], t[0][3], t[0][2]))))
    upper, roots = climb(groups, sources[0], sources[0])
    # paths of the sources' tops: (source, height, (path, (subroot, root)), payload); a single source is the root, with an empty path
    above = descend(upper, roots.map(lambda t: (t[0], t[3], ((), t[1])))).map(lambda t: (t[3][0], t[3][1], (t[1][0], (t[2], t[1][1])), t[3][2]))
    alone = roots.filter(lambda t: t[3] == 0).map(lambda t: (t[2][0], t[2][1], ((), (t[1], t[1])), t[2][2]))
    above = _kept(above.union(alone).coalesce(_tasks(sc, sources[0]), shuffle=True))
    below = descend(steps, above).map(lambda t: _proof_row(t[3], t[2], t[1][0], *t[1][1]))
    single = above.filter(lambda t: t[1] == 0).map(lambda t: _proof_row(t[3], t[2][1][0], t[2][0], *t[2][1]))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "claim"))
    return spark.createDataFrame(below.union(single), f"{kinds}, leaf string, subroot string, root string, proof {PROOF}", verifySchema=False)


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and claim of documents: claim is the leaf of the row as someone might hand it over.

    Where 2 divides the crc32 of the id, the handed text has lost its line feeds; a null text, or a row without an id, is as it was.
    """
    leaf = lambda text: hashed(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claim = leaf(F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text")))
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), claim.alias("claim"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The manifest of documents with each proof's digest, and what verifying every claim by its proof gives."""
    built = manifest(document_leaves(docs))
    beside = F.array_join(F.flatten(F.col("proof.siblings")), "")
    out = built.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded(F.col("claim"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
