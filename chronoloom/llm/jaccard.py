"""Similarity join on word shingles: keys of parts find blocks of texts that may link, signature trees join each block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.llm.common import cut, drop_folder, id_column, may_be_among, small_batches, written
from chronoloom.llm.components import components

RANKED = 1 << 20  # at most so many of the most frequent shingles are known to all tasks (8 bytes each); any number gives the same links
FREQUENT = 16  # found less often, a shingle isn't among them
CHUNK_SHINGLES = 1 << 21  # so many shingles are counted at once in a task
CHUNK_KEYS = 1 << 20  # so many keys are met at once in a task
LEVEL = 1.25
BIN_SHINGLES = 1 << 16  # small blocks that one task joins at once
UNIT_SHINGLES = 1 << 17  # of a large block, what one task joins at once; with all pairs counted, PAIR_SHINGLES
PAIR_SHINGLES = 1 << 19
SENT = 8
BROADCAST_ROWS = 1 << 19  # of 48 bytes: where more rows are dealt to units, these are shuffled to the sets instead
SIGNATURE_WORDS = 64  # of 64 bits
LEAF, FANOUT = 16, 8
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of n words (A-Z lower-cased); all words as one run if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in dict.fromkeys(words)}
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    length = min(n, len(words))
    count = len(words) - length + 1
    runs = np.full(count, length, np.uint64)
    for k in range(length):
        runs = (runs ^ codes[k : k + count]) * MIX
        runs ^= runs >> np.uint64(32)
    return np.unique(runs)


def node_of(shingles: np.ndarray) -> int | None:
    """A 64-bit name of the set, so equal sets are one node; none for an empty set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))) if len(shingles) else None


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    """Sets ordered by size, in leaves of LEAF and nodes of FANOUT children.

    A node keeps the OR of its sets' bitmaps, the least and largest size, and `spare`: the most by which a set below it exceeds
    its number of bits. Two sets share at most the common bits and the lesser of their spares.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]))), np.int64)
        bits = np.zeros((len(sets), SIGNATURE_WORDS), np.uint64)
        for row, i in enumerate(self.order):
            at = sets[i] % np.uint64(64 * SIGNATURE_WORDS)
            np.bitwise_or.at(bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = np.array([len(sets[i]) for i in self.order], np.int64)
        spare = size - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, size, size, spare)]  # level 0: the sets themselves
        for fan in [LEAF, *[FANOUT] * 20]:
            bits, low, high, spare = self.levels[-1]
            starts = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(spare, starts)))
            if len(starts) == 1:
                break

    def fan(self, level: int) -> int:
        return LEAF if level == 1 else FANOUT


def may_link(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes can hold a pair of sets that links, by sizes and by the most they can overlap."""
    least = x[1][i] + y[1][j]
    fits = (100 * x[2][i] >= percent * y[1][j]) & (100 * y[2][j] >= percent * x[1][i])
    most = np.minimum(x[2][i], y[2][j])
    fits &= (100 + percent) * most >= percent * least
    at = np.flatnonzero(fits)
    for a in range(0, len(at), 1 << 15):
        some = at[a : a + (1 << 15)]
        common = np.bitwise_count(x[0][i[some]] & y[0][j[some]]).sum(axis=1).astype(np.int64)
        bound = np.minimum(common + np.minimum(x[3][i[some]], y[3][j[some]]), most[some])
        fits[some] = (100 + percent) * bound >= percent * least[some]
    return fits


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, spanning: bool = False) -> list[tuple[int, int]]:
    """All links between sets of `left` and `right` (within `left` if that is None); with `spanning`, those that join the groups."""
    links: list[tuple[int, int]] = []
    each_link(left, right, percent, lambda a, others: links.extend((a, int(b)) for b in others), spanning)
    return links


def each_link(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, take: Callable[[int, np.ndarray], None], spanning: bool = False, groups: np.ndarray | None = None) -> None:
    """Calls take(a, others) with sets that link; each pair comes once.

    Both trees go down together from pairs of top nodes; pairs that cannot link are dropped with all below them, and every
    other pair is verified. With `spanning`, a pair of sets that earlier links already join is skipped, as it cannot change
    the components; `groups` numbers what was joined before. Numbers of `right` follow those of `left`.
    """
    if not left or (right is not None and not right):
        return
    x = SignatureTree(left)
    y = x if right is None else SignatureTree(right)
    sets = left + (right or [])
    shift = 0 if right is None else len(left)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    lx, ly = len(x.levels) - 1, len(y.levels) - 1
    label = np.arange(len(sets)) if groups is None else groups.copy()
    size = np.array([len(v) for v in sets], np.int64)
    at = np.cumsum(size) - size
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    has = np.zeros(int(codes.max()) + 1, bool)

    def verified(a: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that link with a."""
        own = codes[at[a] : at[a] + size[a]]
        lengths = size[others]
        starts = np.cumsum(lengths) - lengths
        has[own] = True
        both = np.add.reduceat(has[codes[np.repeat(at[others] - starts, lengths) + np.arange(lengths.sum())]], starts, dtype=np.int64)
        has[own] = False
        return others[100 * both >= percent * (size[a] + lengths - both)]

    def children(tree: SignatureTree, level: int, node: np.ndarray) -> np.ndarray:
        return node[:, None] * tree.fan(level) + np.arange(tree.fan(level))

    def down(i: np.ndarray, j: np.ndarray, lx: int, ly: int) -> None:
        i, j = (v[may_link(x.levels[lx], i, y.levels[ly], j, percent)] for v in (i, j)) if len(i) else (i, j)
        if not len(i):
            return
        if lx == 0 and ly == 0:
            by_left = np.argsort(i, kind="stable")
            firsts = np.flatnonzero(np.diff(i[by_left], prepend=-1))
            for k, some in zip(firsts, np.split(j[by_left], firsts[1:])):
                a, others = int(x.order[i[by_left[k]]]), y.order[some] + shift
                if spanning:
                    others = others[label[others] != label[a]]
                others = verified(a, others) if len(others) else others
                if spanning and len(others):
                    joined, one = np.unique(label[others], return_index=True)
                    others = others[one]
                    label[np.isin(label, joined)] = label[a]
                if len(others):
                    take(a, others)
            return
        if lx >= ly:
            more = children(x, lx, i)
            i, j, lx = more.ravel(), np.repeat(j, more.shape[1]), lx - 1
            keep = i < len(x.levels[lx][1])
            if ly > lx:  # the other follows at once, so that both stay level
                i, j = i[keep], j[keep]
                more = children(y, ly, j)
                i, j, ly = np.repeat(i, more.shape[1]), more.ravel(), ly - 1
                keep = j < len(y.levels[ly][1])
        else:
            more = children(y, ly, j)
            i, j, ly = np.repeat(i, more.shape[1]), more.ravel(), ly - 1
            keep = j < len(y.levels[ly][1])
        if right is None and lx == ly:
            keep &= (i < j) if lx == 0 else (i <= j)
        i, j = i[keep], j[keep]
        if spanning and lx == 0 and ly == 0:
            known = label[x.order[i]] == label[y.order[j] + shift]
            i, j = i[~known], j[~known]
        step = 1 << 12  # times LEAF squared, so about a million pairs at once
        for a in range(0, len(i), step):
            down(i[a : a + step], j[a : a + step], lx, ly)

    down(i, j, lx, ly)


def described(docs: DataFrame, n: int, name: Column | None = None) -> tuple[DataFrame, str]:
    """row, name, doc_id, n_shingles, node, tokens of every row, as a table in the scratch folder, and the table's folder.

    row is a number of its own for each row, name the given column (a long), tokens are the set's hashes. The table is written
    once, so the numbers stay; all that follows reads it.
    """
    doc_id, id_type = id_column(docs)
    wanted = docs.select((F.lit(0) if name is None else name).cast("long").alias("name"), doc_id, "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                sets = [shingle_set(t, n) for t in some.column("text").to_pylist()]
                told = {
                    "row": pa.array(np.arange(number, number + len(sets))), "name": some.column("name"), "doc_id": some.column("doc_id"),
                    "n_shingles": pa.array(list(map(len, sets)), pa.int64()), "node": pa.array(list(map(node_of, sets)), pa.int64()), "tokens": pa.array([x.tobytes() for x in sets], pa.binary()),
                }
                number += len(sets)
                yield pa.RecordBatch.from_pydict(told)

    return written(wanted.mapInArrow(rows, f"row long, name long, doc_id {id_type}, n_shingles long, node long, tokens binary"))


def as_set(tokens: bytes) -> np.ndarray:
    return np.frombuffer(tokens, np.uint64)


def level_tops(most: int) -> list[int]:
    """The largest size of each level, up to the first that is at least `most`; each is about LEVEL times the one before."""
    tops = [1]
    while tops[-1] < most:
        tops.append(int(tops[-1] * LEVEL) + 1)
    return tops


TOPS = np.array(level_tops(1 << 32), np.int64)


def keys_of(s: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """Keys of a set, of which two sets that link share at least one, unless they are equal.

    A level is a range of sizes; a set gives keys at its own and at those of larger sets that it can link with, so both sets of
    a pair give keys at the larger one's level. There, two that link differ by at most d shingles. The range of hashes is cut
    into more than d parts, and what a set has in a part is a key; so at most d of one's keys aren't also the other's. In any
    order that all sets agree on, the first d + 1 keys of both have one in common. The order puts keys of several shingles
    first, then single ones, then those of `frequent` shingles only, so texts that share a common passage or a phrase seldom
    meet. Sets with too few parts in use give all parts, the empty ones too.
    """
    n = len(s)
    if not n:
        return s
    rare = np.ones(n, bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s
    mixed = (s ^ (s >> np.uint64(29))) * MIX
    mixed ^= mixed >> np.uint64(32)
    out = []
    level = int(np.searchsorted(TOPS, n))
    while level == int(np.searchsorted(TOPS, n)) or 100 * n >= percent * int(TOPS[level - 1] + 1):
        d = 2 * (100 - percent) * int(TOPS[level]) // (100 + percent)
        if d:
            n_parts = (d + 1) * 7 // 5 + 4
            part = ((s >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            place = part[starts] + np.uint64(level << 40)
            keys = (np.add.reduceat(mixed, starts) ^ (place * MIX)) * MIX
            size = np.diff([*starts, n])
            group = np.where(np.add.reduceat(rare, starts, dtype=np.int64) == 0, 2, np.where(size == 1, 1, 0))
            if len(keys) > d:
                out.append(keys[np.lexsort((keys, group))[: d + 1]])
            else:
                empty = np.setdiff1d(np.arange(n_parts, dtype=np.uint64), part) + np.uint64(level << 40)
                out += [keys, (empty * MIX) * MIX]
        level += 1
    return np.concatenate(out) if out else s[:0]


def repeated_shingles(base: DataFrame) -> DataFrame:
    """token, n: shingles that several rows of a task's chunk have, and how many do."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0

        def out() -> pa.RecordBatch:
            every = np.concatenate(sets)
            sets.clear()
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            count = np.diff(first, append=len(every))
            more = count > 1
            return pa.RecordBatch.from_arrays([pa.array(every[first[more]].view(np.int64)), pa.array(count[more])], names=["token", "n"])

        for batch in batches:
            for tokens in batch.column("tokens"):
                sets.append(as_set(tokens.as_py()))
                held += len(sets[-1])
                if held > CHUNK_SHINGLES:
                    yield out()
                    held = 0
        if held:
            yield out()

    return base.select("tokens").mapInArrow(rows, "token long, n long")


def most_frequent(base: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that occur most, at most RANKED; see repeated_shingles for what is counted."""
    counts = cut(repeated_shingles(base).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT))
    sizes = counts.groupBy("n").agg(F.count("*").alias("k"))
    above = sizes.select("n", F.sum("k").over(Window.orderBy(F.desc("n"))).alias("above"))
    least = above.where(F.col("above") <= RANKED).agg(F.min("n")).first()[0]
    if not least:
        return np.zeros(0, np.uint64)
    return np.sort(counts.where(F.col("n") >= least).select("token").toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64))


def met_in_chunk(keys: list[np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a chunk, given by node, with one node each, and pairs of nodes as keys of their own.

    Nodes that keys of the chunk connect are joined at once; every key then has the least node of its group, and each other node
    of the group meets that one under a key of the two. So a key that very many rows have, and a text that has very many
    copies, leave a chunk as one row, and near copies with one node between them.
    """
    lengths = np.array(list(map(len, keys)), np.int64)
    nodes, keys, lengths = nodes[lengths > 0], [k for k in keys if len(k)], lengths[lengths > 0]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable").astype(np.int32)
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    first = np.flatnonzero(new)
    code = np.empty(len(order), np.int32)
    code[order] = np.cumsum(new, dtype=np.int32) - 1
    every = every[first]
    starts = np.cumsum(lengths) - lengths
    label = nodes.copy()
    while True:
        of_key = np.minimum.reduceat(np.repeat(label, lengths)[order], first)
        now = np.minimum(label, np.minimum.reduceat(of_key[code], starts))
        if (now == label).all():
            break
        label = now
    other = label != nodes
    pairs = np.stack([label[other], nodes[other]], 1)
    names = (pairs[:, 0].astype(np.uint64) * MIX ^ pairs[:, 1].astype(np.uint64)) * MIX
    return np.concatenate([every, names, names]), np.concatenate([of_key, pairs[:, 0], pairs[:, 1]])


def keyed(base: DataFrame, percent: int, frequent: np.ndarray) -> DataFrame:
    """key, row: the keys (see keys_of) of every row with a shingle, after met_in_chunk; of equal sets of a chunk, one row's."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, seen, held = [], [], set(), 0

        def out() -> Iterator[pa.RecordBatch]:
            if keys:
                key, row = met_in_chunk(keys, np.array(numbers, np.int64))
                for i in range(0, len(key), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 18)].view(np.int64)), pa.array(row[i : i + (1 << 18)])], names=["key", "row"])

        for batch in batches:
            for number, node, tokens in zip(batch.column("row").to_pylist(), batch.column("node").to_pylist(), batch.column("tokens")):
                if node is not None and node not in seen:
                    seen.add(node)
                    numbers.append(number)
                    keys.append(keys_of(as_set(tokens.as_py()), percent, frequent))
                    held += len(keys[-1])
                    if held > CHUNK_KEYS:
                        yield from out()
                        keys, numbers, seen, held = [], [], set(), 0
        yield from out()

    return base.select("row", "node", "tokens").mapInArrow(rows, "key long, row long")


def met(keys: DataFrame) -> DataFrame:
    """Edges (a, b) that join all rows of a key, from each to the next. A key has at most one row from each chunk of keyed()."""
    near = keys.select("row", F.lag("row").over(Window.partitionBy("key").orderBy("row")).alias("b"))
    return near.where("b <> row").select(F.col("row").alias("a"), "b").distinct()  # near copies meet under very many keys


def blocks_of(base: DataFrame, percent: int) -> DataFrame:
    """node, row, n_shingles, copies, label of each node that shares a key with another; `row` is one of its rows, label the block's.

    Rows of equal sets have the same keys, so those that have a label have the same one.
    """
    label = components(met(keyed(base, percent, most_frequent(base)))).withColumnRenamed("node", "_of")
    rows = base.where("node is not null").select("row", "node", "n_shingles").join(label, F.col("row") == F.col("_of"), "left")
    nodes = rows.groupBy("node").agg(F.min("row").alias("row"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("copies"), F.min("label").alias("label"))
    return cut(nodes.where("label is not null"))


def binned(members: DataFrame, sized: DataFrame) -> DataFrame:
    """Units of small blocks: as many blocks as BIN_SHINGLES hold, about."""
    n_bins = 1 + int((sized.agg(F.sum("_all")).first()[0] or 0) // BIN_SHINGLES)
    bin_of = F.concat_ws(":", F.lit("bin"), F.pmod(F.xxhash64("label"), F.lit(n_bins)).cast("string"))
    return members.join(sized.select("label"), "label").withColumns({"unit": bin_of, "side": F.lit(0)})


def paired(members: DataFrame, percent: int, chunk: Column, pure: Column, most: int) -> DataFrame:
    """Units of large blocks: unit, side, so that each pair that may link is in one unit; `chunk` numbers the parts by a hash.

    A block is cut into bands of sizes, so that sets that link are in the same or the next band, and a band into parts of the
    same `pure` (null for what is mixed), and those into chunks of `most` shingles. Each pair of chunks of the same or of
    adjacent bands is a unit, but not those of one `pure`, whose sets need no more links.
    """
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9))).cast("int")
    large = members.withColumns({"band": band, "_pure": pure})
    by = ["label", "band", "_pure"]
    chunks = large.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(2 * F.sum("n_shingles") / most)).alias("_k"))
    sizes = chunks.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_k")
    found = (large["label"] == sizes["_of_label"]) & (large["band"] == sizes["_of_band"]) & large["_pure"].eqNullSafe(sizes["_of__pure"])
    placed = large.join(sizes, found).select(*large.columns, F.pmod(chunk, F.col("_k")).alias("chunk"))
    listed = chunks.select(*by, F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") - 1)).alias("chunk"))
    name = F.concat_ws(":", F.col("band").cast("string"), F.coalesce(F.col("_pure").cast("string"), F.lit("mixed")), F.col("chunk").cast("string"))
    first, second = (listed.select("label", F.col("band").alias(f"band_{s}"), F.col("_pure").alias(f"pure_{s}"), F.col("chunk").alias(f"chunk_{s}"), name.alias(f"name_{s}")) for s in "ab")
    same = first.join(second.withColumn("band_a", F.col("band_b")), ["label", "band_a"]).where("name_a <= name_b")
    above = first.join(second.withColumn("band_a", F.col("band_b") - F.lit(1)), ["label", "band_a"])
    pairs = same.unionByName(above).where("not (pure_a <=> pure_b and pure_a is not null)")
    pairs = pairs.withColumn("unit", F.concat_ws("|", F.col("label").cast("string"), "name_a", "name_b"))
    left, right = (pairs.where("true" if s == "a" else "name_a <> name_b").select("label", F.col(f"band_{s}").alias("band"), F.col(f"pure_{s}").alias("_pure"), F.col(f"chunk_{s}").alias("chunk"), "unit", F.lit(i).alias("side")) for i, s in enumerate("ab"))
    sides = left.unionByName(right).select("unit", "side", *[F.col(c).alias(f"_of_{c}") for c in (*by, "chunk")])
    here = (placed["label"] == sides["_of_label"]) & (placed["band"] == sides["_of_band"]) & placed["_pure"].eqNullSafe(sides["_of__pure"]) & (placed["chunk"] == sides["_of_chunk"])
    return placed.join(sides, here).select(*members.columns, "unit", "side")


def joined_units(base: DataFrame, dealt: DataFrame, join: Callable[[list, list, list | None, dict, dict], list[tuple]], columns: str) -> DataFrame:
    """Rows (of `columns`) of join(names, left, right, copies, groups) over all units of `dealt` (row, node, copies, group, unit, side).

    names holds the nodes of left and then right; copies, how many rows each node is; groups, what earlier links joined it to.
    Only the sets of dealt rows are shuffled: a bitmap of their numbers keeps the others out. Up to BROADCAST_ROWS dealt rows are
    broadcast, so that sets are shuffled once.
    """
    parts = F.split("unit", r"\|")  # "bin:number", "label:chunk", or the block and its two chunks, of which one can have no rows
    alone = (F.size(parts) < 3) | (F.get(parts, F.lit(1)) == F.get(parts, F.lit(2)))
    dealt = cut(dealt.select(F.col("row").alias("_of_row"), "copies", "group", F.xxhash64("unit").alias("unit"), F.when(alone, 2).otherwise(F.col("side")).alias("side")))
    some = may_be_among(base.select("row", "node", "tokens"), F.col("row"), dealt.select("_of_row"), "_maybe").where("_maybe")
    told = F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt
    work = some.join(told, some["row"] == told["_of_row"]).select("unit", "side", "node", "copies", "group", "tokens")
    names_out = [c.split()[0] for c in columns.split(", ")]

    def join_unit(rows: pd.DataFrame) -> pd.DataFrame:
        sides: list[dict[int, np.ndarray]] = [{}, {}]
        for side, node, tokens in zip(rows["side"], rows["node"], rows["tokens"]):
            sides[side % 2][node] = as_set(tokens)
        left, right = (list(s.values()) for s in sides)
        alone = rows["side"].iloc[0] == 2
        out = join([*sides[0], *sides[1]], left, None if alone else right, dict(zip(rows["node"], rows["copies"])), dict(zip(rows["node"], rows["group"])))
        return pd.DataFrame(out, columns=names_out, dtype=object).astype("Int64")

    return work.groupBy("unit").applyInPandas(join_unit, columns)


def all_units(members: DataFrame, percent: int) -> DataFrame:
    """Deals the nodes of blocks so that each pair of a block's nodes that may link is in one unit."""
    members = members.withColumn("group", F.col("node"))
    sized = members.groupBy("label").agg(F.sum("n_shingles").alias("_all"))
    small = binned(members, sized.where(F.col("_all") <= PAIR_SHINGLES))
    large = members.join(sized.where(F.col("_all") > PAIR_SHINGLES).select("label"), "label")
    return small.unionByName(paired(large, percent, F.xxhash64("node"), F.lit(None).cast("long"), PAIR_SHINGLES), allowMissingColumns=True)


def spanning_links(base: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that give the same components as all links do, by rounds whose cost is in proportion to a dense block's size.

    Small blocks are joined whole. A large block is first cut into chunks by hash, each joined by itself; then up to SENT nodes of
    each group so found are sent on, and these are joined in chunks likewise. A block that is one group then is done: near copies of
    a text, however many, end here. In the others, all pairs of chunks that differ in group are joined, so no link is missed: a
    large group's chunks meet those of other groups, but not each other.
    """

    def join(names: list, left: list, right: list | None, _copies: dict, groups: dict) -> list[tuple]:
        numbers = np.unique(np.array([groups[v] for v in names], np.int64), return_inverse=True)[1]
        links: list[tuple[int, int]] = []
        each_link(left, right, percent, lambda a, others: links.extend((names[a], names[int(b)]) for b in others), True, numbers)
        return links

    def round_of(dealt: DataFrame) -> DataFrame:
        return cut(joined_units(base, dealt, join, "a long, b long"))

    def in_chunks(some: DataFrame, salt: int) -> DataFrame:
        sizes = some.groupBy("label").agg(F.ceil(F.sum("n_shingles") / UNIT_SHINGLES).alias("_k"))
        unit = F.concat_ws(":", F.col("label").cast("string"), F.pmod(F.xxhash64("node", F.lit(salt)), F.col("_k")).cast("string"))
        return some.join(sizes, "label").withColumns({"unit": unit, "side": F.lit(0)}).drop("_k")

    def grouped(some: DataFrame, links: DataFrame) -> DataFrame:
        label = components(links).withColumnRenamed("label", "_group")
        return cut(some.drop("group").join(label, "node", "left").withColumn("group", F.coalesce("_group", "node")).drop("_group"))

    def open_blocks(some: DataFrame) -> DataFrame:
        more = some.groupBy("label").agg(F.min("group").alias("_low"), F.max("group").alias("_top")).where("_low <> _top").select("label")
        return some.join(more, "label", "left_semi")

    members = members.withColumn("group", F.col("node"))
    sized = cut(members.groupBy("label").agg(F.sum("n_shingles").alias("_all")))
    small = binned(members, sized.where(F.col("_all") <= UNIT_SHINGLES))
    large = members.join(sized.where(F.col("_all") > UNIT_SHINGLES).select("label"), "label")
    links = round_of(small.unionByName(in_chunks(large, 1).select(*small.columns)))
    if large.isEmpty():
        return links
    now = open_blocks(grouped(large, links))
    every = F.struct(*now.columns)
    draw = F.xxhash64("node", F.lit(2))
    sent = now.groupBy("label", "group", F.pmod(draw, F.lit(SENT))).agg(F.min_by(every, draw).alias("_one")).select("_one.*")
    links = links.unionByName(round_of(in_chunks(sent, 3)))
    now = open_blocks(grouped(now, links))
    if now.isEmpty():
        return links
    sizes = now.groupBy("label", "group").agg(F.sum("n_shingles").alias("_size"))
    wide = cut(now.join(sizes, ["label", "group"]))
    pure = F.when(F.col("_size") > UNIT_SHINGLES // 4, F.col("group"))
    # a mixed group keeps together, so that its chunk has it joined
    chunk = F.when(pure.isNull(), F.xxhash64("group")).otherwise(F.xxhash64("node"))
    return links.unionByName(round_of(paired(wide, percent, chunk, pure, UNIT_SHINGLES)))


def similar_pairs(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Every link between different sets, once: node_a, node_b (node_a the lesser; see described() for the nodes of rows)."""

    def pairs(names: list, left: list, right: list | None, _copies: dict, _groups: dict) -> list[tuple]:
        return [(min(names[a], names[b]), max(names[a], names[b])) for a, b in tree_join(left, right, percent)]

    base, _ = described(docs, n)
    return joined_units(base, all_units(blocks_of(base, percent), percent), pairs, "node_a long, node_b long")


def counted_links(base: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links that join the groups as (a, b, null); the rows that a node links with as (a, null, n_links). Every pair is verified."""

    def join(names: list, left: list, right: list | None, copies: dict, _groups: dict) -> list[tuple]:
        weight = np.array([copies[v] for v in names], np.int64)
        counts, label, edges = np.zeros(len(names), np.int64), np.arange(len(names)), []

        def take(a: int, others: np.ndarray) -> None:
            counts[a] += weight[others].sum()
            counts[others] += weight[a]
            other_labels, one = np.unique(label[others], return_index=True)
            fresh = other_labels != label[a]
            edges.extend((names[a], names[int(b)], None) for b in others[one[fresh]])
            if fresh.any():
                label[np.isin(label, other_labels)] = label[a]

        each_link(left, right, percent, take)
        return edges + [(names[a], None, int(counts[a])) for a in np.flatnonzero(counts)]

    return cut(joined_units(base, all_units(members, percent), join, "a long, b long, n_links long"))


def node_groups(base: DataFrame, links: DataFrame) -> DataFrame:
    """node, label of every node: the group that links join it to."""
    nodes = base.where("node is not null").select("node").distinct()
    return nodes.join(components(links.select("a", "b")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of `docs` (doc_id, text).

    Two documents link where 100 * shared >= percent * all of their distinct shingles of n words; with fewer words the whole
    text is one shingle. component_id is the least doc_id that links reach; n_links, the number of other rows that a row links
    with, those of equal sets included. Unless `counted`, there is no n_links, and pairs that other links already join are not
    verified, so groups of very many near copies cost in proportion to their size. Documents of equal sets are one node of the
    search. A null text or one without words has no shingles and links with nothing. A null doc_id takes part but names no
    component: its own is the least other id, or null; ids can be of any type that has an order. Rows that repeat are given each; rows that repeat a doc_id link by each
    of their texts. Other columns are not read. Shingles are compared by 64-bit hashes. `docs` is read once.
    """
    base, links = links_of(docs, n, percent, counted)
    own = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_own"), F.count("*").alias("_copies"))
    wide = own.join(node_groups(base, links), "node")
    of_node = wide.join(wide.groupBy("label").agg(F.min("_own").alias("_least")), "label")
    if counted:
        met_by = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("_others"))
        of_node = of_node.join(met_by, "node", "left").withColumn("_links", F.coalesce("_others", F.lit(0)) + F.col("_copies") - 1)
    of_node = cut(of_node.select("node", "_least", *(["_links"] if counted else [])))
    out = base.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    n_links = [F.coalesce("_links", F.lit(0)).alias("n_links")] if counted else []
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"), *n_links)


def links_of(docs: DataFrame, n: int, percent: int, counted: bool, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """described() rows without their tokens, whose table is deleted, and the links; see counted_links and spanning_links."""
    with small_batches(docs.sparkSession):
        base, folder = described(docs, n, name)
        members = blocks_of(base, percent)
        links = counted_links(base, members, percent) if counted else spanning_links(base, members, percent)
    bare = cut(base.drop("tokens"))
    drop_folder(docs.sparkSession, folder)
    return bare, links


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked rows of `docs`, as similar_groups links them; rows without words all stay.

    The one that stays has the least doc_id, or, if none has an id, any; of several texts under that id, the one of fewest
    shingles; of rows that are equal in all columns, one. Only rows that may go are shuffled. Rows are told by a 64-bit hash.
    """
    name = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    base, links = links_of(docs, n, percent, False, name)
    rows = base.where("node is not null").select("name", "row", "doc_id", "n_shingles", "node")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "n_shingles", "node", "name")
    best = rows.groupBy("node").agg(F.min(rank).alias("_best")).join(node_groups(base, links), "node")
    stays = best.join(best.groupBy("label").agg(F.min("_best").alias("_first")), "label").select("node", F.col("_first.name").alias("_stays"))
    told = rows.join(stays, "node").groupBy("name").agg(F.first(F.col("name") != F.col("_stays")).alias("_goes"), F.count("*").alias("_times"))
    asked = cut(told.where("_goes or _times > 1").select(F.col("name").alias("_asked"), "_goes"))
    wide = may_be_among(docs.select(F.struct("*").alias("_row"), name.alias("_name")), F.col("_name"), asked.select("_asked"), "_maybe")
    met_rows = wide.where("_maybe").join(asked, F.col("_name") == F.col("_asked"), "left").where("_goes is null or not _goes")
    once = met_rows.where("_goes is not null").groupBy("_name").agg(F.first("_row").alias("_row"))
    kept = [wide.where("not _maybe"), met_rows.where("_goes is null"), once]
    out = kept[0].select("_row").unionByName(kept[1].select("_row")).unionByName(kept[2].select("_row"))
    return out.select("_row.*")
