"""Mixing sources to target weights with fixed-length blocks of words."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.llm.common import GAP, cut, literal_array, position, prefix_sums, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times a source, and so a document, is taken at most
BLOCK_WORDS = 256
SHARD_BLOCKS = 256  # of an output shard, at least
MOST_SHARDS = 65536  # shards are larger where there would be more
SEED = 20240229
LOG2_SOURCES = 17
TASK_SLOTS, CHUNK_SLOTS = 1 << 17, 1 << 12  # slots that one task makes, and in one piece


def source_key(source: Column) -> Column:
    """Orders sources by code point, null last; never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("z"))


def targets(sized: DataFrame) -> DataFrame:
    """One row for each source: _source, source_size, weight, target.

    Every source gets least(MOST * size, level * weight); the level is where the targets sum to SHARE of all words. That is
    where handing the excess round by weight ends. The level is found from the sources in the order of MOST * size / weight:
    it is the first at which the words left by the sources before suffice for no more than this source's own cap.
    """
    sizes = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    alone = Window.orderBy("_source")
    place = (F.row_number().over(alone) - 1) % len(WEIGHTS)
    sizes = sizes.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), place))
    ratio = F.col("source_size") * MOST / F.col("weight")
    by_ratio = Window.orderBy(ratio, "_source")
    rest = (
        F.sum("source_size").over(Window.partitionBy()) * SHARE
        - F.coalesce(F.sum(F.col("source_size") * MOST).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = sizes.select("*", rest.alias("_level"), ratio.alias("_ratio"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_source", "_level"))).over(Window.partitionBy())
    target = F.least(F.col("source_size") * float(MOST), F.coalesce(level["_level"], F.lit(0.0)) * F.col("weight"))
    return levels.select("_source", "source_size", "weight", target.cast("double").alias("target"))


def with_permuted(df: DataFrame, name: str, index: Column, n: Column, *salt: Column) -> DataFrame:
    """Adds a pseudorandom permutation of 0..n-1, computed for each index alone.

    The indexes fill a grid of about sqrt(n) columns row by row; three times, each row and then each column is rotated by a
    hash of its number. Rotations keep inside the ragged last row, so the map is one to one for every n.
    """
    columns = df.columns
    df = df.withColumns({"_x": index.cast("long"), "_n_all": n.cast("long")}).withColumn("_wide", F.ceil(F.sqrt(F.col("_n_all").cast("double"))).cast("long"))
    for turn in range(3):
        for rows in (True, False):
            df = df.withColumns({"_r": F.expr("_x div _wide"), "_c": F.expr("_x % _wide")})
            if rows:
                length, number, at = F.least(F.col("_wide"), F.col("_n_all") - F.col("_r") * F.col("_wide")), F.col("_r"), F.col("_c")
            else:
                length, number, at = F.expr("(_n_all - _c - 1) div _wide + 1"), F.col("_c"), F.col("_r")
            df = df.withColumns({"_length": length, "_turned": at + F.pmod(F.xxhash64(F.lit(2 * turn + (not rows)), number, *salt), length)})
            moved = F.col("_turned") % F.col("_length")
            df = df.withColumn("_x", F.col("_r") * F.col("_wide") + moved if rows else moved * F.col("_wide") + F.col("_c"))
    return df.select(*columns, F.col("_x").alias(name))


def drawn_counts(plan: list, spark: SparkSession, seed: int = SEED, shard_blocks: int | None = None) -> DataFrame:
    """out_shard, _source, count: how many blocks of each source each output shard draws.

    `plan` has (source, blocks owed). Every shard draws a source for each of its places with the sources' shares of what is
    owed, so its counts are multinomial.
    """
    plan = [(s, n) for s, n in plan if n > 0]
    ends = list(accumulate(n for _, n in plan))
    total = ends[-1] if ends else 0
    shard_blocks = shard_blocks or blocks_of_a_shard(total)
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(max(total, 1)))
    # source names may hold any character, so they are a list of literals; there are fewer than 2**LOG2_SOURCES
    names = F.lit([s for s, _ in plan] or [""])
    source = F.get(names, position(literal_array(ends, "bigint"), draw, LOG2_SOURCES))
    places = spark.range(0, total, 1, parallel(total))
    return places.select(F.floor(F.col("id") / shard_blocks).alias("out_shard"), source.alias("_source")).groupBy("out_shard", "_source").count()


def blocks_of_a_shard(total: int) -> int:
    return max(SHARD_BLOCKS, -(-total // MOST_SHARDS))


def parallel(n_slots: int) -> int:
    return max(1, -(-n_slots // TASK_SLOTS))


def drawn_slots(owed: DataFrame, plan: list, seed: int = SEED, shard_blocks: int | None = None) -> DataFrame:
    """One row for each slot of the mix: out_shard, _source, slot, rank.

    `owed` has _source, _owed (blocks to take) and _most (blocks that can be taken); `plan` has (_source, _owed), sorted. The
    slots of a source are numbered by shard as drawn_counts() drew them, and decide by their numbers which blocks are taken.
    Drawn slots past _most fall away. Of a source that was drawn more often than it owes, slots are left out at equal distances;
    one that was drawn less gets further slots in shards by hash. So every source has _owed slots; rank counts them from 0.
    """
    total = sum(n for _, n in plan)
    shard_blocks = shard_blocks or blocks_of_a_shard(total)
    n_shards = max(1, -(-total // shard_blocks))
    before = Window.partitionBy("_source").orderBy("out_shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(drawn_counts(plan, owed.sparkSession, seed, shard_blocks).withColumn("_from", F.coalesce(F.sum("count").over(before), F.lit(0))))
    given = counts.groupBy("_source").agg(F.sum("count").alias("_given"))
    owed = owed.join(given, "_source", "left").withColumn("_given", F.least(F.coalesce("_given", F.lit(0)), "_most"))
    drawn = counts.join(F.broadcast(owed), "_source").select(  # a row for each source
        "out_shard", "_source", "_owed", "_given", "_from", F.least(F.col("_from") + F.col("count"), "_given").alias("_to")
    )
    late = owed.select(F.lit(None).cast("long").alias("out_shard"), "_source", "_owed", "_given", F.col("_given").alias("_from"), F.col("_owed").alias("_to"))
    spans = drawn.unionByName(late).where("_from < _to")
    # few rows stand for many slots: they are cut and dealt to tasks before they are told out
    dealt = spans.withColumn("_at", F.explode(F.sequence("_from", F.col("_to") - 1, F.lit(CHUNK_SLOTS).cast("long")))).repartition(parallel(total), "_source", "_at")
    slots = dealt.withColumn("slot", F.explode(F.sequence("_at", F.least(F.col("_at") + CHUNK_SLOTS, "_to") - 1)))
    thin = slots.withColumn("rank", F.when(F.col("_given") > F.col("_owed"), F.expr("slot * _owed div _given")).otherwise(F.col("slot")))
    kept = thin.where("_given <= _owed or (slot + 1) * _owed div _given > rank")
    by_hash = F.pmod(F.xxhash64("_source", "slot", F.lit(seed)), F.lit(n_shards))
    return kept.select(F.coalesce("out_shard", by_hash).alias("out_shard"), "_source", "slot", "rank")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, shard_blocks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixes the sources of `docs` (doc_id, text, source) to their targets.

    Returns three DataFrames:
    rows (doc_id, _source, size, _start): each document and where its words start in its source's stream;
    sources (_source, source_size, weight, target);
    slots (out_shard, _source, slot, block, pass, n_words): one row for each block that is taken, with the output shard that drew
    it, the block of `block_words` words of the source's stream, pass 0 or 1, the how-manieth taking of that block it is, and how
    many of its words are taken: all but in a source's last slots, which are cut so that its words are the target, rounded.

    A null text or one without words has size 0 and is never taken. A null source is a source of its own. Rows that repeat a
    doc_id each count. A source is read in the order of doc_id (null first), then size; rows of an id that holds very many rows, or
    of none, come in the order of a hash. The block numbers of a source are visited in a new pseudorandom order for each pass,
    every block at most once a pass. Other columns are not read. Sources must be fewer than 2**LOG2_SOURCES.
    """
    sized = cut(docs.select("doc_id", source_key(F.col("source")).alias("_source"), F.size(words(F.col("text"))).cast("long").alias("size")))
    sources = cut(targets(sized))
    blocks_in = F.ceil(F.col("source_size") / block_words)
    short = blocks_in * block_words - F.col("source_size")  # words that the last block lacks, in each of two passes
    wanted = F.ceil((F.col("target") + MOST * short) / block_words)
    most = MOST * blocks_in
    # a row for each source, a small dimension table: its shares become literals of the draw
    owed = sources.select("_source", F.when(F.col("source_size") > 0, F.least(wanted, most)).otherwise(0).alias("_owed"), most.alias("_most"))
    plan = [tuple(r) for r in owed.select("_source", "_owed").orderBy("_source").collect()]
    if len(plan) >= 2**LOG2_SOURCES:
        raise ValueError(f"more than {2**LOG2_SOURCES - 1} sources")
    of_source = sources.join(owed, "_source").select("_source", "source_size", "_owed", F.round("target").cast("long").alias("_words"), blocks_in.alias("_n"))
    slots = drawn_slots(owed, plan, seed, shard_blocks).join(F.broadcast(of_source), "_source")
    slots = slots.withColumns({"pass": F.expr("cast(slot div _n as int)"), "_index": F.expr("slot % _n")})
    slots = with_permuted(slots, "block", F.col("_index"), F.col("_n"), F.col("_source"), F.col("pass"), F.lit(seed))
    held = F.when(F.col("block") == F.col("_n") - 1, F.col("source_size") - F.col("block") * block_words).otherwise(block_words)
    slots = cut(slots.select("out_shard", "_source", "slot", "block", "pass", held.cast("long").alias("n_words"), (F.col("_owed") - F.col("rank")).alias("_left"), "_words"))
    # At most MOST * short + block_words words are too many, so the last four slots of a source hold them all.
    extra = slots.groupBy("_source").agg((F.sum("n_words") - F.first("_words")).alias("_extra"))
    later = Window.partitionBy("_source").orderBy("_left").rowsBetween(Window.unboundedPreceding, -1)
    last = slots.where("_left <= 4").withColumn("_later", F.coalesce(F.sum("n_words").over(later), F.lit(0))).join(F.broadcast(extra), "_source")
    trimmed = last.withColumn("n_words", F.col("n_words") - F.least(F.col("n_words"), F.greatest(F.lit(0), F.col("_extra") - F.col("_later"))))
    columns = ["out_shard", "_source", "slot", "block", "pass", "n_words"]
    slots = slots.where("_left > 4").select(*columns).unionByName(trimmed.where("n_words > 0").select(*columns))
    rows = prefix_sums(sized, "doc_id", ["size"], {"_start": F.col("size")}, ["_source"])
    return rows, sources, slots


def pieces(rows: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The taken pieces of documents, one row for each taking: _source, _start of the document, from and to within it (words), pass, out_shard."""
    last = F.floor((F.col("_start") + F.col("size") - 1) / block_words)
    spread = rows.where("size > 0").select("_source", "_start", "size", F.explode(F.sequence(F.floor(F.col("_start") / block_words), last)).alias("block"))
    low = F.greatest(F.col("block") * block_words - F.col("_start"), F.lit(0))
    high = F.least(F.col("block") * block_words + F.col("n_words") - F.col("_start"), F.col("size"))
    met = spread.join(slots, ["_source", "block"])
    return met.select("_source", "_start", low.alias("from"), high.alias("to"), "pass", "out_shard").where(F.col("from") < F.col("to"))


def mix_digest(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, shard_blocks: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of documents; see mix().

    More columns: n_pieces, in how many takings of blocks the document's words are, and first_shard, the least output shard that
    has any of them (null where nothing is taken).
    """
    rows, sources, slots = mix(docs, block_words, seed, shard_blocks)
    rows = cut(rows)
    taken = pieces(rows, slots, block_words).groupBy("_source", "_start").agg(F.sum(F.col("to") - F.col("from")).alias("_taken"), F.count("*").alias("_pieces"), F.min("out_shard").alias("_shard"))
    out = rows.join(taken, ["_source", "_start"], "left").join(F.broadcast(sources), "_source")
    of = lambda c: F.when(F.col("size") > 0, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return out.select(
        "doc_id", "size", "source_size", "target", of("_taken").alias("taken"), of("_pieces").alias("n_pieces"), F.when(F.col("size") > 0, F.col("_shard")).alias("first_shard")
    )


def with_starts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """_source, _start, size, text of the rows of `docs` that have words.

    Repeated rows: the n-th row of an id, source and size, by text, meets the n-th place of the same in `rows`. Texts are shuffled
    once: both tables are dealt by what they share, and every window keeps inside that.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    words_in = F.size(words(F.col("text"))).cast("long").alias("size")
    texts = docs.select(key, source_key(F.col("source")).alias("_source"), words_in, F.lit(None).cast("long").alias("_start"), "text")
    places = rows.select(key, "_source", "size", "_start", F.lit(None).cast("string").alias("text"))
    both = texts.unionByName(places).where("size > 0").repartition("_key", "_source", "size")
    is_place = F.col("_start").isNotNull()
    nth = Window.partitionBy("_key", "_source", "size", "_place").orderBy("_start", "text")
    numbered = both.withColumn("_place", is_place).withColumn("_turn", F.row_number().over(nth))
    met = numbered.withColumn("_at", F.max("_start").over(Window.partitionBy("_key", "_source", "size", "_turn")))
    return met.where("not _place").select("_source", F.col("_at").alias("_start"), "size", "text")


def packed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, shard_blocks: int | None = None) -> DataFrame:
    """The mix as output shards of packed blocks: shard, position, source, block, n_words, text.

    One row for each block that a shard drew; see mix(). text has the block's words, one space between two, over the borders of
    documents. Every block has `block_words` words but the last one of a source and its last slots, which can have fewer. position
    counts from 0 within a shard, in an order by hash that mixes the sources. What a block is taken twice for is two rows, in any shards.
    """
    rows, _, slots = mix(docs, block_words, seed, shard_blocks)
    first = F.floor(F.col("_start") / block_words)
    last = F.floor((F.col("_start") + F.col("size") - 1) / block_words)
    # the array of words is bound by transform() once for each document, or it would be made again for every block
    told = F.transform(
        F.array(words(F.col("text"))),
        lambda u: F.transform(
            F.sequence(first, last),
            lambda k: F.struct(
                k.alias("block"),
                F.slice(u, (F.greatest(k * block_words - F.col("_start"), F.lit(0)) + 1).cast("int"), (F.least((k + 1) * block_words - F.col("_start"), F.col("size")) - F.greatest(k * block_words - F.col("_start"), F.lit(0))).cast("int")).alias("words"),
            ),
        ),
    )[0]
    parts = with_starts(docs, rows).select("_source", "_start", F.explode(told).alias("_p"))
    parts = parts.select("_source", "_start", "_p.block", F.array_join("_p.words", " ").alias("text"), F.size("_p.words").cast("long").alias("n"))
    blocks = parts.groupBy("_source", "block").agg(F.array_sort(F.collect_list(F.struct("_start", "text"))).alias("_parts"))
    # A shard has about shard_blocks slots, so no window is larger than that.
    order = Window.partitionBy("out_shard").orderBy(F.xxhash64("_source", "slot", F.lit(~seed)), "_source", "slot")
    dealt = slots.select("out_shard", "_source", "block", "n_words", (F.row_number().over(order) - 1).alias("position"))
    source = F.when(F.col("_source").startswith("s"), F.substr("_source", F.lit(2)))
    return dealt.join(blocks, ["_source", "block"]).select(
        F.col("out_shard").alias("shard"), "position", source.alias("source"), "block", "n_words",
        F.call_function("substring_index", F.array_join(F.col("_parts.text"), " "), F.lit(" "), F.col("n_words").cast("int")).alias("text"),
    )


def mix_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents: every document once with its words that are taken at all, again with those taken twice.

    A row has the columns of documents; text has the taken words with the white space that follows each, n_chars its length. A
    document that is taken whole keeps its text as it is. Documents of which nothing is taken do not appear. Rows that repeat
    a doc_id, text and source are told apart by their place in the stream.
    """
    rows, _, slots = mix(docs)
    rows = cut(rows)
    spans = pieces(rows, slots).groupBy("_source", "_start", "pass").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("_spans")).drop("pass")
    # Repeated rows: the n-th row of an id, source and size meets the n-th place of the same.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    same = Window.partitionBy("_key", "_source", "size")
    turns = rows.where("size > 0").withColumn("_key", key).withColumn("_turn", F.row_number().over(same.orderBy("_start")))
    places = turns.select("_key", "_source", "size", "_turn", "_start").join(spans, ["_source", "_start"]).drop("_start")
    # The row itself is packed, so that its columns can have any names.
    counted = docs.select(
        F.struct("*").alias("_row"), key.alias("_key"), source_key(F.col("source")).alias("_source"),
        F.size(words(F.col("text"))).cast("long").alias("size"), "text",
    )
    wide = counted.withColumn("_turn", F.row_number().over(same.orderBy("text"))).drop("text")
    hit = wide.join(places, ["_key", "_source", "size", "_turn"]).select("_row", "size", "_spans", F.col("_row.text").alias("text"))
    units = F.regexp_extract_all(F.regexp_replace("text", f"^{GAP}", ""), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    whole = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"]) == F.col("size")
    cut_out = F.transform(
        F.array(units),
        lambda u: F.array_join(F.transform("_spans", lambda s: F.array_join(F.slice(u, s["from"].cast("int") + 1, (s["to"] - s["from"]).cast("int")), "")), ""),
    )[0]
    text = F.when(whole, F.col("text")).otherwise(cut_out)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return hit.select("_row", text.alias("text")).select(*[own.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
