"""Benchmark decontamination: MinHash containment search of short items in long documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import ascii_lower, cut, literal_array, may_be_among, words

SHINGLE = 5
CONTAINED = 80  # per cent of an item's distinct shingles
BROADCAST_BYTES = 32 << 20  # what is broadcast of the items at most; more is joined by shuffle
BITMAP_WORDS = 1 << 18  # of 64 bits: the sketches' bitmap at most, 2 MB; one word a sketch entry below that
NO_ID_SALTS = 64
ENTRY_BYTES = 64  # of a sketch entry or an array element, ids and overhead included


def word_hashes(text: Column) -> Column:
    return F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))


def hashed_shingles(hashes: Column, n: int) -> Column:
    """Hashes of the runs of n words, given the words' hashes; none where there are fewer words."""
    runs = F.transform(
        F.array(hashes),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])),
    )[0]
    return F.when(F.size(hashes) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def shingles(text: Column, n: int) -> Column:
    """Distinct runs of n words as strings."""
    runs = F.transform(
        F.array(words(ascii_lower(text))),
        lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))),
    )[0]
    return F.array_distinct(F.coalesce(runs, F.array().cast("array<string>")))


def sketches(items: DataFrame, n: int, contained: int = CONTAINED) -> DataFrame:
    """The MinHash sketch of each item: item_id, _need, _size_class, _hash.

    An item of m distinct shingles is contained where `need` = ceil(contained % of m) of them are. Its sketch is its m - need +
    1 smallest hashes: of those, a document that contains it must have at least one, so the search loses nothing.
    """
    sets = items.select("item_id", F.array_sort(F.array_distinct(hashed_shingles(word_hashes(F.col("text")), n))).alias("_set"))
    m = F.size("_set")
    need = F.floor((m * contained + 99) / 100).cast("int")
    small = F.slice("_set", F.lit(1), m - need + 1)
    size_class = F.floor(F.log2(m.cast("double"))).cast("int")
    return sets.where(m > 0).select("item_id", need.alias("_need"), size_class.alias("_size_class"), F.explode(small).alias("_hash"))


def class_thresholds(sketch: DataFrame) -> list[tuple[int, int]]:
    """(size class, largest hash of its sketches), a row for each power of two, so a few dozen."""
    return [tuple(r) for r in sketch.groupBy("_size_class").agg(F.max("_hash")).orderBy("_size_class").collect()]


def class_key(size_class: int, h: Column) -> Column:
    """A hash under the name of its class, so that classes meet by one number. Two names that agree by chance only add a candidate."""
    return h.bitwiseXOR(F.lit((size_class * 0x1F3D5B79A1C2E4D7) % 2**63))


def _place(h: Column, n_words: int) -> tuple[Column, Column]:
    """The word of the bitmap that a hash belongs to, and its bit in it."""
    return F.pmod(h, F.lit(n_words)).cast("int"), F.call_function("shiftrightunsigned", h, F.lit(40)).bitwiseAND(F.lit(63)).cast("int")


def sketch_bitmap(sketch: DataFrame, n_entries: int) -> list[int]:
    """A bitmap of the sketches' hashes, as 64-bit words: about one in 64 hashes that aren't in a sketch is taken for one that is."""
    n_words = min(BITMAP_WORDS, 1 << max(6, (n_entries - 1).bit_length()))
    word, bit = _place(F.col("_hash"), n_words)
    held = sketch.select(word.alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_b")).groupBy("_w").agg(F.bit_or("_b"))
    out = [0] * n_words
    for w, bits in held.collect():
        out[w] = bits
    return out


def looked_up(docs: DataFrame, classes: list[tuple[int, int]], n: int, bitmap: list[int] | None = None) -> DataFrame:
    """The columns of `docs` but the text, _size_class, _key: for each class, those of a document's shingle hashes that reach no
    further than its threshold. With a bitmap of the sketches, hashes that are in no sketch stay in their arrays and make no row.
    """
    hashes, ids = hashed_shingles(word_hashes(F.col("text")), n), [c for c in docs.columns if c != "text"]
    least = max([t for _, t in classes], default=-(2**63))
    known = literal_array(bitmap, "bigint") if bitmap else None

    def wanted(h: Column) -> Column:
        if known is None:
            return h <= least
        word, bit = _place(h, len(bitmap))
        return (h <= least) & (F.call_function("shiftright", F.get(known, word), bit).bitwiseAND(F.lit(1)) == 1)

    told = docs.select(*ids, F.explode(F.array_distinct(F.filter(hashes, wanted))).alias("_hash"))
    each = [F.when(F.col("_hash") <= top, F.struct(F.lit(c).alias("_size_class"), class_key(c, F.col("_hash")).alias("_key"))) for c, top in classes]
    none = F.array().cast("array<struct<_size_class:int,_key:bigint>>")
    return told.select(*ids, F.explode(F.array_compact(F.array(*each)) if each else none).alias("_e")).select(*ids, "_e.*")


def contained_items(docs: DataFrame, items: DataFrame, n: int = SHINGLE, contained: int = CONTAINED) -> DataFrame:
    """Pairs of documents and benchmark items that they contain: doc_id, item_id, n_item, n_shared.

    Containment: at least `contained` per cent of the item's distinct shingles of n words (A-Z lower-cased) are among the
    document's. An item with fewer words is one shingle of all its words. Items are dealt into classes of size by powers of two;
    for each class by itself, those of a document's shingle hashes that are at most the largest in the class's sketches (the
    document's MinHash sketch for that class) are looked up among the class's items. Candidates are verified on the shingles'
    words; only texts of candidates are shuffled for that, as a bitmap of their ids keeps the others out. Null or empty texts
    contain nothing and are contained nowhere. Rows that repeat a doc_id are one document for the result, which has each pair
    once, with the larger count; a null doc_id is an id like others. Items that repeat an item_id count each, by the larger
    count. Other columns are not read.
    """
    items = items.select("item_id", "text")
    lengths = F.least(F.size(words(F.col("text"))), F.lit(n))
    # At most n lengths: n for items of n words or more, and those of shorter items.
    sized = items.withColumn("_n", lengths).where("_n > 0")
    kinds = sorted(r[0] for r in sized.select("_n").distinct().collect())
    found = None
    for k in kinds:
        some = sized.where(F.col("_n") == k).select("item_id", "text")
        part = _contained(docs.select("doc_id", "text"), some, k, contained)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], _result_type(docs, items))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))


def _result_type(docs: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], items.schema["item_id"], T.StructField("n_item", T.IntegerType()), T.StructField("n_shared", T.IntegerType())])


def _contained(docs: DataFrame, items: DataFrame, n: int, contained: int) -> DataFrame:
    # rows without an id are told apart by their texts, so that they don't meet in one task
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(NO_ID_SALTS)).cast("int")).otherwise(0)
    docs = docs.withColumn("_salt", salt)
    sketch = cut(sketches(items, n, contained))
    classes = class_thresholds(sketch)
    entries = sketch.select("item_id", F.coalesce(*[F.when(F.col("_size_class") == c, class_key(c, F.col("_hash"))) for c, _ in classes], F.col("_hash")).alias("_key"))
    n_entries = sketch.count()
    small = n_entries * ENTRY_BYTES <= BROADCAST_BYTES
    probes = looked_up(docs, classes, n, sketch_bitmap(sketch, n_entries))
    pairs = probes.join(F.broadcast(entries) if small else entries, "_key").select("doc_id", "_salt", "item_id").distinct()
    candidates = cut(pairs)
    known = cut(items.select("item_id", shingles(F.col("text"), n).alias("_item")))
    size = known.agg(F.sum(F.octet_length(F.array_join("_item", "")) + ENTRY_BYTES * (1 + F.size("_item")))).first()[0] or 0
    wanted = candidates.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, candidates["item_id"].eqNullSafe(known["item_id"])).select("doc_id", "_salt", candidates["item_id"], "_item")
    key = F.xxhash64("doc_id", "_salt")
    some = may_be_among(docs, key, candidates.select(key.alias("_id")).distinct(), "_maybe").where("_maybe")
    # each text's shingles are made once, then met with its candidates
    texts = some.select(F.col("doc_id").alias("_doc"), F.col("_salt").alias("_with"), shingles(F.col("text"), n).alias("_own"))
    both = wanted.join(texts, wanted["doc_id"].eqNullSafe(texts["_doc"]) & (wanted["_salt"] == texts["_with"]))
    counted = both.select("doc_id", "item_id", F.size("_item").alias("n_item"), F.size(F.array_intersect("_item", "_own")).alias("n_shared"))
    return counted.where(F.col("n_shared") * 100 >= F.col("n_item") * contained)


def decontaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, contained: int = CONTAINED) -> DataFrame:
    """The rows of `docs` that contain none of `items`; see contained_items.

    A bitmap of the ids that go keeps the texts of nearly all others out of the shuffle. Rows without an id go or stay together,
    which is one question to the result, no join.
    """
    hits = cut(contained_items(docs, items, n, contained).select(F.col("doc_id").alias("_hit")).distinct())
    without = docs.where("doc_id is null") if hits.where("_hit is null").isEmpty() else docs.where("false")
    told = may_be_among(docs.where("doc_id is not null"), F.col("doc_id"), hits, "_maybe_hit")
    doubted = told.where("_maybe_hit").join(hits, F.col("doc_id") == F.col("_hit"), "left_anti")
    return told.where("not _maybe_hit").unionByName(doubted).drop("_maybe_hit").unionByName(without)
