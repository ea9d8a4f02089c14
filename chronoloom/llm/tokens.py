"""Token counts: pieces of each distinct pre-token, joined to per-document pre-token frequencies."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import id_column

SPACE = "▁"
# Cuts before a run of space marks, before a line feed, and between a Latin letter and what is neither that nor space mark. In the
# vocabularies that this is for, no piece has such a place inside, so no merge crosses it; pieces_cross() checks a model for that.
LATIN = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
PRE_TOKEN = re.compile(f"(?:{SPACE}+|\n)?[^{LATIN}{SPACE}\n]*[{LATIN}]*")
BLOCK_DOCS, BLOCK_CHARS = 1 << 15, 1 << 25
MOST_SEEN, MOST_SUMS = 1 << 19, 1 << 21
LIMIT = 4096


def pieces_cross(pieces: list[str]) -> list[str]:
    """The pieces that would let a merge cross a pre-token's border; the method needs that there are none."""
    return [p for p in pieces if len(cut_up(p)) > 1]


def isolated(pre_token: str) -> tuple[str, int]:
    """A text whose pieces are the pre-token's and so many more.

    The model puts a space mark in front of a text. A pre-token's own first mark is that one; others are put behind a line feed,
    which is a piece by itself, as is the mark before it.
    """
    if pre_token[0] == SPACE and len(pre_token) > 1:
        return pre_token[1:].replace(SPACE, " "), 0
    return "\n" + pre_token.replace(SPACE, " "), 2


UNLIKE_SCANS = "the documents came in other partitions or another order in a second scan: write them to a table first"


def cut_up(text: str) -> list[str]:
    found = PRE_TOKEN.findall(text)
    return found[:-1]  # the last match is the empty one at the end


def pre_tokens(text: str) -> list[str]:
    """Cuts a text, with the space mark that the model puts in front, where no merge can cross."""
    return cut_up(SPACE + text.replace(" ", SPACE)) if text else []


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Blocks of a task's documents (name, ids, texts), by number and length; equal blocks have equal names."""
    ids, texts, chars = [], [], 0

    def block() -> tuple[int, list, list]:
        name = xxhash.xxh3_64(repr(ids).encode())
        for text in texts:
            name.update(b"%d:" % len(text) + text.encode("utf-8", "surrogatepass"))
        return name.intdigest() % 2**63, ids, texts

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(doc_id)
            texts.append(text or "")
            chars += len(texts[-1])
            if len(ids) == BLOCK_DOCS or chars >= BLOCK_CHARS:
                yield block()
                ids, texts, chars = [], [], 0
    if ids:
        yield block()


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column of binaries: slices of `values` up to each of `ends`."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def buffer_of(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binaries, and how many each row has."""
    column = pa.concat_arrays([column])  # from offset 0
    offsets = np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1]
    width = np.dtype(dtype).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype, (offsets[-1] - offsets[0]) // width, offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype)
    return values, np.diff(offsets) // width


def distinct_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's pre-tokens, sorted, as that packs better; repeats only where more than MOST_SEEN differ."""
    seen: set[str] = set()
    for _, _, texts in blocks(batches):
        for text in texts:
            seen.update(pre_tokens(text))
            if len(seen) > MOST_SEEN:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["pre_token"])
                seen = set()
    yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["pre_token"])


def frequencies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and pre-token: the documents (places in the block) that have it, each as often as it does."""
    for block, _, texts in blocks(batches):
        number: dict[str, int] = {}
        codes, lengths = [], []
        for text in texts:
            found = pre_tokens(text)
            codes.append(np.fromiter((number.setdefault(t, len(number)) for t in found), np.int32, len(found)))
            lengths.append(len(found))
        if not number:
            continue
        names = sorted(number)
        rank = np.empty(len(names), np.int32)
        rank[np.fromiter(map(number.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        code = rank[np.concatenate(codes)]
        codes.clear()
        places = np.repeat(np.arange(len(texts), dtype=np.uint16), lengths)[np.argsort(code, kind="stable")]
        ends = np.cumsum(np.bincount(code, minlength=len(number)))
        for a in range(0, len(names), 20000):
            b = min(a + 20000, len(names))
            low = ends[a - 1] if a else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[a:b], pa.string()), pa.array(np.full(b - a, block, np.int64)), binaries(places[low : ends[b - 1]], ends[a:b] - low)],
                names=["pre_token", "block", "places"],
            )


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: its documents' ids and sizes. Ids have the type that they come with."""
    first = next(batches, None)
    if first is None:
        return
    kind = first.schema.field("doc_id").type
    for block, ids, texts in blocks(itertools.chain([first], batches)):
        sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sizes.tolist()], pa.list_(pa.int64()))], names=["block", "ids", "sizes"])


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From joined rows (block, places, n): the sums of n for each block and place."""
    sums: dict[int, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        places = [np.flatnonzero(v) for v in sums.values()]
        values = [v[p] for v, p in zip(sums.values(), places)]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([p.astype(np.uint16).tobytes() for p in places], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())],
            names=["block", "places", "sums"],
        )

    for batch in batches:
        places, lengths = buffer_of(batch.column("places"), np.uint16)
        weight = np.repeat(batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64), lengths)
        names, row = np.unique(batch.column("block").to_numpy(zero_copy_only=False), return_inverse=True)
        row = np.repeat(row, lengths)
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(names) + 1))
        for k, block in enumerate(names.tolist()):
            some = order[ends[k] : ends[k + 1]]
            added = np.bincount(places[some], weight[some]).astype(np.int64)
            if block not in sums or len(sums[block]) < len(added):
                sums[block] = np.concatenate([sums.get(block, added[:0]), np.zeros(len(added) - len(sums.get(block, ())), np.int64)])
            sums[block][: len(added)] += added
        if sum(map(len, sums.values())) > MOST_SUMS:
            yield out()
            sums.clear()
    yield out()


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `docs` (doc_id, text), for a sentencepiece BPE model.

    Texts are cut into pre-tokens that no merge crosses. Pieces are counted once for each distinct pre-token. Frequencies of
    pre-tokens in documents are packed by blocks of documents, joined to the counts by pre-token, summed for each block in
    each partition, and then over the partitions. Ids of tokens are never made. Null and empty texts have 0 tokens; null
    doc_ids stay null, and ids can be of any type; rows that repeat are counted each; other columns are not read. `docs` is read
    three times and must give the same rows in the same partitions each time, as a table does; else the job fails with
    UNLIKE_SCANS. The model file is read on the driver and sent to the tasks.
    """
    import sentencepiece

    model = Path(model_path).read_bytes()
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = [i for i in range(processor.vocab_size()) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
    if crossing := pieces_cross([processor.id_to_piece(i) for i in plain]):
        raise ValueError(f"pieces cross pre-tokens: {crossing[:3]}")

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            names = batch.column("pre_token").to_pylist()
            n = [len(ids) - extra for ids, (_, extra) in zip(processor.encode([isolated(t)[0] for t in names], num_threads=1), map(isolated, names))]
            yield pa.RecordBatch.from_arrays([batch.column("pre_token"), pa.array(n, pa.int32())], names=["pre_token", "n"])

    def finish(rows: pa.Table) -> pa.Table:
        known = rows.filter(rows["ids"].is_valid())
        same = known.num_rows  # equal blocks share a name and have equal sums
        if not same:
            raise RuntimeError(UNLIKE_SCANS)
        ids, sizes = known["ids"][0].values, known["sizes"][0].values
        total = np.zeros(len(ids), np.int64)
        for places, sums in zip(rows["places"].to_pylist(), rows["sums"].to_pylist()):
            if places is not None:
                total[np.frombuffer(places, np.uint16)] += np.frombuffer(sums, np.int64)
        total //= same
        return pa.concat_tables([pa.table({"doc_id": ids, "n_bytes": sizes, "n_tokens": total, "over_limit": total > limit})] * same)

    doc_id, id_type = id_column(docs)
    texts = docs.select(doc_id, "text")
    counts = texts.mapInArrow(distinct_of, "pre_token string").distinct().mapInArrow(count_pieces, "pre_token string, n int")
    frequencies = texts.mapInArrow(frequencies_of, "pre_token string, block long, places binary")
    joined = frequencies.join(counts, "pre_token").select("block", "places", "n")
    sums = joined.mapInArrow(partial_sums, "block long, places binary, sums binary")
    known = texts.mapInArrow(documents_of, f"block long, ids array<{id_type}>, sizes array<long>")
    both = sums.unionByName(known, allowMissingColumns=True)
    kinds = [T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return both.groupBy("block").applyInArrow(finish, T.StructType(kinds))
