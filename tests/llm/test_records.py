"""Runs of words, Merkle manifests and WARC archives, on hard rows, against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from chronoloom.llm import merkle, queries, runs, warc

SF = "/root/testdata/sf0.001"


# Runs.


def all_runs(s):
    """Every period by itself: maximal stretches that agree with those a period on."""
    out = {}
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs_match_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(300):
        s = []
        while len(s) < draw.randint(0, 150):
            w = [draw.randrange(draw.choice([1, 2, 3]))] * 1 + [draw.randrange(3) for _ in range(draw.randint(0, 6))]
            w = w * draw.randint(1, 8)
            s += (w + [draw.randrange(3)]) * draw.randint(1, 5) if draw.random() < 0.3 else w
        assert runs.runs_of(np.array(s, np.int64)) == all_runs(s)


def test_z_function():
    s = [1, 1, 2, 1, 1, 2, 1, 3]
    want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    assert runs.z_function(s) == want and runs.z_function([]) == []


def test_long_loops_take_linear_time():
    assert runs.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    once = np.arange(40_000)
    assert runs.runs_of(np.concatenate([[-1], np.tile(once, 5)])) == [(1, 200_000, 40_000)]


def told_runs(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    known = {}
    found = all_runs([known.setdefault(x, len(known)) for x in w])
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_run_digest_matches_brute_force(spark, hard_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 12000")
    looped = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', 'a b', repeat('x ', cast(id % 40 as int)), repeat('é y z\t', cast(id % 7 as int)), 'end') as text")
    for some in (docs.select("doc_id", "text"), looped, hard_docs.where("length(text) < 12000 or text is null").select("doc_id", "text")):
        got = runs.run_digest(some)
        assert tuple(got.columns) == RUNS
        assert rows_of(got, *RUNS) == Counter(told_runs(r.doc_id, r.text) for r in some.collect())
    assert runs.run_digest(hard_docs).count() == hard_docs.count()
    assert runs.run_digest(no_docs).count() == 0


def test_collapsed_texts_keep_one_period(spark):
    docs = spark.createDataFrame([("k", "so ha ha ha ha ha ha ha he"), (None, None)], "id string, body string")
    got = {r.id: r for r in runs.collapse_runs(docs, "id", "body").collect()}
    assert got["k"].collapsed == "so ha he" and [tuple(r) for r in got["k"].runs] == [(1, 7, 1)]
    assert got[None].collapsed == "" and got[None].runs == []


# The manifest.


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(digests):
    paths, nodes = [[] for _ in digests], [([i], d) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j, (below, _) in enumerate(run):
                for i in below:
                    paths[i].append((j, [d for m, (_, d) in enumerate(run) if m != j]))
            above.append(([i for below, _ in run for i in below], sha("".join(d for _, d in run))))
        nodes = above
    return nodes[0][1], paths


def told_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        text = r.text
        if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            text = text.replace("\n", "")
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), leaf_of(r, text)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    root, top = tree([trees[s][0] for s in names])
    out = Counter()
    for s, above in zip(names, top):
        for (known, doc_id, leaf, acc), path in zip(sorted(by[s]), trees[s][1]):
            path = path + above
            for j, others in path:
                acc = sha("".join(others[:j]) + acc + "".join(others[j:]))
            out[(doc_id if known else None, leaf, trees[s][0], root, sha("".join(d for _, p in path for d in p)), acc, acc == root)] += 1
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_matches_brute_force(spark, hard_docs, no_docs):
    sizes = [(f"s{k}é", k) for k in (1, 2, 3, 4, 9, 10, 28, 82)]
    rows = [(i, f"text\n{i % 5}", "en", s, i) for i, (s, n) in enumerate((s, n) for s, n in sizes for _ in range(n))]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tall = spark.range(6600).selectExpr("id as doc_id", "'t\n' as text", "'en' as lang", "'s' as source", "id % 7 as n_chars")  # blocks of blocks of blocks
    for docs in (hard_docs, many, tall, many.where("source = 's1é'"), many.where("source = 's10é'"), spark.read.parquet(f"{SF}/documents.parquet")):
        got = merkle.manifest_digest(docs)
        assert tuple(got.columns) == MANIFEST
        assert rows_of(got, *MANIFEST) == told_manifest(docs.collect())
    assert merkle.manifest_digest(no_docs).count() == 0


def test_a_proof_holds_for_its_leaf_alone(spark):
    leaves = spark.range(50).selectExpr("id as doc_id", "'a' as source", "sha2(string(id), 256) as leaf", "sha2(string(id), 256) as claim")
    built = merkle.manifest(leaves)
    assert built.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 50
    swapped = built.withColumn("leaf", F.sha2((F.col("doc_id") + 1).cast("string"), 256))
    assert swapped.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 0


# Archives.


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a.example/{i}", f"<html>page {i % 50} é {'lorem ipsum ' * (i % 30)}</html>") for i in range(400)]
    rows += [(1000, None, None), (1001, "http://x/ y\r\nz", ""), (1002, "", ""), (None, "u", "<html>only here</html>"), (None, "u", ""), (7, "again", "<html>page 7 é</html>"), (7, "again", "<html>page 7 é</html>")]
    rows += [(2000 + i, "http://hot", "hot") for i in range(300)] + [(5000, "big", "x" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'q' as first", "0 as n").repartition(5).checkpoint()


def told_pages(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    out = Counter()
    for r in rows:
        f = first.get(r.html or "")
        again = f is not None and f != r.page_id
        out[(r.page_id, len((r.html or "").encode()), digest(r.html), "revisit" if again else "response", f if again else None)] += 1
    return out


PAGE = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("hot", [warc.HOT_GROUPS, 2])
def test_pages_come_back(spark, pages, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_GROUPS", hot)
    assert rows_of(warc.archived_pages(pages), *PAGE) == told_pages(pages.collect())
    assert warc.archived_pages(pages.where("false")).count() == 0


def test_archives_are_rolled_and_hold_the_payloads(spark, pages, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archives(pages, folder, records=40)
    read = warc.read_archives(spark, folder).cache()
    assert read.where("error is not null").count() == 0
    assert max(r["count"] for r in read.groupBy("path").count().collect()) == 40
    held = rows_of(read.where("record_type = 'response'").select(F.decode("payload", "utf-8").alias("html")), "html")
    assert set(held) == {(r.html or "",) for r in pages.collect()}
    assert {r.target_uri for r in read.where("record_id = '1001'").collect()} == {"http://x/%20y%0D%0Az"}


def test_an_archive_is_a_zstandard_stream(spark, pages, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archives(pages.coalesce(1), folder, records=10_000)
    for path in tmp_path.glob("a/part-*"):
        data = path.read_bytes()
        assert data[:4] == warc.DICTIONARY_MAGIC
        frames = list(warc.archive_frames(memoryview(data)))
        assert all(f.startswith(b"WARC/1.1\r\n") and f.endswith(b"\r\n\r\n") for _, f in frames)


def archive(*records, dictionary=b""):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(dict_data=known, write_checksum=True)
    return (warc.skippable_frame(dictionary) if dictionary else b"") + b"".join(packer.compress(r) for r in records)


def test_what_does_not_hold_is_an_error():
    good = warc.record_bytes("1", "http://a", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    assert warc.parsed_record(good)["payload"] == b"abc"
    for bad in (b"", good[:-1], good + b"x", good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"WARC/1.1", b"HTTP"), good.replace(b"Length: 3", b"Length: 4")):
        with pytest.raises(ValueError):
            warc.parsed_record(bad)
    revisit = warc.record_bytes("2", None, None, hashlib.sha1(b"abc").hexdigest(), 3, "1")
    assert warc.parsed_record(revisit)["refers_to"] == "1" and warc.parsed_record(revisit)["payload_bytes"] == 3
    with pytest.raises(ValueError):
        warc.parsed_record(revisit.replace(b"WARC-Refers-To", b"WARC-Refers-Of"))


def test_broken_archives():
    good = warc.record_bytes("1", "http://a", b"abc" * 99, hashlib.sha1(b"abc" * 99).hexdigest(), 297, None)
    dictionary = zstandard.train_dictionary(2048, [good + bytes([i % 251] * 40) + str(i).encode() * 9 for i in range(300)]).as_bytes()
    for held in (b"", dictionary):
        data = archive(good, good, good, dictionary=held)
        frames = list(warc.archive_frames(memoryview(data)))
        assert [f for _, f in frames] == [good] * 3
        cut_ = list(warc.archive_frames(memoryview(data[:-5])))
        assert [f for _, f in cut_[:2]] == [good] * 2 and isinstance(cut_[2][1], ValueError)
        at = frames[1][0]
        spoilt = bytearray(data)
        spoilt[frames[2][0] - 1] ^= 1  # the second frame's checksum
        assert [isinstance(f, ValueError) for _, f in warc.archive_frames(memoryview(bytes(spoilt)))] == [False, True, False]
        assert isinstance(list(warc.archive_frames(memoryview(data[:at] + b"junkjunk")))[1][1], ValueError)


def test_registered_over_whole_tables(spark):
    assert queries.op13_warc(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert queries.op11_periodic_runs(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
