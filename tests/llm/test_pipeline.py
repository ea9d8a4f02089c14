"""The pipeline's stages: columns, what each decides, and the whole on a small table."""

import re
from collections import Counter

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return [(df.columns, [r.asDict() for r in df.collect()]) for df in out]


def test_all_but_the_last_have_the_columns_of_documents(stages):
    for columns, _ in stages[1:-1]:
        assert columns == stages[0][0]
    assert {"doc_id", "text", "shard", "slot"} <= set(stages[-1][0])


def test_quality_goes_by_the_label(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1][1]}
    right = [labels[r["doc_id"]] == (r["doc_id"] in kept) for r in stages[0][1] if r["doc_id"] in labels]
    assert sum(right) / len(right) > 0.97


def test_one_document_of_each_group_stays(stages):
    sets = {}
    for r in stages[1][1]:
        w = WORD.findall(r["text"].lower())
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x) >= 4 * len(y) and 5 * len(y) >= 4 * len(x) and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    assert sorted(r["doc_id"] for r in stages[2][1]) == sorted(set(label.values()))


def test_contaminated_documents_go(spark, stages):
    items = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(r.text.lower())
        items.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})

    def clean(text):
        w = WORD.findall(text.lower())
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return not any(100 * len(own & x) >= 80 * len(x) for x in items)

    assert {r["doc_id"] for r in stages[3][1]} == {r["doc_id"] for r in stages[2][1] if clean(r["text"])}


def test_the_mix_meets_its_targets(stages):
    sizes, taken, whole = Counter(), Counter(), {r["doc_id"]: r for r in stages[3][1]}
    for r in stages[3][1]:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    per_doc = Counter()
    for r in stages[4][1]:
        n = len(WORD.findall(r["text"]))
        taken[r["source"]] += n
        per_doc[r["doc_id"]] += n
        assert r["n_chars"] == len(r["text"])
    assert all(n <= 2 * len(WORD.findall(whole[i]["text"])) for i, n in per_doc.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.03)


def test_shards_are_contiguous_and_balanced(stages):
    rows = stages[5][1]
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in stages[4][1])
    bytes_of, slots = Counter(), {}
    for r in rows:
        bytes_of[r["shard"]] += len(r["text"].encode()) + 16
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    most = max(len(r["text"].encode()) + 16 for r in rows)
    assert all(abs(bytes_of[s] - sum(bytes_of.values()) / corpus_pipeline.N_SHARDS) <= most + 1 for s in range(corpus_pipeline.N_SHARDS))
    last = -1
    for s in sorted(slots):
        slots[s].sort()
        assert [k for k, _ in slots[s]] == list(range(len(slots[s])))
        ids = [i for _, i in slots[s]]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]


def test_run_gives_the_stages_rows(spark, stages):
    got = Counter((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r["doc_id"], r["shard"], r["slot"]) for r in stages[5][1])


def test_empty_documents_pass_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() == 0
