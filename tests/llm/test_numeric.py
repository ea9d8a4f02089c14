"""The numpy helpers against brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import common, jaccard, quality_fm, quality_gbt, secrets, tokens
from chronoloom.llm.features import NAMES, base_counts, statistics

TEXT = st.text(alphabet="aab c\n\t#é", max_size=120)


def brute_base(text):
    words = [w for line in [text] for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_base_counts(text):
    base, words = base_counts(text)
    assert base == brute_base(text)
    assert np.isfinite(statistics(text, base, words)).all()


def test_base_counts_of_nothing():
    assert base_counts(None)[0] == base_counts("")[0] == (0, 0, 0, 0, 0)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 5))
def test_shingle_sets(text, n):
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", text.lower())
    want = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    assert len(jaccard.shingle_set(text, n)) == len(want)


def groups_of(links, n):
    label = list(range(n))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    return {frozenset(i for i in range(n) if label[i] == x) for x in label}


@pytest.mark.parametrize("seed", range(8))
def test_tree_join_finds_all_groups(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(14):
        base = rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64)
        for _ in range(rng.integers(1, 30)):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.08])]
            extra = rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([keep, extra]) if len(keep) else base))
    n = len(sets)
    want = [(i, j) for i, j in itertools.combinations(range(n), 2) if jaccard.linked(sets[i], sets[j], 80)]
    assert groups_of(jaccard.tree_join(sets, None, 80), n) == groups_of(want, n)
    left, right = sets[: n // 2], sets[n // 2 :]
    across = [(i, j) for i, j in want if i < n // 2 <= j]
    got = jaccard.tree_join(left, right, 80)
    assert groups_of(got, n) == groups_of(across, n) and all(i < n // 2 <= j for i, j in got)


@pytest.mark.parametrize("percent", [80, 85])
def test_keys_of_linked_sets_meet(percent):
    rng = np.random.default_rng(percent)
    checked = 0
    for _ in range(4000):
        size = int(np.exp(rng.uniform(0, 6.5))) + 1
        a = np.unique(rng.integers(0, 2**64, size, np.uint64))
        lost = int(rng.integers(0, max(2, size // 8 + 1)))
        b = np.unique(np.concatenate([a[rng.permutation(size)[lost:]], rng.integers(0, 2**64, int(rng.integers(0, max(2, size // 8 + 1))), np.uint64)]))
        frequent = np.sort(np.concatenate([a[rng.random(size) < rng.choice([0, 0.5, 1])], b[:1]]))
        if len(b) and len(np.setxor1d(a, b)) and jaccard.linked(a, b, percent):
            checked += 1
            assert set(jaccard.keys_of(a, percent, frequent)) & set(jaccard.keys_of(b, percent, frequent))
    assert checked > 1000


def test_keys_of_a_chunk_keep_what_they_connect():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        keys = [np.unique(rng.integers(0, 60, rng.integers(0, 4)).astype(np.uint64)) for _ in range(n)]
        nodes = rng.permutation(1000)[:n].astype(np.int64)
        by_key = {}
        for key, node in zip(*map(list, jaccard.met_in_chunk(keys, nodes))):
            by_key.setdefault(int(key), []).append(int(node))
        place = {int(v): i for i, v in enumerate(nodes)}
        got = [(place[a], place[b]) for some in by_key.values() for a, b in zip(some, some[1:])]
        want = [(i, j) for i, j in itertools.combinations(range(n), 2) if set(keys[i]) & set(keys[j])]
        assert groups_of(got, n) == groups_of(want, n)
        for i in range(n):  # each key is still there, for other chunks
            assert all(len(by_key[int(k)]) >= 1 for k in keys[i])


def test_a_local_folder_will_not_do_for_executors_elsewhere():
    assert common.reaches_one_machine("spark://host:7077", "file") and common.reaches_one_machine("yarn", None)
    assert not common.reaches_one_machine("local[8]", "file") and not common.reaches_one_machine("yarn", "hdfs")


def test_pre_tokens_count_like_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    assert tokens.pieces_cross([model.id_to_piece(i) for i in range(model.vocab_size()) if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i)]) == []
    assert tokens.pieces_cross(["a▁b", "▁▁", "ab", "a.", ".a", "1a"]) == ["a▁b", "a."]
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(" ▁\n\tabcé中😀<s>/ﬁ\r\0\".,#9²_\u0301") for _ in range(rng.randint(0, 14)))
        n = sum(len(model.encode(tokens.isolated(t)[0])) - tokens.isolated(t)[1] for t in tokens.pre_tokens(text))
        assert n == len(model.encode(text)), repr(text)


def test_factorisation_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    size = 2**quality_fm.LOG2_WORDS + len(NAMES) + 1
    model = quality_fm.Model(0.3, rng.normal(size=size), rng.normal(size=(size, 8)), np.zeros(len(NAMES) + 1), np.ones(len(NAMES) + 1))
    parts = [quality_fm.described(t, 5) for t in ("a b b c", "", None, "X Y\nz!!")]
    at, value, starts = quality_fm.rows_of(parts, model.mean, model.scale)
    got = quality_fm.raw_scores(model, at, value, starts)[0]
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(at)])):
        pairs = sum(model.factors[at[j]] @ model.factors[at[k]] * value[j] * value[k] for j in range(a, b) for k in range(a, j))
        assert got[i] == pytest.approx(model.bias + model.weights[at[a:b]] @ value[a:b] + pairs)


def test_words_of_one_bucket_are_one_feature():
    _, words = base_counts(" ".join(f"w{i} w{i % 3}" for i in range(40)))
    at, value = quality_fm.hashed_words(words, 3)
    assert len(at) == len(set(at.tolist())) <= 8 and (value**2).sum() == pytest.approx(1)


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3)).astype(float)
    y = np.where(rng.random(2000) < 0.1, 1 - y, y)
    trees = quality_gbt.fit(x, y, falling=(0,))
    assert ((quality_gbt.raw_scores(trees, x) > 0) == (y > 0)).mean() > 0.85
    line = np.linspace(0, 1, 101)
    for a, b in rng.random((50, 2)):
        scores = quality_gbt.raw_scores(trees, np.stack([line, np.full(101, a), np.full(101, b)], 1))
        assert (np.diff(scores) <= 1e-12).all()
    none = quality_gbt.fit(np.zeros((0, len(NAMES))), np.zeros(0))
    assert np.isfinite(quality_gbt.raw_scores(none, np.zeros((2, len(NAMES))))).all()


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query("[0-9a-f]{16,}") == []
    clause = secrets.trigram_query(secrets.BASE[0].regex)
    assert len(clause) == 1 and frozenset({"sec", "ecr", "cre", "ret"}) in clause[0] and frozenset({"api", "pik", "ike", "key"}) in clause[0]
    assert len(clause[0]) == 6
