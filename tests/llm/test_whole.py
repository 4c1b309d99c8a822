"""The whole job: what an earlier version left out."""

import collections
import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from quarry.llm import common, keysets, lm_score, packing
from test_operators import components_of


def shingles(text, n=5):
    own = text.lower().split()
    return {tuple(own[k : k + n]) for k in range(max(1, len(own) - n + 1))} if own else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


# --- pipeline: near duplicates ---------------------------------------------------------------------


def test_pipeline_links_pairs_of_the_least_similarity_and_no_others(spark, sf_dir):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    docs = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 150, 400]))]
        docs.append(" ".join(base))
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randrange(1, max(2, len(own) // 16))):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append("  ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    # one shingle makes most of a text, which says nothing of its set of shingles
    docs += ["same " * 400 + docs[0], "same " * 400 + docs[-1], "", " ", docs[3]]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    own = {i: shingles(t) for i, t in rows}
    alike = {(a, b): similarity(own[a], own[b]) for a, b in itertools.combinations(sorted(own), 2)}
    assert sum(0.6 < s < 0.8 for s in alike.values()) > 20 and sum(0.8 <= s < 0.9 for s in alike.values()) > 20
    expected = components_of(own, [pair for pair, s in alike.items() if s >= 0.8])
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


# --- pipeline: lines -------------------------------------------------------------------------------


def test_pipeline_removes_short_repeated_lines(spark, sf_dir):
    docs = [(1, "All rights reserved.\nbody one of the first\nAnd so."), (2, "All rights reserved.\nbody two, another\nAnd so.\nAnd so."), (3, "And so."), (4, None)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf_dir).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: docs[0][1], 2: "body two, another", 4: None}


# --- op10 ------------------------------------------------------------------------------------------


def test_local_search_takes_all_sequences_of_two_patterns():
    # 200,000 sequences of two 40s, as many of one 60 twice: the 60s belong with the 40s
    runs = [(((40, 2),), 200_000), (((60, 1),), 400_000)]
    better = packing.local_search(runs, 100)
    assert sum(n for _, n in better) == 400_000
    held = collections.Counter()
    for pattern, n in better:
        assert packing.fill(pattern) <= 100
        for x, k in pattern:
            held[x] += n * k
    assert held == {40: 400_000, 60: 400_000}


# --- key sets --------------------------------------------------------------------------------------


def test_only_a_missing_file_is_an_empty_range(monkeypatch):
    def failing(error):
        def opened(path):
            raise error

        return opened

    monkeypatch.setattr(common, "mapped", failing(OSError("connection reset")))
    with pytest.raises(OSError):
        keysets.KeySet("store://host/a", 1).contains(np.array([5], np.uint64))
    with pytest.raises(OSError):
        lm_score._get("store://host/lm/0.bi")
    monkeypatch.setattr(common, "mapped", failing(FileNotFoundError("no such key")))
    assert not keysets.KeySet("store://host/a", 1).contains(np.array([5], np.uint64)).any()
    assert lm_score._get("store://host/lm/0.bi") is None


def test_mappings_of_a_worker_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "MOST_OPEN", 5)
    monkeypatch.setattr(common, "_OPEN", collections.OrderedDict())
    parts = 40
    keys = np.arange(parts, dtype=np.uint64) * np.uint64((1 << 64) // parts) + np.uint64(1 << 40)
    for p, k in zip(keysets.ranges(keys, parts).tolist(), keys, strict=True):
        (tmp_path / f"{p}.keys").write_bytes(np.array([k]).tobytes())
    own = keysets.KeySet(f"file://{tmp_path}", parts)
    for _ in range(2):
        assert own.contains(np.concatenate([keys, keys + np.uint64(1)])).tolist() == [True] * parts + [False] * parts
        assert len(common._OPEN) == 5


def test_a_packing_task_starts_without_what_former_stages_kept(monkeypatch):
    import inspect

    from quarry.llm import common, packing, tokens

    monkeypatch.setattr(common, "_OPEN", collections.OrderedDict(a=(object(), 1)))
    common.release()
    assert not common._OPEN
    assert inspect.getsource(packing.pieces).index("release()") < inspect.getsource(packing.pieces).index("for batch in batches")
    assert inspect.signature(tokens.Encoder).parameters["most"].default <= 500_000
