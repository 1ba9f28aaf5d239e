import re

import numpy as np
import pytest
from millrace.llm import simhash, substrings, token_counts
from millrace.llm.decontaminate import _slices


def _classes(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_trie_join_descends_into_dense_parts(spark, monkeypatch, budget):
    monkeypatch.setattr(simhash, "_NODE_ROWS", 64)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    values = [int(x) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, int(rng.integers(0, 5))))) for x in seeds for _ in range(4)]
    values = np.unique(np.array([*values, *((0xABCDEF << 40) ^ m for m in range(150))], dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long").repartition(3)
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.link_forest(df, budget).collect()]
    pairs = [(int(a), int(b)) for k, a in enumerate(values) for b in values[k + 1 :] if int(a ^ b).bit_count() <= budget]
    assert _classes(got) == _classes(pairs)


def test_suffixes_are_sorted_to_the_depth():
    rng = np.random.default_rng(0)
    for trial in range(24):
        n, letters = int(rng.integers(1, 900)), int(rng.integers(1, 5))
        text = np.concatenate([rng.integers(0, letters + 1, n).astype(np.uint8), np.zeros(100, np.uint8)])
        if trial % 3 == 0:
            text[:n] = np.tile(text[:7], n)[:n]
        order = substrings.suffix_array(text, 50)
        assert sorted(order.tolist()) == list(range(len(text)))
        raw = text.tobytes()
        prefixes = [raw[k : k + 50] for k in order if k < n]
        assert prefixes == sorted(prefixes)


def test_texts_over_several_chunks_lose_no_match(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_CHUNK", 3000)
    rng = np.random.default_rng(9)
    shared = rng.integers(97, 123, 50).astype(np.uint8).tobytes().decode()
    rows = [(1, shared)]
    for k in range(2, 9):  # one long text among them, far above a chunk
        filler = rng.integers(65, 91, 40_000 if k == 5 else 900).astype(np.uint8).tobytes().decode()
        rows.append((k, filler[:450] + shared + filler[450:]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.remove_repeats(df).collect()}
    first, expect = {}, {}
    for k, text in rows:
        raw, gone = text.encode(), bytearray(len(text))
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], k) < k:
                gone[p : p + 50] = b"\1" * 50
        expect[k] = [(m.start(), len(m[0])) for m in re.finditer(b"\1+", bytes(gone))]
    assert got == expect and all(len(expect[k]) == 1 for k in range(2, 9))


def test_ids_that_do_not_fit_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_counts.write_token_files(docs, f"file://{tmp_path}/t", "x", 70_000)


def test_slices_of_windows_are_of_measured_size(spark):
    rows = [(k, [b"the", f"w{k}".encode(), b"a"]) for k in range(500)]  # one and the same least word everywhere
    windows = spark.createDataFrame(rows, "item_id long, words array<binary>")
    found = _slices(windows, 4000)
    assert len(found) > 10 and found[0][1] == 0 and found[-1][2] == found[0][0] - 1
    assert all(b[1] == a[2] + 1 for a, b in zip(found, found[1:]))
    assert _slices(windows.limit(0), 10) == [(1, 0, 0)]
