import random

import corpus_pipeline


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_dedup_finds_every_pair_of_similarity_four_fifths(spark):
    pick = random.Random(7)
    rows, n = [], 0
    for base in range(12):
        words = [f"w{pick.randrange(5000)}" for _ in range(pick.choice((40, 90, 200)))]
        for _ in range(4):
            copy = list(words)
            for _ in range(pick.randrange(0, 1 + len(words) // 30)):
                copy[pick.randrange(len(copy))] = f"x{pick.randrange(5000)}"
            rows.append((n, " ".join(copy)))
            n += 1
    sets = {i: _shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in rows:
        for i in sets:
            for j in sets:
                if _jaccard(sets[i], sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got == set(label.values())
    assert len(got) < len(rows) - 12


def test_near_dedup_keeps_rows_of_null_and_repeated_ids(spark):
    texts = [" ".join(f"{name}{k}" for k in range(30)) for name in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (2, texts[3]), (5, texts[2]), (None, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (2, texts[3])], key=str)
