import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.decontaminate import contaminated_spans
from millrace.llm.licenses import scan_licenses
from millrace.llm.lines import drop_repeated_lines
from millrace.llm.packing import OpenWindows, pack_documents
from millrace.llm.quality import apply_quality_rules
from millrace.llm.shards import assign_shards
from millrace.llm.simhash import fingerprint, simhash_components
from millrace.llm.substrings import remove_repeats
from millrace.llm.token_counts import count_tokens, write_token_files
from millrace.llm.tokens import WordTokenizer
from millrace.llm.toxicity import ToxicityParams, fit_label_model, score_toxicity, vote_sums

PROSE = "The quiet river bends past old mills, and every spring the water climbs the stone steps again. "
LONG = " ".join(f"word{k} follows word{k * 7 % 101}." for k in range(90))
TEXTS = [
    (1, LONG),
    (2, LONG),
    (3, PROSE * 2 + "tail one"),
    (4, "head two " + PROSE),
    (5, None),
    (6, ""),
    (7, "x"),
    (8, "line a b c d e f\n\nline a b c d e f\nshort\nline a b c d e f"),
    (8, "line a b c d e f\n\nline a b c d e f\nshort\nline a b c d e f"),
    (None, LONG + " more"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, 0.5, "z") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, score double, part string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_quality_counts_and_verdicts(docs, empty):
    got = {r.doc_id: r["quality_"] for r in apply_quality_rules(docs).collect()}
    assert got[1].kept and not got[5].kept and got[5].clean_text is None and got[6].clean_text == ""
    for i, text in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip()]
        expect = (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered))
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == expect
    assert apply_quality_rules(empty).count() == 0


def test_quality_rejects_what_loses_most_lines(spark):
    nav = "home | about | contact | help | more | next\n" * 12
    rows = spark.createDataFrame([(1, nav + LONG[:100]), (2, LONG + "\nHome | About | Contact | Help")], "doc_id long, text string")
    got = {r.doc_id: r.quality for r in apply_quality_rules(rows).collect()}
    assert not got[1].kept and got[2].kept and got[2].clean_text == LONG and got[2].lost_words == 7


def test_shards_are_jump_hashes_with_gapless_slots(spark, empty):
    rows = spark.range(-500, 1500).select(F.col("id").alias("doc_id"), F.lit(1).alias("shard"))
    got = assign_shards(rows, "doc_id", 7).collect()
    assert all((r["shard_"], r["grown_shard"]) == (jump(r.doc_id, 7), jump(r.doc_id, 8)) for r in got)
    assert all(r["grown_shard"] in (r["shard_"], 7) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard_"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    nulls = assign_shards(empty.sparkSession.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), "doc_id", 3)
    assert sorted(r.slot for r in nulls.collect()) == [0, 1] and assign_shards(empty, "doc_id", 3).count() == 0


def test_tokenizer_equals_the_plain_one():
    own = WordTokenizer(queries.vocabulary())
    texts = [*(t for _, t in TEXTS), "It's I'LL 12²½ éÉßſİΣσ ẞǅ\x85\xa0x ́y «z»​", "<|endoftext|> a", " .'s 'sx"]
    assert own.ids_of(texts) == [own._whole(t) if t else b"" for t in texts]


def test_packing_places_every_id_once(docs, empty):
    plain = WordTokenizer(queries.vocabulary())
    got = pack_documents(docs, queries.vocabulary(), window=64, open_windows=2).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in TEXTS:
        if i == 8:
            continue
        pieces = sorted(by[i], key=lambda r: r.start)
        whole = plain._whole(text or "") + b"\x02\0\0\0"
        assert b"".join(bytes(p.ids) for p in pieces) == whole and pieces[0].doc_tokens == len(whole) // 4
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= 64
    assert pack_documents(empty, queries.vocabulary()).count() == 0


def test_open_windows_take_the_best_fit():
    w = OpenWindows(10, 2)
    assert [w.place(n) for n in (6, 7, 3, 4, 8)] == [(0, 0, None), (1, 0, None), (1, 7, None), (0, 6, None), (2, 0, None)]
    assert [w.place(n) for n in (5, 6)] == [(3, 0, None), (4, 0, 2)]


def brute_repeats(rows, length=50):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        key = i if i is not None else 2**63 - 1
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], key) < key:
                gone[p : p + length] = b"\1" * length
        out[i] = (len(b), bytes(x for x, g in zip(b, gone) if not g), len(re.findall(b"\1+", bytes(gone))))
    return out


def test_repeats_equal_brute_force(spark, docs, empty):
    got = {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.spans)) for r in remove_repeats(docs).collect()}
    assert got == brute_repeats(TEXTS)
    rng = np.random.default_rng(5)
    base = [bytes(rng.integers(97, 100, 300)).decode() for _ in range(4)]
    rows = []
    for k in range(60):
        a, b = rng.integers(0, 4, 2)
        i, j = sorted(rng.integers(0, 300, 2))
        rows.append((k, base[a][i:j] + "|é" * int(rng.integers(0, 3)) + base[b][: int(rng.integers(0, 300))]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.spans)) for r in remove_repeats(df).collect()} == brute_repeats(rows)
    assert remove_repeats(empty).count() == 0


def test_decontamination_equals_brute_force(spark, docs, empty):
    items = [(1, "word3 follows word21. Word4 follows word28. word5 follows word35. word6 follows"), (2, "short"), (3, None), (4, "HEAD two"), (None, "quiet river"), (1, "again")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)):
            if i is not None and w:
                windows[tuple(w[k : k + 10])].add(i)
    for limit in (64 << 20, 300):  # one slice and several
        for r in contaminated_spans(docs, bench, broadcast_bytes=limit).collect():
            w, hit, found = words(r.text), set(), set()
            for key, ids in windows.items():
                for k in range(len(w) - len(key) + 1):
                    if tuple(w[k : k + len(key)]) == key:
                        hit |= set(range(k, k + len(key)))
                        found |= ids
            assert (r.n_words, {s.start + d for s in r.spans for d in range(s.length)}, set(r.item_ids)) == (len(w), hit, found)
    assert contaminated_spans(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    assert contaminated_spans(empty, bench).count() == 0


def test_licenses_are_inherited_from_the_nearest_directory(spark, empty):
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/COPYING.txt", "x\nThis work is licensed under the GNU General Public License, version 3.\ny"),
        ("a/b/c/f.py", "code"), ("a/f.py", None), ("f.py", "code"), ("a/b/g.py", "# Licensed under the Apache License, Version 2.0."),
        ("a/f.py", None), (None, "code"),
    ]
    got = {r.path: (r.license, r.inherited, r.inherited_from) for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/LICENSE"][0] == "MIT" and got["a/b/g.py"][0] == "Apache-2.0" and got["a/b/COPYING.txt"][0] == "GPL-3.0"
    assert got["a/b/c/f.py"] == (None, "GPL-3.0", "a/b/COPYING.txt") and got["a/f.py"] == (None, "MIT", "a/LICENSE")
    assert got["f.py"] == (None, None, None) and got[None] == (None, None, None) and len(got) == 7
    assert scan_licenses(empty.select(F.col("text").alias("path"), "text")).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(spark, docs, empty):
    assert all(fingerprint(t) == plain_fingerprint(t) for _, t in TEXTS)
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3, int(rng.integers(0, 6))))) for k in range(300)]
    rows += [(300 + k, LONG.replace(f"word{k}", "changed")) for k in range(40)]
    fps = {k: plain_fingerprint(t) for k, t in rows}
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash_components(df).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: find(k) for k in fps}
    assert simhash_components(docs).count() == len(TEXTS) and simhash_components(empty).count() == 0


def test_token_files_are_counted_across_blocks(spark, docs, empty, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    files = write_token_files(docs, folder, queries.vocabulary(), 49407)
    plain = WordTokenizer(queries.vocabulary())
    for block in (2, 6, 1 << 20):
        counts = count_tokens(files.select("file", "bytes").distinct(), folder, 49407, block_bytes=block)
        got = files.join(counts, ["file", "ordinal"]).collect()
        assert len(got) == len(TEXTS)
        texts = dict(TEXTS)
        assert all(r.n_tokens == len(plain._whole(texts[r.id] or "")) // 4 for r in got)
    np.array([1, 2, 9, 9, 3], dtype="<u2").tofile(f"{tmp_path}/tokens/open.bin")
    one = spark.createDataFrame([("open.bin", 10)], "file string, bytes long")
    rows = sorted((r.ordinal, r.start, r.n_tokens) for r in count_tokens(one, folder, 9, block_bytes=4).collect())
    assert rows == [(0, 0, 2), (1, 3, 0), (2, 4, 1)]
    assert write_token_files(empty, folder, queries.vocabulary(), 9).count() == 0


def test_line_runs_go_from_later_copies(spark, docs, empty):
    rows = [
        (1, "a b c d\nx y\n\nz w q r\nend one two three four five"),
        (2, "first line of this other text\nx y\nz w q r\nx"),
        (3, "x y\nother\nz w q r"),
        (4, "end one two three four five"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.clean_text, r.removed_lines) for r in drop_repeated_lines(df).collect()}
    assert got == {1: (rows[0][1], []), 2: ("first line of this other text\nx", [1, 2]), 3: (rows[2][1], []), 4: ("", [0])}
    own = {r.doc_id: r.clean_text for r in drop_repeated_lines(docs).collect()}
    assert own[8] == "line a b c d e f\n\nshort" and own[5] is None and own[6] == "" and own[2] == ""
    assert drop_repeated_lines(docs).count() == len(TEXTS) and drop_repeated_lines(empty).count() == 0


def test_toxicity_learns_and_scores_everything(spark, docs):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        toxic = k % 4 == 0
        words = [f"w{x}" for x in rng.integers(0, 200, 30)] + (["grumblefoo", "vile" + "abcdef"[k % 6]] if toxic and k % 28 else [])
        rows.append((k, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    got = score_toxicity(df.select("doc_id", "text"), labels, "doc_id % 5 <> 0").join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in got)
    assert right >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)
    mixed = score_toxicity(docs, labels.limit(0)).collect()
    assert len(mixed) == len(TEXTS) and all(0 <= r["score_"] <= 1 for r in mixed)


def test_label_model_finds_rates_and_dependences():
    """Votes drawn from a known model, voters 0 and 1 one and the same: EM from few labels recovers the classes."""
    rng = np.random.default_rng(4)
    toxic = rng.random(20_000) < 0.2
    hit = np.where(toxic[:, None], rng.random((20_000, 6)) < 0.7, rng.random((20_000, 6)) < 0.1)
    hit[:, 1] = hit[:, 0]
    masks = (hit << np.arange(6)).sum(axis=1)
    few = slice(0, 300)
    known = vote_sums(masks[few], np.ones(300), np.where(toxic[few], 0.95, 0.05), 6)

    def rest(model):
        p = 1 / (1 + np.exp(-model.logit(masks[300:])))
        return vote_sums(masks[300:], np.ones(len(masks) - 300), p, 6)

    model = fit_label_model(known, rest, 0.2, 20)
    assert abs(model.prior - 0.2) < 0.03
    assert 0 in (model.parent[1], *([1] if model.parent[0] == 1 else [])) or model.parent[0] == 1
    child = 1 if model.parent[1] == 0 else 0
    assert (model.rate[:, child, 1] > 0.95).all() and (model.rate[:, child, 0] < 0.05).all()
    assert abs(model.rate[1, 4].mean() - 0.7) < 0.2
    right = ((model.logit(masks) > 0) == toxic).mean()
    votes = np.where(hit, np.log(7.0), np.log(0.3 / 0.9))[:, [0, 2, 3, 4, 5]].sum(axis=1) + np.log(0.25)
    assert right > ((votes > 0) == toxic).mean() - 0.01  # the best rule that knows the model
    assert ToxicityParams().max_labelled == 16_000


def test_pipeline_follows_its_stages(spark, tmp_path):
    import corpus_pipeline

    junk = "home | about | contact | help | next | more\n" * 20
    other = " ".join(f"alpha{k} meets beta{k * 3 % 97}." for k in range(80))
    leak = " ".join(f"gamma{k} sees delta{k * 5 % 89}." for k in range(80))
    rows = [(1, LONG), (2, LONG), (3, junk), (4, other), (5, leak), (6, other.replace("alpha7 ", "omega ")), (7, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(leak.split()[30:45])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert {1, 4} <= kept and not kept & {2, 3, 5, 7}
    plain = WordTokenizer(queries.vocabulary())
    for i in (1, 4):
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == plain._whole(dict(rows)[i]) + b"\x02\0\0\0"
