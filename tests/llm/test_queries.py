"""The registered queries over the whole smallest tables, against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from millrace.llm import queries
from millrace.llm.tokens import WordTokenizer

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def _jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_op2_shards(spark, texts):
    slots = collections.defaultdict(list)
    for r in queries.op2_sharding(spark, FOLDER).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (_jump(r.doc_id, 40), _jump(r.doc_id, 41))
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op4_pieces(spark, texts):
    coder = WordTokenizer(queries.vocabulary())
    ids = {i: np.frombuffer(coder._whole(t or "") + b"\x02\0\0\0", dtype="<u4") for i, t in texts.items()}
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op4_packing(spark, FOLDER).collect():
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert by.keys() == ids.keys()
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        for p in pieces:
            own = ids[i][p.start : p.start + p.length]
            assert len(own) == p.length and zlib.crc32(own.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[i])
        assert sum(p.length for p in pieces) == len(ids[i])
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
    total = sum(map(len, ids.values()))
    assert max(sum(r.length for r in rows) for rows in sequences.values()) <= 4096
    assert len(sequences) * 4096 - total < 4096 * (1 + 2)  # one unfilled window a merge group, of a few groups


def test_op5_removes_what_starts_earlier(spark, texts):
    first, expect = {}, {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(raw, gone) if not g)
        expect[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, FOLDER).collect()}
    assert got == expect and any(n for _, n, _, _ in expect.values())


def test_op8_components(spark, texts):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], dtype=">u8").view(np.uint8)).reshape(-1, 64)
        return int.from_bytes(np.packbits(2 * bits.sum(axis=0) > len(parts)).tobytes(), "big")

    fps = {i: fingerprint(t) for i, t in texts.items()}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_near_dedup(spark, FOLDER).collect()}
    assert got == {i: (f"{fps[i]:016x}", label[i]) for i in fps}


def test_op9_counts(spark, texts):
    coder = WordTokenizer(queries.vocabulary())
    got = {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, FOLDER).collect()}
    assert got == {i: len(coder._whole(t or "")) // 4 for i, t in texts.items()}


def test_op3_scores_every_document(spark, texts):
    got = queries.op3_toxicity(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == texts.keys() and len(got) == len(texts)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op7_reports_statements(spark, texts):
    got = {r.doc_id: r for r in queries.op7_license_scan(spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    plain = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    for i, t in texts.items():
        stated = {name for said, name in plain.items() if said in (t or "")}
        assert not stated or got[i].license in stated
        if not re.search("(?i)licen|copyright|rights reserved|public domain|permission|redistribution|free software|proprietary", t or ""):
            assert got[i].license is None
