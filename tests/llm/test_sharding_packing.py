import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revoicer.llm import packing, sharding
from revoicer.llm.queries import vocabulary


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**9))
def test_permutation(n, seed):
    assert sorted(sharding.permuted_int(i, n, seed) for i in range(n)) == list(range(n))


def test_shards(docs, no_docs, corpus):
    rows = sharding.assign_shards(docs, shards=7).collect()
    n = len(corpus)
    assert len(rows) == n and sorted(r.place for r in rows) == list(range(n)) and sorted(r.row_number for r in rows) == list(range(n))
    counts = [sum(r.shard == s for r in rows) for s in range(7)]
    assert max(counts) - min(counts) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert all((r.shard, r.slot) == sharding.shard_of(r.row_number, n, 7) for r in rows) and all(r.grown_shard is None and r.law == "rows" for r in rows)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    again = {(r.row_number, r.place) for r in sharding.assign_shards(docs.repartition(9), shards=7).collect()}
    assert again == {(r.row_number, r.place) for r in rows}
    assert sharding.assign_shards(no_docs).count() == 0
    assert len({r.shard for r in sharding.assign_shards(docs.limit(3), shards=40).collect()}) == 3


def test_no_python_in_sharding(docs):
    plan = sharding.assign_shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_read_shard(docs):
    own = docs.where("doc_id < 40").dropDuplicates(["doc_id"])
    assigned = sharding.assign_shards(own, shards=3)
    assert sum(sharding.read_shard(assigned, own, s).count() for s in range(3)) == own.count()


def packed_ok(rows, max_len):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    return len(by)


@pytest.mark.parametrize("max_len", [2048, 64])
def test_pack(docs, no_docs, corpus, max_len):
    from tokenizers import Tokenizer

    text = vocabulary("word_bpe_49k.json")
    rows = packing.pack(docs, text, max_len).collect()
    tokenizer = Tokenizer.from_str(text)
    want = []
    for i, t, *_ in corpus:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(str(i), k // max_len, k, len(ids[k : k + max_len]), zlib.crc32(ids[k : k + max_len].tobytes())) for k in range(0, len(ids), max_len)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    n = packed_ok(rows, max_len)
    assert n <= 1.1 * -(-sum(r.length for r in rows) // max_len) + 1
    assert packing.pack(no_docs, text, max_len).count() == 0


def test_sequences_hold_their_ids(docs):
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json"), 256, with_ids=True)
    for r in packing.sequences(rows).collect():
        assert len(r.ids) == sum(s.length for s in r.spans) <= 256
        first = r.spans[0]
        own = rows.where(f"sequence_id = {r.sequence_id} and offset = 0").first() if r.sequence_id == 0 else None
        assert own is None or r.ids[: first.length] == own.ids


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 50), max_size=30))
def test_plan_places_every_piece(histogram):
    plan = packing.Plan(histogram, 128)
    length = np.repeat(list(histogram), list(histogram.values())) if histogram else np.zeros(0, int)
    rank = np.concatenate([np.arange(n) for n in histogram.values()]) if histogram else np.zeros(0, int)
    if len(length):
        sequence, offset = packing.place(plan.rows, length, rank)
        order = np.lexsort((offset, sequence))
        s, o, n = sequence[order], offset[order], length[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        assert (o[new] == 0).all() and (~new[1:] <= (o[1:] == o[:-1] + n[:-1])).all() and (o + n <= 128).all() and s.max() + 1 == plan.sequences


def test_nnls():
    rng = np.random.default_rng(0)
    A, x = rng.random((20, 30)), np.maximum(rng.normal(size=30), 0)
    got = packing.nnls(A, A @ x, tolerance=1e-9)
    assert (got >= 0).all() and np.allclose(A @ got, A @ x, atol=1e-5)
