import math
import zlib
from collections import Counter

import numpy as np
import pytest

from revoicer.llm import class_lm, sentencepieces, toxicity
from tests.llm.conftest import prose


# ---- toxicity ---------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in toxicity.fresh(rng).items()}
    x, mask, y = rng.normal(size=(5, 3, 16)), np.ones((5, 3)), np.array([1.0, 0, 1])
    mask[3:, 1] = 0
    _, g, dx = toxicity.loss_gradient(p, x, mask, y)
    for k in ("Wf", "Wb", "Uf", "Ub", "bf", "bb", "Wa", "ba", "va", "wo", "bo"):
        at = tuple(rng.integers(n) for n in p[k].shape)
        old, e = p[k][at], 1e-5
        p[k][at] = old + e
        up = toxicity.loss_gradient(p, x, mask, y)[0]
        p[k][at] = old - e
        down = toxicity.loss_gradient(p, x, mask, y)[0]
        p[k][at] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][at], abs=1e-6)
    assert dx.shape == x.shape and np.abs(dx[3:, 1]).max() == 0


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 100, 1000):
        place, mask, owner = toxicity.windows(np.array([n, 7]))
        own = owner == 0
        assert set(place[own][mask[own] > 0]) == set(range(n)) and set(place[~own][mask[~own] > 0]) == set(range(n, n + 7))


def labelled(n, seed):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["dolt", "Dolt!", "vermin", "vermin-like"])
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_learns_and_scores_every_row(spark, docs, no_docs, corpus):
    rows = labelled(400, 1)
    d = spark.createDataFrame([(1000 + i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(1000 + i, 1, y) for i, (_, y) in enumerate(rows)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    sample = toxicity.Sample(steps=120)
    out = toxicity.classify(d, labels, sample).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == rows[r.doc_id - 1000][1] for r in held) >= 0.95 * len(held)
    scored = toxicity.classify(docs, labels, sample).collect()
    assert len(scored) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    model = toxicity.fit(docs, labels)
    assert model["p"] is None  # no labelled document: the prior alone
    assert toxicity.classify(no_docs, labels).count() == 0
    kept = toxicity.without_toxic(d.withColumn("toxicity", d.doc_id), labels, sample)
    assert kept.columns == ["doc_id", "text", "toxicity"] and kept.count() == sum(r.predicted == 0 for r in out)


def test_unseen_forms_and_late_words():
    model = toxicity.fit_texts([([t], y) for t, y in labelled(400, 2)], toxicity.Sample(steps=200))
    clean = prose(__import__("random").Random(9), 3000)
    late = clean + " vermin dolt, vermin"
    a, b, empty = toxicity.score_texts(model, [clean, late, ""])
    assert b > 0.5 > a and empty == pytest.approx(model["prior"])


# ---- class-based model ------------------------------------------------------


def test_exchange_never_loses_likelihood():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 4, (40, 40)) + 20 * np.kron(np.eye(2), np.ones((20, 20))).astype(int)
    own, likelihood = class_lm.exchange(n, classes=4, sweeps=6)
    assert all(b >= a - 1e-6 for a, b in zip(likelihood, likelihood[1:])) and own[-1] == 0 and (own[:-1] > 0).all()
    start = np.zeros((40, 4))
    start[np.arange(40), np.concatenate([1 + np.arange(39) % 3, [0]])] = 1
    grid = start.T @ n @ start
    first = class_lm.xlogx(grid).sum() - class_lm.xlogx(grid.sum(axis=1)).sum() - class_lm.xlogx(grid.sum(axis=0)).sum()
    assert likelihood[-1] > first


def test_language_model(docs, no_docs, corpus):
    import re

    rows = class_lm.score(docs).collect()
    assert len(rows) == len(corpus)
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", fold(t or "")) + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in corpus if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t, *_ in corpus)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=1e-3) for a, b in zip(got, want))
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert class_lm.score(no_docs).count() == 0


def test_score_by_plain_counting(docs, corpus):
    """The model's score from its classes alone: transitions and shares counted by hand."""
    rows = {(r.doc_id, round(r.score, 4)) for r in class_lm.score(docs).collect()}
    _, tail, _, m = class_lm.fit(class_lm.ids_and_text(docs))
    single = {bytes(r.word): r.cls for r in tail.collect()}
    assert single and not single.keys() & m["units"].keys()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    pool = lambda w: int(m["own"][m["units"][w] if w in m["units"] else len(m["units"]) + zlib.crc32(w[-3:]) % class_lm.POOLS])
    cls = lambda w: single.get(w, pool(w))
    texts = [(i, (t or "").encode().lower().split()) for i, t, *_ in corpus]
    train = [ws for i, ws in texts if not held(i)]
    c = Counter(w for ws in train for w in ws)
    grid, tokens, words = Counter(), Counter(), Counter(cls(w) for w in c)
    for ws in train:
        chain = [0, *map(cls, ws), 0]
        grid.update(zip(chain, chain[1:]))
        tokens.update(chain[1:])
    total, k = sum(grid.values()), class_lm.CLASSES
    share = [sum(grid[a, b] for a in range(k)) + 1e-6 * total for b in range(k)]

    def move(a, b):
        own, before = share[b] / sum(share), sum(grid[a, x] for x in range(k))
        return class_lm.MIXED * own + (1 - class_lm.MIXED) * grid[a, b] / before if before else own

    def score(ws):
        chain = [0, *map(cls, ws), 0]
        return sum(math.log10(move(a, b)) for a, b in zip(chain, chain[1:])) + sum(math.log10((c[w] + 1) / (tokens[cls(w)] + words[cls(w)] + 1)) for w in ws)

    some = [(i, ws) for i, ws in texts if len(ws) < 420]
    assert {(i, round(score(ws), 4)) for i, ws in some} <= rows
    for x in range(k):  # what may follow a class, and what a class may say, known or not
        assert math.isclose(sum(move(x, y) for y in range(k)), 1) and math.isclose(sum((c[w] + 1) for w in c if cls(w) == x) + 1, tokens[x] * (x > 0) + words[x] + 1)


def test_class_model_gains_on_held_out_text(spark):
    import random

    rng = random.Random(8)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    texts = [" ".join(rng.choice((nouns, verbs)[j % 2]) for j in range(60)) for _ in range(300)]
    rows = class_lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows) + 10 * len(rows)


def test_rarer_words_leave_their_pool(spark, monkeypatch):
    """Nouns and verbs that share one pool part by their neighbours, counted by hand."""
    import random

    monkeypatch.setattr(class_lm, "UNITS", 40)
    rng = random.Random(9)
    common = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    rare = [f"n{i}end" for i in range(40)], [f"v{i}end" for i in range(40)]
    texts = [" ".join(rng.choice((common if rng.random() < 0.9 else rare)[j % 2]) for j in range(60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    _, tail, _, m = class_lm.fit(docs)
    found = {bytes(r.word).decode(): (r.c, r.cls) for r in tail.collect()}
    train = [t.split() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    assert {w: n for w, (n, _) in found.items()} == {w: n for w, n in c.items() if w.encode() not in m["units"]}
    assert not {k for w, (_, k) in found.items() if w[0] == "n"} & {k for w, (_, k) in found.items() if w[0] == "v"}
    size = class_lm.CLASSES
    pool = lambda w: int(m["own"][m["units"][w.encode()] if w.encode() in m["units"] else len(m["units"]) + zlib.crc32(w.encode()[-3:]) % class_lm.POOLS])
    grid, near = np.zeros((size, size)), {w: np.zeros(2 * size) for w in found}
    for ws in train:
        chain = [0, *map(pool, ws), 0]
        for a, b in zip(chain, chain[1:]):
            grid[a, b] += 1
        for w, a, b in zip(ws, chain, chain[2:]):
            if w in near:
                near[w][a] += 1
                near[w][size + b] += 1
    for w, (_, k) in found.items():
        assert class_lm.best_class(near[w][None], grid)[0] == k


# ---- pieces -----------------------------------------------------------------


def model_bytes(unigram=False):
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    if not unigram:
        return data
    proto = pb.ModelProto()
    proto.ParseFromString(data)
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):  # scores of a kind that sums make sense of, without ties
        if p.type == p.NORMAL:
            p.score = -8.0 - 0.9 * abs(math.sin(i)) * 3 - i * 1e-7 + 1.5 * len(p.piece)
    return proto.SerializeToString()


def test_pieces_equal_the_library(docs, no_docs, corpus):
    import sentencepiece

    data = model_bytes()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rows = sentencepieces.encode(docs, data)
    got = sorted(((str(r.doc_id), list(r.ids)) for r in rows.collect()), key=str)
    assert got == sorted(((str(i), library.encode(t or "")) for i, t, *_ in corpus), key=str)
    assert all(r.round_trip and r.decoded_crc32 == r.text_crc32 == zlib.crc32(b"") or r.round_trip for r in rows.collect())
    back = sorted(((str(r.doc_id), r.text) for r in sentencepieces.decode(rows, data).collect()), key=str)
    assert back == sorted(((str(i), t or "") for i, t, *_ in corpus), key=str)
    assert sentencepieces.encode(no_docs, data).count() == 0


def test_viterbi_for_unigram_models(spark):
    import random

    import sentencepiece

    data = model_bytes(unigram=True)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepieces.load(data)
    rng = random.Random(3)
    texts = [prose(rng, 12) for _ in range(15)] + ["hello world", "日本 x"]
    rows = sentencepieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), data).collect()
    score = lambda ids: sum(next((s for s, i in [model.pieces[library.id_to_piece(x)]]), 0) if library.id_to_piece(x) in model.pieces else 0 for x in ids)
    for r in rows:
        assert r.round_trip and score(list(r.ids)) >= score(library.encode(texts[r.doc_id])) - 1e-3


def plain_code(word, model):
    """Ids of a word by the rules alone: merge by merge, or the best sum of scores."""
    if model.kind == "bpe":
        parts = list(word)
        while hits := [(-model.pieces[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.pieces]:
            i = min(hits)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    else:
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            best.append(max((best[i][0] + (model.pieces[word[i:j]][0] if word[i:j] in model.pieces else model.unknown_score), i) for i in range(max(0, j - model.longest), j) if word[i:j] in model.pieces or j - i == 1))
        parts, j = [], len(word)
        while j:
            parts.insert(0, word[best[j][1] : j])
            j = best[j][1]
    return [i for p in parts for i in ([model.pieces[p][1]] if p in model.pieces else [model.bytes_[b] for b in p.encode()])]


def test_folds_follow_the_rules(spark):
    import random

    rng = random.Random(4)
    for data in (model_bytes(), model_bytes(unigram=True)):
        model = sentencepieces.load(data)
        words = {sentencepieces.SPACE + w for w in prose(rng, 60).split()} | {"ü日", "...", "▁▁▁", "日" * 3}
        pieces = list(model.pieces)
        # Words of pieces' ends put together meet passed-over edges; some are longer than one mask.
        words |= {"".join(rng.choice(pieces)[-rng.randint(1, 6) :] for _ in range(n)) for n in [2, 3, 4] * 60 + [20, 30, 60] * 5}
        words |= {"a" * n for n in (59, 60, 61, 64, 65, 200)} | {"ab" * 40 + "日" + "=" * 70}
        rows = spark.createDataFrame([(w, None, None) for w in sorted(words)], "word string, block long, members binary")
        out = sentencepieces.coded(rows, model).collect()
        assert {r.word: list(r.ids) for r in out} == {w: plain_code(w, model) for w in words}


def test_order_of_merges_that_one_pass_would_miss(spark):
    """abc outranks bc, its own half: it fits only once bc is joined."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model_bytes())
    for p in [p for p in proto.pieces if p.type == p.NORMAL and len(p.piece) > 1]:
        proto.pieces.remove(p)
    for k, piece in enumerate(["abc", "xabc", "bc", "cd", "ca", "cab", "xabcd"]):
        proto.pieces.add(piece=piece, score=-float(k))
    model = sentencepieces.load(proto.SerializeToString())
    words = ["abc", "xabc", "abcd", "xabcd", "bcabcab", "cabc", "xabcd" * 20, "cab" * 30 + "d"]
    out = sentencepieces.coded(spark.createDataFrame([(w, None, None) for w in words], "word string, block long, members binary"), model).collect()
    assert {r.word: list(r.ids) for r in out} == {w: plain_code(w, model) for w in words}


def test_words_of_texts_are_those_of_their_distinct_tokens():
    import re

    model = sentencepieces.load(model_bytes())
    find = re.compile(model.pattern).findall
    odd = ["", " ", "  a", "a  b", "a ", "▁", "a▁ b", "▁▁ x▁y", "\n \n", "é日² ²", "x.\ny 12a"]
    texts = [x.encode() for x in odd] + [b"\xff a\xe2\x96 b", b"\xe3\x81 \xe3\x81", b"one two, one " * 3000]
    for prefix in (True, False):
        model.prefix = prefix
        own = sentencepieces.spelt(texts, model)
        words, ends = own.words.to_pylist(), np.concatenate([[0], np.cumsum(own.counts)])
        got = [[words[w] for t in own.token[a:b] for w in own.word[own.first[t] : own.first[t] + own.size[t]]] for a, b in zip(ends[:-1], ends[1:])]
        assert got == [find(sentencepieces.marked(t.decode("utf-8", "replace"), model)) for t in texts]
        assert len(set(words)) == len(words)
        assert len(own.first) < 40 and len(own.word) < 60  # what the pattern searched: not the 9000 words of the last text


def test_edges_reach_python_in_two_columns_and_in_order(spark):
    import pyarrow as pa

    model = sentencepieces.load(model_bytes())
    rows = sentencepieces.lattice(spark.createDataFrame([("▁the", None, None), (None, 1, bytearray(b"m"))], "word string, block long, members binary"), model)
    assert rows._jdf.queryExecution().analyzed().child().output().size() == 2
    assert [(r.word, r.n, r.members) for r in rows.collect()] == [("▁the", 4, None), (None, None, bytearray(b"m"))]

    table = sentencepieces.Pieces.of(model)
    arrow = pa.schema([*sentencepieces.BPE_EDGES.items(), *sentencepieces.CARRIED.items()])
    bits, a = sentencepieces.PLACE + sentencepieces.PIECE, table.texts.index("a") << sentencepieces.PLACE

    def words_of(turns):
        batches = [pa.record_batch({"edge": pa.array([t << bits | a]), "carried": pa.array([b"a"])}) for t in turns]
        return [w for x in sentencepieces.grouped(batches, table, sentencepieces.bpe_edges, arrow) for w in x["word"].to_pylist()]

    last = (1 << sentencepieces.TURN) - 1
    assert words_of([last - 1, last, 0, 1]) == ["a"] * 4  # the count goes round
    for turns in ([0, 2], [1, 0], [0, 1, 0]):
        with pytest.raises(RuntimeError):
            words_of(turns)
