from collections import Counter

import numpy as np
import pytest

from revoicer.llm import neardup, quality


def bag(text):
    w = (text or "").encode().split()
    return Counter(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows):
    """Brute force: every pair of texts."""
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    bags = {t: bag(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            common = sum((bags[a] & bags[b]).values())
            total = sum(bags[a].values()) + sum(bags[b].values()) - common
            if total and common >= 0.8 * total:
                parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            k = find(t or "")
            least[k] = min(least.get(k, i), i)
    return sorted((str(i), str(least.get(find(t or "")))) for i, t in rows)


@pytest.mark.parametrize("cell", [512, 3])
def test_near_duplicates(docs, no_docs, corpus, cell, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "STRAYS", 2 if cell == 3 else 512)
    monkeypatch.setattr(neardup, "HEADS", 1 if cell == 3 else 16)
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.near_duplicates(docs).collect())
    assert got == classes([(r[0], r[1]) for r in corpus])
    assert neardup.near_duplicates(no_docs).count() == 0


def test_one_of_each_class_stays(docs, no_docs, corpus):
    kept = neardup.without_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted({c for i, c in classes([(r[0], r[1]) for r in corpus]) if c != "None"} | ({"None"} if any(c == "None" for _, c in classes([(r[0], r[1]) for r in corpus])) else set()))
    assert neardup.without_copies(no_docs).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    names = rng.integers(0, 2**62, 40).astype(np.uint64)
    a, b = rng.integers(1, 50, 40), rng.integers(0, 50, 40)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    shares = []
    for k in range(40):
        h = neardup.mixed(names + np.uint64(k))
        s = neardup.signatures(np.repeat([0, 1], [40, int((b > 0).sum())]), np.concatenate([h, h[b > 0]]), np.concatenate([a, b[b > 0]]), 2)
        shares.append((s[0] == s[1]).mean())
    assert abs(np.mean(shares) - true) < 4 * np.std(shares) / 40**0.5 + 1e-3


def base_of(text):
    """The contract's counts, by hand."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality(docs, no_docs, corpus):
    rows = quality.assess(docs).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = []
    for i, t, *_ in corpus:
        n, *rest = base_of(t or "")
        want.append((str(i), n, *rest, n < 50 or 100 * rest[-1] > 50 * n))
    assert got == sorted(want)
    assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)
    kept = quality.without_rejected(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert quality.assess(no_docs).count() == 0 and quality.without_rejected(no_docs).count() == 0


def test_distance():
    p = np.array([[1.0, 0, 0], [0, 1, 0], [1, 1, 0], [0, 0, 0]])
    d = quality.distance(p, np.array([1.0, 0, 0]))
    assert d[0] == 0 and d[1] == 1 and 0 < d[2] < 1 and d[3] == 0
    assert (quality.distance(p, np.zeros(3)) == 0).all()


def test_symbols_and_odd_case_are_rejected(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(1)
    good = [(i, "The " + prose(rng, 150) + " and the of is in to.", "en") for i in range(60)]
    junk = [(100, " ".join(w + "***" for w in prose(rng, 150).split()), "en"), (101, prose(rng, 150).upper().replace(" ", "!! "), "en")]
    out = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(good + junk, "doc_id long, text string, lang string")).collect()}
    assert not out[100] and not out[101] and all(out[i] for i in range(60))
