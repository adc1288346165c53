"""Toxicity of documents: a bidirectional GRU with attention pooling, in numpy.

Each word enters as a word embedding (hashed) beside the mean of the embeddings of
its character n-grams (trigrams, and prefixes of four to six), so unseen words that
share a stem with known ones are recognised. Letters and digits alone count, so
punctuation inside a word hides nothing. The network reads windows of WINDOW words,
STRIDE apart; every window of every whole text is scored, and a document's score is
the calibrated maximum.

Fitting uses a bounded sample of labelled rows (``Sample``), multiple-instance style:
a toxic document is stood for by its highest window, a clean one by its highest and
by random ones. Nothing else is fitted on a sample; scoring covers all text.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_columns

WINDOW, STRIDE = 32, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 15
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
#: Windows that one pass of the network takes at most, and words whose n-grams are held at once.
CHUNK, WORDS = 4096, 1 << 15


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled sample that the network is fitted on."""

    positives: int = 1500
    negatives: int = 3000
    steps: int = 450
    batch: int = 96
    seed: int = 7


# ---- words to vectors -------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word (0: no letter or digit), and its n-gram buckets as
    flat values with a count for each word. Stable over processes."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    low = np.zeros(128, dtype=bool)
    low[[*range(48, 58), *range(97, 123), *range(65, 91)]] = True
    kept = np.where(code < 128, low[np.minimum(code, 127)], ~((code >= 0x2000) & (code < 0x2070)) & (code >= 0xAA))
    code, owner = code[kept].astype(np.uint64), owner[kept]
    length = np.bincount(owner, minlength=len(words))
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    at = np.arange(len(code)) - start[owner]  # place of the character in its word
    value = mixed((code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    whole = mixed(total[start + length] - total[start])
    bucket = np.where(length > 0, whole % np.uint64(WORD_BUCKETS - 1) + np.uint64(1), 0).astype(np.int64)
    # Trigrams of ^word$, then prefixes: each a hash and the word it belongs to.
    edge = lambda shift, mark: np.where((at + shift >= 0) & (at + shift < length[owner]), code[np.clip(np.arange(len(code)) + shift, 0, max(len(code) - 1, 0))], np.uint64(mark))
    tri = mixed(edge(-1, 2) * np.uint64(0x9E3779B1) + edge(0, 0) * np.uint64(0x85EBCA77C2B2) + edge(1, 3) * np.uint64(0xC2B2AE3D27D4EB4F)) if len(code) else np.zeros(0, np.uint64)
    grams, owners = [tri], [owner]
    for k in (4, 5, 6):
        has = np.flatnonzero(length >= k)
        grams.append(mixed(total[start[has] + k] - total[start[has]] + np.uint64(k)))
        owners.append(has)
    grams, owners = np.concatenate(grams) % np.uint64(GRAM_BUCKETS), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return bucket, grams[order].astype(np.int64), np.bincount(owners, minlength=len(words))


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def group_mean(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), values.shape[1]), dtype=np.float32)
    has = counts > 0
    if has.any():
        out[has] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(counts[has])[:-1]]), axis=0) / counts[has, None]
    return out


def many_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_features of a large vocabulary, some words at a time."""
    parts = [word_features(words[i : i + WORDS]) for i in range(0, max(1, len(words)), WORDS)]
    bucket, grams, counts = zip(*parts, strict=True)
    return np.concatenate(bucket), np.concatenate([g.astype(np.int32) for g in grams]), np.concatenate(counts)


def word_vectors(p: dict, bucket: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Some words at a time: the rows of all n-grams of a large vocabulary are many."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    means = [group_mean(p["Ec"][grams[ends[i] : ends[min(i + WORDS, len(counts))]]], counts[i : i + WORDS]) for i in range(0, max(1, len(counts)), WORDS)]
    return np.concatenate([p["Ew"][bucket], np.concatenate(means)], axis=1)


# ---- the network ------------------------------------------------------------


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gru(gates: np.ndarray, U: np.ndarray, mask: np.ndarray, backwards: bool, keep: bool = False):
    """States of one direction, (T, B, H); gates: (T, B, 3H), inputs' part. A masked step keeps the state."""
    steps, batch, h3 = gates.shape
    n = h3 // 3
    h, out, cache = np.zeros((batch, n), dtype=gates.dtype), np.empty((steps, batch, n), dtype=gates.dtype), [None] * steps
    for t in reversed(range(steps)) if backwards else range(steps):
        g = gates[t]
        zr = sigmoid(g[:, : 2 * n] + h @ U[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(g[:, 2 * n :] + (r * h) @ U[:, 2 * n :])
        step = z * mask[t][:, None]
        if keep:
            cache[t] = (h, z, r, c)
        h = h + step * (c - h)
        out[t] = h
    return out, cache


def gru_back(dout: np.ndarray, cache: list, U: np.ndarray, mask: np.ndarray, backwards: bool):
    steps, batch, n = dout.shape
    dgates, dU, dh = np.zeros((steps, batch, 3 * n), dtype=dout.dtype), np.zeros_like(U), np.zeros((batch, n), dtype=dout.dtype)
    for t in range(steps) if backwards else reversed(range(steps)):
        h, z, r, c = cache[t]
        m = mask[t][:, None]
        dh = dh + dout[t]
        dz = dh * (c - h) * m * z * (1 - z)
        dc = dh * z * m * (1 - c * c)
        drh = dc @ U[:, 2 * n :].T
        dr = drh * h * r * (1 - r)
        dgates[t] = np.concatenate([dz, dr, dc], axis=1)
        dU[:, :n] += h.T @ dz
        dU[:, n : 2 * n] += h.T @ dr
        dU[:, 2 * n :] += (r * h).T @ dc
        dh = dh * (1 - z * m) + drh * r + dz @ U[:, :n].T + dr @ U[:, n : 2 * n].T
    return dgates, dU


def head(p: dict, states: np.ndarray, mask: np.ndarray):
    """Attention over the states, then a logit for each window."""
    u = np.tanh(states @ p["Wa"] + p["ba"])
    s = np.where(mask > 0, u @ p["va"], -1e9)
    e = np.exp(s - s.max(axis=0))
    a = e * mask
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", a, states)
    return pooled @ p["wo"] + p["bo"], (u, a, pooled)


def logits(p: dict, gates_f: np.ndarray, gates_b: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """index, mask: (N, T); gates: of each distinct word."""
    out = np.empty(len(index), dtype=np.float32)
    for i in range(0, len(index), CHUNK):
        ix, m = index[i : i + CHUNK].T, mask[i : i + CHUNK].T
        forward, _ = gru(gates_f[ix], p["Uf"], m, False)
        back, _ = gru(gates_b[ix], p["Ub"], m, True)
        out[i : i + CHUNK] = head(p, np.concatenate([forward, back], axis=2), m)[0]
    return out


def loss_gradient(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Mean log loss, gradients of the dense parameters and of the inputs x (T, B, D)."""
    forward, cf = gru(x @ p["Wf"] + p["bf"], p["Uf"], mask, False, True)
    back, cb = gru(x @ p["Wb"] + p["bb"], p["Ub"], mask, True, True)
    states = np.concatenate([forward, back], axis=2)
    z, (u, a, pooled) = head(p, states, mask)
    q = sigmoid(z)
    dz = ((q - y) / len(y)).astype(np.float32)
    g = {"wo": pooled.T @ dz, "bo": dz.sum(keepdims=True)}
    dpooled = dz[:, None] * p["wo"][None]
    da = np.einsum("bh,tbh->tb", dpooled, states)
    ds = a * (da - (a * da).sum(axis=0))
    du = ds[:, :, None] * p["va"] * (1 - u * u)
    g |= {"va": np.einsum("tb,tba->a", ds, u), "Wa": np.einsum("tbh,tba->ha", states, du), "ba": du.sum(axis=(0, 1))}
    dstates = a[:, :, None] * dpooled + du @ p["Wa"].T
    n = p["Uf"].shape[0]
    dgf, g["Uf"] = gru_back(dstates[:, :, :n], cf, p["Uf"], mask, False)
    dgb, g["Ub"] = gru_back(dstates[:, :, n:], cb, p["Ub"], mask, True)
    for k, d in (("f", dgf), ("b", dgb)):
        g["W" + k], g["b" + k] = np.einsum("tbd,tbg->dg", x, d), d.sum(axis=(0, 1))
    loss = -np.mean(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))
    return float(loss), g, dgf @ p["Wf"].T + dgb @ p["Wb"].T


def fresh(rng: np.random.Generator) -> dict:
    d, h = WORD_DIM + GRAM_DIM, HIDDEN
    r = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
    return {
        "Ew": r(WORD_BUCKETS, WORD_DIM, scale=0.05), "Ec": r(GRAM_BUCKETS, GRAM_DIM, scale=0.05),
        "Wf": r(d, 3 * h), "Wb": r(d, 3 * h), "Uf": r(h, 3 * h), "Ub": r(h, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
        "Wa": r(2 * h, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": r(ATTENTION), "wo": r(2 * h), "bo": np.zeros(1, np.float32),
    }


# ---- windows ----------------------------------------------------------------


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts of the given word counts that lie one after the
    other: place of each word (N, WINDOW), mask, and the text of each window. The last
    window of a text ends with it; a text without a word has none."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(nth * STRIDE, np.maximum(sizes[owner] - WINDOW, 0))
    place = first[:, None] + np.arange(WINDOW)[None]
    mask = place < sizes[owner][:, None]
    base = (np.cumsum(sizes) - sizes)[owner]
    return np.where(mask, place + base[:, None], 0), mask.astype(np.float32), owner


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word numbers of all texts, word counts, and the distinct words."""
    known: dict[str, int] = {}
    put, flat, sizes = known.setdefault, array("q"), []
    for x in texts:  # text by text: of its words only new ones stay
        words = x.lower().split()
        sizes.append(len(words))
        flat.extend([put(w, len(known)) for w in words])
    return np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64), list(known)


def highest(p: dict, texts: list[str]) -> np.ndarray:
    """The greatest logit of each whole text's windows; -inf for a text without words."""
    flat, sizes, vocab = coded(texts)
    top = np.full(len(texts), -np.inf)
    if len(flat):
        x = word_vectors(p, *word_features(vocab))
        place, mask, owner = windows(sizes)
        np.maximum.at(top, owner, logits(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], flat[place], mask).astype(float))
    return top


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    """A score in [0, 1] for each whole text; a text without words gets the prior."""
    if model["p"] is None:
        return np.full(len(texts), model["prior"])
    top = highest(model["p"], texts)
    a, b = model["scale"]
    return np.where(np.isfinite(top), sigmoid(a * np.where(np.isfinite(top), top, 0) + b), model["prior"])


# ---- fitting ----------------------------------------------------------------


def fit_texts(rows: list[tuple[list[str], int]], sample: Sample = Sample(), weight: tuple[float, float] = (1.0, 1.0)) -> dict:
    """A model from documents given as (window texts, label); weight: how many documents
    one of each label stands for, in the prior and the calibration."""
    y = np.array([label for _, label in rows], dtype=np.float32)
    share = np.array(weight)[y.astype(int)]
    prior = float((share * y).sum() / share.sum()) if len(y) else 0.0
    if not len(y) or prior in (0.0, 1.0):
        return {"p": None, "prior": prior, "scale": (1.0, 0.0)}
    rng = np.random.default_rng(sample.seed)
    p = fresh(rng)
    pieces = [w for ws, _ in rows for w in ws]
    doc = np.repeat(np.arange(len(rows)), [len(ws) for ws, _ in rows])
    flat, sizes, vocab = coded(pieces)
    bucket, grams, counts = many_features(vocab)
    place, mask, owner = windows(sizes)
    if not len(owner):
        return {"p": None, "prior": prior, "scale": (1.0, 0.0)}
    index, of = flat.astype(np.int32)[place], doc[owner]
    del place, pieces
    offset = np.cumsum(counts) - counts
    # The first number of each embedding starts at the log odds of its documents.
    seen = {"Ew": np.zeros((2, WORD_BUCKETS)), "Ec": np.zeros((2, GRAM_BUCKETS))}
    edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(ws) for ws, _ in rows])])]
    for d, label in enumerate(y.astype(int)):  # document by document: no table of all n-grams
        own = np.unique(flat[edges[d] : edges[d + 1]])
        seen["Ew"][label, np.unique(bucket[own])] += 1
        seen["Ec"][label, np.unique(grams[spans(offset[own], counts[own])])] += 1
    for name, (neg, pos) in seen.items():
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
        p[name][:, 0] = np.where(pos + neg >= 2, np.clip(odds, -3, 3) / 2, 0)
    p["Ew"][0] = 0
    first = word_vectors(p, bucket, grams, counts)
    z = (np.where(mask > 0, (first[:, 0] + first[:, WORD_DIM])[index], -9)).max(axis=1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    positives, negatives = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    by_doc = np.argsort(of, kind="stable")
    n_of = np.bincount(of, minlength=len(rows))
    at = np.cumsum(n_of) - n_of
    positives, negatives = positives[n_of[positives] > 0], negatives[n_of[negatives] > 0]
    best = lambda: by_doc[np.lexsort((z[by_doc], of[by_doc]))[np.cumsum(n_of)[n_of > 0] - 1]]
    top = dict(zip(np.flatnonzero(n_of), best(), strict=True))
    for step in range(1, sample.steps + 1):
        if step % max(1, sample.steps // 6) == 0:
            x = word_vectors(p, bucket, grams, counts)
            z = logits(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], index, mask)
            top = dict(zip(np.flatnonzero(n_of), best(), strict=True))
        if not len(positives) or not len(negatives):
            break
        third = sample.batch // 3
        pick_p, pick_n, pick_r = rng.choice(positives, third), rng.choice(negatives, third), rng.choice(negatives, third)
        rows_w = np.array([top[d] for d in pick_p] + [top[d] for d in pick_n] + [by_doc[at[d] + rng.integers(n_of[d])] for d in pick_r])
        target = np.concatenate([np.ones(third), np.zeros(2 * third)]).astype(np.float32)
        ix, m = index[rows_w].T, mask[rows_w].T
        used, inverse = np.unique(ix, return_inverse=True)
        c = counts[used]
        g_rep = np.repeat(np.arange(len(used)), c)
        g_at = grams[spans(offset[used], c)]
        x = word_vectors(p, bucket[used], g_at, c)
        _, grad, dx = loss_gradient(p, x[inverse.reshape(ix.shape)], m, target)
        dword = np.zeros((len(used), x.shape[1]), dtype=np.float32)
        np.add.at(dword, inverse.reshape(-1), dx.reshape(-1, x.shape[1]))
        grad["Ew"], grad["Ec"] = np.zeros_like(p["Ew"]), np.zeros_like(p["Ec"])
        np.add.at(grad["Ew"], bucket[used], dword[:, :WORD_DIM])
        np.add.at(grad["Ec"], g_at, (dword[:, WORD_DIM:] / np.maximum(c, 1)[:, None])[g_rep])
        grad["Ew"][0] = 0
        for k, v in p.items():
            m1, m2 = state[k]
            m1 += 0.1 * (grad[k] - m1)
            m2 += 0.001 * (grad[k] ** 2 - m2)
            rate = 0.01 * (1 - step / (sample.steps + 1))
            v -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    x = word_vectors(p, bucket, grams, counts)
    z = logits(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], index, mask)
    high = np.full(len(rows), -np.inf)
    np.maximum.at(high, of, z.astype(float))
    return {"p": p, "prior": prior, "scale": calibrated(high[np.isfinite(high)], y[np.isfinite(high)], share[np.isfinite(high)])}


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and shift of a logistic curve from maximum logit to label, by Newton steps."""
    weight = np.broadcast_to(weight, z.shape)
    w, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        q = sigmoid(x @ w)
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (weight * (q - y)) + 1e-2 * (w - [1, 0])), -2, 2)
    return max(float(w[0]), 0.05), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), held_out_mod: int = 5) -> dict:
    """Fit on labelled documents whose crc32(doc_id) % held_out_mod is not 0.

    Labels of one id are merged by their maximum; null labels don't count. Of each
    class the rows with the least hash of their id are taken, up to Sample's bounds:
    that bound, not the table, is what reaches the driver. Where a bound leaves rows out,
    those of the sample stand for them in the prior and the calibration, so class shares
    are those of all labels; the calibration sees every window of the sampled texts, as
    scoring does.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__label"))
    known = known.where(F.crc32(F.col("__id").cast("string")) % held_out_mod != 0)
    found = {r["__label"]: r["count"] for r in known.where("__label in (0, 1)").groupBy("__label").count().collect()}
    weight = tuple(found.get(label, 0) / max(1, min(found.get(label, 0), most)) for label, most in ((0, sample.negatives), (1, sample.positives)))
    order = F.xxhash64("__id")
    ids = known.where("__label = 1").orderBy(order, "__id").limit(sample.positives).unionByName(known.where("__label = 0").orderBy(order, "__id").limit(sample.negatives))
    # At most positives + negatives ids: safe to broadcast at any size of the tables.
    rows = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("__doc") == F.col("__id"))

    def cut(batch, texts):
        out = []
        for raw in texts:
            words = raw.decode("utf-8", "replace").split()
            out.append("\n".join(" ".join(words[i : i + WINDOW]) for i in range(0, max(1, len(words)), WINDOW)))
        return {"cut": out}

    got = with_columns(rows, cut, "cut string", keep=["__doc", "__label"]).collect()
    got = sorted({(r["__doc"], r["cut"], r["__label"]) for r in got})
    model = fit_texts([(c.split("\n"), label) for _, c, label in got], sample, weight)
    if model["p"] is None:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model["p"])

    def tops(batch, texts):
        return {"top": highest(shared.value, [t.decode("utf-8", "replace") for t in texts])}

    whole = with_columns(rows, tops, "top double", keep=["__doc", "__label"]).collect()
    high, y = np.array(sorted({(r["__doc"], r["top"], r["__label"]) for r in whole if np.isfinite(r["top"])})).reshape(-1, 3)[:, 1:].T
    return model | {"scale": calibrated(high, y, np.array(weight)[y.astype(int)])}


def score(docs: DataFrame, model: dict, keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score of each whole text as column ``name``.

    Edge cases: null and empty texts, and texts without a word, get the share of
    positives in the sample; repeated rows get equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the data

    def run(batch, texts):
        return {name: score_texts(shared.value, [t.decode("utf-8", "replace") for t in texts])}

    return with_columns(docs, run, f"`{name}` double", keep)


def classify(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(plain, fit(docs, labels, sample), keep=["doc_id"], name="score")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """The documents whose score is under 0.5, with their columns as they were."""
    model = fit(docs, labels, sample)
    return score(docs, model, name="__toxicity").where("__toxicity < 0.5").drop("__toxicity")


