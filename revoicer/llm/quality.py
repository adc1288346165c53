"""Quality rules: base counts of a text, and the distance of its distributions from its
language's.

For every document two histograms are made: shares of character classes, and shares
of the common words of its language (and of all other words). Each is held against the
reference of the document's language by the Jensen-Shannon distance (base 2, so in
[0, 1]); a histogram with too few observations is not judged (minimum-length guards).

References are sums over every document of the language that passes the base rules;
languages without a word list share one reference. The number of references is fixed
by the word lists, so the table of them is small at any size of the input.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lists, map_slices, materialise, with_columns

#: Common function words by language code.
COMMON_WORDS = {
    "de": "auf das dem den der des die ein eine er es für ich im in ist mit nicht sich sie sind und von war wie zu".split(),
    "en": "a and are as at be but by for from he in is it not of on or that the they this to was were with you".split(),
    "es": "al como con de del el en es esta la las lo los más mi no para pero por que se su sus un una y".split(),
    "fr": "au avec ce dans de des du elle en est et il la le les mais ne par pas pour que qui se son sur un une".split(),
}
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "exclamation", "symbol", "bracket", "other")


@dataclass(frozen=True)
class Limits:
    """Production parameters: greatest distances, and least observations to judge by."""

    char_distance: float = 0.29
    word_distance: float = 0.17
    word_allowance: float = 1.4  # over the square root of n_words: what sampling alone adds to a short text's distance
    min_chars: int = 200
    min_words: int = 50  # as the base rule: the allowance alone protects short texts
    min_reference: int = 2000  # words that a reference needs before it judges at all


def class_table() -> np.ndarray:
    """Class of each ASCII code; letters beyond ASCII are told by case apart."""
    out = np.full(128, CLASSES.index("other"), dtype=np.int64)
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\x0b\x0c\r"), ("newline", "\n"), ("stop", ".,;:?'\"-"), ("exclamation", "!"), ("symbol", SYMBOLS), ("bracket", "()[]{}")):
        out[[ord(c) for c in chars]] = CLASSES.index(name)
    return out


TABLE = class_table()


def histogram(text: str, raw: bytes) -> np.ndarray:
    """Counts of character classes (code points)."""
    data = np.frombuffer(raw, dtype=np.uint8)
    plain = np.bincount(data, minlength=256)
    out = np.bincount(TABLE, weights=plain[:128], minlength=len(CLASSES)).astype(np.int64)
    beyond = len(text) - int(plain[:128].sum())
    if beyond:
        upper = sum(n for c, n in Counter(text).items() if ord(c) > 127 and c.isupper())
        lower = sum(n for c, n in Counter(text).items() if ord(c) > 127 and c.isalpha() and not c.isupper())
        out[CLASSES.index("upper")] += upper
        out[CLASSES.index("lower")] += lower
        out[CLASSES.index("other")] += beyond - upper - lower
    return out


def base_counts(text: str, raw: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, and word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = raw.split()
    white = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated, distinct = 0, Counter(triples)
    if len(distinct) < len(triples):
        hit = np.fromiter((distinct[t] > 1 for t in triples), dtype=bool, count=len(triples))
        cover = np.zeros(len(words), dtype=bool)
        for k in range(3):
            cover[k : k + len(hit)] |= hit
        repeated = int(cover.sum())
    return words, len(text) - white, symbols, len(lines) - len(set(lines)), repeated


BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
MORE = f"{BASE}, char_hist array<bigint>, word_hist array<bigint>"
WIDTH = max(len(x) for x in COMMON_WORDS.values()) + 1


def features(langs: list, texts: list[bytes]) -> dict:
    rows, chars, common = [], np.zeros((len(texts), len(CLASSES)), np.int64), np.zeros((len(texts), WIDTH), np.int64)
    places = {k: {w.encode(): i for i, w in enumerate(v)} for k, v in COMMON_WORDS.items()}
    for i, (lang, raw) in enumerate(zip(langs, texts, strict=True)):
        text = raw.decode("utf-8", "replace")
        words, *counts = base_counts(text, raw)
        rows.append((len(words), *counts))
        chars[i] = histogram(text, raw)
        if found := places.get(lang):
            seen = Counter(text.lower().encode().translate(None, b".,;:?!\"'()[]{}*#$%&|<>").split())
            for w, at in found.items():
                common[i, at] = seen.get(w, 0)
        common[i, -1] = len(words) - common[i, :-1].sum()
    table = np.array(rows, dtype=np.int64).reshape(len(texts), 5)
    size = lambda m: lists(m.ravel(), np.full(len(m), m.shape[1]), pa.int64())
    return {name: table[:, k] for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))} | {"char_hist": size(chars), "word_hist": size(common)}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def reference_lang(lang: Column) -> Column:
    """The reference's name: a language with a word list, or one for all others."""
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("other"))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of p from q (counts); 0 where either is empty."""
    n, m = p.sum(axis=1, keepdims=True), q.sum()
    if m == 0:
        return np.zeros(len(p))
    p, q = p / np.maximum(n, 1), (q / m)[None]
    mid = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(mid > 0, mid, 1)), 0).sum(axis=1)
    return np.where(n[:, 0] > 0, np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1)), 0.0)


def references(measured: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Summed histograms for each reference (at most one row per word list and one more)."""
    good = measured.where(~base_failed())
    aggs = [F.sum(F.col("char_hist")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("word_hist")[i]).alias(f"w{i}") for i in range(WIDTH)]
    rows = good.groupBy(reference_lang(F.col("lang")).alias("ref")).agg(*aggs).collect()
    return {r["ref"]: (np.array([r[f"c{i}"] for i in range(len(CLASSES))], float), np.array([r[f"w{i}"] for i in range(WIDTH)], float)) for r in rows}


def verdicts(langs: list, n_words: np.ndarray, failed: np.ndarray, chars: np.ndarray, common: np.ndarray, refs: dict, limits: Limits) -> dict:
    char_d, word_d = np.zeros(len(langs)), np.zeros(len(langs))
    names = np.array([x if x in COMMON_WORDS else "other" for x in langs], dtype=object)
    for ref, (c, w) in refs.items():
        at = np.flatnonzero(names == ref)
        if len(at) and w.sum() >= limits.min_reference:
            char_d[at] = distance(chars[at], c)
            if ref in COMMON_WORDS:
                word_d[at] = distance(common[at], w)
    judged_c, judged_w = chars.sum(axis=1) >= limits.min_chars, n_words >= limits.min_words
    bad = failed | (judged_c & (char_d > limits.char_distance)) | (judged_w & (word_d > limits.word_distance + limits.word_allowance / np.sqrt(np.maximum(n_words, 1))))
    return {"char_distance": char_d, "word_distance": word_d, "kept": ~bad}


def decide(measured: DataFrame, limits: Limits = Limits(), keep: list[str] | None = None) -> DataFrame:
    """``measured`` (see :func:`measure`) with base_failed, the two distances and kept."""
    refs = references(measured)
    keep = keep or [c for c in measured.columns if c not in ("char_hist", "word_hist")]
    flagged = measured.withColumn("base_failed", base_failed()).withColumn("__none", F.lit(""))

    def run(batch, _):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        grid = lambda name, n: np.asarray(get(name).flatten(), dtype=float).reshape(-1, n)
        langs = get("lang").to_pylist()
        return verdicts(langs, np.asarray(get("n_words")), np.asarray(get("base_failed").to_numpy(zero_copy_only=False)), grid("char_hist", len(CLASSES)), grid("word_hist", WIDTH), refs, limits)

    return with_columns(flagged, run, "char_distance double, word_distance double, kept boolean", [*keep, "base_failed"], text="__none")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and both histograms of every whole text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    run = lambda batch, texts: {"doc_id": batch.column(0), "lang": batch.column(1), **features(batch.column(1).to_pylist(), texts)}
    return map_slices(plain, run, f"doc_id bigint, lang string, {MORE}")


def assess(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, distances, kept.

    Edge cases: a null or empty text has no word, so it fails the base rules; a null or
    unlisted language uses the shared reference, without a word list; documents under
    the guards are judged by the base rules alone; an empty table gives no rows.
    """
    out = decide(materialise(measure(docs), "quality"), limits)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def without_rejected(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that are kept, with their columns as they were. Two passes over the
    texts: one for the references, one that decides row by row; no join, no shuffle of text."""
    refs = references(materialise(measure(docs), "quality"))

    def run(batch, texts):
        langs = batch.column(batch.schema.get_field_index("__lang")).to_pylist()
        f = features(langs, texts)
        failed = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
        grid = lambda name, n: np.asarray(f[name].flatten(), dtype=float).reshape(-1, n)
        return {"__kept": verdicts(langs, f["n_words"], failed, grid("char_hist", len(CLASSES)), grid("word_hist", WIDTH), refs, limits)["kept"]}

    tagged = docs.withColumn("__lang", F.col("lang").cast("string"))
    return with_columns(tagged, run, "__kept boolean", docs.columns).where("__kept").drop("__kept")
