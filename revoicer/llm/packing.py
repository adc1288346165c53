"""Packing tokenised documents into sequences of a fixed length.

The work on data is two linear passes; the decision is made on a histogram of piece
lengths, which has ``max_len`` numbers whatever the size of the corpus:

1. Tokenise; cut documents to pieces; count pieces by length.
2. On the driver, enumerate patterns of up to DEPTH lengths (in steps of GRAIN tokens)
   that fill a sequence, fit their repeat counts to the histogram by non-negative least
   squares, round down, and take exact lengths for them. What is left, pieces and
   the room in those sequences alike, is packed by best-fit decreasing, on counts.
3. Each piece finds its place from its length and its rank among the pieces of that
   length: a search in the plan's sorted ranges.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import MEMORIES, arrow_schema, column, ids_and_text, materialise, record, slices, without_cycles

GRAIN, DEPTH = 16, 3
#: Distinct words whose ids one Python worker remembers; then it starts anew.
REMEMBERED = 1_000_000
#: Marks that are no letter, digit or white space, and in no contraction or special token.
TAIL = b".,;:!?*#$%&"
#: Of a pre-tokenizer that parts runs of letters from runs of marks.
MARKS_PATTERN = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_memory: dict[str, object] = {}
MEMORIES["packing"] = _memory


# ---- tokens -----------------------------------------------------------------


class WordCoder:
    """Ids of texts, word by word: exact for a tokenizer whose pre-tokens never hold
    white space and whose normaliser maps each word alone, which is checked by tests
    for the vocabulary in use. Words that were seen are looked up."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # Lower-case ASCII letters pass a lower-casing normaliser, a split into runs of
        # letters and the byte alphabet unchanged, so those words need the merges alone.
        bare = json.loads(tokenizer_json) | {"normalizer": None, "pre_tokenizer": None}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        self.folds = '"Lowercase"' in tokenizer_json
        self.parts_at_marks = MARKS_PATTERN in tokenizer_json
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), 0

    def learn(self, words: set[bytes]) -> None:
        """Make words known. A word that ends with a letter or digit and then marks of
        TAIL is two pre-tokens or more, parted there: its ids are those of both parts."""
        plain = [w for w in words if w.isalpha()] if self.folds and self.parts_at_marks else []
        joined, whole = [], {w for w in words if not w.isalpha()} if plain else set(words)
        if self.parts_at_marks:
            for w in list(whole):
                core = w.rstrip(TAIL)
                if len(core) < len(w) and core[-1:].isalnum():
                    joined.append((w, core, w[len(core) :]))
                    whole.discard(w)
            # A part never ends in marks after a letter, so it is coded whole.
            parts = {x for j in joined for x in j[1:] if x not in self.known and x not in words}
            plain += [x for x in parts if x.isalpha()] if self.folds else []
            whole.update(x for x in parts if not (self.folds and x.isalpha()))
        self.code(self.merges, plain)
        self.code(self.tokenizer, list(whole))
        if joined:
            pair = np.array([(self.known[a], self.known[b]) for _, a, b in joined]).ravel()
            sizes = self.start[pair + 1] - self.start[pair]
            ids = self.flat[np.repeat(self.start[pair] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            self.append([j[0] for j in joined], ids, sizes[::2] + sizes[1::2])

    def append(self, words: list[bytes], ids, sizes: np.ndarray) -> None:
        n, total = len(self.known), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + total] = ids
        self.start[n : n + len(words) + 1] = self.used + np.concatenate([[0], np.cumsum(sizes)])
        self.used += total
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def code(self, tokenizer, words: list[bytes]) -> None:
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            ids = [e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)]
            self.append(part, list(chain.from_iterable(ids)), np.array(list(map(len, ids))))

    def encode(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other (each closed by ``end``), and their counts."""
        # The normaliser maps A-Z to a-z, so folding them first changes no id.
        parts = [(t.lower() if self.folds else t).split() for t in texts]
        words = list(chain.from_iterable(parts))
        word = np.array(list(map(self.known.get, words, repeat(-1))), dtype=np.int64)
        if len(missing := np.flatnonzero(word < 0)):
            fresh = {words[i] for i in missing}
            if len(self.known) + 2 * len(fresh) > REMEMBERED:
                self.clear()
                fresh, missing = set(words), np.arange(len(words))
            self.learn(fresh)
            word[missing] = list(map(self.known.__getitem__, map(words.__getitem__, missing.tolist())))
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        sizes = self.start[word + 1] - self.start[word]
        before = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.concatenate([[0], np.cumsum(n_words)])
        text_sizes = before[edge[1:]] - before[edge[:-1]]
        source = np.repeat(self.start[word] - before[:-1], sizes) + np.arange(before[-1])
        flat = self.flat[source]
        if end is None:
            return flat, text_sizes
        out = np.full(len(flat) + len(texts), end, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), text_sizes)] = flat
        return out, text_sizes + 1


def coder(tokenizer_json: str) -> WordCoder:
    """This worker's coder for a vocabulary."""
    if _memory.get("key") != (key := hash(tokenizer_json)):
        _memory.update(key=key, coder=WordCoder(tokenizer_json))
    return _memory["coder"]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def pieces(docs: DataFrame, tokenizer_json: str, max_len: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most max_len tokens of every document, each with its task ``part`` and
    its ``rank`` among the task's pieces of its length; with_ids adds the ids themselves."""
    struct = T._parse_datatype_string(PIECES + (", ids array<bigint>" if with_ids else ""))
    arrow = arrow_schema(struct)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: a few MB

    @without_cycles
    def run(batches):
        ranks: dict[int, int] = defaultdict(int)
        part = TaskContext.get().partitionId()
        for batch, texts in slices(batches, memory="packing"):
            flat, sizes = coder(shared.value).encode(texts, end_id)
            count = -(-sizes // max_len)
            doc = np.repeat(np.arange(len(texts)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(sizes[doc] - piece * max_len, max_len)
            first = (np.cumsum(sizes) - sizes)[doc] + piece * max_len
            data = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B")
            rank = np.empty(len(doc), np.int64)
            for i, n in enumerate(length.tolist()):
                rank[i] = ranks[n]
                ranks[n] += 1
            out = {
                "doc_id": column(batch, "doc_id").take(pa.array(doc)), "piece": piece, "start": piece * max_len, "length": length, "part": np.full(len(doc), part), "rank": rank,
                "ids_crc32": np.fromiter((zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)), np.int64, len(doc)),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat.astype(np.int64)))
            yield record(out, arrow)

    return ids_and_text(docs).mapInArrow(run, struct)


# ---- the plan, on the histogram ---------------------------------------------


def length_patterns(bins: int, depth: int) -> np.ndarray:
    """All multisets of 1 to depth bin numbers (1..bins) that sum to bins, padded by 0."""
    found: list[list[int]] = []

    def grow(head: list[int], least: int, left: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) < depth:
            for x in range(least, left + 1):
                if x == left or left - x >= x:
                    grow([*head, x], x, left - x)

    grow([], 1, bins)
    return np.array([x + [0] * (depth - len(x)) for x in found], dtype=np.int64)


def nnls(A: np.ndarray, b: np.ndarray, rounds: int = 600, tolerance: float = 1e-3) -> np.ndarray:
    """min |Ax - b|, x >= 0, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(A.shape[1]), np.zeros(A.shape[1], dtype=bool)
    for _ in range(rounds):
        rest = b - A @ x
        if np.abs(rest).sum() <= tolerance * b.sum():
            break
        w = A.T @ rest
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(A[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            ratio = x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300)
            x[at] += float(ratio.min()) * (s - x[at])
            passive[at[(x[at] <= 1e-12) & bad]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


class Plan:
    """Where pieces go: rows (length, first rank, count, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], max_len: int):
        self.max_len, self.left = max_len, np.zeros(max_len + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.taken, self.rows, self.sequences = np.zeros(max_len + 1, np.int64), [], 0
        #: Sequences with room: room -> runs of (first sequence, count).
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.fit()
        self.best_fit()
        self.rows.sort()

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.taken[length]), count, sequence, offset))
        self.taken[length] += count
        self.left[length] -= count

    def opened(self, room: int, run: tuple[int, int]) -> None:
        if room > 0:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append(run)

    def fit(self) -> None:
        """The fitted patterns, rounded down, with exact lengths, longest first."""
        if self.left[self.max_len]:
            n = int(self.left[self.max_len])
            self.put(self.max_len, n, self.sequences, 0)
            self.sequences += n
        bins = -(-self.max_len // GRAIN)
        if self.max_len % GRAIN or not self.left.any():
            return
        # A length counts as the nearest multiple of GRAIN, so that the fit neither over- nor
        # understates what a sequence holds; shorter ones than half of it wait for the rest.
        near = (np.arange(self.max_len + 1) + GRAIN // 2 - 1) // GRAIN
        histogram = np.bincount(near, weights=self.left, minlength=bins + 1)[1 : bins + 1]
        patterns = length_patterns(bins, DEPTH)
        patterns = patterns[(patterns < bins).all(axis=1)]
        A = np.zeros((bins, len(patterns)))
        for k in range(DEPTH):
            at = np.flatnonzero(patterns[:, k])
            np.add.at(A, (patterns[at, k] - 1, at), 1)
        repeats = np.floor(nnls(A, histogram) + 1e-9).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if not repeats[i]:
                break
            slots, need = sorted((int(b) for b in patterns[i] if b), reverse=True), defaultdict(int)
            for b in slots:
                need[b] += 1
            have = {b: int(self.left[near == b].sum()) for b in need}
            n = min(int(repeats[i]), *(have[b] // need[b] for b in need))
            if n > 0 and slots[-1] * GRAIN >= (len(slots) - 1) * GRAIN // 2:
                self.fill(slots[:-1], n)

    def fill(self, slots: list[int], n: int) -> None:
        """n sequences with a piece for each given slot, the longest of its bin; equal ones
        are put as runs. A pattern's least slot stays open: best fit then gives each
        sequence the piece that suits its exact room."""
        runs = []
        reserved = np.zeros_like(self.left)
        for b in slots:
            own, need = [], n
            for length in range(min(b * GRAIN + GRAIN - GRAIN // 2, self.max_len), b * GRAIN - GRAIN // 2, -1):
                if take := min(need, int(self.left[length] - reserved[length])):
                    own.append((length, take))
                    reserved[length] += take
                    need -= take
            runs.append(own)
        at = [(0, 0)] * len(slots)  # (run, used of it) of each slot
        done = 0
        while done < n:
            step = min(runs[k][at[k][0]][1] - at[k][1] for k in range(len(slots)))
            offset = 0
            for k in range(len(slots)):
                length = runs[k][at[k][0]][0]
                self.put(length, step, self.sequences, offset)
                offset += length
                used = at[k][1] + step
                at[k] = (at[k][0] + 1, 0) if used == runs[k][at[k][0]][1] else (at[k][0], used)
            self.opened(self.max_len - offset, (self.sequences, step))
            self.sequences += step
            done += step

    def best_fit(self) -> None:
        """What is left, longest first, each into the fullest sequence that takes it."""
        for length in range(self.max_len, 0, -1):
            while n := int(self.left[length]):
                k = bisect_left(self.rooms, length)
                if k < len(self.rooms):
                    room = self.rooms[k]
                    first, have = self.open[room].pop()
                    if not self.open[room]:
                        self.rooms.pop(k)
                    m = min(n, have)
                    self.put(length, m, first, self.max_len - room)
                    if m < have:
                        self.opened(room, (first + m, have - m))
                    self.opened(room - length, (first, m))
                    continue
                each = self.max_len // length
                m, e = (n // each, each) if n >= each else (1, n)
                for i in range(e):
                    self.put(length, m, self.sequences, i * length)
                self.opened(self.max_len - e * length, (self.sequences, m))
                self.sequences += m


def place(rows: list, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, from the plan's rows."""
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    top = int(max(table[:, 1].max(initial=0), rank.max(initial=0))) + 1
    at = np.searchsorted(table[:, 0] * top + table[:, 1], length * top + rank, side="right") - 1
    hit = table[at]
    return hit[:, 3] + rank - hit[:, 1], hit[:, 4]


def pack(docs: DataFrame, tokenizer_json: str, max_len: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece.

    Edge cases: a null or empty text is one piece of the end id alone; a text of any
    length is cut to pieces of max_len; repeated rows are packed each; an empty table
    gives no rows. Ids of documents may be null or repeated: nothing joins on them.
    """
    fixed = materialise(pieces(docs, tokenizer_json, max_len, end_id, with_ids), "pieces")
    # At most max_len rows of counts come to the driver.
    histogram = {r["length"]: r["n"] for r in fixed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(histogram, max_len)
    by_part = fixed.groupBy("part", "length").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = fixed.join(starts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("__before"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    shared = docs.sparkSession.sparkContext.broadcast(plan.rows)  # bounded by max_len and the patterns, not by the data
    struct = T.StructType([fixed.schema[c] for c in keep] + T._parse_datatype_string("sequence_id bigint, offset bigint").fields)

    def run(batches):
        for batch in batches:
            sequence, offset = place(shared.value, np.asarray(column(batch, "length")), np.asarray(column(batch, "rank")))
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in keep] + [pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return ranked.select(*keep, "rank").mapInArrow(run, struct)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, spans: the packed sequences themselves (pack with ids). A group
    holds one sequence: max_len tokens at most."""
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("spans"))
