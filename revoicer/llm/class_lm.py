"""Class-based bigram language model with exchange clustering (Brown classes).

Every training text counts; nothing is sampled:

1. One pass over the texts writes each block (a slice of the corpus) as word numbers and
   a list of its words. A shuffle by word gives the exact count of every training word.
2. The UNITS most frequent words, and rarer words pooled by their last three bytes, are
   the seeds: exchange clustering moves them between CLASSES classes while the likelihood
   of their bigrams grows, from a table of at most (UNITS + POOLS + 1) squared counts.
3. Every other training word leaves its pool: a shuffle by word sums how often each class
   stands before and after it, over the whole corpus, and the word takes the class in
   which those neighbours are likeliest. These counts grow with the input and need no
   table on any one machine. Only words that no training text has stay with a pool.
4. Class bigrams are counted again under those classes. A word's probability is that of
   its class after the last word's class (interpolated with the class's own) times its
   own share of its class, from exact counts with one added. Words of each block get
   count and class through a side file in the shared folder, so texts are never shuffled
   and no task needs the whole vocabulary.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_schema, blocks, column, fresh_folder, give_back, id_crc, ids_and_text, lists, materialise, read_block, read_file, record, without_cycles, write_by_block, write_file

UNITS, POOLS, CLASSES = 1000, 256, 48
#: Frequent words that every task holds; the others come by block.
FREQUENT = 50_000
SWEEPS = 8
#: Weight of the class's own probability beside its transition.
MIXED = 0.1
HELD_OUT = (7, 2)  # modulus and remainder of crc32(doc_id) that marks held-out texts
#: One neighbour count of a word: a class before it, or CLASSES + a class after it.
NEIGHBOUR = np.dtype([("slot", "u1"), ("n", "<u4")])
#: Tasks that a pass over blocks has at most.
TASKS = 10_000
#: Bytes of text in a block, but for a single longer text.
BLOCK_BYTES = 8 << 20


def held_out(ids: list) -> np.ndarray:
    return id_crc(ids) % HELD_OUT[0] == HELD_OUT[1]


def indexed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts, word counts, and the distinct words, ASCII lower case."""
    parts = [t.lower().split() for t in texts]
    words = list(chain.from_iterable(parts))
    distinct = list(dict.fromkeys(words))
    place = dict(zip(distinct, range(len(distinct)), strict=True))
    return np.array(list(map(place.__getitem__, words)), dtype=np.int64), np.fromiter(map(len, parts), np.int64, len(parts)), distinct


def unit_numbers(words: list[bytes], units: dict[bytes, int]) -> np.ndarray:
    """Unit of each word: its own, or the pool of its last three bytes."""
    n = len(units)
    crc = zlib.crc32
    return np.fromiter((units[w] if w in units else n + crc(w[-3:]) % POOLS for w in words), np.int64, len(words))


# ---- blocks and counts --------------------------------------------------------


def write_blocks(docs: DataFrame, folder: str) -> DataFrame:
    """(block, texts): the blocks with their numbers of training texts. The texts of a block
    lie in one file as word numbers, its words with their training occurrences (0 where
    only held-out texts have them) in another."""
    struct = T._parse_datatype_string("block bigint, texts bigint")
    arrow = arrow_schema(struct)

    @without_cycles
    def run(batches):
        for block, batch, texts in blocks(batches, limit=BLOCK_BYTES):
            flat, sizes, words = indexed(texts)
            ids = column(batch, "doc_id")
            train = ~held_out(ids.to_pylist())
            n = np.bincount(flat, weights=np.repeat(train, sizes), minlength=len(words)).astype(np.int64)
            write_file(folder, f"{block}.texts", pa.table({"doc_id": ids, "train": train, "words": lists(flat, sizes, pa.int32())}))
            write_file(folder, f"{block}.words", pa.table({"word": pa.array(words, pa.binary()), "n": n}))
            yield record({"block": [block], "texts": [int(train.sum())]}, arrow)

    return materialise(docs.mapInArrow(run, struct), "blocks")


def over_blocks(listed: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block) -> dict of columns`` for every block."""
    struct = T._parse_datatype_string(schema)
    arrow = arrow_schema(struct)

    @without_cycles
    def run(batches):
        for batch in batches:
            for block in column(batch, "block").to_pylist():
                yield record(fn(block), arrow)
                give_back()

    return listed.select("block").repartition(min(TASKS, max(1, listed.count()))).mapInArrow(run, struct)


def read_texts(folder: str, block: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, marks of training texts, word numbers one text after the other, sizes."""
    rows = read_file(folder, f"{block}.texts").combine_chunks()
    words = rows["words"].combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    return rows["doc_id"], np.asarray(rows["train"]), np.asarray(words.flatten()), np.asarray(pc.list_value_length(words)).astype(np.int64)


def read_words(folder: str, block: int) -> tuple[list[bytes], np.ndarray]:
    rows = read_file(folder, f"{block}.words")
    return rows["word"].to_pylist(), np.asarray(rows["n"])


def block_words(listed: DataFrame, folder: str) -> DataFrame:
    """(block, word, n): the training occurrences of every word of every block."""

    def run(block):
        rows = read_file(folder, f"{block}.words").combine_chunks()
        return {"block": np.full(len(rows), block), "word": rows["word"].cast(pa.binary()).combine_chunks(), "n": rows["n"].combine_chunks()}

    return over_blocks(listed, run, "block bigint, word binary, n bigint")


def training(flat: np.ndarray, sizes: np.ndarray, train: np.ndarray, values: np.ndarray, end: int) -> np.ndarray:
    """The values of the words of training texts, with an end after each text."""
    return with_ends(values[flat[np.repeat(train, sizes)]], sizes[train], end)


def pairs(seq: np.ndarray, end: int, size: int) -> np.ndarray:
    """Counts of neighbours in a run of texts with ends, as a flat table."""
    before = np.concatenate([[end], seq[:-1]]) if len(seq) else seq
    return np.bincount(before * size + seq, minlength=size * size)


def summed(counted: DataFrame, size: int) -> np.ndarray:
    """The table (a, b, n), size * size rows at most, on the driver."""
    rows = counted.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((size, size), np.int64)
    n[np.asarray(rows["a"]), np.asarray(rows["b"])] = np.asarray(rows["n"])
    return n


def bigrams(listed: DataFrame, folder: str, units: dict[bytes, int]) -> DataFrame:
    """(a, b, n): how often unit b follows unit a in training texts; the last unit is the
    end of a text, which also stands before the first word."""
    shared = listed.sparkSession.sparkContext.broadcast(units)
    total = len(units) + POOLS + 1

    def run(block):
        _, train, flat, sizes = read_texts(folder, block)
        own = unit_numbers(read_words(folder, block)[0], shared.value)
        sums = pairs(training(flat, sizes, train, own, total - 1), total - 1, total)
        at = np.flatnonzero(sums)
        return {"a": at // total, "b": at % total, "n": sums[at]}

    return over_blocks(listed, run, "a int, b int, n bigint")


# ---- classes of the words outside the seeds -----------------------------------


def neighbours(listed: DataFrame, folder: str, units: dict[bytes, int], own: np.ndarray) -> DataFrame:
    """(word, counts): for the training words of each block that are no unit of their own,
    how often each seed class stands before and after them (NEIGHBOUR records)."""
    shared = listed.sparkSession.sparkContext.broadcast((units, own))

    def run(block):
        units, own = shared.value
        _, train, flat, sizes = read_texts(folder, block)
        words, _ = read_words(folder, block)
        unit = unit_numbers(words, units)
        number = training(flat, sizes, train, np.arange(len(words)), -1)
        cls = training(flat, sizes, train, own[unit].astype(np.int8), 0)
        at = np.flatnonzero((number >= 0) & (np.append(unit, 0)[number] >= len(units)))
        key = np.repeat(number[at] * (2 * CLASSES), 2)
        key[::2] += np.append(np.int8(0), cls)[at]
        key[1::2] += CLASSES + cls[at + 1].astype(np.int64)  # an end follows every word
        del number, cls, at, flat
        key, n = np.unique(key, return_counts=True)
        packed = np.empty(len(key), NEIGHBOUR)
        packed["slot"], packed["n"] = key % (2 * CLASSES), n
        which, first = np.unique(key // (2 * CLASSES), return_index=True)
        offsets = np.append(first, len(key)).astype(np.int32) * NEIGHBOUR.itemsize
        counts = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
        return {"word": pa.array([words[i] for i in which], pa.binary()), "counts": counts}

    return over_blocks(listed, run, "word binary, counts binary")


def best_class(counts: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each word (a row: CLASSES counts before it, CLASSES after it) the class in which
    its occurrences and what follows them are likeliest; ties to the lowest class."""
    moves = np.log(transitions(grid))
    before, after = counts[:, :CLASSES], counts[:, CLASSES:]
    gain = before @ moves + after @ moves.T - before.sum(axis=1, keepdims=True) * np.log(grid.sum(axis=0) + 1)
    return 1 + np.argmax(gain[:, 1:], axis=1)  # class 0 is the end's


def assigned(near: DataFrame, grid: np.ndarray) -> DataFrame:
    """(word, c, cls): count and class of every word of ``near``. A word has one row a block
    at most, and a partition is read as a stream, one word after another."""
    shared = near.sparkSession.sparkContext.broadcast(grid)
    struct = T._parse_datatype_string("word binary, c bigint, cls int")
    arrow = arrow_schema(struct)

    def rows(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
        return record({"word": words, "c": counts[:, :CLASSES].sum(axis=1).astype(np.int64), "cls": best_class(counts, shared.value)}, arrow)

    def run(batches):
        held: tuple[list[bytes], np.ndarray] = ([], np.zeros((0, 2 * CLASSES)))  # the last word so far
        for batch in batches:
            if not len(batch):
                continue
            word, packed = column(batch, "word"), column(batch, "counts")
            new = np.append(True, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)).astype(bool)
            entries = np.frombuffer(b"".join(packed.to_pylist()), NEIGHBOUR)
            owner = np.repeat(np.cumsum(new) - 1, np.asarray(pc.binary_length(packed)) // NEIGHBOUR.itemsize)
            counts = np.bincount(owner * (2 * CLASSES) + entries["slot"], weights=entries["n"], minlength=int(new.sum()) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            words = word.filter(pa.array(new)).to_pylist()
            if held[0] and held[0][0] == words[0]:
                counts[0] += held[1][0]
            elif held[0]:
                words, counts = held[0] + words, np.concatenate([held[1], counts])
            held = words[-1:], counts[-1:]
            if len(words) > 1:
                yield rows(words[:-1], counts[:-1])
        if held[0]:
            yield rows(*held)
        give_back()

    return near.repartition("word").sortWithinPartitions("word").mapInArrow(run, struct)


def with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The values of each text with an end after them."""
    out = np.full(len(values) + len(sizes), end, dtype=values.dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = values
    return out


# ---- exchange clustering ----------------------------------------------------


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, list[float]]:
    """Class of each unit from the unit bigrams n (the last unit, the end, keeps class 0
    to itself), and the log likelihood after each sweep, which never falls."""
    size = len(n)
    n = n.astype(float)
    order = np.argsort(-(n.sum(axis=0) + n.sum(axis=1))[:-1], kind="stable")
    own = np.zeros(size, np.int64)
    own[order] = 1 + np.arange(size - 1) % (classes - 1)
    one = np.zeros((size, classes))
    one[np.arange(size), own] = 1
    right, left = n @ one, n.T @ one  # unit before class, class before unit (transposed)
    grid = one.T @ right
    likelihood = []
    for _ in range(sweeps):
        moved = 0
        for w in order:
            r, lft, self_n, old = right[w].copy(), left[w].copy(), n[w, w], own[w]
            if r.sum() + lft.sum() == 0:
                continue
            r[old] -= self_n
            lft[old] -= self_n
            grid[old] -= r
            grid[:, old] -= lft
            grid[old, old] -= self_n
            # Gain of putting w into each class, against a grid without w.
            rows, cols = xlogx(grid + r) - xlogx(grid), xlogx(grid + lft[:, None]) - xlogx(grid)
            diagonal = np.diagonal(grid)
            gain = rows.sum(axis=1) - np.diagonal(rows) + cols.sum(axis=0) - np.diagonal(cols) + xlogx(diagonal + r + lft + self_n) - xlogx(diagonal)
            first, second = grid.sum(axis=1), grid.sum(axis=0)
            gain -= xlogx(first + r.sum() + lft + self_n) - xlogx(first) + xlogx(second + lft.sum() + r + self_n) - xlogx(second)
            # What w leaves behind in other classes' sums does not depend on its class.
            gain[0] = -np.inf
            gain += marginal(first, second, r, lft, self_n)
            new = int(np.argmax(gain))
            new = old if gain[new] <= gain[old] + 1e-9 else new
            grid[new] += r
            grid[:, new] += lft
            grid[new, new] += self_n
            if new != old:
                moved += 1
                own[w] = new
                right[:, old] -= n[:, w]
                right[:, new] += n[:, w]
                left[:, old] -= n[w]
                left[:, new] += n[w]
        likelihood.append(float(xlogx(grid).sum() - xlogx(grid.sum(axis=1)).sum() - xlogx(grid.sum(axis=0)).sum()))
        if not moved:
            break
    return own, likelihood


def marginal(first: np.ndarray, second: np.ndarray, r: np.ndarray, lft: np.ndarray, self_n: float) -> np.ndarray:
    """The part of the gain that the other classes' sums take: a class before w gains
    lft in its row sum and a class after w gains r in its column sum, but for the class
    w joins, whose sums the caller has counted whole."""
    rows = xlogx(first + lft) - xlogx(first)
    cols = xlogx(second + r) - xlogx(second)
    return -(rows.sum() - rows) - (cols.sum() - cols)


# ---- the model --------------------------------------------------------------


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame, str, dict]:
    """The blocks, (word, c, cls) of every training word outside the units, the folder of
    the blocks with a file of facts for each, and the model for the driver."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "word_blocks")
    listed = write_blocks(docs, folder)
    met = block_words(listed, folder)
    totals = materialise(met.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "word_counts")
    # FREQUENT rows at most come to the driver, whatever the vocabulary.
    top = [(bytes(r["word"]), r["c"]) for r in totals.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
    units = {w: i for i, (w, _) in enumerate(top[:UNITS])}
    texts = listed.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    words = totals.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    size = len(units) + POOLS + 1
    n = summed(bigrams(listed, folder, units), size)
    own, _ = exchange(n)
    one = np.zeros((size, CLASSES))
    one[np.arange(size), own] = 1
    tail = materialise(assigned(neighbours(listed, folder, units, own), one.T @ n @ one), "word_classes")
    # Frequent words leave before the join: they are in every block, and every task has them.
    # The list is short words, FREQUENT of them at most.
    frequent = F.broadcast(spark.createDataFrame([(bytearray(w),) for w, _ in top], "word binary"))
    classes = {bytes(r["word"]): r["cls"] for r in tail.join(frequent, "word", "left_semi").collect()} | {w: int(own[i]) for w, i in units.items()}
    distinct = np.bincount(own[: len(units)], minlength=CLASSES)
    for r in tail.groupBy("cls").agg(F.count(F.lit(1)).alias("v")).collect():
        distinct[r["cls"]] += r["v"]
    model = {
        "units": units, "own": own, "distinct": distinct, "texts": texts, "n": words["n"] + texts, "v": words["v"] + (texts > 0),
        "frequent": {w: i for i, (w, _) in enumerate(top)}, "counts": np.array([c for _, c in top], np.int64), "classes": np.array([classes[w] for w, _ in top], np.int64),
    }
    side = fresh_folder(spark, "block_counts")
    write_by_block(met.select("block", "word").join(frequent, "word", "left_anti").join(tail.join(frequent, "word", "left_anti").hint("merge"), "word").select("block", "word", "c", "cls"), side)
    grid = summed(class_bigrams(listed, folder, side, model), CLASSES)
    model |= {"moves": np.log10(transitions(grid)), "tokens": grid.sum(axis=0)}
    return listed, tail, folder, model


def transitions(grid: np.ndarray) -> np.ndarray:
    """Probability of each class after each other, from counts: mixed with the class's own,
    which stands alone after a class that was never seen. Each row sums to 1."""
    share = grid.sum(axis=0) + 1e-6 * max(1, grid.sum())
    share = share / share.sum()
    before = grid.sum(axis=1, keepdims=True)
    return np.where(before > 0, (1 - MIXED) * grid / np.maximum(before, 1) + MIXED * share, share)


def facts_of(words: list[bytes], n: np.ndarray, model: dict, side: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Training count and class of each word of a block. A word without training
    occurrences has count 0 and its pool's class."""
    at = np.fromiter((model["frequent"].get(w, -1) for w in words), np.int64, len(words))
    counts, classes = np.append(model["counts"], 0)[at], np.append(model["classes"], -1)[at]
    own = read_block(side, block)
    rare: dict[bytes, int] = {} if own is None else {w: i for i, w in enumerate(own["word"].to_pylist())}
    rest = np.flatnonzero(at < 0)
    place = np.fromiter((rare.get(words[i], -1) for i in rest), np.int64, len(rest))
    if own is not None:
        counts[rest], classes[rest] = np.append(own["c"], 0)[place], np.append(own["cls"], -1)[place]
    unseen = np.flatnonzero(classes < 0)
    if n[unseen].any():
        raise RuntimeError("a training word of a block has no class")
    classes[unseen] = model["own"][unit_numbers([words[i] for i in unseen], model["units"])]
    return counts, classes


def class_bigrams(listed: DataFrame, folder: str, side: str, model: dict) -> DataFrame:
    """(a, b, n) over classes in training texts. Writes count and class of each word of a
    block beside its texts, where scoring finds them."""
    shared = listed.sparkSession.sparkContext.broadcast(model)

    def run(block):
        _, train, flat, sizes = read_texts(folder, block)
        counts, classes = facts_of(*read_words(folder, block), shared.value, side, block)
        write_file(folder, f"{block}.facts", pa.table({"c": counts, "cls": classes.astype(np.int8)}))
        sums = pairs(training(flat, sizes, train, classes, 0), 0, CLASSES)
        at = np.flatnonzero(sums)
        return {"a": at // CLASSES, "b": at % CLASSES, "n": sums[at]}

    return over_blocks(listed, run, "a int, b int, n bigint")


def sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each text's values; a text's sum does not depend on its neighbours."""
    first = np.cumsum(sizes) - sizes
    return np.where(sizes > 0, np.add.reduceat(np.append(x, 0), first), 0) if len(sizes) else np.zeros(0)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Edge cases: a null or empty text is its end token alone; a null id counts as the
    empty id; repeated rows count and score each; an empty table gives no rows; without
    training texts every count is 0 and both scores still are defined.
    """
    listed, _, folder, model = fit(ids_and_text(docs))
    m = {k: model[k] for k in ("n", "v", "texts", "tokens", "distinct", "moves")}

    def run(block):
        ids, train, flat, sizes = read_texts(folder, block)
        facts = read_file(folder, f"{block}.facts")
        c, cls = np.asarray(facts["c"]), np.asarray(facts["cls"]).astype(np.int64)
        whole = m["n"] + m["v"] + 1
        base = np.log10(c + 1) - np.log10(whole)
        emit = np.log10(c + 1) - np.log10(m["tokens"] + m["distinct"] + 1)[cls]
        seq = with_ends(cls[flat], sizes, 0)
        moves = m["moves"][np.concatenate([[0], seq[:-1]]), seq] if len(seq) else np.zeros(0)
        return {
            "doc_id": ids.combine_chunks(), "held_out": ~train, "n_tokens": sizes + 1, "n_known": sums((c > 0)[flat], sizes).astype(np.int64) + (m["texts"] > 0),
            "train_tokens": np.full(len(sizes), m["n"]), "base_score": sums(base[flat], sizes) + np.log10((m["texts"] + 1) / whole), "score": sums(emit[flat], sizes) + sums(moves, sizes + 1),
        }

    return over_blocks(listed, run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
