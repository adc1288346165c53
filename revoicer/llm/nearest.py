"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is centred, padded to CODE_BITS dimensions where it has fewer, rotated at
random, and kept as one bit per dimension, packed to 64-bit words, with two correction
scalars: its distance from the centre, and the inner product of its unit residual with its
own code. A query is rotated too and rounded to LEVELS steps, kept as one packed word list
for each binary digit; the inner product with a code is then a sum of bit counts. Bits and
scalars give it without bias, with an error bound that shrinks as the code grows. In each
block of the table the SEEDS best estimates are scored exactly, which gives a floor; then
only vectors whose upper bound reaches it are, on the original vectors in double precision.

Blocks of the table and chunks of queries are files in the shared folder; each task reads
one block and some chunks, so neither is copied for the other. The work still is every
query against every code. Copies of a vector are merged first: of equal vectors only the
TOP + 1 least ids can be among a query's nearest, since ties go to the smaller id, so a
vector that fills a third of the table costs one code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_schema, column, fresh_folder, materialise, read_block, record, write_by_block

TOP = 20
QUERY_STEP = 20
#: Vectors of a block of the table: the least where tasks are few, and the most.
BLOCK, BLOCK_MOST = 8192, 65536
#: Queries of a chunk, and chunks that a task takes.
QUERIES, CHUNKS = 4096, 64
#: Rows that the centre is the mean of: those with the least hashes.
CENTRE_ROWS = 4096
#: Standard errors that the bounds span.
WIDTH = 2.5
#: Least length of a code, and estimates scored first in each block.
CODE_BITS, SEEDS = 128, 48
#: Binary digits of a rounded query, and its steps.
DIGITS = 4
LEVELS = 1 << DIGITS
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix: pads to CODE_BITS and rotates."""
    bits = -(-max(dim, CODE_BITS) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, distance from the centre, and <unit residual, code> of each row."""
    residual = x - centre
    norm = np.linalg.norm(residual, axis=1)
    unit = (residual / np.where(norm > 0, norm, 1)[:, None]) @ turn
    own = np.abs(unit).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(unit > 0, axis=1), norm, np.where(norm > 0, own, 1.0)


class Codes:
    """The codes of a block: packed words, set bits, and what scales and bounds estimates.

    <q, x> = <q, centre> + norm * <q, unit>, and <q, unit> is estimated by <q', code> / own
    with q' the rotated query; its deviation is |q| * sqrt((1 - own^2) / own^2 / (bits - 1))."""

    def __init__(self, bits: np.ndarray, norm: np.ndarray, own: np.ndarray):
        self.words = np.ascontiguousarray(np.ascontiguousarray(bits).view(np.uint64).T)  # (words, rows)
        self.n = bits.shape[1] * 8
        self.set = np.bitwise_count(self.words).sum(axis=0, dtype=np.int64).astype(np.float32)
        self.scale = (norm / own).astype(np.float32)
        self.deviation = (norm * np.sqrt(np.maximum(1 - own**2, 0) / own**2 / (self.n - 1))).astype(np.float32)


def estimate(codes: Codes, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries, rows) and their standard errors, by bit counts."""
    q = queries @ turn
    low = q.min(axis=1)
    step = np.maximum((q.max(axis=1) - low) / (LEVELS - 1), 1e-30)
    rounded = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
    sums = np.zeros((len(q), codes.words.shape[1]), np.uint32)
    both, counted = np.empty(sums.shape, np.uint64), np.empty(sums.shape, np.uint8)
    for digit in range(DIGITS):
        planes = np.packbits(rounded >> digit & 1, axis=1).view(np.uint64)
        for w, row in enumerate(codes.words):
            np.bitwise_and(planes[:, w, None], row[None], out=both)
            np.bitwise_count(both, out=counted)
            sums += counted.astype(np.uint32) << digit
    # <q', code> = twice the sum over the set bits, less the sum over all.
    guess = sums.astype(np.float32)
    guess *= (2 * step).astype(np.float32)[:, None]
    guess += np.outer(2 * low, codes.set).astype(np.float32)
    guess -= (low * codes.n + step * rounded.sum(axis=1)).astype(np.float32)[:, None]
    guess *= codes.scale[None] / np.float32(np.sqrt(codes.n))
    guess += (queries @ centre).astype(np.float32)[:, None]
    spread = np.stack([np.linalg.norm(queries, axis=1), step / np.sqrt(12)], axis=1).astype(np.float32)
    return guess, spread @ np.stack([codes.deviation, codes.scale])


def block_top(codes: Codes, vectors: np.ndarray, ids: np.ndarray, firsts: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, centre: np.ndarray, turn: np.ndarray, top: int):
    """(query row, id, score) of the best in one block: distinct vectors, the ids of
    vector i at firsts[i]:firsts[i + 1]."""
    guess, deviation = estimate(codes, queries, centre, turn)
    n, size = len(vectors), np.diff(firsts)
    # One place is kept for the query itself, which is among the candidates.
    seeds = min(n, max(SEEDS, top + 1))
    floor = np.full(len(queries), -np.inf)
    if n > top + 1:
        first = np.argpartition(-guess, seeds - 1, axis=1)[:, :seeds]
        exact = np.einsum("qsd,qd->qs", vectors[first], queries)
        floor = np.sort(exact, axis=1)[:, -(top + 1)]
    guess += WIDTH * deviation
    # A hair of room for rounding, which differs between sums in different orders.
    rows, at = np.nonzero(guess >= (floor - 1e-5 * np.abs(floor))[:, None])
    for i in range(0, len(rows), 1 << 18):
        r, a = rows[i : i + (1 << 18)], at[i : i + (1 << 18)]
        exact = np.einsum("ij,ij->i", queries[r], vectors[a])
        good = exact >= floor[r] - 1e-9 * np.abs(floor[r])
        r, a, exact = r[good], a[good], exact[good]
        m = size[a]
        rr, ss = np.repeat(r, m), np.repeat(exact, m)
        ii = ids[np.repeat(firsts[a] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        other = ii != query_ids[rr]
        yield rr[other], ii[other], ss[other]


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of each row's top scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else np.zeros(0, int)
    return order[np.arange(len(r)) - start < top]


def valid(vectors: DataFrame, dim: int | None) -> DataFrame:
    """Rows that take part, as vec_id and doubles."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where("vec_id is not null and embedding is not null").where(ok)
    return rows if dim is None else rows.where(F.size("embedding") == dim)


def search(vectors: DataFrame, queries: DataFrame | None = None, top: int = TOP, dim: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest rows by inner product.

    queries (vec_id, embedding) default to the rows whose vec_id is divisible by
    QUERY_STEP; a candidate with the query's own id is left out. Edge cases: vectors
    null, zero or with null or non-finite parts take no part, nor do those of another
    dimension than most have (``dim`` fixes it); of rows that repeat an id and a vector
    one counts; ties in score go to the smaller id; an empty table gives no rows.
    """
    all_rows = valid(vectors, dim)
    if dim is None:
        most = all_rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if most is None:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        dim = most["d"]
        all_rows = all_rows.where(F.size("embedding") == dim)
    asked = valid(queries, dim) if queries is not None else all_rows.where(F.col("vec_id") % QUERY_STEP == 0)
    asked = asked.distinct()
    # Copies: one row per distinct vector, with its least ids alone.
    least = Window.partitionBy("embedding").orderBy("vec_id")
    keyed = all_rows.withColumn("hash", F.xxhash64("embedding")).distinct()
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    # Each salt of a vector keeps its least ids, then the salts meet: no task sees all copies.
    ranked = salted.withColumn("n", F.row_number().over(Window.partitionBy("hash", "embedding", "salt").orderBy("vec_id"))).where(F.col("n") <= top + 1)
    ranked = ranked.withColumn("n", F.row_number().over(least)).where(F.col("n") <= top + 1)
    groups = materialise(ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    sample = np.array([r["embedding"] for r in groups.orderBy(F.xxhash64("embedding"), "embedding").limit(CENTRE_ROWS).select("embedding").collect()])
    centre, turn = (sample.mean(axis=0) if len(sample) else np.zeros(dim)), rotation(dim)
    n, tasks = groups.count(), 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // BLOCK_MOST), min(-(-n // BLOCK), tasks))
    index_files, query_files = fresh_folder(vectors.sparkSession, "codes"), fresh_folder(vectors.sparkSession, "queries")
    write_by_block(coded(groups, centre, turn, parts), index_files)
    chunks = max(1, -(-asked.count() // QUERIES))
    write_by_block(asked.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(chunks)).alias("block"), "vec_id", "embedding"), query_files)
    shared = vectors.sparkSession.sparkContext.broadcast((centre, turn))
    struct = T._parse_datatype_string("query_id bigint, vec_id bigint, score double")
    arrow = arrow_schema(struct)

    def cell(v: pa.Table, chunk: int):
        if (q := read_block(query_files, chunk)) is None:
            return
        grid = lambda t: np.asarray(t["embedding"].combine_chunks().flatten()).reshape(-1, dim)
        queries_, vectors_, query_ids = grid(q), grid(v), np.asarray(q["vec_id"])
        lists = v["ids"].combine_chunks()
        ids, firsts = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(lists)))])
        codes = Codes(np.frombuffer(b"".join(v["bits"].to_pylist()), np.uint8).reshape(len(vectors_), -1), np.asarray(v["norm"]), np.asarray(v["own"]))
        centre_, turn_ = shared.value
        size = max(1, (1 << 20) // max(1, len(vectors_)))
        for i in range(0, len(queries_), size):
            found = list(block_top(codes, vectors_, ids, firsts, queries_[i : i + size], query_ids[i : i + size], centre_, turn_, top))
            if found:
                r, d, s = (np.concatenate(x) for x in zip(*found, strict=True))
                keep = best(r, d, s, top)
                yield record({"query_id": query_ids[i : i + size][r[keep]], "vec_id": d[keep], "score": s[keep]}, arrow)

    def run(batches):
        for batch in batches:
            for task in column(batch, "id").to_pylist():
                block, group = task % parts, task // parts
                if (v := read_block(index_files, block)) is not None:
                    for chunk in range(group * CHUNKS, min(chunks, (group + 1) * CHUNKS)):
                        yield from cell(v, chunk)

    cells = parts * -(-chunks // CHUNKS)
    found = vectors.sparkSession.range(0, cells, 1, cells).mapInArrow(run, struct)
    # At most ``top`` rows of each query from each block meet here.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def coded(groups: DataFrame, centre: np.ndarray, turn: np.ndarray, parts: int) -> DataFrame:
    """The index: block, ids, embedding, bits, norm, own of every distinct vector."""
    rows = groups.withColumn("block", F.pmod(F.xxhash64("embedding"), F.lit(parts)))
    struct = T._parse_datatype_string("block bigint, ids array<bigint>, embedding array<double>, bits binary, norm double, own double")
    arrow = arrow_schema(struct)
    dim = len(centre)

    def run(batches):
        for batch in batches:
            x = np.asarray(column(batch, "embedding").flatten()).reshape(-1, dim)
            bits, norm, own = encode(x, centre, turn)
            yield record({"block": column(batch, "block"), "ids": column(batch, "ids"), "embedding": column(batch, "embedding"), "bits": [b.tobytes() for b in bits], "norm": norm, "own": own}, arrow)

    return rows.mapInArrow(run, struct)
