"""Near-duplicate documents by weighted Jaccard similarity of word shingles.

A document is the multiset of its SHINGLE-word shingles (shorter texts: one shingle of
all their words). Two texts are linked where the weighted Jaccard similarity of their
multisets, sum of minima over sum of maxima, is at least 0.8; a class is a connected
component of links, exact copies included.

1. Texts are told apart by a 128-bit hash; copies are merged before anything else.
2. BagMinHash: each (shingle, weight level) carries a Poisson process over time, made
   level block by level block (blocks double: [0,1), [1,2), [2,4), ...), seeded by the
   shingle and the block alone. A weight w keeps the points of levels under w. The
   earliest point of each register is the signature; two signatures agree in a register
   with a probability of exactly the weighted Jaccard similarity.
3. BANDS bands of ROWS registers: texts that agree in a band meet in a bucket, and
   buckets that share a text make a family. Only texts in a family go on.
4. Families are cut to cells of bounded size. In a cell every pair is compared exactly, on
   the multisets, by vectorised counting; one link is kept for each two classes that meet.
5. In families of several cells, the heads of each cell's classes meet next; after that
   only texts outside their family's largest class matter, and each of them is compared
   exactly with all members of other classes. Pairs of one class are never made.
6. Components by contraction: classes hook onto their least neighbour, round by round.

No step holds a family, a class or the links on the driver or in one Python group: rows
stream through sorted partitions, and what meets in memory is a cell of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_schema, column, map_slices, materialise, record, slices, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Most texts and bytes of a cell, most texts outside the largest class that a cell is held
#: against at once, and heads that a cell sends on.
CELL, CELL_BYTES, STRAYS, HEADS = 512, 8 << 20, 512, 16
GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---- shingles ---------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(k: int) -> np.uint64:
    return np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one text after the other, and their counts."""
    words, sizes = words_of(texts)
    known = {w: 0 for w in words}
    for w in known:
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    total = int(counts.sum())
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat((np.cumsum(sizes) - sizes), counts) + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        at = first + k
        there = k < np.minimum(sizes[owner], SHINGLE)
        out = np.where(there, mixed(out * np.uint64(3) + h[np.minimum(at, max(len(h) - 1, 0))] + GOLD), out) if not there.all() else mixed(out * np.uint64(3) + h[at] + GOLD)
    return out, counts


def bags(hashes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingles, weights) of each text."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two bags; 1 of two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common)


# ---- signatures -------------------------------------------------------------


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Registers (n, REGISTERS) of n bags given as (document, shingle, weight), no pair
    twice and no document without a row: the identity of the earliest point in each.

    A block of levels [lo, hi) has points at rate REGISTERS * (hi - lo); a point has a
    register and a level, and counts where its level is under the weight. Points are
    made in the order of time up to a horizon by which the document's registers should
    all be full; for documents where one is not, the horizon is doubled.
    """
    best, name = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, np.uint64)
    horizon = (np.log(REGISTERS) + 4.0) / np.maximum(1, np.bincount(doc, weights=weight, minlength=n))
    blocks = [(0, 1)] + [(1 << k, 1 << (k + 1)) for k in range(int(weight.max(initial=1)).bit_length())]
    todo = np.ones(n, bool)
    while todo.any():
        for lo, hi in blocks:
            on = (weight > lo) & todo[doc]
            d, w, seed, step = doc[on], weight[on], mixed(shingle[on] + salt(hi)), 0
            time = np.zeros(len(d))
            while len(d):
                step += 1
                draw = mixed(seed + salt(3 * step))
                time = time - np.log(uniform(draw)) / (REGISTERS * (hi - lo))
                live = np.flatnonzero(time < horizon[d])
                d, w, seed, time, draw = d[live], w[live], seed[live], time[live], draw[live]
                level = lo + (uniform(mixed(seed + salt(3 * step + 1))) * (hi - lo)).astype(np.int64) if hi - lo > 1 else np.full(len(d), lo)
                kept = level < w
                at = (d * REGISTERS + (mixed(seed + salt(3 * step + 2)) % np.uint64(REGISTERS)).astype(np.int64))[kept]
                np.minimum.at(best, at, time[kept])
                first = best[at] == time[kept]
                name[at[first]] = draw[kept][first]
        todo = ~np.isfinite(best.reshape(n, REGISTERS)).all(axis=1)
        horizon = np.where(todo, horizon * 2, horizon)
    return name.reshape(n, REGISTERS)


def weighed(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) and how often each occurs; doc must be ascending."""
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], shingle[first], np.diff(np.concatenate([first, [len(doc)]]))


def signed(texts: list[bytes]) -> tuple[list[bytes], list]:
    """Keys and band hashes of texts; a text without a word has no band. Copies within
    the slice are worked once."""
    keys = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
    once = {k: i for i, k in enumerate(keys)}
    some = [i for i in once.values() if texts[i].strip()]
    place = {keys[i]: j for j, i in enumerate(some)}
    if not some:
        return keys, [None] * len(keys)
    hashes, counts = shingles([texts[i] for i in some])
    names = signatures(*weighed(np.repeat(np.arange(len(some)), counts), hashes), len(some))
    rows = names.reshape(len(some), BANDS, ROWS)
    bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), BANDS))
    for k in range(ROWS):
        bands = mixed(bands * np.uint64(3) + rows[:, :, k] + GOLD)
    bands = bands.astype(np.int64)
    at = [place.get(k) for k in keys]
    return keys, [None if j is None else bands[j].tolist() for j in at]


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, key, bands of every document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch, texts):
        keys, band = signed(texts)
        return {"doc_id": column(batch, "doc_id"), "key": keys, "bands": band}

    return map_slices(plain, run, "doc_id bigint, key binary, bands array<bigint>")


# ---- cells ------------------------------------------------------------------


class Cell:
    """Bags side by side, for exact similarities of one bag with all of them."""

    def __init__(self, members: list[tuple[np.ndarray, np.ndarray]]):
        flat = np.concatenate([m[0] for m in members])
        self.names, self.ids = np.unique(flat, return_inverse=True)
        self.weights = np.concatenate([m[1] for m in members])
        sizes = np.array([len(m[0]) for m in members])
        self.first, self.total = np.cumsum(sizes) - sizes, np.array([m[1].sum() for m in members])
        self.mark = np.zeros(len(self.names) + 1, np.int64)

    def similarities(self, bag: tuple[np.ndarray, np.ndarray], upto: int | None = None) -> np.ndarray:
        """Weighted Jaccard similarity with the first ``upto`` members (all of them)."""
        n = len(self.first) if upto is None else upto
        if n == 0:
            return np.zeros(0)
        at = np.minimum(np.searchsorted(self.names, bag[0]), len(self.names) - 1)
        own = self.names[at] == bag[0]
        self.mark[at[own]] = bag[1][own]
        stop = self.first[n] if n < len(self.first) else len(self.ids)
        common = np.add.reduceat(np.minimum(self.mark[self.ids[:stop]], self.weights[:stop]), self.first[:n])
        self.mark[at[own]] = 0
        return common / (self.total[:n] + int(bag[1].sum()) - common)


def linked_inside(keys: list[bytes], members: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[bytes, bytes]]:
    """Links of a cell, one for each two classes that meet: every pair is compared."""
    cell, label, links = Cell(members), np.arange(len(keys)), []
    for i in range(1, len(keys)):
        for j in np.flatnonzero(cell.similarities(members[i], i) >= SIMILARITY):
            if label[i] != label[j]:
                links.append((keys[j], keys[i]))
                label[label == label[i]] = label[j]
    return links


def linked_across(strays: list[tuple], members: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Links between (key, label, bag) of strays and members of other labels, at most one
    for each stray and label."""
    cell = Cell([m[2] for m in members])
    place: dict[bytes, int] = {}
    label = np.array([place.setdefault(m[1], len(place)) for m in members])
    links = []
    for key, own, bag in strays:
        hit = np.flatnonzero((cell.similarities(bag) >= SIMILARITY) & (label != place.get(own, -1)))
        for j in hit[np.unique(label[hit], return_index=True)[1]]:
            links.append((key, members[j][0]))
    return links


LINKS = "a binary, b binary"


def links_in_cells(rows: DataFrame) -> DataFrame:
    """Links within each (family, cell) of rows (family, cell, key, text)."""
    struct = T._parse_datatype_string(LINKS)
    arrow = arrow_schema(struct)

    def run(batches):
        now, keys, members, out = None, [], [], []
        for batch, raw in slices(batches):
            for family, cell, key, bag in zip(column(batch, "family").to_pylist(), column(batch, "cell").to_pylist(), column(batch, "key").to_pylist(), bags(*shingles(raw)), strict=True):
                if (family, cell) != now:
                    out += linked_inside(keys, members) if len(keys) > 1 else []
                    now, keys, members = (family, cell), [], []
                keys.append(key)
                members.append(bag)
            yield record({"a": [x[0] for x in out], "b": [x[1] for x in out]}, arrow)
            out = []
        out = linked_inside(keys, members) if len(keys) > 1 else []
        yield record({"a": [x[0] for x in out], "b": [x[1] for x in out]}, arrow)

    return rows.select("family", "cell", "key", "text").repartition("family", "cell").sortWithinPartitions("family", "cell", "key").mapInArrow(run, struct)


def links_of_strays(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between texts outside their family's largest class and all other classes of
    the family, for families of several cells. pool: family, cell, cells, key, text."""
    several = pool.where("cells > 1").join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = several.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    tops = sizes.groupBy("family").agg(F.max(F.struct("c", "label", "bytes")).alias("top"), F.sum("c").alias("all"), F.sum("bytes").alias("bytes")).where(F.col("all") > F.col("top.c"))
    tops = tops.select("family", F.col("top.label").alias("main"), F.greatest(F.ceil((F.col("all") - F.col("top.c")) / STRAYS), F.ceil((F.col("bytes") - F.col("top.bytes")) / CELL_BYTES)).cast("int").alias("chunks"))
    rows = salted_join(several, tops, "family")
    chunks = F.greatest(F.col("chunks"), F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.where("label != main").withColumn("chunk", F.pmod(F.xxhash64("key", F.lit("s")), chunks).cast("int")).withColumn("cell", every(F.col("cells"))).withColumn("side", F.lit(0))
    right = rows.withColumn("chunk", every(chunks)).withColumn("side", F.lit(1))
    names = ["family", "chunk", "cell", "side", "key", "label", "text"]
    struct = T._parse_datatype_string(LINKS)
    arrow = arrow_schema(struct)

    def run(batches):
        now, sides = None, ([], [])
        for batch, raw in slices(batches):
            out = []
            for family, chunk, cell, side, key, label, bag in zip(*(column(batch, c).to_pylist() for c in names[:-1]), bags(*shingles(raw)), strict=True):
                if (family, chunk, cell) != now:
                    out += linked_across(*sides) if all(sides) else []
                    now, sides = (family, chunk, cell), ([], [])
                sides[side].append((key, label, bag))
            yield record({"a": [x[0] for x in out], "b": [x[1] for x in out]}, arrow)
        out = linked_across(*sides) if all(sides) else []
        yield record({"a": [x[0] for x in out], "b": [x[1] for x in out]}, arrow)

    return left.select(*names).unionByName(right.select(*names)).repartition("family", "chunk", "cell").sortWithinPartitions(*names[:5]).mapInArrow(run, struct)


def heads(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """One text of each cell's largest classes, dealt to new cells: links among them join
    what is one class in several cells, so that few texts are left outside it."""
    several = pool.where("cells > 1").join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    own = several.groupBy("family", "cell", "cells", "label").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("key"))
    best = own.withColumn("r", F.row_number().over(Window.partitionBy("family", "cell").orderBy(F.desc("c"), "key"))).where(F.col("r") <= HEADS)
    met = best.withColumn("cell", F.pmod(F.xxhash64("key", F.lit("h")), F.ceil(F.col("cells") * HEADS / CELL)).cast("int")).select("family", "cell", "key")
    return met.join(pool.select("key", "text"), "key")


# ---- components -------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, label): connected components of links (a, b), named by their least node.

    Rounds of contraction: each label hooks onto its least neighbour if that is less,
    chains of hooks are shortened by doubling, and links are renamed; links within a
    label go. Each round is written, so nothing is computed twice or kept on the driver.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = materialise(nodes.withColumn("label", F.col("node")), "labels")
    edges = materialise(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        # b's least neighbour is under b by the order of the pair; only such labels hook.
        hooks = materialise(edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")), "hooks")
        while True:
            on = hooks.select(F.col("from").alias("to"), F.col("to").alias("next"))
            further = materialise(hooks.join(on, "to", "left").select("from", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            hooks = further.select("from", "to")
            if further.where("moved").isEmpty():
                break
        renamed = lambda df, c: df.join(hooks.withColumnRenamed("from", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        labels = materialise(renamed(labels, "label"), "labels")
        edges = materialise(renamed(renamed(edges, "a"), "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def salted_join(rows: DataFrame, small: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """rows joined with one row per value of ``on``; a value with many rows is spread."""
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("key", F.lit("salt")), F.lit(salts)).cast("int")).join(spread, [on, "__salt"]).drop("__salt")


def text_of(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """keys with their text, for (key, rep, ...): joined on the id of one row that has it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # A merge join at every size: the keys grow with the corpus, so they are not sent around.
    found = rows.join(keys.withColumnRenamed("rep", "__id").hint("merge"), "__id").where(F.unhex(F.md5("text")) == F.col("key"))
    return found.drop("__id")


def link_texts(signed_docs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: key, rep) of all distinct texts and (node, label) of those in a link."""
    texts = materialise(signed_docs.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "texts")
    # A text whose rows all have null ids can't be fetched by id: see near_duplicates.
    met = texts.where("bands is not null and rep is not null").select("key", F.explode("bands").alias("bucket"))
    first = met.groupBy("bucket").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "a")
    families = components(materialise(met.join(first, "bucket").select("a", F.col("key").alias("b")).distinct(), "meetings"))
    named = families.select(F.col("node").alias("key"), F.col("label").alias("family")).join(texts.select("key", "rep"), "key")
    own = text_of(named, docs)
    own = own.groupBy("key").agg(F.first("family").alias("family"), F.first("text").alias("text")) if repeats(signed_docs) else own
    fetched = materialise(own.withColumn("bytes", F.octet_length("text")), "family_texts")
    sizes = fetched.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("bytes") / CELL_BYTES)).cast("int").alias("cells"))
    pool = salted_join(fetched, sizes, "family").withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int"))
    links = materialise(links_in_cells(pool), "links")
    labels = components(links)
    if not sizes.where("cells > 1").isEmpty():
        links = materialise(links.unionByName(links_in_cells(heads(pool, labels))), "links")
        labels = components(links)
        labels = components(materialise(links.unionByName(links_of_strays(pool, labels)), "links"))
    return texts.select("key", "rep"), labels


def repeats(docs: DataFrame) -> bool:
    """Whether an id has several rows."""
    return not docs.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: one row per document; class_id is the least doc_id of its class.

    Edge cases: null and empty texts are copies of each other, and so are texts of white
    space alone only if equal; texts under five words are compared as one shingle; rows
    with a null id belong to the class of their text, and texts that only such rows have
    stay with their exact copies (class_id null if no row of them has an id); an id of
    several rows may be in several classes; an empty table gives no rows.
    """
    return classified(docs).select("doc_id", "class_id")


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, class of every document; class is a text key that tells apart
    the classes of one class_id, where an id has several texts."""
    own = materialise(sign(docs), "signed")
    texts, labels = link_texts(own, docs)
    named = texts.join(labels, texts["key"] == labels["node"], "left").select("key", "rep", "label")
    alone = named.where("label is null").select("key", F.col("rep").alias("class_id"), F.col("key").alias("class"))
    linked = named.where("label is not null")
    least = linked.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = alone.unionByName(linked.join(least, "label").select("key", "class_id", F.col("label").alias("class")))
    return own.select("doc_id", "key").join(classes, "key").select("doc_id", "key", "class_id", "class")


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least id, with its columns as they
    were; rows without an id stay only where no row with an id is in their class. Where
    an id has several texts, the row kept for a class has a text of that class."""
    classes = materialise(classified(docs), "classes")
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    least = classes.where("doc_id = class_id")
    if repeats(docs):
        # A class may have several texts of its least id: the one of the least key stays.
        keep = least.groupBy("class").agg(F.min("doc_id").alias("__keep"), F.min("key").alias("__key"))
        tagged = docs.withColumn("__text_key", key)
        same = (F.col("doc_id").cast("long") == F.col("__keep")) & (F.col("__text_key") == F.col("__key"))
        kept = tagged.join(keep.hint("merge"), same).dropDuplicates(["__keep", "__key"]).select(*docs.columns)
    else:
        keep = least.select(F.col("doc_id").alias("__keep")).distinct()
        kept = docs.join(keep.hint("merge"), F.col("doc_id").cast("long") == F.col("__keep")).drop("__keep")
    orphans = classes.where("class_id is null").select("key").distinct()
    if not orphans.isEmpty():
        own = docs.where("doc_id is null").withColumn("__key", key).join(orphans.withColumnRenamed("key", "__key"), "__key", "left_semi")
        kept = kept.unionByName(own.dropDuplicates(["__key"]).select(*docs.columns))
    return kept
