"""SentencePiece encoding and decoding as a relational lattice.

1. Words: stretches of text that no piece crosses (white space before letters or marks).
   They are looked for once in each distinct token of a block (what stands between spaces).
   Each block of documents sends its distinct words once, packed by hash bucket.
2. Lattice: every substring of a word up to the longest piece is exploded and equi-joined
   to the piece table; what matches are the edges, grouped by word.
3. A fold of Spark's higher-order ``aggregate`` picks the path. For a unigram model it is
   Viterbi's: the best score at each place. For a BPE model the best sum of scores is not
   what the model means, so the fold merges in its order: of the edges whose two halves
   stand side by side, the best score, the leftmost of equals, until none is left. One
   pass over the edges in that order does this, but where an edge becomes a half of a
   better one that was passed over (``risk``); those words are folded round by round.
4. Each bucket sends the ids of a block's words back to the block's side file, in the order
   in which the block listed them; texts are never shuffled.

A path is a bit mask of places where pieces start: one long for words of at most BITS
characters, an array of longs for others, folded by the same rule. Characters without a
piece become byte pieces.

A bucket holds a word once for each block that has it, whatever the word's count, so no
word is a hot key.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_schema, blocks, column, fresh_folder, give_back, ids_and_text, read_block, record, without_cycles, write_by_block

SPACE = "▁"
BITS = 60
#: Words where no finer cut is safe: marks of space, then all up to the next mark.
COARSE = rf"{SPACE}*[^{SPACE}]+|{SPACE}+"


def word_pattern(pieces: list[str]) -> str:
    """Words that no piece crosses: marks of space, then letters alone or other characters
    alone. Letters (as ``re`` sees them, superscripts too) that pieces put beside others
    count as others."""
    letter = re.compile(r"[^\W\d_]")
    crossing = {c for p in pieces for a, b in zip(p, p[1:]) for c, other in ((a, b), (b, a)) if letter.match(c) and other != SPACE and not letter.match(other)}
    moved = re.escape("".join(sorted(crossing)))
    fine = rf"{SPACE}*[^\W\d_{moved}]+|{SPACE}*(?:(?!{SPACE})[\W\d_{moved}])+|{SPACE}+"
    for pattern in (fine, COARSE):
        if all(map(re.compile(pattern).fullmatch, pieces)):
            return pattern
    raise ValueError("a piece holds a space after other characters")


@dataclass
class Model:
    """The piece table of a model file, whose normaliser must leave text as it is."""

    kind: str
    pieces: dict[str, tuple[float, int]]
    bytes_: list[int]
    unknown: int
    shown: list[bytes]  # bytes that each id stands for
    prefix: bool
    pattern: str

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def unknown_score(self) -> float:
        return min(s for s, _ in self.pieces.values()) - 10.0


def load(data: bytes) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(data)
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models that keep text as it is are supported")
    kinds = {1: "unigram", 2: "bpe"}
    if proto.trainer_spec.model_type not in kinds:
        raise ValueError("only unigram and BPE models are supported")
    bytes_, shown, unknown, pieces = [0] * 256, [], 0, {}
    for i, p in enumerate(proto.pieces):
        if p.type == p.BYTE:
            bytes_[int(p.piece[3:5], 16)] = i
            shown.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type == p.NORMAL:
            pieces[p.piece] = (p.score, i)
            shown.append(p.piece.replace(SPACE, " ").encode())
        else:
            unknown = i if p.type == p.UNKNOWN else unknown
            shown.append(b"")
    if not any(bytes_):
        raise ValueError("only models with byte pieces are supported")
    if max(map(len, pieces)) > 32:
        raise ValueError("pieces of more than 32 characters are not supported")
    if len(pieces) >= 1 << PIECE:
        raise ValueError("so many pieces are not supported")
    return Model(kinds[proto.trainer_spec.model_type], pieces, bytes_, unknown, shown, spec.add_dummy_prefix, word_pattern(list(pieces)))


def marked(text: str, model: Model) -> str:
    return (" " + text if model.prefix and text else text).replace(" ", SPACE)


def tokens_of(texts: list[bytes], model: Model) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all marked texts, that is the words of COARSE, and how many each text
    has. Tokens lack their first mark, since nearly all have one; a space stands before
    those that have none."""
    parts = pa.compute.split_pattern(pa.array(texts, pa.large_binary()), b" ")
    flat, counts = parts.flatten(), np.asarray(pa.compute.list_value_length(parts)).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(counts)])
    # Texts with marks of their own, or with spaces beside each other or at an end.
    mark = SPACE.encode()
    odd = np.flatnonzero([not model.prefix or not t or t[:1] == b" " or t[-1:] == b" " or b"  " in t or mark in t for t in texts])
    if not len(odd):
        return flat, counts
    found = [re.findall(COARSE, marked(texts[i].decode("utf-8", "replace"), model)) for i in odd.tolist()]
    own = [(x[1:] if x[0] == SPACE else " " + x).encode() for x in chain.from_iterable(found)]
    first = edges[:-1]
    counts[odd] = np.fromiter(map(len, found), np.int64, len(found))
    first[odd] = len(flat) + np.cumsum(counts[odd]) - counts[odd]
    return pa.concat_arrays([flat, pa.array(own, pa.large_binary())]).take(pa.array(spans(first, counts))), counts


def listed(values: pa.Array) -> list:
    """Python's objects of binary or string values, much faster than by ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


@dataclass
class Spelt:
    """Texts as numbers of distinct tokens, those as numbers of distinct words."""

    words: pa.StringArray
    counts: np.ndarray  # tokens of each text
    token: np.ndarray
    first: np.ndarray  # of each distinct token's words
    size: np.ndarray
    word: np.ndarray


def spelt(texts: list[bytes], model: Model) -> Spelt:
    """The words of a text are those of its tokens, so each distinct token is searched once."""
    find = re.compile(model.pattern).findall
    flat, counts = tokens_of(texts, model)
    coded = flat.dictionary_encode()
    tokens, held = listed(coded.dictionary), pa.compute.match_substring
    # Those that are more than a mark and other characters after it.
    odd = np.asarray(pa.compute.equal(pa.compute.binary_length(coded.dictionary), 0)) | np.asarray(held(coded.dictionary, " ")) | np.asarray(held(coded.dictionary, SPACE))
    plain = [tokens[k] for k in np.flatnonzero(~odd).tolist()] if odd.any() else tokens
    words = find(b" ".join([b"", *plain]).decode("utf-8", "replace").replace(" ", SPACE))
    more = [find(tokens[k][1:].decode() if tokens[k][:1] == b" " else SPACE + tokens[k].decode()) for k in np.flatnonzero(odd).tolist()]
    n = len(words)
    found = pa.array(words + list(chain.from_iterable(more)), pa.string())
    first, size = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
    first[~odd] = np.flatnonzero(np.asarray(pa.compute.starts_with(found.slice(0, n), SPACE)))
    size[~odd] = np.diff(np.append(first[~odd], n))
    size[odd] = np.fromiter(map(len, more), np.int64, len(more))
    first[odd] = n + np.cumsum(size[odd]) - size[odd]
    known = found.dictionary_encode()
    return Spelt(known.dictionary, counts, np.asarray(coded.indices), first, size, np.asarray(known.indices))


# ---- the lattice ------------------------------------------------------------

#: Bytes of text whose words a task holds at once.
BLOCK_BYTES = 3 << 20
#: Bits of an edge's first character, those of its piece's number, those that count the
#: words; and the id that stands for a missing piece.
PLACE, PIECE, TURN, NONE = 26, 20, 17, 0x7FFFFFFF


@dataclass
class Pieces:
    """The piece table by number, best score first; its last row is any other character."""

    texts: list[str]
    length: np.ndarray
    rank: np.ndarray  # equal for equal scores
    id: np.ndarray
    cost: np.ndarray

    @classmethod
    def of(cls, model: Model) -> Pieces:
        rows = sorted(model.pieces.items(), key=lambda x: (-x[1][0], x[0]))
        score = np.array([s for _, (s, _) in rows] + [model.unknown_score])
        return cls(
            [p for p, _ in rows], np.array([len(p) for p, _ in rows] + [1]), np.unique(-score, return_inverse=True)[1].astype(np.int64),
            np.array([i for _, (_, i) in rows] + [NONE]), -score,
        )


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """Edges of each word of (word, members) rows, grouped; rows without a word pass by, in
    their place. Every single character has an edge, if need be to no piece."""
    table = Pieces.of(model)
    # Bounded by the vocabulary: tens of thousands of short rows.
    pieces = words.sparkSession.createDataFrame([(p, k) for k, p in enumerate(table.texts)], "piece string, p int")
    spans = words.selectExpr("monotonically_increasing_id() as at", "word", "if(word is null, 0, char_length(word)) as n", "coalesce(cast(word as binary), members) as carried")
    spans = spans.withColumn("i", F.expr("explode(if(n > 0, sequence(0, n - 1), array(-1)))"))
    spans = spans.withColumn("rest", F.expr(f"if(i < 0, '', substring(word, i + 1, {model.longest}))")).withColumn("l", F.expr("explode(if(i < 0, array(0), sequence(1, char_length(rest))))"))
    spans = spans.withColumn("piece", F.expr("substring(rest, 1, l)"))
    met = spans.join(F.broadcast(pieces), "piece", "left").where("p is not null or l <= 1")
    # Millions of rows go to Python, so they are two columns: one number, and at a word's
    # first edge the word. A negative number marks a row without a word.
    turn = f"at & {(1 << TURN) - 1}L"
    edge = f"shiftleft({turn}, {PLACE + PIECE}) | shiftleft(cast(coalesce(p, {len(table.texts)}) as bigint), {PLACE}) | cast(i as bigint)"
    rows = met.selectExpr(f"if(i < 0, ~({turn}), {edge}) as edge", "if(i <= 0 and l <= 1, carried, null) as carried")
    shape = BPE_EDGES if model.kind == "bpe" else UNIGRAM_EDGES
    arrow = pa.schema([*((f, k) for f, k in shape.items()), *CARRIED.items()])
    struct = T.StructType([T.StructField(f.name, from_arrow(f.type)) for f in arrow])
    edges = bpe_edges if model.kind == "bpe" else unigram_edges

    def run(batches):
        return grouped(batches, table, edges, arrow)

    return rows.mapInArrow(run, struct)


def from_arrow(kind: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)


JOIN = pa.struct([("req", pa.int64()), ("span", pa.int64()), ("risk", pa.int64()), ("at", pa.int64())])
PART = [("k", pa.int32()), ("req", pa.int64()), ("span", pa.int64())]
WIDE = pa.struct([*PART, ("at", pa.int64()), ("better", pa.list_(pa.struct(PART)))])
#: ``at`` is a place (high half) and an id (low half); ``odd``: some character has no piece.
BPE_EDGES = {"word": pa.string(), "n": pa.int32(), "odd": pa.bool_(), "ones": pa.list_(pa.int64()), "joins": pa.list_(JOIN), "wide": pa.list_(WIDE)}
UNIGRAM_EDGES = {"word": pa.string(), "n": pa.int32(), "odd": pa.bool_(), "into": pa.list_(pa.list_(pa.struct([("b", pa.int32()), ("o", pa.float64()), ("id", pa.int32())])))}
CARRIED = {"members": pa.binary()}


def grouped(batches, table: Pieces, edges, arrow: pa.Schema):
    """Rows (edge, carried) to one row per word, in the same order.

    A word's rows follow each other, by place and length: they come from exploding one row
    and from a join that streams them past the piece table. Each edge has the last bits of
    its word's number in the partition, which is that of the row before or the next one, so
    an order that ever was otherwise would be seen, and raises."""
    held: list[pa.RecordBatch] = []
    last = None

    def turns(edge: np.ndarray) -> np.ndarray:
        return np.where(edge < 0, ~edge, edge >> (PLACE + PIECE))

    def emit(rows: pa.Table):
        wordless = np.asarray(rows["edge"]) < 0
        changes = np.flatnonzero(np.diff(wordless)) + 1
        for a, b in zip([0, *changes], [*changes, len(rows)], strict=True):
            part = rows.slice(a, b - a).combine_chunks()
            if wordless[a]:
                out = {"members": part["carried"]} | {c: pa.nulls(len(part), arrow.field(c).type) for c in arrow.names if c != "members"}
            else:
                edge = np.asarray(part["edge"])
                local = np.cumsum(np.concatenate([[0], np.diff(edge >> (PLACE + PIECE)) != 0]))
                out = edges(local, edge >> PLACE & ((1 << PIECE) - 1), edge & ((1 << PLACE) - 1), table)
                out |= {"word": part["carried"].drop_null().cast(pa.string()), "members": pa.nulls(len(out["n"]), CARRIED["members"])}
            columns = [out[f.name] for f in arrow]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], schema=arrow)

    for batch in batches:
        if not len(batch):
            continue
        turn = turns(np.asarray(column(batch, "edge")))
        step = np.diff(turn, prepend=turn[0] if last is None else last) & ((1 << TURN) - 1)
        if (step > 1).any():
            raise RuntimeError("the rows of a word came apart")
        last = turn[-1]
        new = np.flatnonzero(step)
        whole = int(new[-1]) if len(new) else 0  # the last word may go on in the next batch
        if whole:
            yield from emit(pa.Table.from_batches([*held, batch.slice(0, whole)]))
            held = []
        held.append(batch.slice(whole))
    if held:
        yield from emit(pa.Table.from_batches(held))
    give_back()


def outranked(group: np.ndarray, length: np.ndarray, rank: np.ndarray, ties: bool) -> np.ndarray:
    """Whether a longer edge of the same group has a better rank, or with ties an equal one."""
    order = np.argsort(group << 6 | length)[::-1]  # groups downwards, long edges first
    g, r = group[order], rank[order]
    least = np.minimum.accumulate(g << 20 | r)  # a later group starts below all before it
    out = np.zeros(len(g), bool)
    out[order[1:]] = (g[1:] == g[:-1]) & ((least[:-1] & ((1 << 20) - 1)) < r[1:] + ties)
    return out


def bpe_edges(local: np.ndarray, p: np.ndarray, i: np.ndarray, table: Pieces) -> dict:
    """Columns of BPE_EDGES, but for the word: joins best first, then leftmost."""
    length, count = table.length[p], int(local[-1]) + 1
    at = i << 32 | table.id[p]
    one = length == 1
    n = np.bincount(local[one], minlength=count)
    odd = np.bincount(local[one], weights=table.id[p[one]] == NONE, minlength=count) > 0
    own, p, i, length, at_ = local[~one], p[~one], i[~one], length[~one], at[~one]
    rank = table.rank[p]
    # Of equal scores the edge further left comes first, so it outranks one with its end.
    risk = outranked(own << PLACE | i, length, rank, False) | outranked(own << PLACE | (i + length), length, rank, True)
    order = np.argsort(own << 43 | rank << PLACE | i, kind="stable")
    own, i, length, at_, risk, rank = (x[order] for x in (own, i, length, at_, risk, rank))
    long = n[own] > BITS
    start, end = (np.where(long, 0, x) for x in (i, i + length))
    short = ~long
    fields = [(1 << start | 1 << end)[short], ((1 << end) - (2 << start))[short], (risk.astype(np.int64) << 62)[short], at_[short]]
    joins = lists_of(pa.StructArray.from_arrays([pa.array(x) for x in fields], fields=list(JOIN)), np.bincount(own[short], minlength=count))
    wide: list = [None] * count
    for w in np.flatnonzero(n > BITS):
        mine = own == w
        wide[w] = wide_edges(i[mine], length[mine], at_[mine], risk[mine])
    return {"n": pa.array(n.astype(np.int32)), "odd": pa.array(odd), "ones": lists_of(pa.array(at[one]), n), "joins": joins, "wide": pa.array(wide, BPE_EDGES["wide"])}


def wide_edges(i: np.ndarray, length: np.ndarray, at: np.ndarray, risk: np.ndarray) -> list[dict]:
    """Edges of a long word against masks of 32 places: ``k`` is the first mask, and
    ``better`` the better edges around a risky one."""
    off = (i % 32).astype(np.uint64)
    one = np.uint64(1)
    end = off + length.astype(np.uint64)  # at most bit 63: no piece is longer than 32
    req, span = (one << off | one << end).view(np.int64), ((one << end) - (one << off + one)).view(np.int64)
    parts = [{"k": k, "req": r, "span": s} for k, r, s in zip((i // 32).tolist(), req.tolist(), span.tolist(), strict=True)]
    starts, ends, at = i.tolist(), (i + length).tolist(), at.tolist()
    by_start: dict[int, list[int]] = {}
    for e, a in enumerate(starts):
        by_start.setdefault(a, []).append(e)
    out, reach = [], int(length.max(initial=0))
    for e, part in enumerate(parts):
        around: list[int] = []
        if risk[e]:
            around = sorted(c for a in range(max(0, ends[e] - reach), starts[e] + 1) for c in by_start.get(a, ()) if c < e and ends[c] >= ends[e])
        out.append(part | {"at": at[e], "better": [parts[c] for c in around]})
    return out


def unigram_edges(local: np.ndarray, p: np.ndarray, i: np.ndarray, table: Pieces) -> dict:
    """Columns of UNIGRAM_EDGES, but for the word: the edges into each place."""
    length, count = table.length[p], int(local[-1]) + 1
    n = np.bincount(local[length == 1], minlength=count)
    odd = np.bincount(local, weights=table.id[p] == NONE, minlength=count) > 0
    order = np.argsort(local << PLACE | (i + length), kind="stable")
    p, i, key = p[order], i[order], (local << PLACE | (i + length))[order]
    edge = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(table.cost[p]), pa.array(table.id[p].astype(np.int32))], names=["b", "o", "id"])
    into = lists_of(edge, np.unique(key, return_counts=True)[1])  # each place has an edge into it
    return {"n": pa.array(n.astype(np.int32)), "odd": pa.array(odd), "into": lists_of(into, n)}


def lists_of(flat: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


FITS = "({m} & {e}.req) = {e}.req and bit_count({m} & {e}.span) = 1"
ONCE = f"aggregate(joins, shiftleft(1L, n + 1) - 1L, (m, e) -> if({FITS.format(m='m', e='e')}, (m & ~e.span) | e.risk, m))"
ROUNDS = f"""aggregate(sequence(1, n - 1), shiftleft(1L, n + 1) - 1L, (m, _) ->
 m & ~coalesce(get(filter(joins, e -> {FITS.format(m='m', e='e')}), 0).span, 0L))"""
#: The two masks of an array that an edge may touch, and the array once it is applied.
PAIR = "(get({m}, {e}.k) | shiftleft(get({m}, {e}.k + 1), 32))"
JOINED = f"concat(slice({{m}}, 1, {{e}}.k), array({PAIR} & ~{{e}}.span & 4294967295L, shiftrightunsigned({PAIR} & ~{{e}}.span, 32)), slice({{m}}, {{e}}.k + 3, size({{m}})))"
FULL = "transform(sequence(0, cast(n div 32 as int) + 2), k -> if(k * 32 > n, 0L, if(k * 32 + 31 <= n, 4294967295L, shiftleft(1L, n + 1 - k * 32) - 1L)))"


def wide_fold() -> str:
    """One pass over the edges of a long word; an applied edge is followed by the better
    ones that it makes fit, best first, until none does."""
    fits = lambda m, e: FITS.format(m=PAIR.format(m=m, e=e), e=e)
    first = f"slice(filter(e.better, b -> {fits('q', 'b')}), 1, 1)"
    again = f"aggregate(e.better, {JOINED.format(m='m', e='e')}, (q, _) -> aggregate({first}, q, (z, c) -> {JOINED.format(m='z', e='c')}))"
    return f"aggregate(wide, {FULL}, (m, e) -> if({fits('m', 'e')}, {again}, m))"


BEST = """aggregate(into, array(named_struct('s', 0D, 'b', 0, 'id', 0)), (best, edges) -> concat(best, array(
 array_max(transform(edges, e -> named_struct('s', best[e.b].s - e.o, 'b', e.b, 'id', e.id))))))"""
BACK = """aggregate(sequence(1, n), named_struct('p', n, 'ats', cast(array() as array<bigint>)), (x, _) -> if(x.p = 0, x,
 named_struct('p', best[x.p].b, 'ats', concat(array(shiftleft(cast(best[x.p].b as bigint), 32) | best[x.p].id), x.ats)))).ats"""


def computed(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns beside those that are always carried, worked out once: without
    this step the optimiser would put a column's expression into each lambda that names
    it, to be worked out again for every element."""
    return rows.select("word", *CARRIED, F.inline(F.array(F.struct("n", "odd", *names))))


def coded(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids, members) of (word, members) rows; rows without a word keep their place
    among the others."""
    rows = lattice(words, model)
    if model.kind == "bpe":
        rows = computed(rows.withColumns({"mask": F.expr(f"if(n <= {BITS}, {ONCE}, null)"), "masks": F.expr(f"if(n > {BITS}, {wide_fold()}, null)")}), "ones", "joins", "wide", "mask", "masks")
        rows = computed(rows.withColumn("mask", F.expr(f"if(mask >= {1 << 62}L, {ROUNDS}, mask)")), "ones", "joins", "wide", "mask", "masks")
        # The edges of the path: both ends are starts, and no place within.
        own = "concat(filter(ones, a -> (shiftright(mask, cast(shiftright(a, 32) as int)) & 3) = 3), transform(filter(joins, e -> (mask & (e.req | e.span)) = e.req), e -> e.at))"
        limb = "cast(shiftright(a, 37) as int)"
        alone = f"(shiftright(get(masks, {limb}) | shiftleft(get(masks, {limb} + 1), 32), cast(shiftright(a, 32) % 32 as int)) & 3) = 3"
        far = f"concat(filter(ones, a -> {alone}), transform(filter(wide, e -> ({PAIR.format(m='masks', e='e')} & (e.req | e.span)) = e.req), e -> e.at))"
        rows = rows.withColumn("ats", F.expr(f"sort_array(if(n <= {BITS}, {own}, {far}))"))
    else:
        rows = computed(rows.withColumn("best", F.expr(BEST)), "best").withColumn("ats", F.expr(BACK))
    rows = computed(rows, "ats")
    byte_ids = f"array({','.join(map(str, model.bytes_))})"
    text = "hex(substring(word, cast(shiftright(a, 32) as int) + 1, 1))"
    raw = f"transform(sequence(0, cast(length({text}) div 2 as int) - 1), b -> {byte_ids}[int(conv(substring({text}, b * 2 + 1, 2), 16, 10))])"
    # Byte pieces are rare; only words that have them pay for the longer expression.
    ids = f"if(odd, flatten(transform(ats, a -> if((a & {NONE}L) = {NONE}L, {raw}, array(cast(a & {NONE}L as int))))), transform(ats, a -> cast(a & {NONE}L as int)))"
    return rows.select("word", F.expr(ids).alias("ids"), *CARRIED)


# ---- documents --------------------------------------------------------------


def packed(numbers: np.ndarray, text: bytes = b"") -> bytes:
    """Numbers and a text, compressed; :func:`unpacked` takes them back."""
    body = np.ascontiguousarray(numbers, "<i4").tobytes()
    raw = len(numbers).to_bytes(8, "little") + body + text
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    end = 8 + 4 * int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw[8:end], "<i4"), raw[end:]


def dealt(words: pa.StringArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the words by bucket, the buckets that have some, where each begins in that
    order, and a checksum of each one's words."""
    crc = np.fromiter(map(zlib.crc32, listed(words.cast(pa.binary()))), np.int64, len(words))
    order = np.argsort(crc % buckets, kind="stable")
    own, first = np.unique((crc % buckets)[order], return_index=True)
    return order, own, first, np.bitwise_xor.reduceat(crc[order], first) if len(words) else crc


def block_words(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(bucket, block, mark, words): the distinct words of each block, packed by bucket."""
    struct = T._parse_datatype_string("bucket int, block bigint, mark bigint, words binary")
    arrow = arrow_schema(struct)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @without_cycles
    def run(batches):
        for block, _, texts in blocks(batches, BLOCK_BYTES):
            distinct = spelt(texts, shared.value).words
            order, own, first, mark = dealt(distinct, buckets)
            held = distinct.take(pa.array(order)).cast(pa.binary())
            size = np.asarray(pa.compute.binary_length(held))
            ends, text = np.concatenate([[0], np.cumsum(size)]), b"".join(listed(held))
            parts = [packed(size[a:b], text[ends[a] : ends[b]]) for a, b in zip(first, [*first[1:], len(held)], strict=True)] if len(held) else []
            yield record({"bucket": own, "block": np.full(len(own), block), "mark": mark, "words": parts}, arrow)

    return docs.mapInArrow(run, struct)


def told_apart(rows: DataFrame) -> DataFrame:
    """From packed rows, those of a bucket together: each distinct word of a bucket, then
    for each block of it a row without a word, whose members are the bucket, the checksum
    and the block, then the block's words by their number in the bucket."""
    struct = T._parse_datatype_string("word string, members binary")
    arrow = arrow_schema(struct)

    def flush(bucket: int, parts: list[tuple[int, int]], words: list[pa.Array]):
        coded = pa.chunked_array(words).dictionary_encode().unify_dictionaries()
        known = coded.chunk(0).dictionary
        for i in range(0, len(known), 1 << 14):
            own = known[i : i + (1 << 14)]
            yield record({"word": own, "members": pa.nulls(len(own), pa.binary())}, arrow)
        held, size = [], 0
        for (block, mark), x in zip(parts, coded.chunks, strict=True):
            held.append(np.array([bucket, mark, block], "<i8").tobytes() + np.asarray(x.indices).astype("<i4").tobytes())
            size += len(held[-1])
            if size > 1 << 20:
                yield record({"word": [None] * len(held), "members": held}, arrow)
                held, size = [], 0
        if held:
            yield record({"word": [None] * len(held), "members": held}, arrow)

    @without_cycles
    def run(batches):
        now, parts, words = None, [], []
        for batch in batches:
            for bucket, block, mark, data in zip(*(column(batch, c).to_pylist() for c in ("bucket", "block", "mark", "words")), strict=True):
                if bucket != now:
                    if parts:
                        yield from flush(now, parts, words)
                    now, parts, words = bucket, [], []
                size, text = unpacked(data)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                parts.append((block, mark))
                words.append(pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(text)))
        if parts:
            yield from flush(now, parts, words)
        parts, words = [], []
        give_back()

    return rows.mapInArrow(run, struct)


def block_ids(rows: DataFrame) -> DataFrame:
    """(block, bucket, mark, ids) of coded rows: the ids of a block's words of one bucket,
    packed with how many each word has."""
    struct = T._parse_datatype_string("block bigint, bucket int, mark bigint, ids binary")
    arrow = arrow_schema(struct)

    def run(batches):
        held: list[pa.Array] = []
        sizes = first = flat = None  # of the bucket's words, once its blocks come
        for batch in batches:
            members, ids = column(batch, "members"), column(batch, "ids")
            wordless = np.asarray(pa.compute.is_valid(members))
            turns = np.flatnonzero(np.diff(wordless)) + 1
            for a, b in zip([0, *turns], [*turns, len(batch)], strict=True):
                if a == b:
                    continue
                if not wordless[a]:
                    held, sizes = held if sizes is None else [], None
                    held.append(ids.slice(a, b - a))
                    continue
                if sizes is None:
                    sizes = np.concatenate([np.asarray(pa.compute.list_value_length(x)) for x in held]).astype(np.int64)
                    first, flat = np.cumsum(sizes) - sizes, np.concatenate([np.asarray(x.flatten()) for x in held])
                out: dict[str, list] = {c: [] for c in arrow.names}
                for data in members.slice(a, b - a).to_pylist():
                    (bucket, mark, block), at = np.frombuffer(data[:24], "<i8").tolist(), np.frombuffer(data[24:], "<i4")
                    own = np.concatenate([[len(at)], sizes[at], flat[spans(first[at], sizes[at])]])
                    for c, x in zip(arrow.names, (block, bucket, mark, packed(own)), strict=True):
                        out[c].append(x)
                yield record(out, arrow)
        held = sizes = first = flat = None
        give_back()

    return rows.mapInArrow(run, struct)


def encode(docs: DataFrame, data: bytes, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (unsigned; little-endian 32-bit ids), decoded_crc32,
    text_crc32, round_trip, and the ids themselves of every whole text.

    The Viterbi fold runs for unigram models, the fold in merge order for BPE models (as
    the registered query's); both give what the model's own library gives.

    Edge cases: a null or empty text has no piece; any character is coded, by bytes where
    no piece has it; long words and texts are coded whole; repeated rows are coded each;
    an empty table gives no rows.
    """
    spark, model = docs.sparkSession, load(data)
    plain = ids_and_text(docs)
    # An explicit number of partitions: words are short, what is made of them is not.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 4 * parts
    met = block_words(plain, model, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
    folder = fresh_folder(spark, "block_ids")
    write_by_block(block_ids(coded(told_apart(met), model)), folder)
    shared = spark.sparkContext.broadcast(model)
    struct = T._parse_datatype_string("doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, text_crc32 bigint, round_trip boolean" + (", ids array<int>" if with_ids else ""))
    arrow = arrow_schema(struct)

    def table(block: int, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each of the block's words has, all ids, and each word's place there."""
        own = read_block(folder, block)
        order, at, first, mark = dealt(words, buckets)
        rows = sorted(zip(*(own[c].to_pylist() for c in ("bucket", "mark", "ids")), strict=True)) if own is not None else []
        parts_ = [unpacked(x)[0] for _, _, x in rows]
        if [(b, m, x[0]) for (b, m, _), x in zip(rows, parts_, strict=True)] != list(zip(at.tolist(), mark.tolist(), np.diff([*first, len(words)]).tolist(), strict=True)):
            raise RuntimeError("the input's partitions changed between two reads; write it first")
        none = np.zeros(0, np.int32)
        sizes, flat = np.concatenate([none, *(x[1 : 1 + x[0]] for x in parts_)]).astype(np.int64), np.concatenate([none, *(x[1 + x[0] :] for x in parts_)])
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return sizes, flat.astype(np.uint32), place

    @without_cycles
    def run(batches):
        shown = Decoder(shared.value)
        for block, batch, texts in blocks(batches, BLOCK_BYTES):
            own = spelt(texts, shared.value)
            sizes, flat_table, place = table(block, own.words)
            at = place[own.word]  # from here to the ids of the distinct tokens, then to those of the texts
            flat = flat_table[spans((np.cumsum(sizes) - sizes)[at], sizes[at])]
            ends = np.concatenate([[0], np.cumsum(sizes[at])])
            first, last = ends[own.first], ends[own.first + own.size]
            sizes = (last - first)[own.token]
            flat = flat[spans(first[own.token], sizes)]
            edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(own.counts)])]
            raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            decoded = [shown.text(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            out = {
                "doc_id": column(batch, "doc_id"), "n_pieces": np.diff(edges), "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1], edges[1:], strict=True)],
                "decoded_crc32": [zlib.crc32(x) for x in decoded], "text_crc32": [zlib.crc32(x) for x in texts], "round_trip": [x == y for x, y in zip(decoded, texts, strict=True)],
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield record(out, arrow)

    return plain.mapInArrow(run, struct)


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Decoder:
    """Ids to bytes by one gather."""

    def __init__(self, model: Model):
        self.flat = np.frombuffer(b"".join(model.shown), np.uint8)
        self.sizes = np.array(list(map(len, model.shown)))
        self.first, self.prefix = np.cumsum(self.sizes) - self.sizes, model.prefix

    def text(self, ids: np.ndarray) -> bytes:
        out = self.flat[spans(self.first[ids], self.sizes[ids])].tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out


def decode(encoded: DataFrame, data: bytes, ids: str = "ids") -> DataFrame:
    """Adds ``text``, decoded from ids; damaged UTF-8 is replaced; null ids give null."""
    model = load(data)
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    struct = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        shown = Decoder(shared.value)
        for batch in batches:
            texts = [None if x is None else shown.text(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in column(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, struct)
