"""Order-dependent plans as folds of higher-order functions: chunks, batches, paces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revoicer.config import Config

LADDER = ((0.0, 1.0), (5.0, 1.0), (10.0, 1.0), (10.0, 0.5), (15.0, 0.5))


def plan_chunks(duration: Column, cuts: Column, max_s: float = 30.0, min_s: float = 1.0) -> Column:
    """``array<struct<idx, start_s, end_s, cut_source>>`` of chunks of at most max_s.

    cuts are the middles of silences. With k chunks still to come, a cut is wanted near an
    even split and must leave no more than the rest can hold; without one, the chunk ends
    hard at max_s. The number of chunks is known beforehand, so the fold is finite.
    """
    k = F.greatest(F.lit(1), F.ceil(duration / max_s)).cast("int")
    none = F.expr("cast(array() as array<struct<idx:int,start_s:double,end_s:double,cut_source:string>>)")
    chunk = lambda i, a, b, how: F.struct(i.cast("int").alias("idx"), a.cast("double").alias("start_s"), b.cast("double").alias("end_s"), how.alias("cut_source"))

    def step(s: Column, i: Column) -> Column:
        rest = duration - s["cur"]
        left = F.ceil(rest / max_s)
        target = s["cur"] + rest / left
        low, high = F.greatest(s["cur"] + min_s, duration - max_s * (left - 1)), s["cur"] + max_s
        inside = F.filter(cuts, lambda c: (c > 0) & (c < duration) & (c >= low) & (c <= high))
        best = F.array_min(F.transform(inside, lambda c: F.struct(F.abs(c - target).alias("d"), c.alias("c"))))
        end = F.coalesce(best["c"], high)
        how = F.when(best.isNull(), F.lit("hard")).otherwise(F.lit("silence"))
        more = F.struct(end.cast("double").alias("cur"), F.concat(s["out"], F.array(chunk(i, s["cur"], end, how))).alias("out"))
        last = F.struct(duration.cast("double").alias("cur"), F.concat(s["out"], F.array(chunk(i, s["cur"], duration, F.lit("eof")))).alias("out"))
        return F.when(s["cur"] >= duration, s).when(rest > max_s, more).otherwise(last)

    start = F.struct(F.lit(0.0).alias("cur"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), k), start, step, lambda s: s["out"])


def hard_cuts(chunks: Column) -> Column:
    return F.size(F.filter(chunks, lambda c: c["cut_source"] == "hard"))


def plan_adaptive(media: DataFrame, silences_at: DataFrame, config: Config = Config()) -> DataFrame:
    """The first level of the ladder without a hard cut, else that with fewest.

    media: m, duration_s. silences_at: m, level (0..4), cuts array<double>, as detected at
    the level's threshold and least length. Adds accepted, chunks, hard_cuts, attempts.
    """
    plans = media.join(silences_at, "m").withColumn("chunks", plan_chunks(F.col("duration_s"), F.coalesce("cuts", F.expr("array(0D)")), config.max_chunk_s, config.min_chunk_s)).withColumn("hard_cuts", hard_cuts(F.col("chunks")))
    best = plans.groupBy("m", "duration_s").agg(F.min_by(F.struct("level", "chunks", "hard_cuts"), F.struct("hard_cuts", "level")).alias("x"), F.array_sort(F.collect_list(F.struct("level", "hard_cuts"))).alias("all"))
    tried = F.filter("all", lambda a: (a["level"] <= F.col("x.level")) | (F.col("x.hard_cuts") > 0))
    return best.select("m", "duration_s", F.col("x.level").alias("accepted"), F.col("x.chunks").alias("chunks"), F.col("x.hard_cuts").alias("hard_cuts"), tried.alias("attempts"))


def ladder_levels(config: Config = Config()) -> list[tuple[int, float, float]]:
    """(level, threshold in dB, least silence in s) of the five attempts."""
    return [(i, config.silence_db + up, config.min_silence_s if factor == 1.0 else max(0.1, config.min_silence_s * factor)) for i, (up, factor) in enumerate(LADDER)]


def plan_batches(lines: Column, cap: int = 1000, fill: float = 0.8, most: int = 12, overhead: int = 7, alone: bool = False) -> Column:
    """Batch number of each line, greedily: ``lines`` is an ordered array of character
    counts; a line longer than the cap raises, or with ``alone`` is a batch of its own."""
    budget = int(cap * fill)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(0).alias("g"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(s: Column, length: Column) -> Column:
        checked = length if alone else F.when(length > cap, F.raise_error(F.lit("a line is longer than the cap")).cast("int")).otherwise(length)
        cost = checked + overhead
        close = (s["n"] > 0) & ((s["used"] + cost > budget) | (s["n"] >= most))
        g = s["g"] + close.cast("int")
        return F.struct((F.when(close, 0).otherwise(s["used"]) + cost).cast("int").alias("used"), (F.when(close, 0).otherwise(s["n"]) + 1).cast("int").alias("n"), g.alias("g"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.aggregate(lines, start, step, lambda s: s["out"])


def batches(segments: DataFrame, cap: int = 1000, fill: float = 0.8, most: int = 12, context: int = 2, text: str = "text") -> DataFrame:
    """m, batch, payload ids, context ids (trimmed to the cap, nearest first) and line ids. A
    line longer than the cap is a batch of its own, without context: ``pieces`` cuts it."""
    own = segments.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("id", F.char_length(F.trim(text)).alias("n")))).alias("rows"))
    g = plan_batches(F.transform("rows", lambda r: r["n"]), cap, fill, most, alone=True)
    lines = own.select("m", F.posexplode(F.arrays_zip("rows", g.alias("g"))).alias("at", "x")).select("m", F.col("x.g").alias("batch"), F.struct("at", "x.rows.id", "x.rows.n").alias("x"))
    w = Window.partitionBy("m").orderBy("x.at")
    beside = lambda fn: F.slice(F.array(*[fn("x", d).over(w) for d in range(1, max(1, context) + 1)]), 1, context)
    lines = lines.withColumns({"before": beside(F.lag), "after": beside(F.lead)})
    own = lines.groupBy("m", "batch").agg(F.array_sort(F.collect_list("x")).alias("payload"), F.min_by("before", "x.at").alias("before"), F.max_by("after", "x.at").alias("after"))
    low, high = F.col("payload")[0]["at"], F.element_at("payload", -1)["at"]
    near = F.filter(F.concat("before", "after"), lambda x: x.isNotNull())
    # A sort by distance then place; a line that does not fit is left out, later ones may fit.
    by_distance = F.array_sort(F.transform(near, lambda x: F.struct(F.greatest(low - x["at"], x["at"] - high).alias("d"), x["at"].alias("at"), x["id"].alias("id"), x["n"].alias("n"))))
    used = F.aggregate("payload", F.lit(0), lambda a, x: (a + x["n"] + 7).cast("int"))
    start = F.struct(used.cast("int").alias("used"), F.expr("cast(array() as array<bigint>)").alias("ids"))

    def take(s: Column, x: Column) -> Column:
        fits = s["used"] + x["n"] + 7 <= cap
        return F.struct((s["used"] + F.when(fits, x["n"] + 7).otherwise(0)).cast("int").alias("used"), F.when(fits, F.concat(s["ids"], F.array(x["id"].cast("long")))).otherwise(s["ids"]).alias("ids"))

    chosen = F.array_sort(F.aggregate(by_distance, start, take, lambda s: s["ids"]))
    ids = F.transform("payload", lambda x: x["id"].cast("long"))
    return own.select("m", "batch", ids.alias("payload_ids"), chosen.alias("context_ids"), F.array_sort(F.concat(ids, chosen)).alias("line_ids"))


def pieces(text: Column, cap: int) -> Column:
    """``array<struct<text, gap>>``: a text in pieces of at most cap characters, cut where
    white space is (which is the gap after a piece), or hard within a word beyond the cap."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(?:\S.{{0,{cap - 1}}}(?<=\S)(?=\s|\z)|\S{{{cap}}})\s*"), F.lit(0))
    cut = F.transform(found, lambda x: F.struct(F.regexp_replace(x, r"\s+\z", "").alias("text"), F.regexp_extract(x, r"(\s*)\z", 1).alias("gap")))
    return F.when(F.char_length(text) > cap, cut).otherwise(F.array(F.struct(text.alias("text"), F.lit("").alias("gap"))))


def render_batch(texts: Column) -> Column:
    """One line bare, several as ``[n] text``."""
    many = F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.trim(x))), "\n")
    return F.when(F.size(texts) == 1, F.trim(texts[0])).otherwise(many)


MARKER = r"[\[\(]\s*(\p{Nd}+)\s*[\]\)]"


def parse_batch(reply: Column, n: Column) -> Column:
    """The n texts of a reply; null unless its markers are 1..n in order and no text is empty."""
    ascii_digits = lambda x: F.translate(x, "०१२३४५६७८९", "0123456789")
    found = F.transform(F.regexp_extract_all(reply, F.lit(MARKER), 1), lambda x: ascii_digits(x).cast("int"))
    texts = F.transform(F.slice(F.split(reply, MARKER), 2, F.lit(1 << 20)), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    ordered = (F.size(found) == n) & F.forall(F.zip_with(found, F.sequence(F.lit(1), n), lambda a, b: a.eqNullSafe(b)), lambda x: x)
    several = F.when(ordered & ~F.exists(texts, lambda x: x == ""), texts)
    one = F.trim(reply)
    return F.when(n == 1, F.when(one != "", F.array(one))).otherwise(several)


def fit_loop(target: Column, base: Column, elastic: Column, config: Config = Config()) -> Column:
    """The duration-fit loop against a synthesiser of duration base / pace^elastic:
    struct<paces, durations, stop_reason, clamped, converged, shipped, achieved>."""
    low, high = config.pace_min, config.pace_max
    empty = F.expr("cast(array() as array<double>)")
    start = F.struct(F.lit(1.0).alias("pace"), empty.alias("paces"), empty.alias("durations"), F.lit(False).alias("clamped"), F.lit(None).cast("string").alias("stop"))

    def step(s: Column, i: Column) -> Column:
        duration = base / F.pow(s["pace"], elastic)
        ratio = F.when(target <= 0, F.lit(0.0)).otherwise(duration / target)
        wanted = s["pace"] * ratio
        following = F.least(F.greatest(wanted, F.lit(low)), F.lit(high))
        clamped_now = F.abs(wanted - following) > 1e-9
        within = ratio.between(config.fit_low, config.fit_high)
        small = F.abs(following - s["pace"]) < config.fit_min_step
        stop = F.when(within, F.lit("converged")).when(F.lit(not config.fit_enabled), F.lit("fit_disabled")).when(i >= config.fit_attempts, F.lit("max_attempts"))
        stop = F.coalesce(stop, F.when(small & clamped_now, F.lit("pinned_at_clamp")).when(small, F.lit("pace_step_below_threshold")))
        sticky = s["clamped"] | (~within & F.lit(config.fit_enabled) & (i < config.fit_attempts) & clamped_now)
        done = F.struct(following.alias("pace"), F.concat(s["paces"], F.array(s["pace"])).alias("paces"), F.concat(s["durations"], F.array(duration)).alias("durations"), sticky.alias("clamped"), stop.alias("stop"))
        return F.when(s["stop"].isNotNull(), s).otherwise(done)

    def finish(s: Column) -> Column:
        off = F.transform(s["durations"], lambda d, i: F.struct(F.abs(F.when(target <= 0, F.lit(0.0)).otherwise(d / target) - 1).alias("off"), i.alias("i")))
        best = F.array_min(off)["i"] + 1
        return F.struct(s["paces"].alias("paces"), s["durations"].alias("durations"), s["stop"].alias("stop_reason"), s["clamped"].alias("clamped"), (s["stop"] == "converged").alias("converged"), best.alias("shipped"), F.element_at(s["durations"], best).alias("achieved"), F.element_at(s["paces"], best).alias("final_pace"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(config.fit_attempts)), start, step, finish)
