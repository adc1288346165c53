"""Queries of the engine's operators over the driver's tables, each with its SQL twin
where SQL can say it. Numbers are shown as bigint or as doubles of six places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revoicer.config import Config
from revoicer.functions import scalar as S
from revoicer.functions import text as X
from revoicer.operators import audit, cache, calls, folds, pcm, qc, stats, timeline
from revoicer.operators import segments as seg
from revoicer.plans import fixtures as fx
from revoicer.streaming import calls as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}

EVENTS = ("click", "error", "purchase", "signup", "view")

# ---- SQL of the fixtures ----------------------------------------------------

SEG = """seg AS (SELECT conv_id AS m, turn::BIGINT AS id, text, role AS speaker, length(text) AS n, sum(length(text)) OVER w AS stop,
 (sum(length(text)) OVER w - length(text)) / 15e0 AS "start", sum(length(text)) OVER w / 15e0 AS "end" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
MEDIA = "media AS (SELECT conv_id AS m, sum(length(text)) / 15e0 AS duration_s FROM conversations GROUP BY 1)"
SIL = """sil AS (SELECT m, (stop * 2 - CASE WHEN id % 3 = 0 THEN 12 ELSE 5 END) / 30e0 AS start_s, stop * 2 / 30e0 AS end_s FROM seg WHERE n > 12)"""
PTS = "pts AS (SELECT DISTINCT event_id % 97 AS m, event_id * 7919 % 12000 / 100e0 AS t FROM events)"
FITS = """fits AS (SELECT l_orderkey AS m, l_linenumber AS segment_id, l_quantity AS target, l_extendedprice / 1000 * (1 - l_discount) AS achieved, l_extendedprice / 1000 AS baseline,
 1 + l_tax AS final_pace, l_linenumber % 3 + 1 AS attempts, l_linenumber = 1 AS clamped, l_linenumber > 3 AS converged, l_returnflag, l_linestatus FROM lineitem)"""
CALLS = "calls AS (SELECT event_type AS stage, user_id, value AS latency_s, event_id % 3 = 0 AS cache_hit, ceil(value) * 20e0 / 10000 AS cost FROM events)"
PAIRS = r"""pairs AS (SELECT m, segment_id, r, h FROM (SELECT conv_id AS m, turn AS segment_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS r,
 trim(regexp_replace(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[^a-z0-9]+', ' ', 'g')) AS h FROM conversations) WHERE h IS NOT NULL AND r <> '')"""
SIG = "sig AS (SELECT vec_id AS m, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 20000)::INTEGER) AS s FROM embeddings)"
PLACED = """placed AS (SELECT m, id AS segment_id, "start" AS window_start_s, "end" AS window_end_s, "start" AS placed_start_s, n * CASE WHEN id % 4 = 1 THEN 5 ELSE 3 END / 60e0 AS duration_s FROM seg)"""


def shown(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, others to six places, arrays as text."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(c, 6).alias(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema.fields])


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, d: shown(fn(spark, d))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(*exprs: str) -> str:
    """SQL select items ``round(expr, 6) AS name`` from ``expr=name``."""
    return ", ".join(f"round(({e.rsplit('=', 1)[0]})::DOUBLE, 6) AS {e.rsplit('=', 1)[1]}" for e in exprs)


def block_sql(v: str, p: str) -> str:
    return r6(f"avg({v})={p}_mean", f"quantile_cont({v}, 0.5)={p}_p50", f"quantile_cont({v}, 0.95)={p}_p95", f"max({v})={p}_max") + f", count(*) FILTER ({v} > 5.0) AS {p}_over"


# ---- statistics -------------------------------------------------------------


@query(f"WITH {FITS}, d AS (SELECT l_returnflag, CASE WHEN target <= 0 THEN 0 ELSE abs(achieved - target) / target * 100 END AS x FROM fits) SELECT l_returnflag, count(*) AS n, {block_sql('x', 'drift')} FROM d GROUP BY 1")
def drift_block(spark, d):
    return stats.drift_block(fx.fits(spark, d), ["l_returnflag"])


@query(f"""WITH {FITS}, d AS (SELECT l_linestatus, abs(baseline - target) / target * 100 AS b, abs(achieved - target) / target * 100 AS a, (achieved - target) / target * 100 AS s,
 greatest(0, (baseline - target) / target * 100) AS ob, greatest(0, (achieved - target) / target * 100) AS oa, attempts, final_pace, clamped, converged FROM fits)
 SELECT l_linestatus, count(*) AS n, {block_sql('b', 'before')}, {block_sql('a', 'after')}, {r6('avg(ob) FILTER (ob > 0)=overrun_before_mean', 'avg(oa) FILTER (oa > 0)=overrun_after_mean')},
 count(*) FILTER (ob > 0) AS overrun_before, count(*) FILTER (oa > 0) AS overrun_after, count(*) FILTER (s > 0) AS running_over, count(*) FILTER (s < 0) AS running_under, {r6('avg(s)=signed_mean')},
 count(*) FILTER (a < b) AS improved, count(*) FILTER (a > b) AS worsened, {r6('avg(attempts)=attempts_mean', 'avg(final_pace)=pace_mean')}, count(*) FILTER (clamped) AS clamped, count(*) FILTER (converged) AS converged,
 {r6('avg(b) - avg(a)=delta', '(avg(b) - avg(a)) / avg(b) * 100=reduction_pct', 'count(*) FILTER (clamped) * 100e0 / count(*)=clamped_pct', 'count(*) FILTER (converged) * 100e0 / count(*)=converged_pct')}, count(*) < 20 AS small_sample FROM d GROUP BY 1""")
def duration_fit_stats(spark, d):
    return stats.duration_fit_stats(fx.fits(spark, d), ["l_linestatus"])


@query(f"WITH {CALLS}, dim AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'never']) AS stage) SELECT dim.stage, count(calls.stage) AS n FROM dim LEFT JOIN calls ON dim.stage = calls.stage AND NOT cache_hit GROUP BY 1")
def calls_by_stage(spark, d):
    return stats.calls_by_stage(fx.calls(spark, d), (*EVENTS, "never"))


@query(f"""WITH {CALLS} SELECT stage, {r6('sum(CASE WHEN cache_hit THEN 0 ELSE cost END)=cost_inr', 'sum(CASE WHEN cache_hit THEN cost ELSE 0 END)=cost_avoided_inr')},
 count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses, {r6('count(*) FILTER (cache_hit) / count(*)::DOUBLE=hit_rate')} FROM calls GROUP BY 1""")
def cost_summary(spark, d):
    return stats.cost_summary(fx.calls(spark, d), ["stage"])


@query(f"WITH {CALLS} SELECT user_id, {r6(*[f'sum(latency_s) FILTER (stage = {chr(39)}{s}{chr(39)})={s}_s' for s in EVENTS])} FROM calls GROUP BY 1")
def stage_latency(spark, d):
    return stats.stage_latency(fx.calls(spark, d), ["user_id"], EVENTS)


@query(f"WITH {CALLS} SELECT stage, {r6('quantile_cont(latency_s, 0.5)=p50', 'quantile_cont(latency_s, 0.95)=p95', 'quantile_cont(latency_s, 0.99)=p99', 'avg(latency_s)=mean')} FROM calls GROUP BY 1")
def percentiles_by_stage(spark, d):
    return stats.grouped(fx.calls(spark, d), ["stage"], *[stats.Percentile(f"p{p}", "latency_s", p) for p in (50, 95, 99)], F.avg("latency_s").alias("mean"))


@query(f"WITH {CALLS} SELECT stage, {r6('min(latency_s)=least', 'max(latency_s)=most', 'avg(latency_s)=mean', 'stddev_samp(latency_s)=stdev', 'max(latency_s) - min(latency_s)=spread', '(max(latency_s) - min(latency_s)) / avg(latency_s) * 100=spread_pct')}, count(DISTINCT latency_s) = 1 AS identical FROM calls GROUP BY 1")
def variance_probe(spark, d):
    return stats.variance_probe(fx.calls(spark, d), ["stage"], "latency_s")


@query("""WITH s AS (SELECT p_brand, 1 + p_size / 50e0 AS pace, max(p_retailprice / 100) AS duration_s FROM part GROUP BY 1, 2)
 SELECT p_brand, round(pace, 6) AS pace, round(duration_s, 6) AS duration_s, round(ln(duration_s / lag(duration_s) OVER w) / ln(pace / lag(pace) OVER w), 6) AS elasticity, duration_s < lag(duration_s) OVER w AS falls, round(duration_s * pace, 6) AS product FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY pace)""")
def pace_elasticity(spark, d):
    sweep = fx.table(spark, d, "part").groupBy("p_brand", (1 + F.col("p_size") / 50.0).alias("pace")).agg(F.max(F.col("p_retailprice") / 100).alias("duration_s"))
    return stats.elasticity(sweep, ["p_brand"])


@query("""WITH s AS (SELECT n_regionkey, n_nationkey, sum(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
 SELECT n_regionkey::BIGINT AS n_regionkey, n_nationkey::BIGINT AS n_nationkey, round(v, 6) AS v, round(v / sum(v) OVER w * 100, 6) AS share_pct, round(v / max(v) OVER w, 6) AS bar, abs(v - avg(v) OVER w) / avg(v) OVER w > 0.05 AS strays FROM s WINDOW w AS (PARTITION BY n_regionkey)""")
def stage_shares(spark, d):
    own = fx.table(spark, d, "supplier").join(fx.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.sum("s_acctbal").alias("v"))
    return stats.shares(own, ["n_regionkey"], "v")


# ---- scalars ----------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS t, p_retailprice / 37 AS a FROM part)
 SELECT p_partkey, round(abs(a - t) / t * 100, 6) AS drift, round((a - t) / t * 100, 6) AS signed, round(greatest(0, (a - t) / t * 100), 6) AS overrun, round(a / t, 6) AS ratio,
 round(least(greatest(a / t, 0.85), 1.25), 6) AS pace, abs(least(greatest(a / t, 0.85), 1.25) - a / t) > 1e-9 AS clamped, round(a / t * 100, 6) AS fill, (a / t BETWEEN 0.95 AND 1.05) AS within FROM p""")
def drift_scalars(spark, d):
    t, a = F.col("p_size").cast("double"), F.col("p_retailprice") / 37
    ratio = S.fit_ratio(a, t)
    return fx.table(spark, d, "part").select("p_partkey", S.drift_pct(a, t).alias("drift"), S.signed_drift_pct(a, t).alias("signed"), S.overrun_pct(a, t).alias("overrun"), ratio.alias("ratio"), S.clamp(ratio, 0.85, 1.25).alias("pace"), S.was_clamped(ratio, 0.85, 1.25).alias("clamped"), S.fill_pct(a, t).alias("fill"), ratio.between(0.95, 1.05).alias("within"))


@query("SELECT event_id, round(ceil(greatest(0, value)) * 30e0 / 3600, 6) AS stt, round(ceil(greatest(0, value)) * 45e0 / 3600, 6) AS stt_diarized, round(length(props) * 20e0 / 10000, 6) AS translate, round(length(props) * 30e0 / 10000, 6) AS tts FROM events")
def call_costs(spark, d):
    chars = F.char_length("props").cast("double")
    return fx.table(spark, d, "events").select("event_id", S.stt_cost(F.col("value")).alias("stt"), S.stt_cost(F.col("value"), True).alias("stt_diarized"), S.translate_cost(chars).alias("translate"), S.tts_cost(chars).alias("tts"))


@query(f"""WITH {SEG} SELECT m, id, round_even("start" * 16000, 0)::BIGINT AS first, round_even("end" * 16000, 0)::BIGINT AS stop,
 lpad(floor("start" / 60)::BIGINT::VARCHAR, 2, '0') || ':' || printf('%06.3f', "start" - floor("start" / 60) * 60) AS at FROM seg""")
def frames_and_timestamps(spark, d):
    return fx.segments(spark, d).select("m", "id", S.frames(F.col("start"), 16000).alias("first"), S.frames(F.col("end"), 16000).alias("stop"), S.timestamp(F.col("start")).alias("at"))


@query(f"""WITH {SEG}, {PLACED} SELECT m, segment_id, round(placed_start_s + 0.125, 6) AS placed, round(window_end_s - window_start_s, 6) AS window_s, round(duration_s / (window_end_s - window_start_s) * 100, 6) AS fill,
 round(placed_start_s + duration_s, 6) AS placed_end_s FROM placed""")
def placement_scalars(spark, d):
    p = fx.placements(spark, d)
    w = F.col("window_end_s") - F.col("window_start_s")
    return p.select("m", "segment_id", S.placed_start(F.col("placed_start_s"), F.lit(0.125)).alias("placed"), w.alias("window_s"), S.fill_pct(F.col("duration_s"), w).alias("fill"), (F.col("placed_start_s") + F.col("duration_s")).alias("placed_end_s"))


# ---- timelines --------------------------------------------------------------

SHAKEN = """shaken AS (SELECT m, id, CASE WHEN id % 5 = 2 THEN "start" + 0.25 WHEN id % 5 = 4 THEN "start" - 0.5 ELSE "start" END AS "start", "end" FROM seg)"""


def shaken(spark, d):
    s = F.col("start")
    return fx.segments(spark, d).withColumn("start", F.when(F.col("id") % 5 == 2, s + 0.25).when(F.col("id") % 5 == 4, s - 0.5).otherwise(s))


@query(f"""WITH {SEG}, {MEDIA}, {SHAKEN}, x AS (SELECT s.*, duration_s, lead("start") OVER w AS nx, row_number() OVER w AS rn FROM shaken s JOIN media USING (m) WINDOW w AS (PARTITION BY m ORDER BY "start", id))
 SELECT m, id, unnest(list_filter([CASE WHEN "end" - "start" <= 0 THEN 'not positive' END, CASE WHEN rn = 1 AND abs("start") > 1e-3 THEN 'does not start at 0' END,
 CASE WHEN abs(nx - "end") > 1e-3 THEN CASE WHEN nx - "end" > 0 THEN 'gap' ELSE 'overlap' END END, CASE WHEN nx IS NULL AND abs("end" - duration_s) > 1e-3 THEN 'does not end with the medium' END], lambda p: p IS NOT NULL)) AS problem FROM x""")
def timeline_violations(spark, d):
    return timeline.violations(shaken(spark, d), fx.media(spark, d))


@query(f"""WITH {SEG}, {PLACED}, x AS (SELECT m, segment_id, placed_start_s + duration_s AS stop, lead(placed_start_s) OVER w AS ns, lead(duration_s) OVER w AS nd, lead(segment_id) OVER w AS nid FROM placed WINDOW w AS (PARTITION BY m ORDER BY placed_start_s, segment_id))
 SELECT m, segment_id AS left_id, nid AS right_id, round(stop - ns, 6) AS overlap_s, round((stop - ns) / nd * 100, 6) AS pct_of_right FROM x WHERE stop - ns > 1e-3""")
def adjacent_overlaps(spark, d):
    return timeline.overlaps(fx.placements(spark, d))


@query(f"""WITH {SEG}, {PLACED} SELECT a.m, a.segment_id AS left_id, b.segment_id AS right_id, round(least(a.placed_start_s + a.duration_s, b.placed_start_s + b.duration_s) - b.placed_start_s, 6) AS overlap_s
 FROM placed a JOIN placed b ON a.m = b.m AND (a.placed_start_s < b.placed_start_s OR (a.placed_start_s = b.placed_start_s AND a.segment_id < b.segment_id)) WHERE least(a.placed_start_s + a.duration_s, b.placed_start_s + b.duration_s) - b.placed_start_s > 1e-3""")
def interval_overlaps(spark, d):
    return timeline.all_overlaps(fx.placements(spark, d))


@query(f"""WITH {SEG} SELECT m, id AS old_id, row_number() OVER (PARTITION BY m ORDER BY "start", "end", id) - 1 AS id FROM seg WHERE id % 3 <> 1""")
def renumbered(spark, d):
    kept = fx.segments(spark, d).where(F.col("id") % 3 != 1)
    return timeline.renumber(kept.select("m", F.col("id").alias("old_id"), "start", "end", "id")).select("m", "old_id", "id")


SPANS = """spans AS (SELECT m, id // 3 AS idx, id % 3 AS n, "start" + 0.05 AS start_s, "end" - 0.05 AS end_s, min("start") OVER w AS c0, max("end") OVER w AS c1 FROM seg WINDOW w AS (PARTITION BY m, id // 3))"""


@query(f"""WITH {SEG}, {SPANS} SELECT m, idx, n, round(CASE WHEN row_number() OVER w = 1 THEN c0 ELSE start_s END, 6) AS "start", round(coalesce(lead(start_s) OVER w, c1), 6) AS "end" FROM spans WINDOW w AS (PARTITION BY m, idx ORDER BY n)""")
def closed_gaps(spark, d):
    idx = F.floor(F.col("id") / 3).cast("int")
    w = Window.partitionBy("m", idx)
    spans = fx.segments(spark, d).select("m", idx.alias("idx"), (F.col("id") % 3).alias("n"), (F.col("start") + 0.05).alias("start_s"), (F.col("end") - 0.05).alias("end_s"), F.min("start").over(w).alias("chunk_start_s"), F.max("end").over(w).alias("chunk_end_s"))
    return timeline.close_gaps(spans).select("m", "idx", "n", "start", "end")


@query(f"""WITH {SEG} SELECT m, id AS idx, lag(CASE WHEN n % 2 = 0 THEN 'silence' ELSE 'hard' END, 1, 'file_start') OVER (PARTITION BY m ORDER BY id) AS start_source FROM seg QUALIFY row_number() OVER (PARTITION BY m ORDER BY id) <= 4""")
def chunk_start_sources(spark, d):
    chunks = fx.segments(spark, d).select("m", F.col("id").alias("idx"), F.when(F.col("n") % 2 == 0, F.lit("silence")).otherwise(F.lit("hard")).alias("cut_source"))
    return timeline.first_n(timeline.start_sources(chunks), 4, "idx").select("m", "idx", "start_source")


@query(f"""WITH {SEG}, {PTS} SELECT m, round(t, 6) AS t, (SELECT max(struct_pack(e := "end", i := id)).i FROM seg s WHERE s.m = pts.m AND s."end" - 1e-3 <= t) AS before_id, (SELECT min(struct_pack(e := "start", i := id)).i FROM seg s WHERE s.m = pts.m AND s."start" + 1e-3 >= t) AS after_id FROM pts""")
def asof_neighbours(spark, d):
    return timeline.asof_neighbours(fx.points(spark, d), fx.segments(spark, d))


@query(f"""WITH {SEG}, {SIL}, {PTS}, x AS (SELECT pts.m, t, min(struct_pack(s := start_s, e := end_s)) AS b FROM pts LEFT JOIN sil ON sil.m = pts.m AND t BETWEEN start_s AND end_s GROUP BY ALL) SELECT m, round(t, 6) AS t, round(b.s, 6) AS start_s, round(b.e, 6) AS end_s FROM x""")
def enclosing_silence(spark, d):
    return timeline.enclosing_silence(fx.points(spark, d), fx.silences(spark, d))


@query(f"""WITH {SEG}, {SIL}, {PTS}, x AS (SELECT pts.m, t, min(struct_pack(dist := abs((start_s + end_s) / 2 - t), mid := (start_s + end_s) / 2)) AS b FROM pts LEFT JOIN sil ON sil.m = pts.m AND abs((start_s + end_s) / 2 - t) <= 1.5 GROUP BY ALL) SELECT m, round(t, 6) AS t, round(b.mid, 6) AS mid FROM x""")
def nearest_silence(spark, d):
    return timeline.nearest_silence(fx.points(spark, d), fx.silences(spark, d))


@query(f"""WITH {SEG}, x AS (SELECT m, id, "end", list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws FROM seg), y AS (SELECT *, lead(ws) OVER (PARTITION BY m ORDER BY "end", id) AS nx FROM x)
 SELECT m, id, round("end", 6) AS boundary_s, array_to_string(list_slice(ws, greatest(1, len(ws) - 5), len(ws)), ' ') AS before, array_to_string(list_slice(nx, 1, 6), ' ') AS after FROM y WHERE nx IS NOT NULL""")
def seam_texts(spark, d):
    return timeline.seam_texts(fx.segments(spark, d))


@query(f"""WITH {SIG}, f AS (SELECT m, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM sig), q AS (SELECT *, abs(x) < 2000 AS quiet FROM f), g AS (SELECT *, i - row_number() OVER (PARTITION BY m, quiet ORDER BY i) AS island FROM q)
 SELECT m, min(i) AS first, max(i) AS last, count(*) AS length FROM g WHERE quiet GROUP BY m, island HAVING count(*) >= 3""")
def gaps_islands(spark, d):
    samples = fx.signals(spark, d).select("m", F.posexplode("samples").alias("i", "x"))
    return timeline.gaps_and_islands(samples, 2000, 3)


# ---- signals ----------------------------------------------------------------


@query(f"""WITH {SIG}, p AS (SELECT m, list_max(list_transform(s, lambda x: abs(x))) AS peak FROM sig) SELECT m, peak::BIGINT AS peak, round(20 * log10(peak / 32768e0), 6) AS dbfs, round(pow(10e0, 20 * log10(peak / 32768e0) / 20), 6) AS back FROM p""")
def peak_levels(spark, d):
    level = pcm.peak_dbfs(F.col("samples"))
    return fx.signals(spark, d).select("m", pcm.peak(F.col("samples")).alias("peak"), level.alias("dbfs"), S.amplitude(level).alias("back"))


@query(f"""WITH {SIG}, b AS (SELECT m, s, list_filter(range(0, 13), lambda k: list_max(list_transform(list_slice(s, k * 5 + 1, k * 5 + 5), lambda x: abs(x))) / 32768e0 >= pow(10e0, -14 / 20e0)) AS loud FROM sig),
 c AS (SELECT m, s, len(loud) = 0 AS q, CASE WHEN len(loud) = 0 THEN 0 ELSE greatest(0, list_min(loud) * 5 - 2) END AS a, CASE WHEN len(loud) = 0 THEN 64 ELSE least(64, (list_max(loud) + 1) * 5 + 2) END AS z FROM b)
 SELECT m, array_to_string(list_slice(s, a + 1, z), ',') AS trimmed, round((z - a) / 1000e0, 6) AS duration_s, round(a / 1000e0, 6) AS lead_trim_s, round((64 - z) / 1000e0, 6) AS trail_trim_s, q AS all_silent FROM c""")
def trimmed_signals(spark, d):
    return pcm.trimmed(fx.signals(spark, d), threshold_db=-14.0, window_ms=5, margin_ms=2).select("m", "trimmed", "duration_s", "lead_trim_s", "trail_trim_s", "all_silent")


@query(f"""WITH {SIG} SELECT m, array_to_string(list_transform(s, lambda x, i: trunc(x * least(1e0, (i - 1) / 15e0, (64 - i) / 15e0))::INTEGER), ',') AS faded FROM sig""")
def faded_signals(spark, d):
    return fx.signals(spark, d).select("m", pcm.faded(F.col("samples"), F.col("rate")).alias("faded"))


CLIPS = "clips AS (SELECT label::BIGINT AS m, m AS ord, m % 40 AS off, s FROM sig)"


def clips(spark, d):
    return fx.signals(spark, d).select(F.col("label").cast("long").alias("m"), F.col("m").alias("ord"), (F.col("m") % 40).cast("int").alias("offset"), F.transform("samples", lambda x: x * 3).alias("samples"))


def canvas(rows):
    return rows.select("m").distinct().withColumn("frames", F.lit(90))


@query(f"""WITH {SIG}, {CLIPS}, f AS (SELECT m, ord, off + generate_subscripts(s, 1) - 1 AS i, unnest(s) * 3 AS x FROM clips), g AS (SELECT m, i, list(x ORDER BY ord) AS xs FROM f WHERE i < 90 GROUP BY ALL)
 SELECT m, i, list_reduce(list_concat([0], xs), lambda a, x: greatest(-32768, least(32767, a + x)))::BIGINT AS x FROM g""")
def mixed_signals(spark, d):
    every = clips(spark, d)
    return pcm.mix(every, canvas(every))


@query(f"""WITH {SIG}, {CLIPS}, f AS (SELECT m, ord, off + generate_subscripts(s, 1) - 1 AS i, unnest(s) * 3 AS x FROM clips), g AS (SELECT m, i, list(ord ORDER BY ord) AS os, list(x ORDER BY ord) AS xs FROM f WHERE i < 90 GROUP BY ALL),
 k AS (SELECT m, os, xs, unnest(range(1, len(xs) + 1)) AS j FROM g), t AS (SELECT m, os[j] AS ord, xs[j] AS x, list_reduce(list_concat([0], xs[:j - 1]), lambda a, v: greatest(-32768, least(32767, a + v))) AS old FROM k),
 w AS (SELECT m, ord, count(*) AS written, count(*) FILTER (old <> 0) AS overlapped, count(*) FILTER (old + x NOT BETWEEN -32768 AND 32767) AS clipped FROM t GROUP BY ALL)
 SELECT c.m, c.ord, coalesce(written, 0) AS written, len(s) - coalesce(written, 0) AS truncated, coalesce(overlapped, 0) AS overlapped, coalesce(clipped, 0) AS clipped FROM clips c LEFT JOIN w ON c.m = w.m AND c.ord = w.ord""")
def mix_counts(spark, d):
    every = clips(spark, d)
    return pcm.mix_counts(every, canvas(every))


# ---- text -------------------------------------------------------------------


@query(r"""SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS chars FROM
 (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{Mn}\p{Mc}''’‌‍]+'), lambda w: regexp_replace(w, '^[''’‌‍]+|[''’‌‍]+$', '', 'g')), lambda w: w <> '') AS ws FROM documents)""")
def tokenized_words(spark, d):
    ws = X.words(F.col("text"))
    return fx.table(spark, d, "documents").select("doc_id", ws.alias("ws")).select("doc_id", F.size("ws").alias("n_words"), F.aggregate("ws", F.lit(0), lambda a, w: a + F.char_length(w)).alias("chars"))


EN_SQL = r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), g AS (SELECT w, len(regexp_extract_all(w, '[aeiouy]+')) AS g FROM v)
 SELECT w, greatest(1, CASE WHEN g > 1 AND w LIKE '%e' AND NOT regexp_matches(w, '(le|ee|ye)$') THEN g - 1 WHEN g > 1 AND w LIKE '%ed' AND NOT regexp_matches(w, '(ted|ded)$') THEN g - 1 ELSE g END)::BIGINT AS n FROM g"""


@query(EN_SQL)
def syllables_en(spark, d):
    vocabulary = fx.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w")).distinct()
    return vocabulary.select("w", X.english_syllables(F.col("w")).alias("n"))


@query()
def syllables_devanagari(spark, d):
    """Literal words: no table of the driver's holds the script."""
    rows = spark.createDataFrame([(w,) for w in "तुमने ऊपर नमस्ते भारत कार्ड हिन्दी विद्यालय समझना".split()], "w string")
    return rows.select("w", X.devanagari_syllables(F.col("w")).alias("n"))


@query(r"""WITH x AS (SELECT conv_id AS m, turn AS id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[!-/:-@\[-`{-~।॥—–]', ' ', 'g'), '[\s]+', ' ', 'g')) AS n FROM conversations)
 SELECT m, id, n AS normal, len(list_filter(string_split(n, ' '), lambda w: regexp_matches(w, '[A-Za-z]')))::BIGINT AS latin FROM x""")
def normalised_turns(spark, d):
    n = X.normalised(F.col("text"))
    return fx.table(spark, d, "conversations").select(F.col("conv_id").alias("m"), F.col("turn").alias("id"), n.alias("normal")).withColumn("latin", X.latin_tokens(F.col("normal")))


@query(f"""WITH {PAIRS}, x AS (SELECT m, length(r) AS sc, length(h) AS tc FROM pairs) SELECT m, count(*) AS n, {r6('sum(tc) / greatest(1, sum(sc))=corpus_char_ratio', 'avg(tc / sc)=char_ratio_mean', 'min(tc / sc)=char_ratio_min', 'max(tc / sc)=char_ratio_max', 'quantile_cont(tc / sc, 0.95)=char_ratio_p95')} FROM x GROUP BY 1""")
def expansion_summary(spark, d):
    rows = X.expansion(fx.pairs(spark, d), "reference", "hypothesis")
    return stats.expansion_summary(rows, ["m"]).drop("over", *[f"syllable_ratio_{s}" for s in ("mean", "min", "max", "p95")])


@query(f"WITH {PAIRS} SELECT m, segment_id, CASE WHEN h = '' THEN 1 ELSE round(levenshtein(r, h) / length(r), 6) END AS cer FROM pairs")
def cer_pairs(spark, d):
    return fx.pairs(spark, d).select("m", "segment_id", X.cer(F.col("reference"), F.col("hypothesis")).alias("cer"))


EDITS = """list_reduce(list_concat([range(0, len(hw) + 1)], list_transform(rw, lambda w: list_transform(hw, lambda v: (v <> w)::BIGINT))), lambda row, mm:
 list_transform(range(1, len(row) + 1), lambda j: j - 1 + list_min(list_transform(range(1, j + 1), lambda k: (CASE WHEN k = 1 THEN row[1] + 1 ELSE least(row[k] + 1, row[k - 1] + mm[k - 1]) END) - (k - 1)))))[-1]"""
WORDS = f"""{PAIRS}, ws AS (SELECT m, segment_id, r, h, list_filter(string_split(r, ' '), lambda x: x <> '') AS rw, list_filter(string_split(h, ' '), lambda x: x <> '') AS hw FROM pairs)"""


@query(f"WITH {WORDS}, e AS (SELECT m, segment_id, ({EDITS})::BIGINT AS edits, len(rw) AS n, len(hw) AS k FROM ws) SELECT m, segment_id, edits, n AS ref_words, k AS hyp_words, CASE WHEN k = 0 THEN 1 ELSE round(edits / n, 6) END AS wer FROM e")
def wer_pairs(spark, d):
    return qc.score_pairs(fx.pairs(spark, d), composed=True).select("m", "segment_id", "edits", "ref_words", "hyp_words", "wer")


@query(f"""WITH {WORDS}, e AS (SELECT m, CASE WHEN h = '' THEN len(rw) ELSE ({EDITS}) END AS we, len(rw) AS rw, levenshtein(r, CASE WHEN h = '' THEN '{qc.EMPTY}' ELSE h END) AS ce, length(r) AS rc FROM ws)
 SELECT m, count(*) AS n, sum(we)::BIGINT AS word_edits, sum(rw)::BIGINT AS ref_words, sum(ce)::BIGINT AS char_edits, sum(rc)::BIGINT AS ref_chars, round(sum(we) / sum(rw), 6) AS wer, round(sum(ce) / sum(rc), 6) AS cer FROM e GROUP BY 1""")
def corpus_wer(spark, d):
    """Micro-averaged word and character rates of each medium."""
    return qc.corpus_rates(qc.score_pairs(fx.pairs(spark, d), composed=True), ["m"])


# ---- folds ------------------------------------------------------------------

BATCH = """lines AS (SELECT m, id, length(trim(text)) AS n, row_number() OVER (PARTITION BY m ORDER BY id) AS pos FROM seg),
 rec AS (SELECT m, id, pos, n, n + 7 AS used, 1 AS k, 0 AS g FROM lines WHERE pos = 1 UNION ALL
 SELECT l.m, l.id, l.pos, l.n, CASE WHEN r.used + l.n + 7 > 1600 OR r.k >= 4 THEN l.n + 7 ELSE r.used + l.n + 7 END, CASE WHEN r.used + l.n + 7 > 1600 OR r.k >= 4 THEN 1 ELSE r.k + 1 END, CASE WHEN r.used + l.n + 7 > 1600 OR r.k >= 4 THEN r.g + 1 ELSE r.g END
 FROM rec r JOIN lines l ON l.m = r.m AND l.pos = r.pos + 1)"""


@query(f"WITH RECURSIVE {SEG}, {BATCH} SELECT m, g::BIGINT AS batch, string_agg(id, ',' ORDER BY id) AS payload_ids FROM rec GROUP BY ALL")
def planned_batches(spark, d):
    return folds.batches(fx.segments(spark, d), cap=2000, most=4).select("m", "batch", "payload_ids")


@query()
def batch_contexts(spark, d):
    return folds.batches(fx.segments(spark, d), cap=2000, most=2)


@query(f"""WITH {SEG} SELECT m, CASE WHEN count(*) = 1 THEN trim(first(text ORDER BY id)) ELSE string_agg('[' || (id + 1) || '] ' || trim(text), chr(10) ORDER BY id) END AS rendered, count(*) AS n, true AS parsed FROM seg GROUP BY 1""")
def rendered_and_parsed(spark, d):
    own = fx.segments(spark, d).groupBy("m").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("r")).select("m", F.transform("r", lambda x: x["text"]).alias("t"))
    text = folds.render_batch(F.col("t"))
    return own.withColumn("rendered", text).withColumn("n", F.size("t").cast("long")).withColumn("parsed", F.size(folds.parse_batch(F.col("rendered"), F.size("t"))) == F.size("t")).drop("t")


CHUNKS = """cutlist AS (SELECT m, list_sort(list(mid)) AS cuts FROM (SELECT m, (start_s + end_s) / 2 AS mid FROM sil) GROUP BY 1), base AS (SELECT media.m, duration_s AS d, coalesce(cuts, []) AS cuts FROM media LEFT JOIN cutlist USING (m)),
 rec AS (SELECT m, d, cuts, 0 AS i, 0e0 AS cur, 0e0 AS a, '' AS how FROM base UNION ALL
 SELECT m, d, cuts, i + 1, CASE WHEN d - cur <= 30 THEN d ELSE coalesce(best, cur + 30) END, cur, CASE WHEN d - cur <= 30 THEN 'eof' WHEN best IS NULL THEN 'hard' ELSE 'silence' END
 FROM (SELECT *, list_min(list_transform(list_filter(cuts, lambda c: c > 0 AND c < d AND c >= greatest(cur + 1, d - 30 * (ceil((d - cur) / 30) - 1)) AND c <= cur + 30), lambda c: struct_pack(dist := abs(c - (cur + (d - cur) / ceil((d - cur) / 30))), c := c))).c AS best FROM rec WHERE cur < d))"""


def cuts(spark, d):
    return fx.silences(spark, d).groupBy("m").agg(F.array_sort(F.collect_list((F.col("start_s") + F.col("end_s")) / 2)).alias("cuts"))


@query(f"WITH RECURSIVE {SEG}, {SIL}, {MEDIA}, {CHUNKS} SELECT m, (i - 1)::BIGINT AS idx, round(a, 6) AS start_s, round(cur, 6) AS end_s, how AS cut_source FROM rec WHERE i > 0")
def planned_chunks(spark, d):
    own = fx.media(spark, d).join(cuts(spark, d), "m", "left").withColumn("cuts", F.coalesce("cuts", F.expr("cast(array() as array<double>)")))
    return own.select("m", F.inline(folds.plan_chunks(F.col("duration_s"), F.col("cuts"))))


@query()
def chunk_ladder(spark, d):
    levels = spark.createDataFrame([(i,) for i in range(5)], "level int")
    s = fx.silences(spark, d).withColumn("len", F.col("end_s") - F.col("start_s"))
    at = s.join(F.broadcast(levels), F.col("len") >= 0.39 - F.col("level") * 0.06).groupBy("m", "level").agg(F.array_sort(F.collect_list((F.col("start_s") + F.col("end_s")) / 2)).alias("cuts"))
    full = fx.media(spark, d).select("m").join(F.broadcast(levels)).join(at, ["m", "level"], "left").withColumn("cuts", F.coalesce("cuts", F.expr("cast(array() as array<double>)")))
    out = folds.plan_adaptive(fx.media(spark, d), full)
    return out.select("m", "accepted", "hard_cuts", F.size("chunks").alias("chunks"), F.size("attempts").alias("tried"))


FIT_REC = """base AS (SELECT p_partkey AS id, p_size / 10e0 AS target, p_retailprice / 400 AS b FROM part),
 rec AS (SELECT id, target, b, 0 AS i, 1e0 AS pace, 0e0 AS dur, CAST(NULL AS VARCHAR) AS stop, false AS cl, 1e0 AS used FROM base UNION ALL
 SELECT id, target, b, i + 1, nxt, dd, CASE WHEN ratio BETWEEN 0.95 AND 1.05 THEN 'converged' WHEN i + 1 >= 3 THEN 'max_attempts' WHEN abs(nxt - pace) < 0.02 THEN CASE WHEN abs(wanted - nxt) > 1e-9 THEN 'pinned_at_clamp' ELSE 'pace_step_below_threshold' END END,
 cl OR (NOT (ratio BETWEEN 0.95 AND 1.05) AND i + 1 < 3 AND abs(wanted - nxt) > 1e-9), pace
 FROM (SELECT *, least(greatest(wanted, 0.85), 1.25) AS nxt FROM (SELECT *, pace * ratio AS wanted FROM (SELECT *, b / pow(pace, 1.2) AS dd, b / pow(pace, 1.2) / target AS ratio FROM rec WHERE stop IS NULL))))"""


@query(f"""WITH RECURSIVE {FIT_REC}, a AS (SELECT id, count(*) AS attempts, max(stop) AS stop_reason, bool_or(cl) AS clamped, min(struct_pack(o := abs(dur / target - 1), i := i, dur := dur, used := used)) AS best FROM rec WHERE i > 0 GROUP BY 1)
 SELECT id, attempts, stop_reason, clamped, best.i::BIGINT AS shipped, round(best.dur, 6) AS achieved, round(best.used, 6) AS final_pace FROM a""")
def fit_loops(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), folds.fit_loop(F.col("p_size") / 10.0, F.col("p_retailprice") / 400, F.lit(1.2)).alias("f"))
    return p.select("id", F.size("f.paces").alias("attempts"), "f.stop_reason", "f.clamped", "f.shipped", "f.achieved", "f.final_pace")


@query("""WITH a AS (SELECT l_orderkey AS m, l_partkey % 3 AS segment_id, l_linenumber AS attempt, max(1 + l_tax) AS pace, max(l_extendedprice / 1000) AS duration_s, max(l_quantity) AS target FROM lineitem GROUP BY 1, 2, 3)
 SELECT m, segment_id, round(arg_min(duration_s, attempt), 6) AS baseline, max(attempt)::BIGINT AS attempts, min(struct_pack(o := abs(duration_s / target - 1), a := attempt)).a::BIGINT AS shipped, round(min(struct_pack(o := abs(duration_s / target - 1), a := attempt, p := pace)).p, 6) AS pace, round(min(struct_pack(o := abs(duration_s / target - 1), a := attempt, d := duration_s)).d, 6) AS achieved FROM a GROUP BY ALL""")
def shipped_attempts(spark, d):
    a = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("m"), (F.col("l_partkey") % 3).alias("segment_id"), F.col("l_linenumber").alias("attempt"), (1 + F.col("l_tax")).alias("pace"), (F.col("l_extendedprice") / 1000).alias("duration_s"), F.col("l_quantity").alias("target"))
    return stats.final_attempts(a.groupBy("m", "segment_id", "attempt").agg(*[F.max(c).alias(c) for c in ("pace", "duration_s", "target")]))


# ---- caching and audits -----------------------------------------------------


def keyed(spark, d):
    h = cache.text_hash(F.col("text"))
    params = cache.canonical_params(speaker=F.col("source"), mode=F.col("lang"), nothing=F.lit(None).cast("string"))
    return fx.table(spark, d, "documents").select("doc_id", cache.cache_key(F.lit("translate"), F.lit("model-a"), params, h).alias("key"))


# chr(0) can't be in DuckDB text: see the test for this query.
@query()
def cache_keys(spark, d):
    return keyed(spark, d)


@query("""WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 4 = 0) SELECT min(doc_id) AS doc_id, key FROM k WHERE key NOT IN (SELECT key FROM c) GROUP BY key""")
def cache_misses(spark, d):
    calls = fx.table(spark, d, "documents").select("doc_id", cache.text_hash(F.col("text")).alias("key"))
    held = calls.where(F.col("doc_id") % 4 == 0).select("key", F.lit("{}").alias("payload"))
    return cache.misses(calls.groupBy("key").agg(F.min("doc_id").alias("doc_id")), held).select("doc_id", "key")


@query("""WITH k AS (SELECT sha256(text) AS key FROM documents), c AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 4 = 0) SELECT count(*) FILTER (key IN (SELECT key FROM c)) AS hits, count(*) FILTER (key NOT IN (SELECT key FROM c)) AS misses, count(*) AS total, round(count(*) FILTER (key IN (SELECT key FROM c)) / count(*), 6) AS hit_rate FROM k""")
def cache_stats(spark, d):
    calls = fx.table(spark, d, "documents").select("doc_id", cache.text_hash(F.col("text")).alias("key"))
    return cache.stats(cache.lookup(calls, calls.where(F.col("doc_id") % 4 == 0).select("key", F.lit("{}").alias("payload"))), None)


@query("""WITH m AS (SELECT doc_id AS m, source AS path, n_chars AS size_bytes, n_chars / 10e0 AS duration_s FROM documents), p AS (SELECT m, CASE WHEN m % 7 = 1 THEN 'x' ELSE path END AS path, CASE WHEN m % 7 = 2 THEN 0 ELSE size_bytes END AS s, CASE WHEN m % 7 = 3 THEN duration_s + 1 ELSE duration_s END AS dd FROM m WHERE m % 7 <> 4)
 SELECT m.m, CASE WHEN p.path IS NULL THEN 'no earlier run' WHEN m.path <> p.path THEN 'another source' WHEN size_bytes <> s THEN 'the size differs' WHEN abs(duration_s - dd) > 0.01 THEN 'the duration differs' END AS reason FROM m LEFT JOIN p USING (m)""")
def provenance_stale(spark, d):
    m = fx.table(spark, d, "documents").select(F.col("doc_id").alias("m"), F.col("source").alias("path"), F.col("n_chars").alias("size_bytes"), (F.col("n_chars") / 10.0).alias("duration_s"))
    k = F.col("m") % 7
    p = m.where(k != 4).select("m", F.when(k == 1, F.lit("x")).otherwise(F.col("path")).alias("path"), F.when(k == 2, 0).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(k == 3, F.col("duration_s") + 1).otherwise(F.col("duration_s")).alias("duration_s"))
    return cache.stale(m, p)


@query(f"""WITH {SEG}, a AS (SELECT m, id, row_number() OVER (PARTITION BY m ORDER BY "start", id) AS n FROM seg), b AS (SELECT m, id, "start" AS s, row_number() OVER (PARTITION BY m ORDER BY "start", id) AS n, id % 6 = 3 AS moved, id % 6 = 5 AS blank FROM seg WHERE NOT (m % 10 = 0 AND id = 1)),
 j AS (SELECT coalesce(a.m, b.m) AS m, coalesce(a.n, b.n) AS n, a.n AS an, b.n AS bn, a.id AS ai, b.id AS bi, moved, blank FROM a FULL JOIN b ON a.m = b.m AND a.n = b.n)
 SELECT m, n, unnest(list_filter([CASE WHEN an IS NULL OR bn IS NULL THEN 'count' END, CASE WHEN ai <> bi THEN 'id' END, CASE WHEN ai <> bi OR moved THEN 'time' END, CASE WHEN ai <> bi THEN 'text' END, CASE WHEN bn IS NOT NULL AND blank THEN 'empty' END], lambda p: p IS NOT NULL)) AS problem FROM j""")
def mapping_audit(spark, d):
    a = fx.segments(spark, d).withColumn("text", F.concat_ws(" ", "id", "text"))
    b = a.where(~((F.col("m") % 10 == 0) & (F.col("id") == 1))).withColumn("end", F.when(F.col("id") % 6 == 3, F.col("end") + 0.5).otherwise(F.col("end"))).withColumn("translation", F.when(F.col("id") % 6 == 5, F.lit(" ")).otherwise(F.col("text")))
    return timeline.mapping_audit(a, b)


@query("""WITH l AS (SELECT source, d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)), c AS (SELECT source AS m, count(*) AS a, count(quality) AS b, count(*) FILTER (quality = 1) AS c FROM l GROUP BY 1)
 SELECT m, 'documents_to_labelled' AS hop, a AS expected, b AS actual, a = b AS passed FROM c UNION ALL SELECT m, 'labelled_to_good', b, c, b = c FROM c""")
def coverage_counts(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("source").alias("m"))
    labelled = docs.join(fx.table(spark, d, "labels"), "doc_id")
    return audit.coverage({"documents": docs, "labelled": labelled, "good": labelled.where("quality = 1")})


@query("""WITH c AS (SELECT source AS m, doc_id AS id, CASE WHEN lang = 'en' THEN 24000 ELSE 16000 END AS rate, CASE WHEN source = 'src1' AND doc_id % 9 = 0 THEN 2 ELSE 1 END AS channels FROM documents WHERE lang IN ('en', 'fr') AND (source <> 'src2' OR lang = 'en'))
 SELECT m, rate::BIGINT AS rate, channels::BIGINT AS channels, string_agg(id, ',' ORDER BY id) AS ids, count(*) OVER (PARTITION BY m) > 1 AS mixed FROM c GROUP BY m, rate, channels""")
def format_groups(spark, d):
    c = fx.table(spark, d, "documents").where("lang in ('en', 'fr') and (source != 'src2' or lang = 'en')")
    return stats.format_groups(c.select(F.col("source").alias("m"), F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", 24000).otherwise(16000).alias("rate"), F.when((F.col("source") == "src1") & (F.col("doc_id") % 9 == 0), 2).otherwise(1).alias("channels")))


@query()
def mux_checks(spark, d):
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("m"), F.lit("h264").alias("codec"), F.lit(640).alias("width"), F.lit(360).alias("height"), F.lit("yuv420p").alias("pix_fmt"), F.when(F.col("s_suppkey") % 3 != 0, 250).alias("nb_frames"), (F.col("s_acctbal") / 100).alias("duration_s"))
    o = s.withColumns({"height": F.when(F.col("m") % 5 == 0, 362).otherwise(360), "has_audio": F.col("m") % 7 != 0, "duration_s": F.col("duration_s") + F.when(F.col("m") % 4 == 0, 0.5).otherwise(0.0001)})
    return audit.mux_checks(s, o)


@query(f"""WITH {SEG}, {PLACED}, {MEDIA}, p AS (SELECT m, sum(duration_s) AS s, max(placed_start_s + duration_s) AS e FROM placed GROUP BY 1)
 SELECT m, round(media.duration_s, 6) AS duration_s, round(s, 6) AS speech_s, round(greatest(0, media.duration_s - s), 6) AS silence_s, round(s / media.duration_s * 100, 6) AS speech_pct, round(greatest(0, e - media.duration_s), 6) AS overflow_s, 0::BIGINT AS clipped_samples, 0::BIGINT AS truncated_frames, 0::BIGINT AS overlapped_frames FROM media JOIN p USING (m)""")
def timeline_totals(spark, d):
    return stats.timeline_totals(fx.placements(spark, d), fx.media(spark, d))


# ---- segments ---------------------------------------------------------------


def as_segments(spark, d):
    return fx.segments(spark, d).select("m", "id", "start", "end", "text", "speaker", F.floor(F.col("id") / 3).cast("int").alias("chunk_index"), F.lit("api_span").alias("boundary_source"), F.array("id").alias("origin"))


@query()
def merged_short(spark, d):
    config = Config(min_segment_s=8.0, max_segment_s=60.0)
    return seg.post_process(as_segments(spark, d), fx.silences(spark, d), config, split=False).select("m", "id", "start", "end", "boundary_source", "origin")


@query()
def split_long(spark, d):
    return seg.post_process(as_segments(spark, d), fx.silences(spark, d), merge=False).select("m", "id", "start", "end", "text", "boundary_source")


@query()
def stitched(spark, d):
    own = fx.segments(spark, d).withColumn("idx", F.floor(F.col("id") / 3).cast("int"))
    w = Window.partitionBy("m", "idx")
    spans = own.select("m", "idx", (F.col("id") % 3).alias("n"), "text", F.min("start").over(w).alias("chunk_start_s"), F.max("end").over(w).alias("chunk_end_s"), "start", "end")
    spans = spans.select("m", "idx", "n", "text", "chunk_start_s", "chunk_end_s", (F.col("start") - F.col("chunk_start_s")).alias("local_start"), (F.col("end") - F.col("chunk_start_s")).alias("local_end"))
    chunks = spans.select("m", "idx", F.col("chunk_start_s").alias("start_s"), F.col("chunk_end_s").alias("end_s"), F.lit("silence").alias("cut_source")).distinct()
    return seg.stitch(chunks, spans).select("m", "id", "start", "end", "text", "boundary_source")


# ---- calls ------------------------------------------------------------------


@query(f"""WITH {SEG} SELECT m, id, translate(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 'e', 'E') AS translation FROM seg""")
def translated_with_fallback(spark, d):
    """Batches to a stub that loses a marker for every third medium, whose lines go again."""

    def backend(df):
        lost = (F.col("m") % 3 == 0) & F.col("text").startswith("[1]")
        return df.withColumn("reply", F.translate(F.when(lost, F.regexp_replace("text", r"\[2\]", "")).otherwise(F.col("text")), "e", "E"))

    rows = fx.segments(spark, d).withColumn("text", F.regexp_replace("text", r"[ \t\n\r]+", " "))
    return calls.translate_segments(rows, backend, Config(translate_model="translate-long", translate_mode="formal"))[0]


@query(f"""WITH RECURSIVE {FIT_REC} SELECT id AS segment_id, i::BIGINT AS attempt, round(used, 6) AS pace, round(dur, 6) AS duration_s, stop AS stop_reason FROM rec WHERE i > 0""")
def fit_attempts(spark, d):
    """The fit loop as rounds of calls to a synthesiser that is not asked about finished segments."""
    rows = fx.table(spark, d, "part").select(F.lit(1).cast("long").alias("m"), F.col("p_partkey").alias("segment_id"), F.lit("x").alias("text"), (F.col("p_size") / 10.0).alias("target"), (F.col("p_retailprice") / 400).alias("base"))
    base = rows.select("segment_id", "base")
    speak = lambda df: df.join(base, "segment_id").withColumn("duration_s", F.col("base") / F.pow(F.col("exact"), F.lit(1.2))).drop("base")
    return calls.fit_rounds(rows, speak).select("segment_id", "attempt", "pace", "duration_s", "stop_reason")


@query("""WITH s AS (SELECT p_brand, 1 + p_size / 50e0 AS pace, max(p_retailprice / 100) AS v FROM part GROUP BY 1, 2), n AS (SELECT p_brand, lead(v) OVER (PARTITION BY p_brand ORDER BY pace) AS nx, v FROM s)
 SELECT p_brand, CASE WHEN bool_and(nx < v) THEN 'falls' WHEN bool_and(nx > v) THEN 'rises' ELSE 'neither' END AS direction FROM n GROUP BY 1""")
def sweep_direction(spark, d):
    sweep = fx.table(spark, d, "part").groupBy("p_brand", (1 + F.col("p_size") / 50.0).alias("pace")).agg(F.max(F.col("p_retailprice") / 100).alias("duration_s"))
    return calls.monotonic(sweep, ["p_brand"])


@query()
def seam_records(spark, d):
    return audit.seams(fx.segments(spark, d), fx.silences(spark, d))


@query(f"""WITH {SEG}, {PAIRS} SELECT m, segment_id, length(r) AS source_chars, length(h) AS target_chars, round(length(h) / length(r)::DOUBLE, 6) AS char_ratio FROM pairs""")
def expansions(spark, d):
    return X.expansion(fx.pairs(spark, d), "reference", "hypothesis").select("m", "segment_id", "source_chars", "target_chars", "char_ratio")


# ---- extensions -------------------------------------------------------------


def timed_calls(spark, d):
    return fx.table(spark, d, "events").select("ts", "user_id", F.col("event_type").alias("stage"), (F.col("event_id") % 3 == 0).alias("cache_hit"), (F.ceil("value") * 20.0 / 10000).alias("cost"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS start, event_type AS stage, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS hits, round(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE ceil(value) * 20e0 / 10000 END), 6) AS cost_inr FROM events GROUP BY ALL""")
def windowed_costs(spark, d):
    """An extension: the streaming aggregate, here over the table at rest."""
    out = streams.windowed_costs(timed_calls(spark, d), "1 day")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


# ---- the flagship -----------------------------------------------------------


@query(f"""WITH {WORDS}, {SEG}, {PLACED}, p AS (SELECT m, segment_id, placed_start_s, duration_s, window_end_s - window_start_s AS target, placed_start_s + duration_s - lead(placed_start_s) OVER (PARTITION BY m ORDER BY placed_start_s, segment_id) AS o FROM placed),
 e AS (SELECT m, segment_id, CASE WHEN len(hw) = 0 THEN 1 ELSE ({EDITS}) / len(rw) END AS wer, len(hw) AS hyp_words, len(list_filter(rw, lambda w: regexp_matches(w, '[a-z]'))) AS latin FROM ws),
 {FITS},
 s AS (SELECT e.m, e.segment_id, wer, hyp_words, latin, coalesce(f.clamped, false) AS clamped, (coalesce(f.achieved, duration_s) - coalesce(f.target, p.target)) / coalesce(f.target, p.target) * 100 AS drift, CASE WHEN o > 1e-3 THEN o ELSE 0 END AS overlap_s FROM e JOIN p ON e.m = p.m AND e.segment_id = p.segment_id LEFT JOIN (SELECT m, segment_id, min(target) AS target, min(achieved) AS achieved, bool_or(clamped) AS clamped FROM fits GROUP BY ALL) f ON f.m = e.m AND f.segment_id = e.segment_id)
 SELECT m, segment_id, round(wer, 6) AS wer, round(drift, 6) AS signed_drift, round(overlap_s, 6) AS overlap_s, round(wer + abs(drift) / 100, 6) AS combined, wer > 0 OR abs(drift) > 5 OR overlap_s > 0 AS flagged, row_number() OVER (PARTITION BY m ORDER BY round(wer + abs(drift) / 100, 9) DESC, segment_id) AS rank,
 array_to_string(list_filter([CASE WHEN hyp_words = 0 THEN 'no speech was recognised in the window' END, CASE WHEN wer >= 0.5 THEN 'high word error rate (#)' WHEN wer > 0 THEN 'word error rate #' END, CASE WHEN abs(drift) > 5 THEN CASE WHEN drift > 0 THEN 'overruns' ELSE 'underruns' END || ' its window by #%' END,
 CASE WHEN clamped THEN 'pace was clamped' END, CASE WHEN overlap_s > 0 THEN 'overlaps the next clip by # s' END, CASE WHEN latin > 0 THEN '# tokens of the reference are in Latin script' END], lambda x: x IS NOT NULL), '; ') AS why FROM s""")
def qc_rank_worst(spark, d):
    """The quality stage over every word of each turn: placements with their segments, fits
    and overlaps, word error rates, drift, reasons, and the rank in each medium. Numbers
    within reasons are shown as #."""
    pairs = fx.pairs(spark, d)
    fits = fx.fits(spark, d).groupBy("m", "segment_id").agg(*[F.min(c).alias(c) for c in ("target", "achieved", "final_pace", "attempts", "converged")], F.bool_or("clamped").alias("clamped"))
    rows = qc.qc_rows(fx.placements(spark, d), pairs.select("m", F.col("segment_id").alias("id"), F.col("reference").alias("translation")), fits, pairs.select("m", "segment_id", "hypothesis"), composed=True)
    why = F.array_join(F.transform("reasons", lambda x: F.regexp_replace(x, "[0-9.]+", "#")), "; ").alias("why")
    return qc.ranked(rows.withColumn("combined", F.round("combined", 9))).select("m", "segment_id", "wer", "signed_drift", "overlap_s", "combined", "flagged", "rank", why)
