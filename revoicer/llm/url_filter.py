"""URL filters with dated lists: which entries were active when a page was fetched.

A list is a history of rows (key, action, at): a key is a host, a domain or a host with a
path prefix; ``block``, ``allow`` and ``remove`` take effect at their time and last until
the next row of the key. That makes validity intervals ``[from, until)``. A capture has
the keys of its host's suffixes and of its path's prefixes; an as-of join finds the
entries of those keys that were active at its fetch time, and the most specific decides.

A key's intervals do not overlap, so they are one row: its history in order of time. A
capture meets at most one row for each of its keys, however often the list changed, and
takes the last interval that began by its fetch time. Captures of one host repeat keys, so
hot keys are salted: histories are repeated SALTS times and captures spread over the salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
#: Scheme and user of a URL, then its host: an address in brackets, or a name.
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"
NAME = r"(\[[^\]/?#]*\]|[^/?#:]*)"


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; empty where there is none. An IPv6
    address keeps its brackets."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY + NAME, 1))


def path_parts(url: Column) -> Column:
    """The segments of a URL's path, empty ones left out."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def url_keys(url: Column, most: int) -> Column:
    """Keys of a URL, least specific first: suffixes of its host from the last label to
    the whole, then the whole host with one, two and more segments of its path, up to
    ``most``: as deep as any key of the list. An IPv6 address is one label."""
    labels = F.when(F.startswith(host(url), F.lit("[")), F.array(host(url))).otherwise(F.split(host(url), r"\."))
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    parts = path_parts(url)
    depth = F.least(F.size(parts), F.lit(most))
    none = F.expr("cast(array() as array<string>)")
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(none)
    return F.when(host(url) == "", none).otherwise(F.concat(suffixes, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, from, until) of entries (key, action, at): each row lasts until the
    key's next; rows of one key and time count by their last action in the order allow,
    block, remove; removals leave no interval. Null keys, actions and times are left out."""
    rows = entries.select(F.lower(F.col("key")).alias("key"), "action", "at").where("key is not null and action is not null and at is not null")
    single = rows.groupBy("key", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("key").orderBy("at")
    return single.select("key", "action", F.col("at").alias("from"), F.lead("at").over(w).alias("until")).where("action != 'remove'")


def judge(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """captures (id, url, fetched_at) with verdict, key, since and n_active.

    verdict is ``block`` or ``allow`` by the most specific active entry, ``none`` where a URL
    has no active one; entries may have paths of any depth. Edge cases: a null or odd URL has no key and gets ``none``; a
    null fetch time is before every entry; repeated rows are judged each; an empty list
    leaves every capture at ``none``; ids may repeat or be null, rows are kept apart.
    """
    rows = captures.select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.col("fetched_at").alias("t"))
    # Equal (id, url, time) rows get one verdict: count them, judge once, give it to each.
    once = rows.groupBy("id", "url", "t").agg(F.count(F.lit(1)).alias("copies"))
    spans = intervals(entries)
    deepest = spans.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    keyed = once.select("id", "url", "t", F.posexplode(url_keys(F.col("url"), deepest)).alias("level", "key")).withColumn("salt", F.pmod(F.xxhash64("id", "url", "t"), F.lit(salts)).cast("int"))
    # One row per key; it holds a row of the list for each time at which the key changed.
    history = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("from", "until", "action"))).alias("history"))
    spread = history.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    last = F.try_element_at(F.filter("history", lambda x: x["from"] <= F.col("t")), F.lit(-1))
    found = keyed.join(spread, ["key", "salt"]).select("id", "url", "t", "level", "key", last.alias("e"))
    active = found.where(F.col("e").isNotNull() & (F.col("e.until").isNull() | (F.col("t") < F.col("e.until"))))
    best = active.groupBy("id", "url", "t").agg(F.max_by(F.struct("e.action", "key", "e.from"), "level").alias("x"), F.count(F.lit(1)).alias("n"))
    named = best.select(F.col("id").alias("b_id"), F.col("url").alias("b_url"), F.col("t").alias("b_t"), "x", "n")
    same = F.col("id").eqNullSafe(F.col("b_id")) & F.col("url").eqNullSafe(F.col("b_url")) & F.col("t").eqNullSafe(F.col("b_t"))
    out = once.join(named, same, "left").select("id", "url", F.col("t").alias("fetched_at"), F.coalesce(F.col("x.action"), F.lit("none")).alias("verdict"), F.col("x.key").alias("key"), F.col("x.from").alias("since"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


# ---- the query's list and fetch times ---------------------------------------


def hashed(text: Column) -> Column:
    """A number that SQL and Spark agree on: the first six hex digits of the md5."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def demo_entries(pages: DataFrame) -> DataFrame:
    """A list history over the hosts and first path segments of pages, whole table in:
    a deterministic half of the keys is blocked on some day, and some of those are
    removed or allowed again later. Days count from 0."""
    own = pages.select(host(F.col("url")).alias("host"), path_parts(F.col("url"))[0].alias("p")).where("host != ''")
    domain = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    parent = F.when((F.size(F.split("host", r"\.")) >= 2) & ~F.startswith("host", F.lit("[")), domain)
    keys = own.select(F.col("host").alias("key")).union(own.where("p is not null").select(F.concat("host", F.lit("/"), "p"))).union(own.select(parent.alias("key")).where("key is not null")).distinct()
    h = hashed(F.col("key"))
    first, later = h % 20, h % 20 + 1 + F.floor(h / 20).cast("long") % 15
    return keys.where(h % 2 == 0).select("key", F.explode(F.array(F.struct(F.lit("block").alias("action"), first.alias("at")), F.struct(F.when(h % 3 == 0, F.lit("allow")).when(h % 3 == 1, F.lit("remove")).otherwise(F.lit("block")).alias("action"), later.alias("at")))).alias("e")).select("key", "e.action", "e.at")


def judge_pages(pages: DataFrame) -> DataFrame:
    """Every page as a capture fetched on day ``page_id % 40``, against that list."""
    captures = pages.select(F.col("page_id").alias("id"), "url", F.pmod(F.col("page_id"), F.lit(40)).alias("fetched_at"))
    return judge(captures, demo_entries(pages)).select(F.col("id").alias("page_id"), "url", "fetched_at", "verdict", "key", "since", "n_active")


JUDGE_SQL = r"""WITH u AS (SELECT page_id, url, page_id % 40 AS t, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)) AS host,
 list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
 h AS (SELECT *, CASE WHEN starts_with(host, '[') THEN [host] ELSE string_split(host, '.') END AS labels FROM u WHERE host <> ''),
 raw AS (SELECT host AS key FROM h UNION SELECT host || '/' || parts[1] FROM h WHERE len(parts) > 0 UNION SELECT array_to_string(labels[-2:], '.') FROM h WHERE len(labels) >= 2),
 e AS (SELECT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS n FROM raw),
 changes AS (SELECT key, 'block' AS action, n % 20 AS day FROM e WHERE n % 2 = 0 UNION ALL SELECT key, CASE n % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'remove' ELSE 'block' END, n % 20 + 1 + (n // 20) % 15 FROM e WHERE n % 2 = 0),
 iv AS (SELECT key, action, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM changes),
 k AS (SELECT page_id, url, t, unnest(list_concat(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[len(labels) - i + 1:], '.')), list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS key,
 generate_subscripts(list_concat(range(1, len(labels) + 1), range(1, len(parts) + 1)), 1) AS level FROM h),
 a AS (SELECT page_id, url, t, max(struct_pack(level := level, action := action, key := k.key, since := since)) AS x, count(*) AS n FROM k JOIN iv ON k.key = iv.key AND t >= since AND (until IS NULL OR t < until) WHERE action <> 'remove' GROUP BY ALL)
 SELECT u.page_id, u.url, u.t AS fetched_at, coalesce(x.action, 'none') AS verdict, x.key AS key, x.since AS since, coalesce(n, 0) AS n_active FROM u LEFT JOIN a ON u.page_id = a.page_id AND u.url = a.url"""
