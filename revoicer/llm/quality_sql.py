"""DuckDB SQL for the quality query: the same counts, references, distances and verdicts."""

from __future__ import annotations

from .quality import COMMON_WORDS, SYMBOLS, WIDTH, Limits


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def jsd(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts; 0 where either is empty."""
    n, m = f"list_sum({p})", f"list_sum({q})"
    half = lambda x, s: f"list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1]::DOUBLE / {n} + z[2]::DOUBLE / {m}) / 2)) ELSE 0 END))"
    return f"CASE WHEN coalesce({n}, 0) = 0 OR coalesce({m}, 0) = 0 THEN 0 ELSE sqrt(least(1, greatest(0, ({half(f'(z[1]::DOUBLE / {n})', 'p')} + {half(f'(z[2]::DOUBLE / {m})', 'q')}) / 2))) END"


def assess_sql(limits: Limits = Limits()) -> str:
    white = r"\x20\x09-\x0D"
    count = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    kinds = [
        count("a-z"), count("A-Z"), count("0-9"), count(r" \t\x0b\x0c\r"), count(r"\n"), count(r".,;:?''\"\-"), count("!"), count("#*$%&|<>"), count(r"()\[\]{}"),
    ]
    upper, letters = r"length(regexp_replace(t, '[\x00-\x7F]|[^\p{Lu}]', '', 'g'))", r"length(regexp_replace(t, '[\x00-\x7F]|[^\p{L}]', '', 'g'))"
    ascii_all = " + ".join(kinds)
    chars = f"[{kinds[0]} + {letters} - {upper}, {kinds[1]} + {upper}, {', '.join(kinds[2:])}, length(t) - ({ascii_all}) - {letters}]"
    names = " ".join(f"WHEN '{k}' THEN {listed(v)}" for k, v in COMMON_WORDS.items())
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"
    judged = f"length(t) >= {limits.min_chars} AND char_distance > {limits.char_distance}"
    worded = f"n_words >= {limits.min_words} AND word_distance > {limits.word_distance} + {limits.word_allowance} / sqrt(greatest(n_words, 1))"
    assert SYMBOLS == "#*$%&|<>"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^{white}]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{white}]')) AS ls,
  string_split_regex(regexp_replace(lower(t), '[.,;:?!"''()\[\]{{}}*#$%&|<>]', '', 'g'), '[{white}]+') AS plain FROM d),
 tri AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS x FROM w WHERE len(ws) >= 3),
 rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, x) > 1), (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
 f AS (SELECT w.rid, doc_id, t, lang, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) THEN lang ELSE 'other' END AS ref, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, {count("#*$%&|<>")} AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, {chars} AS ch, plain, CASE lang {names} ELSE []::VARCHAR[] END AS common FROM w LEFT JOIN rep USING (rid)),
 tok AS (SELECT rid, x, count(*) AS n FROM (SELECT rid, unnest(plain) AS x FROM f) GROUP BY ALL),
 hits AS (SELECT f.rid, list_position(common, x) AS k, n FROM f JOIN tok ON f.rid = tok.rid AND list_contains(common, x)),
 ml AS (SELECT rid, map_from_entries(list(struct_pack(k := k, v := n))) AS mp, sum(n) AS s FROM hits GROUP BY rid),
 h AS (SELECT f.*, list_concat(list_transform(range(1, {WIDTH}), lambda k: coalesce(mp[k], 0)), [n_words - coalesce(s, 0)]) AS wh, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f LEFT JOIN ml USING (rid)),
 r AS (SELECT ref, {sums("ch", 10)} AS rc, {sums("wh", WIDTH)} AS rw FROM h WHERE NOT base_failed GROUP BY ref HAVING sum(list_sum(wh)) >= {limits.min_reference}),
 j AS (SELECT h.*, CASE WHEN rc IS NULL THEN 0 ELSE {jsd("ch", "rc")} END AS char_distance, CASE WHEN rc IS NULL OR h.ref = 'other' THEN 0 ELSE {jsd("wh", "rw")} END AS word_distance FROM h LEFT JOIN r USING (ref))
 SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance, NOT (base_failed OR ({judged}) OR ({worded})) AS kept FROM j"""
