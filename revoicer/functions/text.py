"""Text expressions: words, syllables, scripts, normal forms, edit distances."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Devanagari code points by their part in a syllable.
DEV_CONSONANTS = r"\x{0915}-\x{0939}\x{0958}-\x{095F}\x{0978}-\x{097F}"
DEV_VOWELS = r"\x{0904}-\x{0914}\x{0960}\x{0961}\x{0972}-\x{0977}"
DEV_MATRAS = r"\x{093A}\x{093B}\x{093E}-\x{094C}\x{094E}\x{094F}\x{0955}-\x{0957}\x{0962}\x{0963}"
DEV_NUKTA, DEV_VIRAMA = r"\x{093C}", r"\x{094D}"
JOINERS = r"\x{27}\x{2019}\x{200C}\x{200D}"


def words(text: Column) -> Column:
    """Runs of letters, marks and joiners, without joiners at their ends."""
    found = F.regexp_extract_all(text, F.lit(rf"([\p{{L}}\p{{Mn}}\p{{Mc}}{JOINERS}]+)"), 1)
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, rf"^[{JOINERS}]+|[{JOINERS}]+$", "")), lambda w: w != "")


def english_syllables(word: Column) -> Column:
    """Vowel groups, less a silent ending; at least one."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit("[aeiouy]+"))
    mute_e = low.rlike("e$") & ~low.rlike("(le|ee|ye)$")
    mute_ed = low.rlike("ed$") & ~low.rlike("(ted|ded)$")
    return F.greatest(F.lit(1), F.when((groups > 1) & mute_e, groups - 1).when((groups > 1) & mute_ed, groups - 1).otherwise(groups))


def aksharas(word: Column) -> Column:
    """A word's syllable units, ``1`` with a vowel of their own and ``0`` with the inherent one."""
    c = rf"[{DEV_CONSONANTS}]{DEV_NUKTA}*"
    # A conjunct's first consonant leaves a mark, so that what stands beside it is no neighbour.
    x = F.regexp_replace(word, c + DEV_VIRAMA, "_")
    x = F.regexp_replace(x, rf"{c}[{DEV_MATRAS}]", "1")
    x = F.regexp_replace(x, rf"[{DEV_VOWELS}]", "1")
    x = F.regexp_replace(x, c, "0")
    return F.regexp_replace(x, "[^01]", "")


def devanagari_syllables(word: Column) -> Column:
    """Units left after the inherent vowels that speech drops: the last, then, from the
    right, each between two units that stay."""
    units = F.filter(F.split(aksharas(word), ""), lambda u: u != "")
    n = F.size(units)
    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("dropped"), F.lit(0).alias("left"))

    def step(s: Column, u: Column) -> Column:
        last, first = s["i"] == 0, s["i"] == n - 1
        drop = (u == "0") & (n > 1) & (last | (~first & ~s["dropped"]))
        return F.struct((s["i"] + 1).alias("i"), drop.alias("dropped"), (s["left"] + F.when(drop, 0).otherwise(1)).alias("left"))

    return F.greatest(F.lit(1), F.aggregate(F.reverse(units), start, step, lambda s: s["left"]))


def script(word: Column) -> Column:
    """``dev``, ``latin`` or ``other`` by the majority of letters; ties are Devanagari."""
    dev, latin = F.regexp_count(word, F.lit(r"[\p{IsDevanagari}&&\p{L}]")), F.regexp_count(word, F.lit(r"[\p{IsLatin}&&\p{L}]"))
    return F.when((dev > 0) & (dev >= latin), F.lit("dev")).when(latin > 0, F.lit("latin")).otherwise(F.lit("other"))


def syllables(text: Column) -> Column:
    """Syllables of a text; null if a word is in neither script, 0 for a blank text."""
    one = lambda w: F.when(script(w) == "dev", devanagari_syllables(w)).when(script(w) == "latin", english_syllables(w))
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.aggregate(words(text), F.lit(0), lambda acc, w: acc + one(w)))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC: Spark has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalised(text: Column, composed: bool = False) -> Column:
    """Lower case, punctuation to spaces, single spaces; ``composed`` skips NFC where
    the text is known to be in that form, and so stays inside the JVM."""
    x = F.lower(text if composed else nfc(text))
    x = F.regexp_replace(x, r"[!-/:-@\[-`{-~\x{0964}\x{0965}\x{2014}\x{2013}]", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def latin_tokens(normal: Column) -> Column:
    return F.size(F.filter(F.split(normal, " "), lambda x: x.rlike("[A-Za-z]")))


def cer(reference: Column, hypothesis: Column) -> Column:
    return F.when(hypothesis == "", F.lit(1.0)).otherwise(F.levenshtein(reference, hypothesis) / F.char_length(reference))


def edits(ref: Column, hyp: Column) -> Column:
    """``struct<c, s, d, i>`` of the least edits from words ``ref`` to words ``hyp``, of
    equal costs the one with fewest substitutions; a fold over the rows of the table of
    prefixes. Where the cost alone is asked, :func:`word_distance` is far cheaper."""
    plus = lambda x, **k: F.struct(*[(x[n] + k.get(n, 0)).alias(n) for n in "csdi"])
    row0 = F.transform(F.sequence(F.lit(0), F.size(hyp)), lambda j: F.struct(j.alias("c"), F.lit(0).alias("s"), F.lit(0).alias("d"), j.alias("i")))

    def next_row(row: Column, r: Column) -> Column:
        head = F.array(plus(F.element_at(row, 1), c=1, d=1))

        def cell(done: Column, j: Column) -> Column:
            same = F.element_at(hyp, j) == r
            diagonal = F.element_at(row, j)
            sub = F.when(same, diagonal).otherwise(plus(diagonal, c=1, s=1))
            return F.concat(done, F.array(F.array_min(F.array(sub, plus(F.element_at(row, j + 1), c=1, d=1), plus(F.element_at(done, -1), c=1, i=1)))))

        return F.when(F.size(hyp) == 0, head).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(hyp), F.lit(1))), head, cell))

    last = F.aggregate(ref, row0, next_row, lambda row: F.element_at(row, -1))
    return F.when(F.size(ref) == 0, F.element_at(row0, -1)).otherwise(last)


def word_distance(ref: Column, hyp: Column) -> Column:
    """Least edits from words ``ref`` to words ``hyp`` of any length: the distinct words of
    both are numbered, each number stands for a character, and the built-in distance of
    strings counts. Code points from 256 up are used, without the surrogates."""

    def coded(words: Column, known: Column) -> Column:
        code = lambda w: F.array_position(known, w) + F.when(F.array_position(known, w) < 0xD800 - 255, 255).otherwise(255 + 2048)
        return F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(code(w)), 8, "0")), "")), "UTF-32")

    def distance(p: Column) -> Column:
        many = F.raise_error(F.lit("a pair has more than a million distinct words")).cast("int")
        return F.when(F.size(p["k"]) > 1_000_000, many).otherwise(F.levenshtein(coded(p["r"], p["k"]), coded(p["h"], p["k"])))

    # Lists of one: what a lambda is given is worked out once, not for every word.
    pair = F.transform(F.array(F.struct(ref.alias("r"), hyp.alias("h"))), lambda p: F.struct(p["r"], p["h"], F.array_distinct(F.concat(p["r"], p["h"])).alias("k")))
    return F.get(F.transform(pair, distance), F.lit(0))


def expansion(df: DataFrame, source: str, target: str, duration: Column | None = None) -> DataFrame:
    """Adds char and syllable counts of both texts and their ratios (null where unknown)."""
    out = df.withColumns({"source_chars": F.char_length(source), "target_chars": F.char_length(target), "source_syllables": syllables(F.col(source)), "target_syllables": syllables(F.col(target))})
    out = out.withColumns({"char_ratio": F.try_divide(F.col("target_chars").cast("double"), F.col("source_chars")), "syllable_ratio": F.try_divide(F.col("target_syllables").cast("double"), F.col("source_syllables"))})
    return out if duration is None else out.withColumn("source_syllables_per_s", F.try_divide(F.col("source_syllables").cast("double"), duration))
