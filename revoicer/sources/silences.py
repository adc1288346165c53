"""Silences from the log lines of an external detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_silences(logs: DataFrame) -> DataFrame:
    """(m, start_s, end_s) from logs (m, log, duration_s): each start with the end that
    follows it, clamped to the medium; a start that another start follows is dropped, one
    left open ends with the medium."""
    lines = logs.select("m", "duration_s", F.posexplode(F.split("log", "\n")).alias("n", "line"))
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    got = lambda what: F.regexp_extract("line", rf"silence_{what}:\s*{number}", 1).try_cast("double")
    marks = lines.withColumns({"s": got("start"), "e": got("end")}).where("s is not null or e is not null")
    w = Window.partitionBy("m").orderBy("n")
    paired = marks.withColumns({"next_s": F.lead("s").over(w), "next_e": F.lead("e").over(w), "last": F.lead("n").over(w).isNull()}).where("s is not null and (next_e is not null or last)")
    inside = lambda x: F.greatest(F.lit(0.0), F.least(x, F.col("duration_s")))
    out = paired.select("m", inside(F.col("s")).alias("start_s"), inside(F.coalesce("next_e", "duration_s")).alias("end_s"))
    return out.where("end_s > start_s")
