"""WAV bytes to records and back. Header facts come from a prefix of the file; samples
only where they are asked for."""

from __future__ import annotations

import array
import io
import struct
import sys
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFO_FIELDS = (("channels", T.IntegerType()), ("sample_width", T.IntegerType()), ("frame_rate", T.IntegerType()), ("frames", T.LongType()), ("duration_s", T.DoubleType()), ("error", T.StringType()))
INFO = "struct<channels:int,sample_width:int,frame_rate:int,frames:bigint,duration_s:double,error:string>"


def header(data: bytes | None) -> dict:
    """Parameters of RIFF/WAVE bytes, or the error."""
    bad = lambda e: {"channels": None, "sample_width": None, "frame_rate": None, "frames": None, "duration_s": None, "error": e}
    if not data:
        return bad("no data")
    try:
        with wave.open(io.BytesIO(data)) as w:
            rate, frames = w.getframerate(), w.getnframes()
            return {"channels": w.getnchannels(), "sample_width": w.getsampwidth(), "frame_rate": rate, "frames": frames, "duration_s": frames / rate if rate else 0.0, "error": None if rate > 0 else "frame rate must be positive"}
    except (wave.Error, EOFError, struct.error) as e:
        return bad(f"not a WAV file: {e}")


@F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in INFO_FIELDS]))
def wav_info(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(bytes(x) if x is not None else None) for x in data], columns=["channels", "sample_width", "frame_rate", "frames", "duration_s", "error"])


def samples_of(data: bytes) -> list[int]:
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit samples can be read")
        own = array.array("h", w.readframes(w.getnframes()))
    if sys.byteorder == "big":
        own.byteswap()
    return list(own)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def wav_samples(data: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else samples_of(bytes(x)) for x in data])


def wav_bytes(samples, rate: int, channels: int = 1) -> bytes:
    own = array.array("h", [int(x) for x in samples])
    if sys.byteorder == "big":
        own.byteswap()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(int(rate))
        w.writeframes(own.tobytes())
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def to_wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else wav_bytes(s, r) for s, r in zip(samples, rate, strict=True)])


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, and WAV facts of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), wav_info("content").alias("info"), "content")


def checked(info: Column) -> Column:
    """The info, or an error in the plan."""
    return F.when(info["error"].isNotNull(), F.raise_error(info["error"]).cast(INFO)).otherwise(info)


def write_wavs(rows: DataFrame, folder: str) -> None:
    """Write each row's samples (name, samples, rate) to ``folder/name.wav``, from the
    executors; a file appears whole, so a repeated task does no harm."""

    def write(part):
        import os
        import uuid

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
        files.create_dir(root, recursive=True)
        for r in part:
            own = f"{root}/.{uuid.uuid4().hex}"
            with files.open_output_stream(own) as out:
                out.write(wav_bytes(r["samples"], r["rate"]))
            files.move(own, f"{root}/{r['name']}.wav")

    rows.select("name", "samples", "rate").foreachPartition(write)
