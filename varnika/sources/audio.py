"""Audio bytes: format by magic numbers, length, peak."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def sniff(content: Column | str) -> Column:
    """wav, mp3, ogg, flac, webm, mp4 or null, by the first bytes."""
    c = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 12))
    return (
        F.when(c.startswith("52494646") & (F.substring(c, 17, 8) == "57415645"), "wav")
        .when(c.startswith("494433") | c.rlike("^FF(FB|F3|F2)"), "mp3")
        .when(c.startswith("4F676753"), "ogg")
        .when(c.startswith("664C6143"), "flac")
        .when(c.startswith("1A45DFA3"), "webm")
        .when(F.substring(c, 9, 8) == "66747970", "mp4")
    )


def py_wav(b: bytes | None) -> dict | None:
    """seconds and peak (of 16-bit samples, else null) of a WAV file; null if it is none. A streaming header's length is that of the bytes there."""
    try:
        with wave.open(io.BytesIO(b or b""), "rb") as w:
            data = w.readframes(w.getnframes())
            frame = w.getnchannels() * w.getsampwidth()
            peak = float(np.abs(np.frombuffer(data[: len(data) // 2 * 2], dtype="<i2").astype(np.int32)).max(initial=0)) / 32768 if w.getsampwidth() == 2 else None
            return {"seconds": len(data) / frame / w.getframerate(), "peak": peak}
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


@F.pandas_udf(T.StructType([T.StructField("seconds", T.DoubleType()), T.StructField("peak", T.DoubleType())]))
def wav(content: pd.Series) -> pd.DataFrame:
    """py_wav in Arrow batches."""
    return pd.DataFrame([py_wav(bytes(b) if b is not None else None) or {"seconds": None, "peak": None} for b in content], columns=["seconds", "peak"])


def inspect(content: str, shortest: float = 0.3, longest: float = 30.0, largest: int = 10_000_000) -> Column:
    """struct(format, bytes, sha256, seconds, peak, fault): fault is empty, too_large, unknown_format, too_short, too_long or null."""
    c = F.col(content)
    w = F.when(sniff(c) == "wav", wav(c))
    size = F.octet_length(c)
    fault = F.when(c.isNull() | (size == 0), "empty").when(size > largest, "too_large").when(sniff(c).isNull(), "unknown_format").when(w["seconds"] < shortest, "too_short").when(w["seconds"] >= longest, "too_long")
    return F.struct(sniff(c).alias("format"), size.alias("bytes"), F.sha2(c, 256).alias("sha256"), w["seconds"].alias("seconds"), w["peak"].alias("peak"), fault.alias("fault"))
