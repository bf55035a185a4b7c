"""Translation providers behind one contract, and the run that uses them.

A provider takes the texts of one batch and returns as many translations.  It runs on
the executors over Arrow batches; equal texts are sent once and joined back.  No provider here
needs a network: ``stub`` marks each text, and others are any Python callable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str], str, str], list[str]]


def stub(texts: list[str], source: str, target: str) -> list[str]:
    return [f"{target}:{t}" for t in texts]


def choose(override: Column, preference: Column, managed_ready: Column, default: str = "llama") -> Column:
    """Explicit choice, else a preference other than auto, else the managed runtime, else the default."""
    return F.coalesce(F.nullif(override, F.lit("")), F.when(preference != "auto", preference), F.when(managed_ready, F.lit("managed")), F.lit(default))


def call(texts: list[str], provider: Provider, source: str, target: str, splits: tuple[int, ...] = ()) -> tuple[list[str | None], str | None]:
    """Translations or an error; a result of another length fails the whole batch.

    With splits, a failed batch is tried again in pieces of those sizes, one after the other.
    """
    try:
        out = provider(texts, source, target)
        if len(out) != len(texts):
            raise ValueError(f"expected {len(texts)} translations, got {len(out)}")
        return list(out), None
    except Exception as e:  # noqa: BLE001  a provider may raise anything
        if splits and len(texts) > 1:
            size = max(1, min(splits[0], len(texts) - 1))
            got = [call(texts[i : i + size], provider, source, target, splits[1:]) for i in range(0, len(texts), size)]
            if all(err is None for _, err in got):
                return [t for part, _ in got for t in part], None
        return [None] * len(texts), str(e)


def translate(segments: DataFrame, provider: Provider, source: str, target: str, size: int = 16, splits: tuple[int, ...] = ()) -> DataFrame:
    """segments(segment_id, source_text) with translated_text, status and error.

    Distinct texts are translated once in batches of size.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["source_text"].tolist()
            out, errors = [], []
            for i in range(0, len(texts), size):
                got, err = call(texts[i : i + size], provider, source, target, splits)
                out += got
                errors += [err] * len(got)
            yield pd.DataFrame({"source_text": texts, "translated_text": out, "error": errors})

    unique = segments.select("source_text").distinct().mapInPandas(run, "source_text string, translated_text string, error string")
    joined = segments.select("segment_id", "source_text").join(unique, "source_text")
    return joined.withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("failed"))
