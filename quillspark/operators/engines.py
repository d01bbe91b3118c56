"""Transcription engines behind one interface: a column of (text, char_confidences, candidates) from an image's width or bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import alignment, sequences
from ..functions.fixed_values import KRAKEN_DRAWS, PIXELS_PER_WORD, SIMULATED_WORDS, TROCR_DRAWS

RESULT = "struct<text:string,char_confidences:array<double>,candidates:array<struct<position:int,options:array<string>>>>"


def simulated_text(width: Column) -> Column:
    """A word for each 60 pixels, one at least, from a cycle of eight."""
    words = F.array(*(F.lit(w) for w in SIMULATED_WORDS))
    n = F.greatest(F.floor(width / PIXELS_PER_WORD).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, i % len(SIMULATED_WORDS))), " ")


def simulated_confidences(text: Column, key: Column, seed: int, share: int, high: tuple[int, int], low: tuple[int, int]) -> Column:
    """Thousandths from a seeded hash, the same on every partitioning: share % of the characters within high, the others within low."""

    def one(i: Column) -> Column:
        h = F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(seed)))
        pick, spread = (F.conv(F.substring(h, at, 8), 16, 10).cast("long") for at in (1, 9))
        within = lambda span: F.lit(span[0]) + F.pmod(spread, F.lit(span[1] - span[0] + 1))
        return F.when(F.pmod(pick, F.lit(100)) < share, within(high)).otherwise(within(low)) / 1000.0

    return F.transform(F.sequence(F.lit(0), F.length(text) - 1), one)


def _result(text: Column, confidences: Column) -> Column:
    return F.struct(text.alias("text"), confidences.alias("char_confidences"), sequences.candidates(confidences).alias("candidates")).cast(RESULT)


def trocr(width: Column, key: Column, seed: int = TROCR_DRAWS[0]) -> Column:
    """The simulated first engine."""
    text = simulated_text(width)
    return _result(text, simulated_confidences(text, key, seed, *TROCR_DRAWS[1:]))


def kraken(width: Column, key: Column, seed: int = KRAKEN_DRAWS[0]) -> Column:
    """The simulated second engine: the same text, more careful confidences."""
    text = simulated_text(width)
    return _result(text, simulated_confidences(text, key, seed, *KRAKEN_DRAWS[1:]))


def fused(width: Column, key: Column) -> Column:
    """Both engines' results fused by confidence."""
    a, b = trocr(width, key), kraken(width, key)
    both = alignment.fusion(a["text"], a["char_confidences"], b["text"], b["char_confidences"])
    return _result(both["text"], both["confidences"])


ENGINES: dict[str, Callable[[Column, Column], Column]] = {"trocr": trocr, "kraken": kraken, "fusion": fused}


def engine(name: str) -> Callable[[Column, Column], Column]:
    """An engine by its name in any case."""
    found = ENGINES.get(name.lower())
    if found is None:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(ENGINES)}")
    return found


def model_engine(load: Callable[[], Callable[[bytes], dict]]) -> Callable[[Column], Column]:
    """A real model as an engine over image bytes: load() runs once in each Python worker's stream and returns a function from bytes to a result."""

    @F.pandas_udf(RESULT)
    def transcribed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for images in batches:
            rows = [model(x) for x in images]
            yield pd.DataFrame({k: [r[k] for r in rows] for k in ("text", "char_confidences", "candidates")})

    return transcribed


def ketos_command(base: str = "catmus-medieval.mlmodel", folder: str = "segmentations/", output: str = "modele_finetune") -> str:
    """The shell command that fine-tunes the second engine; it is never run."""
    return " ".join(("ketos train", f"-i {base}", f"-o {output}", "-f page", "--augment", f"{folder}*.xml"))
