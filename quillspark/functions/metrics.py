"""Error rates of one pair of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens

#: The supplementary planes' code points stand for words; a pair of texts may have as many distinct words.
FIRST_CODE, CODES = 0x10000, 1 << 20


#: Distances up to which only the cells of the table within them are computed, one after another.
BANDS = (16, 64)


def distance(a: Column, b: Column) -> Column:
    """levenshtein(a, b): most texts are near each other, so narrow bands of the table are tried first; what exceeds them is computed whole."""
    within = (F.array_max(F.filter(F.array(F.levenshtein(a, b, band)), lambda d: d >= 0)) for band in BANDS)
    return F.coalesce(*within, F.levenshtein(a, b))


def char_distance(reference: Column, prediction: Column) -> Column:
    """Edit distance in code points; equal texts skip the quadratic part."""
    return F.when(reference == prediction, F.lit(0)).otherwise(distance(reference, prediction)).cast("long")


def vocabulary(a: Column, b: Column) -> Column:
    """The distinct words of a pair of word arrays; too many for the block of code points fail the row."""
    found = F.array_distinct(F.concat(a, b))
    return F.when(F.size(found) <= CODES, found).otherwise(F.raise_error(F.lit(f"more than {CODES} distinct words in a pair")).cast("array<string>"))


def encoded(words: Column, known: Column) -> Column:
    """Each word as the code point of its place in the vocabulary."""
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + F.lit(FIRST_CODE - 1)), 8, "0")), "UTF-32")
    return F.array_join(F.transform(words, code), "")


def with_word_distance(df: DataFrame, reference: str, prediction: str, distance: str = "word_dist", length: str = "words") -> DataFrame:
    """df with the edit distance in words and the reference's words.

    Each distinct word of a pair becomes one code point, so that the built-in distance counts words. Word arrays and the
    vocabulary are columns of their own, else every use of them would split the texts again.
    """
    a, b, known = "__reference_words", "__prediction_words", "__vocabulary"
    split = df.withColumn(a, tokens(F.col(reference))).withColumn(b, tokens(F.col(prediction)))
    named = split.withColumn(known, vocabulary(F.col(a), F.col(b)))
    far = F.levenshtein(encoded(F.col(a), F.col(known)), encoded(F.col(b), F.col(known)))
    out = named.withColumn(distance, F.when(F.col(reference) == F.col(prediction), F.lit(0)).otherwise(far).cast("long"))
    return out.withColumn(length, F.size(a).cast("long")).drop(a, b, known)


def word_distance(reference: Column, prediction: Column) -> Column:
    """The same for a single expression; with_word_distance() is the form for many rows."""
    a, b = tokens(reference), tokens(prediction)
    known = vocabulary(a, b)
    return F.when(reference == prediction, F.lit(0)).otherwise(F.levenshtein(encoded(a, known), encoded(b, known))).cast("long")


def rate(distance: Column, length: Column, predicted: Column) -> Column:
    """distance / length; of an empty reference 0 for an empty prediction (predicted is its length) and 1 for any other."""
    return F.when(length == 0, F.when(predicted == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(distance / F.when(length > 0, length))


def cer(reference: Column, prediction: Column) -> Column:
    """Character error rate of one pair."""
    return rate(char_distance(reference, prediction), F.length(reference), F.length(prediction))


def wer(reference: Column, prediction: Column) -> Column:
    """Word error rate of one pair."""
    return rate(word_distance(reference, prediction), F.size(tokens(reference)), F.size(tokens(prediction)))
