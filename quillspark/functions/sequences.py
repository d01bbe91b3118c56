"""Array functions over confidences, tokens and labels."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import CANDIDATE_OPTIONS, ENTITY_TYPES, IGNORED_LABEL, REVIEW_THRESHOLD

#: BIO label -> id: O, then B and I of each type.
LABEL_IDS = {label: n for n, label in enumerate(["O", *(f"{p}-{t}" for t in ENTITY_TYPES for p in "BI")])}


def resized(values: Column, length: Column) -> Column:
    """Cut to length, or padded with the last value (0.5 if there is none)."""
    last = F.coalesce(F.get(values, F.size(values) - 1), F.lit(0.5))
    return F.when(F.size(values) >= length, F.slice(values, F.lit(1), length)).otherwise(F.concat(values, F.array_repeat(last, F.greatest(length - F.size(values), F.lit(0)))))


def uncertain_positions(confidences: Column, threshold: Column | float = REVIEW_THRESHOLD) -> Column:
    """0-based positions with a confidence strictly below the threshold."""
    marked = F.transform(confidences, lambda c, i: F.when(c < threshold, i))
    return F.filter(marked, lambda i: i.isNotNull())


def candidates(confidences: Column, threshold: Column | float = REVIEW_THRESHOLD) -> Column:
    """(position, options) of the uncertain positions."""
    options = F.array(*(F.lit(o) for o in CANDIDATE_OPTIONS))
    return F.transform(uncertain_positions(confidences, threshold), lambda i: F.struct(i.alias("position"), options.alias("options")))


def spread_confidences(pieces: Column, confidences: Column, text: Column) -> Column:
    """Each decoded piece's confidence for each of its characters, resized to the text. The first piece marks the start and is skipped."""
    useful = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    n = F.least(F.size(useful), F.size(confidences))
    pairs = F.arrays_zip(F.slice(useful, F.lit(1), n).alias("piece"), F.slice(confidences, F.lit(1), n).alias("c"))
    spread = F.flatten(F.transform(pairs, lambda z: F.array_repeat(z["c"], F.length(z["piece"]))))
    return resized(spread, F.length(text))


def top_softmax(logits: Column) -> Column:
    """The highest softmax probability of each step's logits."""
    return F.transform(logits, lambda x: 1 / F.aggregate(F.transform(x, lambda v: F.exp(v - F.array_max(x))), F.lit(0.0), lambda a, v: a + v))


def subtoken_labels(labels: Column, word_ids: Column) -> Column:
    """Label id at each word's first sub-token, the ignored id elsewhere. A null word id resets the comparison."""
    ids = F.create_map(*(F.lit(x) for kv in LABEL_IDS.items() for x in kv))

    def label(w: Column, i: Column) -> Column:
        return F.when(w.isNull() | w.eqNullSafe(F.get(word_ids, i - 1)), F.lit(IGNORED_LABEL)).otherwise(F.element_at(ids, F.get(labels, w)))

    return F.transform(word_ids, label)


def restored_labels(label_ids: Column, pad: int) -> Column:
    """The ignored id replaced by the padding id, as decoding needs."""
    return F.transform(label_ids, lambda x: F.when(x == IGNORED_LABEL, F.lit(pad)).otherwise(x))


def runs(flags: Column) -> Column:
    """(start, end) of runs of true in a boolean array, end exclusive."""
    at = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
    whole = F.sequence(F.lit(0), F.size(flags))
    starts = F.filter(whole, lambda i: at(i) & ~at(i - 1))
    ends = F.filter(whole, lambda i: ~at(i) & at(i - 1))
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def rounded(value: Column, digits: int) -> Column:
    """Rounded as the exact binary value is, a tie to the even digit: 0.70005, which is less in binary, to 0.7. round() takes the shortest decimal instead."""
    step, tie = 10.0**-digits, 0.5 * 10.0**-digits
    # The formatter takes what is below the last digit's half for 0, the double nearest to that half included, which may be above it.
    up = F.abs(value) >= tie if Decimal(tie) > Decimal(5).scaleb(-digits - 1) else F.abs(value) > tie
    small = F.when(up, F.signum(value) * step).otherwise(F.lit(0.0))
    return F.when(F.abs(value) < step, small).otherwise(F.translate(F.format_number(value, digits), ",", "").cast("double"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, inside of lambdas too, where Spark finds no common expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean(values: Column) -> Column:
    """The mean in array order, 0 of none: the order of a float sum is part of the result."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.when(F.size(values) > 0, F.size(values))).otherwise(F.lit(0.0))
