"""Text normalisation and tokens as column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import ABBREVIATION_SIGNS, ABBREVIATIONS, CORRECTION_LEXICON, REVIEW_THRESHOLD, TILDES

#: What Python's str.split() cuts at: Unicode white space, and the four ASCII separators that Java leaves out.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"
PUNCTUATION = ".,;:!?"


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no function for it, so this is the one Python stage of normalisation; rows already in ASCII skip no stage, so apply it once, at ingestion."""

    @F.pandas_udf("string")
    def normalised(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFC")

    return normalised(text)


def _replaced(text: Column, table: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), table.items(), text)


def expand_abbreviations(text: Column) -> Column:
    """Signs to their expansions, one after another."""
    return _replaced(text, ABBREVIATIONS)


def resolve_tildes(text: Column) -> Column:
    """Composed vowels with a tilde to vowel and n."""
    return _replaced(text, TILDES)


def modernise_letters(text: Column) -> Column:
    """j to i everywhere; an initial v before anything but a vowel to u. Words end at the ASCII space only."""
    plain = F.translate(text, "jJ", "iI")
    lower = F.regexp_replace(plain, "(^| )v(?=[^ aeiouAEIOU])", "$1u")
    return F.regexp_replace(lower, "(^| )V(?=[^ aeiouAEIOU])", "$1U")


def normalise(text: Column, with_nfc: bool = False) -> Column:
    """All rules in order. with_nfc is for text that wasn't composed at ingestion."""
    return modernise_letters(resolve_tildes(expand_abbreviations(nfc(text) if with_nfc else text)))


def word_at(text: str, position: int) -> str:
    """The lower-cased word around a 0-based position: from the space before it to the space at or after it."""
    end = text.find(" ", position)
    return text[text.rfind(" ", 0, position) + 1 : len(text) if end < 0 else end].lower()


def corrected(text: str, confidences, candidates, threshold: float, lexicon: frozenset[str]) -> str:
    """One text's correction; each candidate is a mapping of position and options."""
    cells, now = list(text), text
    for c in candidates:
        position = c["position"]
        if position >= len(cells) or (position < len(confidences) and confidences[position] >= threshold):
            continue
        at = position if len(now) == len(cells) else sum(map(len, cells[:position]))
        for option in c["options"]:
            tried = now[:at] + option + now[at + len(cells[position]) :]
            if word_at(tried, position) in lexicon:
                cells[position], now = option, tried
                break
    return now


def completions(options: tuple[str, ...], lexicon: frozenset[str]) -> dict[tuple[str, str], str] | None:
    """What stands before and after a character, in lower case, with the first option between that makes a word of the lexicon; None for options of other than one character, or whose lower case depends on what is around them."""
    if any(o is None or len(o) != 1 or len(o.lower()) != 1 or o in " Σ" for o in options):
        return None
    found: dict[tuple[str, str], str] = {}
    for option in options:
        for word in lexicon:
            for k, c in enumerate(word):
                if c == option.lower():
                    found.setdefault((word[:k], word[k + 1 :]), option)
    return found


def corrected_by(text: str, positions: list[int], found: dict[tuple[str, str], str]) -> str:
    """corrected() for the positions of uncertain characters that all have completions()' options, in a text without a capital sigma: one lookup a position."""
    now, n = text, len(text)
    for p in positions:
        if p < n:
            end = now.find(" ", p + 1)
            option = found.get((now[now.rfind(" ", 0, p) + 1 : p].lower(), now[p + 1 : n if end < 0 else end].lower()))
            if option is not None:
                now = now[:p] + option + now[p + 1 :]
    return now


def correct(text: Column, confidences: Column, candidates: Column, threshold: float = REVIEW_THRESHOLD, lexicon: tuple[str, ...] = CORRECTION_LEXICON) -> Column:
    """Candidates (position, options) in order: the first option whose word is in the lexicon replaces an uncertain character. Later candidates see earlier replacements.

    A fold over array functions expresses this too, but copies the whole text for every option: 18 ms a line. Positions and
    confidences stay Arrow arrays here, and where a batch's candidates all have the same options of one character,
    corrected_by() tries them at once; other batches and texts go by corrected().
    """
    known = frozenset(lexicon)

    @F.arrow_udf("string")
    def fixed(texts: pa.Array, all_confidences: pa.Array, all_candidates: pa.Array) -> pa.Array:
        flat = all_candidates.flatten()
        place, options = flat.field("position"), flat.field("options")
        sizes = options.value_lengths().to_numpy(zero_copy_only=False)
        found = None
        if len(flat) and not flat.null_count and not place.null_count and not options.null_count and (sizes == sizes[0]).all() and pc.min(place).as_py() >= 0:
            # Only distinct strings are compared: the options of all candidates, one column an option.
            by_code = options.flatten().dictionary_encode()
            codes = by_code.indices.to_numpy(zero_copy_only=False).reshape(len(flat), -1)
            if not by_code.null_count and (codes == codes[0]).all():
                found = completions(tuple(by_code.dictionary[int(k)].as_py() for k in codes[0]), known)
        if found is None:
            rows = zip(texts.to_pylist(), all_confidences.to_pylist(), all_candidates.to_pylist())
            return pa.array([t if t is None or c is None else corrected(t, () if p is None else [math.nan if x is None else x for x in p], c, threshold, known) for t, p, c in rows], pa.string())
        lengths = lambda column: pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n_places, n_given = lengths(all_candidates), lengths(all_confidences)
        places, given = place.to_numpy(zero_copy_only=False).astype(np.int64), all_confidences.flatten().to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(len(texts)), n_places)
        has = places < n_given[row]
        sure = np.zeros(len(places), bool)
        sure[has] = given[((np.cumsum(n_given) - n_given)[row] + places)[has]] >= threshold
        left = places[~sure].tolist()
        ends = np.cumsum(np.bincount(row[~sure], minlength=len(texts))).tolist()
        out, start = [], 0
        for k, (t, end) in enumerate(zip(texts.to_pylist(), ends)):
            if t is None or start == end:
                out.append(t)
            elif "Σ" in t:
                out.append(corrected(t, all_confidences[k].as_py() or (), all_candidates[k].as_py(), threshold, known))
            else:
                out.append(corrected_by(t, left[start:end], found))
            start = end
        return pa.array(out, pa.string())

    return fixed(text, confidences, candidates)


def normalise_line(text: Column, confidences: Column, candidates: Column, aligned: bool = False) -> Column:
    """Rules, then correction. Positions refer to the raw text but are applied to the normalised one; aligned=True corrects first instead."""
    if aligned:
        return normalise(correct(text, confidences, candidates))
    return correct(normalise(text), confidences, candidates)


def tokens(text: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(text, WHITE_SPACE), lambda x: x != "")


def clean(word: Column) -> Column:
    """Lower case, without punctuation at either end."""
    return F.btrim(F.lower(word), F.lit(PUNCTUATION))


def abbreviation_count(text: Column) -> Column:
    """Unresolved abbreviation signs."""
    return F.length(text) - F.length(F.translate(text, ABBREVIATION_SIGNS, ""))


def piece_matches(word: Column, piece: Column) -> Column:
    """Whether a sub-word piece, without its marks, stands in the word; an empty piece does."""
    return F.contains(F.lower(word), F.lower(F.btrim(piece, F.lit("▁ "))))


def panel_text(text: Column) -> Column:
    """At most 52 characters for a panel, (non transcrite) for a missing text."""
    short = F.when(F.length(text) > 52, F.concat(F.substring(text, 1, 49), F.lit("..."))).otherwise(text)
    return F.when(text.isNull() | (text == ""), F.lit("(non transcrite)")).otherwise(short)
