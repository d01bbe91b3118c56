"""Licence scans (operator 2, native): a positional index of rare licence words, postings met at relative positions, key phrases verified.

The corpus gives each licence word its inverse document frequency. Of each template's mandatory words the up to `RARE` of
the highest IDF are its index entries, rank by rank (word -> template, position). A file that has a word of the first rank
is looked up: each of its rare words gives, by rank, the placements (template, word position - template position), and the
ranks' lists are intersected, so that only placements remain at which all rare words of a template stand in their relative
positions. Such a placement counts if all words of the template's mandatory key phrases stand at their places and enough
of its other words do. Each true placement has all mandatory words, so none is missed, whichever words are rare; the IDF
decides how few placements are ever looked at. Everything is an expression over a row's own words: texts are never
shuffled.

Defined cases: a null text counts as empty; placements may begin before a text's first word (key phrases can't); a
repeated or null doc_id is a row of its own; an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import NOTICES
from .shared import table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words of a licence notice, and the phrases of it that must be there."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_places(self) -> list[int]:
        """Positions in the template of the words of all key phrases."""
        found: set[int] = set()
        for key in self.keys:
            k = key.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)
            found |= set(range(at, at + len(k)))
        return sorted(found)


TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template("reserved", "all rights reserved", ("all rights reserved",), base=True),
    *(Template(*notice) for notice in NOTICES),
)
#: A placement needs at least this share of its template's words.
MIN_SCORE = 0.5
#: Index entries of a template.
RARE = 3
#: Letters that lower() turns into ASCII ones: the Kelvin sign and the dotted capital I.
FOLDED = ("\u212a", "\u0130")


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased. lower() also changes letters that are no part of any licence word or separator; rows with those that it would turn into ASCII are translated."""
    whole = F.coalesce(text, F.lit(""))
    odd = F.contains(whole, F.lit(FOLDED[0])) | F.contains(whole, F.lit(FOLDED[1]))
    low = F.when(odd, F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(whole))
    return F.array_remove(F.split(low, SEPARATORS), "")


def idf(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """Of each word of the templates' key phrases, by the number of texts that have it: a row a word comes to the driver."""
    vocabulary = sorted({t.words[k] for t in templates for k in t.key_places})
    found = words.select(F.explode(F.array_intersect("w", F.split(F.lit(" ".join(vocabulary)), " "))).alias("word")).groupBy("word").count().collect()
    texts = dict((r["word"], r["count"]) for r in found)
    most = max(texts.values(), default=0) + 1
    return {w: math.log(most / (1 + texts.get(w, 0))) for w in vocabulary}


def entries(template: Template, weights: dict[str, float]) -> list[int]:
    """Positions of the template's rarest mandatory words, the rarest first; of a repeated word one."""
    order = sorted(template.key_places, key=lambda k: (-weights[template.words[k]], template.words[k], k))
    first = {template.words[k]: k for k in reversed(order)}
    return [k for k in order if first[template.words[k]] == k][:RARE]


def index(templates: tuple[Template, ...], weights: dict[str, float], rank: int = 0) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position) for the rarest mandatory word of each template, or that of another rank (the last one where there are fewer)."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(templates):
        places = entries(t, weights)
        at = places[min(rank, len(places) - 1)]
        postings.setdefault(t.words[at], []).append((n, at))
    return postings


def placements(w: Column, templates: tuple[Template, ...], ranks: list[dict[str, list[tuple[int, int]]]]) -> Column:
    """Array of (template, start, score) for the verified placements in the words w of a row; ranks: the index by rank."""
    tpl = F.array(*(F.split(F.lit(t.text), " ") for t in templates))
    keys = F.array(*(F.array(*map(F.lit, t.key_places)) for t in templates))

    def hits(postings: dict[str, list[tuple[int, int]]]) -> Column:
        """The placements that a rank's words in the row give."""
        rare = sorted(postings)
        told = F.create_map(*(x for word in rare for x in (F.lit(word), F.array(*(F.struct(F.lit(n).alias("t"), F.lit(p).alias("p")) for n, p in postings[word])))))
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(rare))
        return F.flatten(F.transform(places, lambda i: F.transform(F.element_at(told, F.get(w, i)), lambda e: F.struct(e["t"].alias("t"), (i - e["p"]).alias("start")))))

    met = hits(ranks[0])
    for postings in ranks[1:]:
        met = F.array_intersect(met, hits(postings))
    sure = F.filter(met, lambda c: F.forall(F.get(keys, c["t"]), lambda k: F.get(w, c["start"] + k).eqNullSafe(F.get(F.get(tpl, c["t"]), k))))

    def scored(c: Column) -> Column:
        words = F.get(tpl, c["t"])
        same = F.filter(words, lambda x, k: F.get(w, c["start"] + k).eqNullSafe(x))
        return F.struct(c["t"].alias("t"), c["start"].cast("long").alias("start"), (F.size(same) / F.size(words)).alias("score"))

    found = F.filter(F.transform(sure, scored), lambda c: c["score"] >= MIN_SCORE)
    none = F.filter(F.array(F.struct(F.lit(0).alias("t"), F.lit(0).cast("long").alias("start"), F.lit(0.0).alias("score"))), lambda c: F.lit(False))
    return F.when(F.arrays_overlap(w, F.array(*map(F.lit, sorted(ranks[0])))), found).otherwise(none)


def license_scan(spark: SparkSession, docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, and the verified placements as an array of (t, start, score)."""
    words = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w"))
    weights = idf(words.select("w"), templates)
    ranks = [index(templates, weights, rank) for rank in range(RARE)]
    return words.select("doc_id", F.size("w").cast("long").alias("n_words"), placements(F.col("w"), templates, ranks).alias("placements"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    scanned = license_scan(spark, table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(t.label) for t in TEMPLATES))
    is_base = [n for n, t in enumerate(TEMPLATES) if t.base]
    found = scanned.select("doc_id", "n_words", "placements", F.filter("placements", lambda c: c["t"].isin(is_base)).alias("base"))

    def labels(column: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda c: F.get(names, c["t"])))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda c: c["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda c: c["start"])).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("placements").alias("labels"),
        F.coalesce(F.array_max(F.transform("placements", lambda c: c["score"])), F.lit(0.0)).alias("score"),
    )


def _sql_placements(t: Template) -> str:
    """The placements of one template as a list of structs, straight from the words."""
    first = t.key_places[0]
    fits = " AND ".join(f"w[i + {k - first + 1}] = '{t.words[k]}'" for k in t.key_places)
    listed = "[" + ", ".join(f"'{x}'" for x in t.words) + "]"
    same = f"len(list_filter(range({len(t.words)}), lambda k: i + k + {1 - first} > 0 AND w[i + k + {1 - first}] = {listed}[k + 1]))"
    placed = f"list_transform(list_filter(range(len(w)), lambda i: {fits}), lambda i: {{'label': '{t.label}', 'base': {str(t.base).lower()}, 'start': i - {first}, 'score': ({same})::DOUBLE / {len(t.words)}}})"
    return f"CASE WHEN list_contains(w, '{max(t.keys[0].split(), key=len)}') THEN {placed} ELSE [] END"


OP2_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), placed AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, list_filter(flatten([{", ".join(map(_sql_placements, TEMPLATES))}]), lambda c: c.score >= {MIN_SCORE}) AS p FROM words
)
SELECT doc_id, n_words, CAST(len(list_filter(p, lambda c: c.base)) AS BIGINT) AS n_base,
  list_min(list_transform(list_filter(p, lambda c: c.base), lambda c: c.start)) AS first_word,
  list_max(list_transform(list_filter(p, lambda c: c.base), lambda c: c.start)) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(p, lambda c: c.base), lambda c: c.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda c: c.label))), ','), '') AS labels,
  coalesce(list_max(list_transform(p, lambda c: c.score)), 0.0) AS score
FROM placed
"""
