"""Entities, lemmas, relations, graphs and TEI paragraphs over tokens.

A text is tagged once; what looks left or right of a token looks into the row's own arrays, so no shuffle is needed before
the graph's aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import DATE_WORDS, FUNCTION_WORDS, ORGANISATIONS, PERSONS, PLACES, RELATION_VERBS, TEI_TAGS, TITLES, VERBS
from ..functions.text import clean, tokens

#: What Python's str.isdigit() accepts and Java's \p{Nd} doesn't: superscripts, subscripts and circled digits.
DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]+$"


@dataclass(frozen=True)
class Lexicon:
    """Words of each entity type; earlier fields win."""

    PER: tuple[str, ...] = PERSONS
    LOC: tuple[str, ...] = PLACES
    TITLE: tuple[str, ...] = TITLES
    ORG: tuple[str, ...] = ORGANISATIONS
    DATE: tuple[str, ...] = DATE_WORDS

    def type_of(self, word: Column) -> Column:
        """A cleaned word's type, or null; digits are dates."""
        found = F.when(word.rlike(DIGITS), F.lit("DATE"))
        for name in ("DATE", "ORG", "TITLE", "LOC", "PER"):
            words = getattr(self, name)
            if words:
                found = F.when(word.isin(list(words)), F.lit(name)).otherwise(found)
        return found


def _literal_map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def bio(types: Column) -> Column:
    """BIO labels of an array of types: I- after the same type, B- otherwise, O for null."""
    return F.transform(types, lambda t, i: F.when(t.isNull(), "O").when(t.eqNullSafe(F.get(types, i - 1)), F.concat(F.lit("I-"), t)).otherwise(F.concat(F.lit("B-"), t)))


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """df with words (their punctuation kept)."""
    return df.withColumn("words", tokens(F.col(text)))


def with_labels(df: DataFrame, lexicon: Lexicon = Lexicon(), text: str = "text") -> DataFrame:
    """df with words and their BIO labels."""
    typed = with_tokens(df, text).withColumn("types", F.transform("words", lambda w: lexicon.type_of(clean(w))))
    return typed.withColumn("labels", bio(F.col("types"))).drop("types")


def labelled_tokens(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each token of with_labels(): keys, tok_pos, word, label."""
    return df.select(*keys, F.posexplode(F.arrays_zip("words", "labels")).alias("tok_pos", "t")).select(*keys, "tok_pos", F.col("t.words").alias("word"), F.col("t.labels").alias("label"))


def labels_by_pieces(words: Column, predictions: Column) -> Column:
    """For each word the label of the first prediction (piece, label) that stands in it, else O: how a token classifier's output meets words."""
    from ..functions.text import piece_matches

    return F.transform(words, lambda w: F.coalesce(F.get(F.filter(predictions, lambda p: piece_matches(w, p["piece"])), F.lit(0))["label"], F.lit("O")))


def _spans(labels: Column) -> Column:
    """(start, end, type) of entities: B- opens, I- goes on whatever its type, all else ends; an I- without an open entity is none."""
    marks = F.transform(labels, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    breaks = F.filter(marks, lambda m: ~m["x"].startswith("I-"))
    begins = F.filter(marks, lambda m: m["x"].startswith("B-"))
    end = lambda b: F.coalesce(F.get(F.filter(breaks, lambda m: m["i"] > b["i"]), F.lit(0))["i"], F.size(labels))
    return F.transform(begins, lambda b: F.struct(b["i"].alias("start"), end(b).alias("end"), F.substring(b["x"], 3, 100).alias("type")))


def entities(words: Column, labels: Column) -> Column:
    """(texte, type) of the entities in order."""
    return F.transform(_spans(labels), lambda s: F.struct(F.array_join(F.slice(words, s["start"] + 1, s["end"] - s["start"]), " ").alias("texte"), s["type"].alias("type")))


def relations(words: Column, labels: Column, verbs: dict[str, str] | None = None) -> Column:
    """(ord, source, type_source, relation, cible, type_cible): each relation verb with the nearest labelled word before and after it."""
    table = _literal_map(verbs or RELATION_VERBS)
    labelled = F.filter(F.transform(labels, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: m["x"] != "O")
    found = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.element_at(table, clean(w)).alias("relation"))), lambda v: v["relation"].isNotNull())

    def edge(v: Column) -> Column:
        before = F.filter(labelled, lambda m: m["i"] < v["i"])
        source, target = F.get(before, F.size(before) - 1), F.get(F.filter(labelled, lambda m: m["i"] > v["i"]), F.lit(0))
        kind = lambda m: F.substring(m["x"], 3, 100)
        return F.struct(v["i"].alias("ord"), F.get(words, source["i"]).alias("source"), kind(source).alias("type_source"), v["relation"].alias("relation"), F.get(words, target["i"]).alias("cible"), kind(target).alias("type_cible"))

    return F.filter(F.transform(found, edge), lambda e: e["source"].isNotNull() & e["cible"].isNotNull())


def relation_rows(df: DataFrame, *keys: str, verbs: dict[str, str] | None = None) -> DataFrame:
    """A row for each relation of with_labels()."""
    return df.select(*keys, F.explode(relations(F.col("words"), F.col("labels"), verbs)).alias("r")).select(*keys, "r.*")


def graph_nodes(edges: DataFrame, *order: str) -> DataFrame:
    """(name, type): the last mention's type wins; in one relation the target comes after the source."""
    mention = lambda name, kind, n: edges.select(F.col(name).alias("name"), F.col(kind).alias("type"), F.struct(*order, F.lit(n).alias("side")).alias("at"))
    return mention("source", "type_source", 0).unionByName(mention("cible", "type_cible", 1)).groupBy("name").agg(F.max_by("type", "at").alias("type"))


def graph_edges(edges: DataFrame, *order: str, multigraph: bool = False) -> DataFrame:
    """(source, cible, relation): one edge for each pair, the last relation wins; all of them in a multigraph."""
    if multigraph:
        return edges.select("source", "cible", "relation")
    return edges.groupBy("source", "cible").agg(F.max_by("relation", F.struct(*order)).alias("relation"))


def morphology(word: Column) -> Column:
    """(pos, lemme) of a word as it stands in the text."""
    low = clean(word)
    function, verb = _literal_map({k: p for k, (p, _) in FUNCTION_WORDS.items()}), _literal_map(VERBS)
    lemmas = _literal_map({k: l for k, (_, l) in FUNCTION_WORDS.items()})
    proper = word.rlike(r"^\p{IsUppercase}")
    stem = F.when(F.length(low) > 3, F.rtrim(low, F.lit("s"))).otherwise(low)
    pos = F.coalesce(F.element_at(function, low), F.when(F.element_at(verb, low).isNotNull(), "VERB"), F.when(proper, "PROPN").otherwise("NOUN"))
    lemma = F.coalesce(F.element_at(lemmas, low), F.element_at(verb, low), F.when(proper, low).otherwise(stem))
    return F.struct(pos.alias("pos"), lemma.alias("lemme"))


def analyse(words: Column) -> Column:
    """(mot, pos, lemme) of each word."""

    def one(w: Column) -> Column:
        m = morphology(w)
        return F.struct(w.alias("mot"), m["pos"].alias("pos"), m["lemme"].alias("lemme"))

    return F.transform(words, one)


def lemmas(words: Column) -> Column:
    """The lemmas alone."""
    return F.transform(words, lambda w: morphology(w)["lemme"])


def xml_escape(text: Column) -> Column:
    """Text content of XML."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tei_paragraph(words: Column, labels: Column) -> Column:
    """Text and tagged entities, each word or entity followed by a space; an I- without an open entity drops its word."""
    tags = _literal_map(TEI_TAGS)

    def entity(s: Column) -> Column:
        tag = F.coalesce(F.element_at(tags, s["type"]), F.lit("name"))
        inside = xml_escape(F.array_join(F.slice(words, s["start"] + 1, s["end"] - s["start"]), " "))
        return F.struct(s["start"].alias("at"), F.concat(F.lit("<"), tag, F.lit(">"), inside, F.lit("</"), tag, F.lit("> ")).alias("piece"))

    word = lambda x, i: F.when(x == "O", F.struct(i.alias("at"), F.concat(xml_escape(F.get(words, i)), F.lit(" ")).alias("piece")))
    plain = F.filter(F.transform(labels, word), lambda p: p.isNotNull())
    pieces = F.sort_array(F.concat(plain, F.transform(_spans(labels), entity)))
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
