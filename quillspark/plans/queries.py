"""The engine's registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alignment, geometry, metrics, sequences, text
from ..operators import contract, engines, evaluation, raster, sampling, tokens, training
from ..sources import contracts, journal, xml
from . import derive, pipelines
from .derive import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _long(name: str):
    return F.col(name).cast("long").alias(name)


# Lines and normalisation


@query
def lines_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return derive.lines(spark, sf).select("doc_id", "lang", "pos", "line", F.length("line").cast("long").alias("n_chars"))


@query
def normalize_rules(spark: SparkSession, sf: str) -> DataFrame:
    return derive.versions(spark, sf).select("doc_id", "pos", "raw", "norm")


@query
def nfc_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    lines = derive.lines(spark, sf)
    apart = F.col("line")
    for letter, base, mark in (("é", "e", "́"), ("ó", "o", "́"), ("ñ", "n", "̃"), ("ü", "u", "̈")):
        apart = F.replace(apart, F.lit(letter), F.lit(base + mark))
    parted = lines.select("doc_id", "pos", apart.alias("apart"))
    return parted.select("doc_id", "pos", F.length("apart").cast("long").alias("n_apart"), text.nfc(F.col("apart")).alias("composed"))


@query
def abbreviations_by_source(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.versions(spark, sf)
    count = lambda c: F.sum(text.abbreviation_count(F.col(c)).cast("long"))
    return v.groupBy("source").agg(count("raw").alias("raw_signs"), count("norm").alias("left_signs"), F.count(F.lit(1)).alias("n_lines"))


@query
def lexicon_correct(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.lines(spark, sf).where(F.length("line") > 0)
    percent = derive.percents(F.length("line"))
    place = F.pmod(F.col("doc_id") * 13 + F.col("pos") * 5, F.length("line").cast("long")).cast("int")
    one = F.array(F.struct(place.alias("position"), F.array(F.lit("e"), F.lit("a"), F.lit("o")).alias("options")))
    fixed = v.select("doc_id", "pos", "line", derive.confidences(percent).alias("cc"), one.alias("candidates"))
    return fixed.select("doc_id", "pos", text.correct(F.col("line"), F.col("cc"), F.col("candidates"), lexicon=derive.CORPUS_WORDS).alias("corrected"))


# Error rates


@query
def cer_line(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.versions(spark, sf)
    return v.select("doc_id", "pos", metrics.char_distance(F.col("line"), F.col("raw")).alias("dist_raw"), metrics.char_distance(F.col("line"), F.col("norm")).alias("dist_norm"), F.length("line").cast("long").alias("chars"))


def _stages(v: DataFrame, *keep: str) -> DataFrame:
    both = F.explode(F.array(F.struct(F.lit("brut").alias("stage"), F.col("raw").alias("text")), F.struct(F.lit("regles").alias("stage"), F.col("norm").alias("text")))).alias("v")
    return v.select(*keep, F.col("line").alias("reference"), both).select(*keep, "reference", "v.*")


@query
def cer_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    errors = evaluation.with_errors(_stages(derive.versions(spark, sf), "lang"), "reference", "text", words=False)
    return evaluation.corpus_cer(errors, "lang", "stage")


@query
def cer_rollup(spark: SparkSession, sf: str) -> DataFrame:
    errors = evaluation.with_errors(derive.versions(spark, sf), "line", "raw", words=False)
    return evaluation.corpus_cer_rollup(errors, "lang", "source").select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "level", "dist", "chars", "cer")


@query
def wer_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.corpus_wer(evaluation.with_errors(derive.versions(spark, sf), "line", "raw"), "lang")


@query
def stage_transitions(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluation.wide_transitions(derive.versions(spark, sf), {"modele": "line", "brut": "raw", "regles": "norm"})
    return found.select("transition", F.round("mean_distance", 9).alias("mean_distance"), "dist", "n_changed", "n_lines")


@query
def stage_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The same for input that has a row a line and stage."""
    v = derive.versions(spark, sf)
    stages = F.explode(F.array(*(F.struct(F.lit(n).alias("stage_ord"), F.lit(s).alias("stage"), F.col(c).alias("text")) for n, (s, c) in enumerate((("modele", "line"), ("brut", "raw"), ("regles", "norm"))))))
    long = v.select(F.concat_ws(":", "doc_id", "pos").alias("line_id"), stages.alias("v")).select("line_id", "v.*")
    return evaluation.stage_transitions(long).select("transition", F.round("mean_distance", 9).alias("mean_distance"), "dist", "n_changed", "n_lines")


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.with_errors(derive.versions(spark, sf), "line", "raw", words=False).select("doc_id", "pos", "dist", "chars")


@query
def bootstrap_replicates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.bootstrap(_errors(spark, sf), ("doc_id", "pos")).select(F.col("iteration").cast("long").alias("iteration"), F.round("cer", 10).alias("cer"))


@query
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    bounds = evaluation.interval(evaluation.bootstrap(_errors(spark, sf), ("doc_id", "pos")))
    return bounds.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query
def poisson_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.poisson_bootstrap(_errors(spark, sf), ("doc_id", "pos")).select(F.col("iteration").cast("long").alias("iteration"), F.round("cer", 10).alias("cer"))


@query
def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    errors = evaluation.with_errors(derive.versions(spark, sf), "line", "raw").select("doc_id", "pos", "dist", "chars", "word_dist", "words")
    return evaluation.report_row(errors, evaluation.bootstrap(errors, ("doc_id", "pos")))


@query
def multinomial_interval(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.interval(evaluation.multinomial_bootstrap(_errors(spark, sf), ("doc_id", "pos")))


@query
def mcnemar_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.mcnemar(derive.versions(spark, sf), "line", "raw", "norm").select(_long("n01"), _long("n10"), F.round("statistic", 9).alias("statistic"))


@query
def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.compare(derive.versions(spark, sf), "line", "raw", "norm").select("dist_a", "dist_b", "chars", _long("n01"), _long("n10"), "best")


@query
def train_eval_join(spark: SparkSession, sf: str) -> DataFrame:
    v = evaluation.with_errors(derive.versions(spark, sf), "line", "raw", words=False).groupBy("doc_id").agg(F.sum("dist").alias("dist"), F.sum("chars").alias("chars"))
    return v.join(table(spark, sf, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.sum("dist").alias("dist"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n_docs"))


@query
def paired_lines(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.versions(spark, sf).withColumn("line_id", F.concat_ws(":", "doc_id", "pos"))
    joined = evaluation.paired(v.select("line_id", "line"), v.select("line_id", "raw"))
    return joined.select("line_id", (F.col("line") == F.col("raw")).alias("same"), F.length("raw").cast("long").alias("n_raw"))


# The contract


def _box():
    return F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (100, 0), (100, 30), (0, 30))))


def _order():
    return F.floor(F.col("pos") / derive.LINE_STEP) * 10_000 + F.pmod("pos", F.lit(derive.LINE_STEP))


def _contract_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as contract structs; the raw text is what was transcribed."""
    v = derive.versions(spark, sf).withColumn("percent", derive.percents(F.length("raw")))
    cc = derive.confidences(F.col("percent"))
    line = contract.make_line(contract.line_id(F.col("doc_id"), _order()), F.col("raw"), _box(), cc, _order(), sequences.candidates(cc))
    return v.withColumn("cc", cc).withColumn("l", line)


def _contract_documents(spark: SparkSession, sf: str, century=None, kind=None) -> DataFrame:
    """The lines of _contract_lines() as documents; confidences and candidates are made from the gathered texts."""
    kinds = F.array(*(F.lit(k) for k in contract.DOCUMENT_TYPES))
    century = F.pmod("doc_id", F.lit(10)) + 8 if century is None else century
    kind = F.get(kinds, F.pmod("doc_id", F.lit(3)).cast("int")) if kind is None else kind
    thin = F.struct(_order().cast("int").alias("reading_order"), contract.line_id(F.col("doc_id"), _order()).alias("line_id"), "doc_id", "pos", F.col("raw").alias("text"))
    named = derive.lines(spark, sf).withColumn("raw", derive.raw(F.col("line"))).withColumn("line_struct", thin)
    named = named.withColumn("document_id", F.concat(F.lit("d"), F.col("doc_id"))).withColumn("century", century).withColumn("document_type", kind)
    named = named.withColumn("image_width", F.lit(1000)).withColumn("image_height", F.lit(1500)).withColumnRenamed("lang", "language")

    def build(x):
        cc = derive.confidences(derive.percents(F.length(x["text"]), x["doc_id"], x["pos"]))
        return sequences.bound(cc, lambda c: contract.make_line(x["line_id"], x["text"], _box(), c, x["reading_order"], sequences.candidates(c)))

    return contract.make_documents(named, line="line_struct", build=build)


@query
def make_lines(spark: SparkSession, sf: str) -> DataFrame:
    v = _contract_lines(spark, sf)
    return v.select("doc_id", "pos", "l.line_id", F.size("l.char_confidences").cast("long").alias("n_confidences"), F.aggregate("percent", F.lit(0).cast("long"), lambda a, x: a + x).alias("percent"), "l.confidence", "l.needs_review")


@query
def contract_files(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty documents written as files, of which only the valid ones are committed, and read back under the contract."""
    century = F.pmod("doc_id", F.lit(12)) + 7
    path = derive.scratch(spark, "contracts")
    contracts.write_contracts(_contract_documents(spark, sf, century), path, strict=False)
    back, _ = contracts.split_quarantine(contracts.read_contracts(spark, path, strict=False, lines=True))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    return back.select("document_id", F.col("metadata.century").cast("long").alias("century"), F.size("lines").cast("long").alias("n_lines"), chars.alias("n_chars"))


@query
def review_rate(spark: SparkSession, sf: str) -> DataFrame:
    docs = _contract_documents(spark, sf)
    return docs.select("document_id", F.size("lines").cast("long").alias("n_lines"), contract.review_rate(F.col("lines")).alias("review_rate"))


@query
def documents_nested(spark: SparkSession, sf: str) -> DataFrame:
    docs = _contract_documents(spark, sf)
    ids = F.array_join(F.transform("lines", lambda x: x["line_id"]), " ")
    return docs.select("document_id", F.col("metadata.century").cast("long").alias("century"), "metadata.document_type", "metadata.license", F.sha2(ids, 256).alias("line_ids"))


@query
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    century = F.pmod("doc_id", F.lit(12)) + 7
    kind = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit("format_inconnu")).when(F.pmod("doc_id", F.lit(7)) != 0, F.lit("texte_simple"))
    found = contract.validated(_contract_documents(spark, sf, century, kind))
    return found.select("document_id", "valid", "message", F.array_join("violations", "; ").alias("violations"))


@query
def eda_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    v = _contract_lines(spark, sf).select("lang", "percent", "l.*")
    counted = v.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.aggregate("percent", F.lit(0).cast("long"), lambda a, x: a + x)).alias("percent"), F.sum(F.length("text").cast("long")).alias("n_chars"),
        F.count_if("needs_review").alias("n_review"), F.sum(text.abbreviation_count(F.col("text")).cast("long")).alias("n_abbreviations"),
    )
    return counted


@query
def eda_report(spark: SparkSession, sf: str) -> DataFrame:
    lines = _contract_lines(spark, sf).select("lang", "l.*")
    found = evaluation.explore(lines, "lang")
    keep = ("mean_confidence", "min_confidence", "max_confidence", "review_rate", "mean_length")
    return found.select("lang", "n_lines", *(F.round(c, 3).alias(c) for c in keep), "n_abbreviations")


@query
def lines_by_century(spark: SparkSession, sf: str) -> DataFrame:
    century = F.when(F.pmod("doc_id", F.lit(11)) != 0, F.pmod("doc_id", F.lit(10)) + 8)
    return evaluation.by_century(contract.flatten(_contract_documents(spark, sf, century)))


# Confidences and labels


@query
def candidate_positions(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.lines(spark, sf)
    found = v.select("doc_id", "pos", sequences.uncertain_positions(derive.confidences(derive.percents(F.length("line")))).alias("p"))
    return found.select("doc_id", "pos", F.size("p").cast("long").alias("n"), F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"))


@query
def confidence_resize(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.lines(spark, sf).withColumn("percent", derive.percents(F.length("line")))
    sized = sequences.resized(F.col("percent"), F.lit(100))
    return v.select("doc_id", "pos", F.array_join(F.transform(sized, lambda x: x.cast("int").cast("string")), ",").alias("percents"))


@query
def token_to_char(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.lines(spark, sf).withColumn("pieces", F.concat(F.array(F.lit("")), F.split("line", " ")))
    v = v.withColumn("percent", derive.percents(F.size("pieces") - 2))
    spread = sequences.spread_confidences(F.col("pieces"), F.col("percent"), F.col("line"))
    return v.select("doc_id", "pos", F.array_join(F.transform(spread, lambda x: x.cast("int").cast("string")), ",").alias("percents"))


@query
def softmax_confidence(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))
    top = table(spark, sf, "embeddings").select("vec_id", F.posexplode(sequences.top_softmax(steps)).alias("step", "p"))
    return top.select("vec_id", _long("step"), F.round("p", 9).alias("p"))


@query
def subtoken_labels(spark: SparkSession, sf: str) -> DataFrame:
    v = tokens.with_labels(derive.lines(spark, sf), derive.CORPUS_LEXICON, "line").where(F.size("words") > 0)
    ids = F.transform(F.sequence(F.lit(0), 2 * F.size("words")), lambda i: F.when(i % 7 != 0, F.floor((i - 1) / 2).cast("int")))
    found = v.withColumn("ids", ids).select("doc_id", "pos", sequences.subtoken_labels(F.col("labels"), F.col("ids")).alias("x"))
    return found.select("doc_id", "pos", F.array_join(F.col("x").cast("array<string>"), ",").alias("label_ids"))


# Tokens, entities, relations


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.with_labels(derive.lines(spark, sf), derive.CORPUS_LEXICON, "line")


@query
def tokens_clean(spark: SparkSession, sf: str) -> DataFrame:
    words = derive.lines(spark, sf).select(F.explode(text.tokens(F.col("line"))).alias("w"))
    return words.groupBy(text.clean(F.col("w")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query
def bio_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.labelled_tokens(_labelled(spark, sf), "doc_id", "pos").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos") * 100 + F.col("tok_pos")).alias("places"))


@query
def entities(spark: SparkSession, sf: str) -> DataFrame:
    found = _labelled(spark, sf).select("doc_id", "pos", F.posexplode(tokens.entities(F.col("words"), F.col("labels"))).alias("ord", "e"))
    return found.select("doc_id", "pos", _long("ord"), "e.texte", "e.type")


@query
def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = _labelled(spark, sf).select("lang", F.explode(tokens.entities(F.col("words"), F.col("labels"))).alias("e"))
    return found.groupBy("lang", "e.type").agg(F.count(F.lit(1)).alias("n"))


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.relation_rows(_labelled(spark, sf), "doc_id", "pos", verbs=derive.CORPUS_VERBS)


@query
def relations(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).select("doc_id", "pos", _long("ord"), "source", "type_source", "relation", "cible", "type_cible")


@query
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.graph_nodes(_relations(spark, sf), "doc_id", "pos", "ord")


@query
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.graph_edges(_relations(spark, sf), "doc_id", "pos", "ord")


@query
def graph_size(spark: SparkSession, sf: str) -> DataFrame:
    r = _relations(spark, sf)
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    return count(tokens.graph_nodes(r, "doc_id", "pos", "ord"), "nodes").unionByName(count(tokens.graph_edges(r, "doc_id", "pos", "ord"), "edges")).unionByName(count(tokens.graph_edges(r, multigraph=True), "multi_edges"))


@query
def pos_lemma(spark: SparkSession, sf: str) -> DataFrame:
    words = derive.lines(spark, sf).select(F.explode(tokens.analyse(text.tokens(F.col("line")))).alias("a"))
    return words.groupBy("a.mot", "a.pos", "a.lemme").agg(F.count(F.lit(1)).alias("n"))


@query
def lemma_index(spark: SparkSession, sf: str) -> DataFrame:
    words = derive.lines(spark, sf).select("doc_id", F.explode(tokens.lemmas(text.tokens(F.col("line")))).alias("lemma"))
    return words.groupBy("lemma").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query
def piece_labels(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.array(*(F.struct(F.lit(p).alias("piece"), F.lit(t).alias("label")) for p, t in (("▁the ", "B-PER"), ("ción", "B-LOC"), ("▁ein", "B-ORG"), ("eau", "B-DATE"))))
    v = derive.lines(spark, sf).select("lang", F.explode(tokens.labels_by_pieces(text.tokens(F.col("line")), pieces)).alias("label"))
    return v.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def entity_f1(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.versions(spark, sf)
    spans = lambda c: tokens.with_labels(v, derive.CORPUS_LEXICON, c).select("doc_id", "pos", F.posexplode(tokens.entities(F.col("words"), F.col("labels"))).alias("ord", "e")).select("doc_id", "pos", "ord", "e.texte", "e.type")
    return evaluation.entity_f1(spans("line"), spans("raw"), "doc_id", "pos", "ord", "texte").select("type", _long("tp"), _long("fp"), _long("fn"), F.round("f1", 9).alias("f1"))


@query
def tei_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("doc_id", "pos", tokens.tei_paragraph(F.col("words"), F.col("labels")).alias("tei"))


@query
def tei_documents(spark: SparkSession, sf: str) -> DataFrame:
    v = _labelled(spark, sf)
    return v.select("doc_id", "pos", xml.tei_xml(tokens.tei_paragraph(F.col("words"), F.col("labels")), F.concat(F.lit("Document "), F.col("doc_id"))).alias("xml"))


# Samples and seals


@query
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.file_digests(_page_files(spark, sf).select("path", F.encode("content", "UTF-8").alias("content")))


@query
def seal_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the rows, dealt anew, one lost and one changed still have their seal."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source")
    digest = sampling.seal(rows, "doc_id", "lang", "source").first()["digest"]
    first = rows.agg(F.min("doc_id")).first()[0]
    versions = {"same": rows.repartition(3, "lang"), "lost": rows.where(F.col("doc_id") != first), "changed": rows.withColumn("source", F.when(F.col("doc_id") == first, "x").otherwise(F.col("source")))}
    found = [sampling.seal(v, "doc_id", "lang", "source").select(F.lit(n).alias("what"), (F.col("digest") == digest).alias("intact"), _long("n")) for n, v in versions.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), F.col("lang"), F.col("doc_id"))


@query
def split_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.distribution(stratified_split(spark, sf), F.col("lang"))


@query
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = stratified_split(spark, sf)
    part = lambda s: rows.where(F.col("split") == s).select("doc_id")
    return part("train").intersect(part("test")).unionByName(part("train").intersect(part("val"))).unionByName(part("val").intersect(part("test")))


@query
def seal_digest(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.seal(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id", "lang", "source").select("digest", _long("n"))


# Rasters and geometry


@query
def row_islands(spark: SparkSession, sf: str) -> DataFrame:
    hourly = table(spark, sf, "events").groupBy("event_type", (F.datediff("ts", F.lit("1970-01-01")).cast("long") * 24 + F.hour("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    ends = hourly.groupBy("event_type").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    every = ends.select("event_type", F.explode(F.sequence("a", "b")).alias("hour")).join(hourly, ["event_type", "hour"], "left")
    return raster.islands(every, "event_type", order="hour", active=F.coalesce(F.col("n"), F.lit(0)) >= 3)


@query
def segment_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = raster.segment_lines(derive.raster_rows(spark, sf))
    return found.select("page_id", *(_long(c) for c in ("reading_order", "x", "y", "w", "h")), geometry.format_points(F.col("polygon")).alias("points"))


@query
def preprocessed_images(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of 8 by 8 pixels through the whole chain of filters, as rows of signs."""
    grey = F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 1000), F.lit(256)))
    hexed = F.array_join(F.transform(grey, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    pictures = table(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(hexed).alias("content"))
    signs = F.translate(F.hex("content"), "F", "1")
    return raster.preprocessed(pictures, tiles=1, window=3).select(F.col("page_id").alias("vec_id"), F.regexp_replace(F.regexp_replace(signs, "00", "."), "11", "#").alias("signs"))


@query
def array_runs(spark: SparkSession, sf: str) -> DataFrame:
    flags = F.transform("embedding", lambda x: x > 0)
    return table(spark, sf, "embeddings").select("vec_id", F.explode(sequences.runs(flags)).alias("r")).select("vec_id", "r.start", "r.end").select("vec_id", _long("start"), _long("end"))


@query
def polygons(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "embeddings").select("vec_id", derive.polygon(F.col("embedding")).alias("p")).select("vec_id", "p", geometry.format_points(F.col("p")).alias("points"))
    box = geometry.bounding_box(geometry.parse_points(F.col("points")), F.lit(200), F.lit(150))
    return p.select("vec_id", "points", box.alias("b"), (F.size(geometry.parse_points(F.col("points"))) == F.size("p")).alias("same_size")).select("vec_id", "points", "same_size", "b.*")


@query
def alto_boxes(spark: SparkSession, sf: str) -> DataFrame:
    numbers = F.array_join(F.transform(F.slice("embedding", F.lit(1), F.pmod("vec_id", F.lit(9)).cast("int")), lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("string")), " ")
    at = lambda k: F.floor(F.get("embedding", F.lit(k)).cast("double") * 1000).cast("double")
    made = table(spark, sf, "embeddings").select("vec_id", geometry.alto_polygon(numbers, at(20), at(21), at(22), at(23)).alias("p"))
    return made.select("vec_id", F.size("p").cast("long").alias("n_points"), geometry.format_points(F.col("p")).alias("points"))


@query
def panel_rows(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.when(F.pmod("pos", F.lit(3)) != 0, F.col("line"))
    colour = F.array_join(geometry.line_colour(F.pmod("pos", F.lit(1000))).cast("array<string>"), ",")
    return derive.lines(spark, sf).select("doc_id", "pos", text.panel_text(shown).alias("panel"), colour.alias("colour"))


# Files


def _page_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = _contract_documents(spark, sf)
    lines = F.transform("lines", lambda x: F.struct(x["reading_order"].alias("reading_order"), x["polygon"].alias("polygon"), x["text"].alias("text")))
    return docs.select(F.concat("document_id", F.lit(".xml")).alias("path"), xml.page_xml(F.concat("document_id", F.lit(".png")), F.lit(1000), F.lit(1500), lines, F.lit("2024-01-01T00:00:00")).alias("content"))


@query
def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _page_files(spark, sf).select("path", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("sha256"), xml.detect_format(F.col("content")).alias("format"))


@query
def xml_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines, _ = xml.corpus_lines(_page_files(spark, sf))
    return lines.select("path", _long("line_idx"), "text", geometry.format_points(F.col("polygon")).alias("points"))


@query
def xml_page_lines(spark: SparkSession, sf: str) -> DataFrame:
    return xml.page_lines(_page_files(spark, sf)).select("path", _long("line_idx"), "line_id", "text", geometry.format_points(F.col("polygon")).alias("points"))


@query
def alto_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Text lines as ALTO files, parsed: every word a String, boxes of which each fifth is empty."""
    lines = derive.lines(spark, sf)
    order = F.floor(F.col("pos") / derive.LINE_STEP) * 10_000 + F.pmod("pos", F.lit(derive.LINE_STEP))
    word = lambda w: F.concat(F.lit('<String CONTENT="'), F.replace(tokens.xml_escape(w), F.lit('"'), F.lit("&quot;")), F.lit('"/>'))
    width = F.when(order % 5 == 4, 0).otherwise(F.length("line") + 1)
    line = F.concat(F.lit('<TextLine ID="l'), order.cast("string"), F.lit('" HPOS="10" VPOS="'), (order * 40).cast("string"), F.lit('" WIDTH="'), width.cast("string"), F.lit('" HEIGHT="30">'), F.array_join(F.transform(F.split("line", " "), word), ""), F.lit("</TextLine>"))
    gathered = lines.select("doc_id", F.struct("pos", line.alias("x")).alias("l")).groupBy("doc_id").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    head = '<?xml version="1.0"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace><TextBlock>'
    content = F.concat(F.lit(head), F.array_join(F.transform("ls", lambda l: l["x"]), ""), F.lit("</TextBlock></PrintSpace></Page></Layout></alto>"))
    found, _ = xml.corpus_lines(gathered.select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".xml")).alias("path"), content.alias("content")))
    return found.select("path", _long("line_idx"), "text", geometry.format_points(F.col("polygon")).alias("points"))


@query
def pair_images(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id")
    here = F.concat(F.lit("corpus/d"), F.pmod("page_id", F.lit(7)).cast("string"), F.lit("/p"), F.col("page_id").cast("string"))
    folder = F.when(F.pmod("page_id", F.lit(3)) == 0, here).otherwise(F.concat(F.lit("scans/p"), F.col("page_id").cast("string")))
    images = p.where("page_id % 5 <> 0").select(F.explode(F.array(F.concat(folder, F.lit(".png")), F.concat(F.lit("scans/x/p"), F.col("page_id").cast("string"), F.lit(".jpg")))).alias("path"))
    return xml.pair_images(p.select(F.concat(here, F.lit(".xml")).alias("path")), images)


@query
def journal_flatten(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query
def journal_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A journal of an entry a day and kind of event, appended to as files and read back."""
    path = derive.scratch(spark, "journal")
    daily = table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd'T'HH':00:00'").alias("timestamp")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    metrics_of = F.create_map(F.lit("n"), F.col("n").cast("double"), F.lit("last"), F.col("last").cast("double"))
    entries = daily.select("timestamp", F.col("event_type").alias("nom"), F.create_map(F.lit("kind"), "event_type").alias("parametres"), metrics_of.alias("metriques"), F.lit("").alias("notes"))
    for half in (0, 1):
        entries.where(F.pmod(F.xxhash64("timestamp"), F.lit(2)) == half).write.mode("append").json(path)
    return journal.metric_rows(journal.read_journal(spark, path))


# Engines and curves


@query
def simulated_engine(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.pmod("n_chars", F.lit(900)).alias("width"))
    read = d.select("doc_id", engines.trocr(F.col("width"), F.col("doc_id")).alias("t"), engines.kraken(F.col("width"), F.col("doc_id")).alias("k"))
    thousandths = lambda r: F.array_join(F.transform(r["char_confidences"], lambda c: F.round(c * 1000).cast("int").cast("string")), ",")
    return read.select("doc_id", F.col("t.text").alias("text"), thousandths(F.col("t")).alias("trocr"), thousandths(F.col("k")).alias("kraken"), F.size("t.candidates").cast("long").alias("n_candidates"))


@query
def fusion_engine(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.pmod("n_chars", F.lit(900)).alias("width"))
    thousandths = F.array_join(F.transform("r.char_confidences", lambda c: F.round(c * 1000).cast("int").cast("string")), ",")
    return d.select("doc_id", engines.fused(F.col("width"), F.col("doc_id")).alias("r")).select("doc_id", "r.text", thousandths.alias("confidences"), F.size("r.char_confidences").cast("long").alias("n"))


@query
def engine_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two engines over the lines: what they read, the first with its last word lost in every third line."""
    lines = derive.lines(spark, sf).select("doc_id", "pos", "line", (F.length("line") * 6).alias("width"))
    read = lambda e: engines.engine(e)(F.col("width"), F.col("doc_id"))["text"]
    cut = F.when(F.pmod("pos", F.lit(3)) == 0, F.regexp_replace("b", " [^ ]*$", "")).otherwise(F.col("b"))
    both = lines.withColumn("b", read("Kraken")).withColumn("a", cut).withColumn("line", F.when(F.pmod("doc_id", F.lit(4)) == 0, F.col("b")).otherwise(F.col("line")))
    return evaluation.compare(both, "line", "a", "b").select("dist_a", "dist_b", "chars", _long("n01"), _long("n10"), F.round("statistic", 9).alias("statistic"), "best")


def _word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct word beside its raw form."""
    words = derive.lines(spark, sf).select(F.explode(text.tokens(F.col("line"))).alias("a")).distinct()
    return words.select("a", derive.raw(F.concat(F.lit(" "), "a")).alias("b")).select("a", F.substring("b", 2, 1_000_000).alias("b"))


@query
def word_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The steps that align each word with its raw form: both, a only, b only."""
    step = lambda p: F.when(p["a"].isNull(), "L").when(p["b"].isNull(), "U").otherwise("D")
    return _word_pairs(spark, sf).select("a", "b", F.array_join(F.transform(alignment.alignment(F.col("a"), F.col("b")), step), "").alias("steps"))


@query
def word_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Each word fused with its raw form."""
    given = lambda c, k, m: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: (F.pmod(F.length(c) * k + i * m, F.lit(61)) + 40) / F.lit(100.0))
    fused = _word_pairs(spark, sf).select("a", "b", alignment.fusion(F.col("a"), given("a", 31, 7), F.col("b"), given("b", 17, 11)).alias("f"))
    return fused.select("a", "b", "f.text", F.array_join(F.transform("f.confidences", lambda c: F.round(c * 100).cast("int").cast("string")), ",").alias("percents"))


@query
def fusion_vote(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.versions(spark, sf)
    cc = lambda c: derive.confidences(derive.percents(F.length(c)))
    return v.select("doc_id", "pos", alignment.fusion(F.col("raw"), cc("raw"), F.col("norm"), cc("norm")).alias("f")).select("doc_id", "pos", "f.text", F.size("f.confidences").cast("long").alias("n"))


@query
def nw_alignment(spark: SparkSession, sf: str) -> DataFrame:
    v = derive.versions(spark, sf)
    pairs = v.select("doc_id", "pos", alignment.alignment(F.col("line"), F.col("raw")).alias("a"))
    return pairs.select("doc_id", "pos", F.size("a").cast("long").alias("n"), F.size(F.filter("a", lambda p: p["a"].isNull())).cast("long").alias("gaps_a"), F.size(F.filter("a", lambda p: p["b"].isNull())).cast("long").alias("gaps_b"))


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "events").groupBy("event_type", F.datediff("ts", F.lit("1970-01-01")).cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("n"))
    return daily.select("event_type", "epoch", (F.lit(1000) - F.col("n")).alias("cer"))


@query
def early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    return training.early_stopping(_curve(spark, sf), "event_type", patience=3)


@query
def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return training.best_epoch(_curve(spark, sf), "event_type")


@query
def simulated_curve(spark: SparkSession, sf: str) -> DataFrame:
    return training.simulated_curve(spark, table(spark, sf, "labels").count()).select(_long("epoch"), F.round("cer", 9).alias("cer"))


@query
def pages_to_documents(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), (F.pmod("doc_id", F.lit(10)) + 8).alias("century"), F.lit("texte_simple").alias("document_type"), F.col("lang").alias("language"), "source", F.lit(48).alias("image_width"), F.lit(400).alias("image_height"))
    found = pipelines.rows_to_documents(derive.raster_rows(spark, sf), meta.where("page_id IS NOT NULL").dropDuplicates(["page_id"]))
    return found.select("document_id", "valid", F.size("lines").cast("long").alias("n_lines"))


@query
def normalisation_impact(spark: SparkSession, sf: str) -> DataFrame:
    lines = pipelines.normalise_documents(_contract_documents(spark, sf))
    return pipelines.normalisation_impact(lines).select("transition", F.round("mean_distance", 9).alias("mean_distance"), "dist", "n_changed", "n_lines")
