"""Contract, evaluation, entities, splits, rasters, curves, files and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import metrics, sequences
from quillspark.operators import contract, engines, evaluation, raster, sampling, tokens, training
from quillspark.plans import pipelines
from quillspark.sources import contracts, journal, xml
from quillspark.streaming import ingest

BOX = [[0.0, 0.0], [100.0, 0.0], [100.0, 30.0], [0.0, 30.0]]


def document(text="exemple", cc=0.9, **change):
    doc = {
        "document_id": "d1", "metadata": {"century": 13, "document_type": "texte_simple", "language": "ancien_francais", "source": "TEST", "license": "CC-BY-SA-4.0"},
        "coordinate_system": {"origin": "top_left", "unit": "pixel", "image_width": 1000, "image_height": 1500},
        "lines": [{"line_id": "d1_line000", "reading_order": 0, "text": text, "polygon": BOX, "confidence": cc, "char_confidences": [cc] * len(text), "needs_review": cc < 0.7}],
    }
    for path, value in change.items():
        at = doc
        *head, last = path.split("__")
        for p in head:
            at = at[p]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return doc


def frame(spark, *docs):
    return spark.createDataFrame([json.dumps(d) for d in docs], "string").select(F.from_json("value", contract.DOCUMENT).alias("d")).select("d.*")


def line(spark, cc):
    df = spark.createDataFrame([("l", "ab", BOX, cc)], "i string, t string, p array<array<double>>, c array<double>")
    return df.select(contract.make_line(F.col("i"), F.col("t"), F.col("p"), F.col("c")).alias("l")).first()["l"]


def test_make_line(spark):
    assert line(spark, [0.6, 0.8])["needs_review"] is False and line(spark, [0.6, 0.8])["confidence"] == 0.7
    assert line(spark, [0.3, 0.3])["needs_review"] is True
    assert line(spark, [])["confidence"] == 0.0
    assert line(spark, [0.95, 0.95])["candidates"] is None
    for bad in ([1.5], [float("nan")], [-0.1]):
        with pytest.raises(Exception):
            line(spark, bad)


@pytest.mark.parametrize("change,message", [
    ({}, "OK"), ({"metadata": None}, "$.metadata : is required"), ({"metadata__century": 25}, "$.metadata.century : is out of range"), ({"metadata__document_type": "format_inconnu"}, "$.metadata.document_type : is not a known type"),
    ({"lines": None}, "$.lines : is required"), ({"coordinate_system__unit": "cm"}, "$.coordinate_system.unit : is not pixel"),
])
def test_validation(spark, change, message):
    assert contract.validated(frame(spark, document(**change))).first()["message"] == message


def test_validation_of_lines(spark):
    doc = document()
    doc["lines"][0]["polygon"] = BOX[:2]
    doc["lines"][0]["confidence"] = 1.2
    found = contract.validated(frame(spark, doc)).first()["violations"]
    assert found == ["$.lines[0].polygon : has fewer than 3 points", "$.lines[0].confidence : is out of range"]


def test_review_rate(spark):
    doc = document()
    doc["lines"] = doc["lines"] * 2 + document(cc=0.2)["lines"] * 2
    assert frame(spark, doc).select(contract.review_rate(F.col("lines"))).first()[0] == 0.5
    doc["lines"] = []
    assert frame(spark, doc).select(contract.review_rate(F.col("lines"))).first()[0] == 0.0


def test_contract_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document("⁊ romanz"), indent=2, ensure_ascii=False))
    docs = contracts.read_contracts(spark, str(tmp_path))
    lines = contract.flatten(docs)
    assert lines.select("century", "text").first() == (13, "⁊ romanz")
    assert evaluation.explore_report(lines)["n_lignes"] == 1
    assert pipelines.normalise_documents(docs).first()["text_normalise"] == "et romanz"
    (tmp_path / "b.json").write_text('{"document_id": "x"}')
    with pytest.raises(Exception):
        contracts.read_contracts(spark, str(tmp_path)).collect()
    good, bad = contracts.split_quarantine(contracts.read_contracts(spark, str(tmp_path), strict=False))
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception):
        contracts.write_contracts(frame(spark, document(metadata__century=25)), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()
    contracts.write_contracts(frame(spark, document()), str(tmp_path / "good"))
    assert spark.read.json(str(tmp_path / "good")).count() == 1
    with pytest.raises(Exception):
        contracts.read_contracts(spark, str(tmp_path / "absent")).collect()


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(document("⁊ a")))
    (folder / "b.json").write_text(json.dumps(document(metadata__century=25)))
    ingest.write_lines(ingest.stream_contracts(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert [r["text_normalise"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["et a"]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    stats = ingest.running_statistics(ingest.stream_contracts(spark, str(folder)))
    q = stats.writeStream.outputMode("complete").format("memory").queryName("stats").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT n_lines, n_abbreviations FROM stats").collect() == [(1, 1)]


def pairs(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "line_id long, reference string, " + ", ".join(f"{c} string" for c in "pq"[: len(rows[0]) - 1]))


def test_corpus_rates(spark):
    errors = evaluation.with_errors(pairs(spark, ("chat", "chat"), ("chien", "chein")), "reference", "p")
    assert evaluation.corpus_cer(errors).first()["cer"] == pytest.approx(2 / 9)
    errors = evaluation.with_errors(pairs(spark, ("le chat", "le chien"), ("il dort", "il dort")), "reference", "p")
    assert evaluation.corpus_wer(errors).first()["wer"] == 0.25
    assert evaluation.corpus_cer(evaluation.with_errors(pairs(spark, ("", "x")), "reference", "p")).first()["cer"] == 0.0


def test_bootstrap(spark):
    df = pairs(spark, ("chat", "chat"), ("chien", "chein"), ("oiseau", "oisaeu"), ("lapin", "lapin"), ("souris", "soursi"))
    errors = evaluation.with_errors(df, "reference", "p")
    one = evaluation.interval(evaluation.bootstrap(errors, ("line_id",), 200)).first()
    assert 0 <= one["low"] <= 6 / 26 <= one["high"]
    assert evaluation.interval(evaluation.bootstrap(errors.repartition(3), ("line_id",), 200)).first() == one
    perfect = evaluation.with_errors(df, "reference", "reference")
    assert tuple(evaluation.interval(evaluation.bootstrap(perfect, ("line_id",), 50)).first()) == (0.0, 0.0)
    assert evaluation.bootstrap(errors.limit(0), ("line_id",), 5).count() == 0
    report = evaluation.report(df, ("line_id",), prediction="p", iterations=50)
    assert report["n_lignes"] == 5 and report["CER"] == round(6 / 26, 4) and not report["CER_sous_15pct"]


def test_mcnemar(spark):
    df = pairs(spark, ("a", "a", "X"), ("b", "b", "X"), ("c", "X", "c"), ("d", "X", "d"))
    r = evaluation.mcnemar(df, "reference", "p", "q").first()
    assert (r["n10"], r["n01"], r["statistic"]) == (2, 2, 0.25)
    assert evaluation.mcnemar(df, "reference", "p", "p").first()["statistic"] == 0.0
    assert evaluation.chi2_tail(3.841458820694124) == pytest.approx(0.05)
    assert evaluation.compare_report(pairs(spark, ("chat", "chat", "chot")), "reference", "p", "q")["best"] == "p"
    assert evaluation.compare_report(pairs(spark, ("chat", "chat", "chat")), "reference", "p", "q")["best"] == "égalité"


def test_pairs_must_be_complete(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "line_id int, a string"), spark.createDataFrame([(1, "x")], "line_id int, b string")
    with pytest.raises(Exception):
        evaluation.paired(a, b).collect()


def test_entities(spark):
    df = tokens.with_labels(spark.createDataFrame([("le roi Charles de France l'an 1250",), ("Charles Guillaume, vint",)], "text string"))
    rows = df.select("labels", tokens.entities(F.col("words"), F.col("labels")).alias("e"), tokens.tei_paragraph(F.col("words"), F.col("labels")).alias("t")).collect()
    assert rows[0]["labels"] == ["O", "B-TITLE", "B-PER", "O", "B-LOC", "O", "B-DATE"]
    assert [tuple(e) for e in rows[1]["e"]] == [("Charles Guillaume,", "PER")]
    assert rows[0]["t"].startswith("le <roleName>roi</roleName> <persName>Charles</persName> de <placeName>France</placeName> ")


def test_orphans_are_dropped(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["I-PER", "B-LOC", "I-PER", "O"])], "words array<string>, labels array<string>")
    r = df.select(tokens.entities(F.col("words"), F.col("labels")).alias("e"), tokens.tei_paragraph(F.col("words"), F.col("labels")).alias("t")).first()
    assert [tuple(e) for e in r["e"]] == [("b c", "LOC")] and r["t"] == "<placeName>b c</placeName> d "


def test_relations_and_graph(spark):
    df = tokens.with_labels(spark.createDataFrame([(1, "Brut tint Engleterre"), (2, "le beau romanz"), (3, "Brut prist Engleterre")], "id int, text string"))
    rel = tokens.relation_rows(df, "id")
    assert [tuple(r) for r in rel.orderBy("id").drop("id", "ord").collect()] == [("Brut", "PER", "TIENT", "Engleterre", "LOC"), ("Brut", "PER", "PREND", "Engleterre", "LOC")]
    assert tokens.graph_nodes(rel, "id", "ord").count() == 2
    assert [r["relation"] for r in tokens.graph_edges(rel, "id", "ord").collect()] == ["PREND"]
    assert tokens.graph_edges(rel, multigraph=True).count() == 2


def test_morphology(spark):
    df = spark.createDataFrame([("li rois tint Brut gent, les",)], "t string").select(tokens.analyse(F.split("t", " ")).alias("a"))
    assert [tuple(x) for x in df.first()["a"]] == [("li", "DET", "li"), ("rois", "NOUN", "roi"), ("tint", "VERB", "tenir"), ("Brut", "PROPN", "brut"), ("gent,", "NOUN", "gent"), ("les", "DET", "le")]


def test_split_and_seal(spark):
    df = spark.createDataFrame([(str(i), 12 + i % 3, f"t{i}") for i in range(150)], "id string, century int, text string")
    parts = sampling.stratified_split(df, F.col("century"), F.col("id")).cache()
    n = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert n == {"train": 105, "val": 21, "test": 24} and parts.count() == 150
    assert sampling.distribution(parts, F.col("century")).count() == 9
    with pytest.raises(ValueError):
        sampling.stratified_split(df, F.col("century"), F.col("id"), (0.5, 0.3, 0.3))
    none = sampling.stratified_split(df.withColumn("c", F.lit(None).cast("int")), F.col("c"), F.col("id"))
    assert sampling.distribution(none, F.col("c")).select("stratum").distinct().collect() == [("inconnu",)]
    test = parts.where("split = 'test'").select("id", "century", "text")
    digest = sampling.seal(test, "id", "century", "text").first()["digest"]
    assert len(digest) == 64 and sampling.sealed_as(test.repartition(5), digest, "id", "century", "text")
    assert not sampling.sealed_as(test.withColumn("text", F.concat("text", F.lit("!"))), digest, "id", "century", "text")


def drawing():
    page = np.full((500, 400), 255, np.uint8)
    for y in (60, 140, 220, 300):
        page[y : y + 20, 50:350] = 0
    page[400:404, 50:350] = 0  # too low
    return page


def images(spark, *pages):
    return spark.createDataFrame([(n, *p.shape, bytearray(p.tobytes())) for n, p in enumerate(pages)], "page_id int, height int, width int, content binary")


def test_segmentation(spark):
    rows = raster.pixel_rows(images(spark, drawing(), np.full((30, 40), 255, np.uint8)))
    found = raster.segment_lines(rows).orderBy("reading_order").collect()
    assert [(r["reading_order"], r["x"], r["y"], r["w"], r["h"]) for r in found] == [(n, 50, y - 3, 299, 26) for n, y in enumerate((60, 140, 220, 300))]
    assert len(found[0]["polygon"]) == 4
    uneven = spark.createDataFrame([(0, 0, [0, 0]), (0, 1, [0])], "page_id int, row_idx int, pixels array<int>")
    with pytest.raises(Exception):
        raster.segment_lines(uneven, min_height=1).collect()


def test_filters(spark):
    page = drawing()
    noisy = page.copy()
    noisy[10, 10] = 0
    out = raster.preprocessed(images(spark, noisy)).first()
    done = np.frombuffer(out["content"], np.uint8).reshape(500, 400)
    assert set(np.unique(done)) <= {0, 255} and done[70, 200] == 0 and done[30, 30] == 255
    assert (raster.open_image(np.full((9, 9), 255, np.uint8)) == 255).all()
    assert raster.skew_angle(page) == 0.0
    assert raster.grey(np.zeros((4, 5, 3), np.uint8)).shape == (4, 5)
    with pytest.raises(ValueError):
        raster.preprocess(np.zeros((0, 0), np.uint8))
    assert spark.range(1).select(raster.crop(F.array(*map(F.lit, range(10))), F.lit(2), F.lit(5)).alias("c")).first()["c"] == [2, 3, 4]


def test_early_stopping(spark):
    curve = spark.createDataFrame([(n + 1, c) for n, c in enumerate([0.30, 0.25, 0.26, 0.25, 0.27, 0.20])], "epoch int, cer double").withColumn("k", F.lit(0))
    stopped = training.early_stopping(curve, "k", patience=3)
    assert stopped.agg(F.max("epoch")).first()[0] == 5
    best = training.best_epoch(stopped, "k").first()
    assert (best["best_value"], best["best_epoch"]) == (0.25, 2)


def test_simulated_curve(spark):
    h = training.history(training.simulated_curve(spark, 60, training.TrainingConfig(epochs=8)))
    assert h == training.history(training.simulated_curve(spark, 60, training.TrainingConfig(epochs=8)))
    assert h["meilleur_cer"] == min(h["cer_par_epoch"]) == 0.1748


def test_engines(spark):
    df = spark.createDataFrame([(1, 30), (2, 600)], "id int, width int")
    for name in ("TrOCR", "kraken", "Fusion"):
        rows = df.select("width", engines.engine(name)(F.col("width"), F.col("id")).alias("r")).orderBy("width").collect()
        assert rows[0]["r"]["text"] == "romanz" and len(rows[1]["r"]["text"].split()) == 10
        assert all(len(r["r"]["text"]) == len(r["r"]["char_confidences"]) for r in rows)
    with pytest.raises(ValueError):
        engines.engine("other")
    loaded = engines.model_engine(lambda: lambda image: {"text": str(len(image)), "char_confidences": [1.0], "candidates": []})
    assert images(spark, drawing()).select(loaded(F.col("content")).alias("r")).first()["r"]["text"] == "200000"
    assert engines.ketos_command().startswith("ketos train -i catmus")


def test_evaluate_engine(spark, tmp_path):
    lines = spark.createDataFrame([(n, 120, "romanz Engleterre" if n else "romanz") for n in range(4)], "line_id int, width int, reference string")
    path = str(tmp_path / "journal")
    report = pipelines.evaluate_engine(spark, lines, "trocr", path, iterations=20)
    assert report["CER"] == round(11 / 57, 4)
    assert pipelines.compare_engines(lines)["best"] == "égalité"
    with pytest.raises(ValueError):
        pipelines.evaluate_engine(spark, lines.limit(0), "trocr")
    journal.append_entry(spark, path, "second", {"a": 1}, {"CER": 0.5}, timestamp="2026-07-05T21:27:29.001564")
    entries = journal.read_journal(spark, path)
    assert entries.count() == 2 and journal.metric_rows(entries).count() == 3 and entries.where("at IS NULL").isEmpty()


PAGE = """<?xml version="1.0" ?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><TextRegion>
<TextLine id="a"><Coords points="0,0 5,0 5,5"/><TextEquiv><Unicode> Ci comence </Unicode></TextEquiv></TextLine>
<TextLine id="b"><Coords points="0,0 5,0 5,5"/></TextLine><TextLine id="c"><Coords points=""/><TextEquiv><Unicode>x</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>"""
ALTO = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><TextLine ID="t" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"><String CONTENT="li"/><String CONTENT=""/><String CONTENT="romanz"/></TextLine></Layout></alto>"""


def test_xml(spark):
    bad = ALTO.replace('<String CONTENT="li"/>', '<Shape><Polygon POINTS="1,2 3,4 5,6"/></Shape><String CONTENT="li"/>')
    files = spark.createDataFrame([("p.xml", PAGE), ("a.xml", ALTO), ("bad.xml", "<x"), ("comma.xml", bad), ("v3.xml", ALTO.replace("ns-v4", "ns-v3"))], "path string, content string")
    lines, errors = xml.corpus_lines(files)
    assert sorted((r["path"], r["text"], len(r["polygon"])) for r in lines.collect()) == [("a.xml", "li romanz", 4), ("p.xml", "Ci comence", 3)]
    assert sorted(r["path"] for r in errors.collect()) == ["bad.xml", "comma.xml"]
    rows = xml.page_lines(files.where("path = 'p.xml'")).orderBy("line_idx").collect()
    assert [(r["line_id"], r["text"]) for r in rows] == [("a", " Ci comence "), ("b", ""), ("c", "x")]
    kinds = files.where("path IN ('p.xml', 'a.xml')").select(xml.detect_format(F.col("content")).alias("f")).collect()
    assert [k["f"] for k in kinds] == ["page", "alto"]
    with pytest.raises(Exception):
        files.where("path = 'bad.xml'").select(xml.detect_format(F.col("content"))).collect()


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p.xml").write_text(PAGE)
    (tmp_path / "p.png").write_bytes(b"png")
    (tmp_path / "d" / "q.xml").write_text(PAGE)
    names = xml.read_files(spark, str(tmp_path), "*.xml").select("path")
    paired = xml.pair_images(names, xml.read_files(spark, str(tmp_path), "*.png").select("path")).collect()
    assert len(paired) == 1 and paired[0]["image"].endswith("/p.png")
    digest = sampling.file_digests(xml.read_files(spark, str(tmp_path), "*.png")).first()["sha256"]
    import hashlib

    assert digest == hashlib.sha256(b"png").hexdigest()


def test_golden_tei(spark):
    import xml.etree.ElementTree as ET

    df = tokens.with_labels(spark.createDataFrame([("Brut tint Engleterre et Charles regna sur France",)], "text string"))
    made = df.select(xml.tei_xml(tokens.tei_paragraph(F.col("words"), F.col("labels")), F.lit("Extrait <1>")).alias("x")).first()["x"]
    root = ET.fromstring(made)
    ns = "{http://www.tei-c.org/ns/1.0}"
    assert [e.text for e in root.iter(f"{ns}persName")] == ["Brut", "Charles"]
    assert [e.text for e in root.iter(f"{ns}placeName")] == ["Engleterre", "France"]
    assert next(root.iter(f"{ns}title")).text == "Extrait <1>"


def test_rounding_follows_the_binary_value(spark):
    values = [0.70005, 0.00005, 0.12345, 0.03125, 0.09375, 0.99995, 0.5, 0.0, 1.0, 2 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", sequences.rounded(F.col("v"), 4).alias("r"))
    assert all(r["r"] == round(r["v"], 4) for r in df.collect())
    cc = F.array(F.lit(0.70005))
    line = spark.range(1).select(contract.make_line(F.lit("l"), F.lit("x"), F.array(F.array(F.lit(0.0))), cc).alias("l")).first()["l"]
    assert line["confidence"] == 0.7 and not line["needs_review"]


def test_multinomial_bootstrap(spark):
    rng = np.random.default_rng(3)
    rows = [(n, int(rng.integers(0, 4)), int(rng.integers(5, 30))) for n in range(2000)]
    errors = spark.createDataFrame([(n, min(d, c), c) for n, d, c in rows], "line_id long, dist long, chars long")
    one = [r["cer"] for r in evaluation.multinomial_bootstrap(errors, iterations=400).orderBy("iteration").collect()]
    other = [r["cer"] for r in evaluation.bootstrap(errors, ("line_id",), 400).collect()]
    assert len(one) == 400 and abs(np.mean(one) - np.mean(other)) < 0.1 * np.std(other) + 2e-4 and 0.85 < np.std(one) / np.std(other) < 1.18
    assert [r["cer"] for r in evaluation.multinomial_bootstrap(errors.repartition(5), iterations=400).orderBy("iteration").collect()] == one
    assert evaluation.multinomial_bootstrap(errors.limit(0), iterations=5).count() == 0
    single = spark.createDataFrame([(0, 0)] * 3, "dist long, chars long")
    assert tuple(evaluation.interval(evaluation.multinomial_bootstrap(single, iterations=5)).first()) == (0.0, 0.0)


def test_wide_transitions_equal_long_ones(spark):
    rows = [(1, "chat", "chot", "chet"), (2, "", "x", ""), (3, "abc", "abc", "ab")]
    wide = spark.createDataFrame(rows, "line_id int, a string, b string, c string")
    long = spark.createDataFrame([(r[0], k, "abc"[k], r[k + 1]) for r in rows for k in range(3)], "line_id int, stage_ord int, stage string, text string")
    assert sorted(map(tuple, evaluation.wide_transitions(wide, {x: x for x in "abc"}).collect())) == sorted(map(tuple, evaluation.stage_transitions(long).collect()))


def test_more_words_than_a_plane_of_code_points(spark):
    known = F.transform(F.sequence(F.lit(0), F.lit(70_000)), lambda n: F.concat(F.lit("w"), n.cast("string")))
    words = ("w0", "w20000", "w65535", "w70000", "w0")
    code = spark.range(1).select(metrics.encoded(F.array(*map(F.lit, words)), known).alias("c"), metrics.vocabulary(known, known).alias("v")).first()
    assert len(code["c"]) == 5 and len(set(code["c"])) == 4 and len(code["v"]) == 70_001


def test_buckets_grow_with_the_rows():
    assert [evaluation.bucket_digits(n) for n in (0, 256_000_000, 256_000_001, 10**11)] == [2, 2, 3, 5]
