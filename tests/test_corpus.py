"""Images, corpora on disk, folders of pages, seals in files, training runs and reports."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation, sampling, training
from quillspark.plans import pipelines, reports
from quillspark.sources import corpus, images, journal

WORDS = ("Ci comence li romanz", "de Brut e de sa gent", "qui Engleterre tindrent", "ainz que Normant i vindrent")


def page():
    picture = np.full((500, 400), 255, np.uint8)
    for y in (60, 140, 220, 300):
        picture[y : y + 20, 50:350] = 0
    return picture


def page_xml():
    lines = "".join(f'<TextLine id="l{n}"><Coords points="{x0},{y} 350,{y + 20}"/><TextEquiv><Unicode>{t}</Unicode></TextEquiv></TextLine>' for n, (t, y, x0) in enumerate(zip(WORDS, (60, 140, 220, 300), (-10, 50, 50, 50))))
    return f'<?xml version="1.0"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><TextRegion>{lines}<TextLine id="out"><Coords points="900,900 950,950"/><TextEquiv><Unicode>outside</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "p1.png").write_bytes(images.encode_png(page()))
    (tmp_path / "c" / "p1.xml").write_text(page_xml())
    (tmp_path / "c" / "broken.png").write_bytes(b"no image")
    (tmp_path / "c" / "broken.xml").write_text("<x")
    return str(tmp_path / "c")


def filtered_png(image, kind):
    """A PNG whose rows all use one filter."""
    channels = image.reshape(*image.shape[:2], -1).astype(int)
    h, w, n = channels.shape
    padded = np.zeros((h + 1, w + 1, n), int)
    padded[1:, 1:] = channels
    left, up, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    p = left + up - corner
    paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
    guess = [0, left, up, (left + up) >> 1, paeth][kind]
    rows = ((channels - guess) & 255).astype(np.uint8).reshape(h, w * n)
    data = zlib.compress(np.hstack([np.full((h, 1), kind, np.uint8), rows]).tobytes())
    grey = images.encode_png(np.zeros((h, w), np.uint8))
    part = lambda name, x: len(x).to_bytes(4, "big") + name + x + zlib.crc32(name + x).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0 if n == 1 else 2, 0, 0, 0])
    return grey[:8] + part(b"IHDR", head) + part(b"IDAT", data) + part(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png(kind):
    rng = np.random.default_rng(kind)
    picture = rng.integers(0, 256, (9, 7), np.uint8)
    assert (images.decode(filtered_png(picture, kind)) == picture).all()
    colour = np.stack([picture] * 3, axis=2)
    assert (images.decode(filtered_png(colour, kind)) == picture).all()


def test_pnm():
    picture = page()[50:90, 40:90]
    assert (images.decode(b"P5\n# note\n50 40\n255\n" + picture.tobytes()) == picture).all()
    red = np.zeros((1, 1, 3), np.uint8)
    red[..., 0] = 255
    assert images.decode(b"P6 1 1 255\n" + red.tobytes())[0, 0] == 76
    for bad in (b"", b"GIF89a", b"P5\n1 1\n65535\n\0\0"):
        with pytest.raises(ValueError):
            images.decode(bad)


def test_corpus(spark, folder):
    examples, bad = corpus.load_corpus(spark, folder, {"century": "13"})
    rows = examples.orderBy("line_idx").collect()
    assert [r["text"] for r in rows] == list(WORDS) and rows[0]["metadata"] == {"century": "13"}
    assert [(r["height"], r["width"]) for r in rows] == [(20, 350)] + [(20, 300)] * 3
    assert set(rows[1]["content"]) == {0}
    assert sorted(r["path"].rpartition("/")[2] for r in bad.collect()) == ["broken.png", "broken.xml"]
    assert corpus.load_corpus(spark, folder, limit=2)[0].count() == 2


def test_evaluation_of_a_corpus(spark, folder):
    report = pipelines.evaluate_corpus(spark, folder, "trocr", iterations=10)
    assert report["n_lignes"] == 4 and report["corpus"] == "c" and report["modele"] == "trocr"
    assert any(line.startswith("CER: ") for line in reports.evaluation_lines(report))


def test_folder_of_pages(spark, folder):
    doc = pipelines.folder_to_documents(spark, folder, 13, "texte_simple", "fro", "TEST").collect()
    assert [(d["document_id"], d["valid"], len(d["lines"])) for d in doc] == [("p1", True, 4)]
    assert doc[0]["lines"][0]["line_id"] == "p1_line000" and doc[0]["page_xml"].count("<TextLine ") == 4


def test_sealed_file(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, "a")], "id int, text string")
    path = str(tmp_path / "s" / "test.json")
    digest = sampling.seal_file(df, path, "id")
    assert sampling.file_sealed_as(path, digest) and (tmp_path / "s" / "test.sha256").read_text() == digest + "\n"
    assert sampling.seal_file(df.repartition(2), path, "id") == digest
    with open(path, "a") as f:
        f.write(" ")
    assert not sampling.file_sealed_as(path, digest)
    with pytest.raises(ValueError):
        sampling.seal_file(df, path, "id", most=1)


def test_fine_tuning(spark, tmp_path):
    found = training.fine_tune(spark, 60, str(tmp_path), training.TrainingConfig(epochs=8), str(tmp_path / "journal"))
    assert found["meilleur_cer"] == 0.1748 and (tmp_path / "courbe_lora_r8.json").exists()
    assert journal.metric_rows(journal.read_journal(spark, str(tmp_path / "journal"))).first()["value"] == 0.1748


def test_reports(spark):
    assert reports.exploration_lines(evaluation.explore_report(spark.createDataFrame([], "text string, confidence double, needs_review boolean, century int"))) == ["No line"]
    lines = spark.createDataFrame([("q~ a", 0.5, True, 13), ("b", 1.0, False, None)], "text string, confidence double, needs_review boolean, century int")
    assert "Centuries: 13: 1, inconnu: 1" in reports.exploration_lines(evaluation.explore_report(lines))
    versions = spark.createDataFrame([(1, 0, "a", "chat"), (1, 1, "b", "chot")], "line_id int, stage_ord int, stage string, text string")
    assert reports.impact_lines(evaluation.stage_transitions(versions)) == ["a→b: 25.00% on average, 1 of 1 lines changed"]


def write_by_jvm(spark, picture, kind, path):
    """A picture as a file of a kind that the JVM knows."""
    jvm = spark._jvm
    h, w = picture.shape
    image = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    raster = image.getRaster()
    for y in range(h):
        for x in range(w):
            raster.setSample(x, y, 0, int(picture[y, x]))
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(path))


def test_jpeg_and_tiff(spark, tmp_path):
    picture = np.full((16, 24), 255, np.uint8)
    picture[4:12, 6:18] = 0
    for kind, name in (("jpg", "a.jpg"), ("jpg", "b.JPEG"), ("tif", "c.tif"), ("tif", "d.tiff")):
        write_by_jvm(spark, picture, kind, str(tmp_path / name))
    (tmp_path / "e.jpg").write_bytes(b"no image")
    (tmp_path / "f.png").write_bytes(images.encode_png(picture))
    rows = {r["path"].rpartition("/")[2]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.jpg", "b.JPEG", "c.tif", "d.tiff", "e.jpg", "f.png"} and rows["e.jpg"]["error"]
    for name, r in rows.items():
        if name != "e.jpg":
            found = np.frombuffer(r["content"], np.uint8).reshape(r["height"], r["width"]).astype(int)
            assert r["error"] is None and abs(found - picture).max() <= (0 if name[0] in "cdf" else 24)  # JPEG loses sharp edges


def test_corpus_of_jpeg_pages(spark, tmp_path):
    (tmp_path / "p1.xml").write_text(page_xml())
    small = page()[:330, :]
    write_by_jvm(spark, small, "jpg", str(tmp_path / "p1.jpg"))
    (tmp_path / "p2.xml").write_text(page_xml())
    (tmp_path / "p2.tif").write_bytes(b"no image")
    examples, bad = corpus.load_corpus(spark, str(tmp_path))
    assert [r["text"] for r in examples.orderBy("line_idx").collect()] == list(WORDS)
    assert [r["path"].rpartition("/")[2] for r in bad.collect()] == ["p2.tif"]
    assert [r["path"].rpartition("/")[2] for r in pipelines.unread_images(spark, str(tmp_path)).collect()] == ["p2.tif"]


def test_blank_pages_are_documents(spark, tmp_path):
    (tmp_path / "p1.png").write_bytes(images.encode_png(page()))
    (tmp_path / "blank.png").write_bytes(images.encode_png(np.full((40, 60), 255, np.uint8)))
    found = pipelines.folder_to_documents(spark, str(tmp_path), 13, "texte_simple", "fro", "TEST").orderBy("document_id").collect()
    assert [(d["document_id"], d["valid"], len(d["lines"])) for d in found] == [("blank", True, 0), ("p1", True, 4)]
    assert "<TextLine" not in found[0]["page_xml"]
