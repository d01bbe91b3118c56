"""Hand-computed cases of the column functions, and Python twins of the harder ones."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import alignment, geometry, metrics, sequences, text


def one(spark, column, **values):
    """The value of a column over one row."""
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [("⁊", "et"), ("q~", "que"), ("mõt", "mont"), ("⁊ mõt", "et mont"), ("et mont gent", "et mont gent"), ("vne dame", "une dame"), ("jour", "iour"), ("vin", "vin"), ("v", "v"), ("a  vn", "a  un")])
def test_rules(spark, raw, expected):
    assert one(spark, text.normalise(F.col("t")), t=("string", raw)) == expected


def test_nfc(spark):
    assert one(spark, text.nfc(F.col("t")), t=("string", unicodedata.normalize("NFD", "évêque"))) == "évêque"


@pytest.mark.parametrize("t,cc,cand,expected", [
    ("rxmanz", [0.9, 0.4, 0.9, 0.9, 0.9, 0.9], [(1, ["o", "a"])], "romanz"),
    ("romanz", [0.9, 0.95, 0.9, 0.9, 0.9, 0.9], [(1, ["a"])], "romanz"),
    ("dx gxnt", [0.1] * 7, [(1, ["e"]), (4, ["a", "e"])], "de gent"),
    ("de", [0.1, 0.1], [(7, ["e"])], "de"),
    ("dx", [], [(1, ["e"])], "de"),
    ("", [], [(0, ["e"])], ""),
])
def test_correction(spark, t, cc, cand, expected):
    kind = "array<struct<position:int,options:array<string>>>"
    assert one(spark, text.correct(F.col("t"), F.col("cc"), F.col("c")), t=("string", t), cc=("array<double>", cc), c=(kind, cand)) == expected


def test_tokens_and_clean(spark):
    t = " Li\tRois, tint\x1c! "
    assert one(spark, text.tokens(F.col("t")), t=("string", t)) == t.split()
    assert one(spark, text.clean(F.col("t")), t=("string", ";Rois,.")) == "rois"
    assert one(spark, text.abbreviation_count(F.col("t")), t=("string", "q~ ⁊ a ꝑ")) == 3
    assert one(spark, text.panel_text(F.col("t")), t=("string", "x" * 60)) == "x" * 49 + "..."
    assert one(spark, text.panel_text(F.col("t")), t=("string", None)) == "(non transcrite)"


@pytest.mark.parametrize("a,b,expected", [("chat", "chot", 0.25), ("", "", 0.0), ("", "texte", 1.0), ("chat", "", 1.0)])
def test_cer(spark, a, b, expected):
    assert one(spark, metrics.cer(F.col("a"), F.col("b")), a=("string", a), b=("string", b)) == expected


def test_wer(spark):
    assert one(spark, metrics.wer(F.col("a"), F.col("b")), a=("string", "le chat dort"), b=("string", "le chien dort")) == pytest.approx(1 / 3)
    assert one(spark, metrics.wer(F.col("a"), F.col("b")), a=("string", " "), b=("string", "x")) == 1.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("aé bc 𝒳 de".split(), k=rng.randint(0, 9))), " ".join(rng.choices("aé bd 𝒳 e".split(), k=rng.randint(0, 9)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", metrics.char_distance(F.col("a"), F.col("b")).alias("c"), metrics.word_distance(F.col("a"), F.col("b")).alias("w"))
    for r in df.collect():
        assert r["c"] == distance(r["a"], r["b"])
        assert r["w"] == distance(r["a"].split(), r["b"].split())


def slow_alignment(a, b):
    n, m = len(a), len(b)
    s = [[-(i + j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i][j] = max(s[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), s[i - 1][j] - 1, s[i][j - 1] - 1)
    return s[n][m]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_alignment(a, b):
    pairs = alignment.align(a, b)
    assert "".join(x for x, _ in pairs if x) == a and "".join(y for _, y in pairs if y) == b
    assert sum(1 if x == y else -1 for x, y in pairs) == slow_alignment(a, b)


def test_alignment_cases():
    assert alignment.align("chat", "chat") == [(c, c) for c in "chat"]
    assert alignment.align("chat", "chot")[2] == ("a", "o")
    assert [p for p in alignment.align("cat", "chat") if p[0] is None] == [(None, "h")]
    assert len(alignment.align("abc", "abcdef")) >= 6


def test_fusion(spark):
    assert alignment.fuse("o", [0.9], "a", [0.4])[0] == "o"
    assert alignment.fuse("romanz", [0.9] * 6, "ramanz", [0.95, 0.4, 0.9, 0.9, 0.9, 0.9])[0] == "romanz"
    fused = one(spark, alignment.fusion(F.col("a"), F.col("p"), F.col("b"), F.col("q")), a=("string", "gent"), p=("array<double>", [0.5] * 4), b=("string", "gent"), q=("array<double>", [0.6] * 4))
    assert fused["text"] == "gent" and fused["confidences"] == [0.6] * 4


def test_confidences(spark):
    cc = ("array<double>", [0.9, 0.5, 0.95, 0.3])
    assert one(spark, sequences.uncertain_positions(F.col("c")), c=cc) == [1, 3]
    assert [x["position"] for x in one(spark, sequences.candidates(F.col("c")), c=cc)] == [1, 3]
    assert one(spark, sequences.resized(F.col("c"), F.lit(2)), c=cc) == [0.9, 0.5]
    assert one(spark, sequences.resized(F.col("c"), F.lit(5)), c=cc) == [0.9, 0.5, 0.95, 0.3, 0.3]
    assert one(spark, sequences.resized(F.col("c"), F.lit(2)), c=("array<double>", [])) == [0.5, 0.5]
    assert one(spark, sequences.spread_confidences(F.col("p"), F.col("c"), F.lit("queli")), p=("array<string>", ["<s>", "que", "li"]), c=("array<double>", [0.9, 0.8])) == [0.9, 0.9, 0.9, 0.8, 0.8]
    assert one(spark, sequences.top_softmax(F.col("x")), x=("array<array<double>>", [[0.0, 0.0], [1000.0, 0.0]])) == [0.5, 1.0]


@pytest.mark.parametrize("flags,expected", [([False, True, True, False, True, False], [(1, 3), (4, 5)]), ([False, True, True], [(1, 3)]), ([False], []), ([], [])])
def test_runs(spark, flags, expected):
    assert [(r["start"], r["end"]) for r in one(spark, sequences.runs(F.col("f")), f=("array<boolean>", flags))] == expected


def test_subtoken_labels(spark):
    ids = lambda labels, words: one(spark, sequences.subtoken_labels(F.col("l"), F.col("w")), l=("array<string>", labels), w=("array<int>", words))
    loc = sequences.LABEL_IDS["B-LOC"]
    assert len(sequences.LABEL_IDS) == 11 and loc == 3
    assert ids(["B-LOC"], [None, 0, 0, None]) == [-100, loc, -100, -100]
    assert ids(["B-LOC", "O"], [None, 0, 1, None]) == [-100, loc, 0, -100]
    assert ids(["B-LOC"], [0, None, 0]) == [loc, -100, loc]
    assert one(spark, sequences.restored_labels(F.col("x"), 1), x=("array<int>", [-100, 5])) == [1, 5]


def test_points(spark):
    parse = lambda t, strict=False: one(spark, geometry.parse_points(F.col("t"), strict), t=("string", t))
    assert parse("10,20 100,20 100,40") == [[10, 20], [100, 20], [100, 40]]
    assert parse("") == [] and parse("5 1,2") == [[1, 2]]
    with pytest.raises(Exception):
        parse("5 1,2", strict=True)
    assert one(spark, geometry.format_points(F.col("p")), p=("array<array<double>>", [[10.9, 20.0], [-1.5, 4.0]])) == "10,20 -1,4"
    box = one(spark, geometry.bounding_box(F.col("p"), F.lit(100), F.lit(100)), p=("array<array<double>>", [[-10.0, 20.0], [180.0, 50.0]]))
    assert tuple(box) == (0, 20, 100, 50)


def test_alto_polygon(spark):
    zero = F.lit(0.0)
    poly = lambda t, w=zero, h=zero: one(spark, geometry.alto_polygon(F.col("t"), zero, zero, w, h), t=("string", t))
    assert poly("1 2 3 4 5 6 7") == [[1, 2], [3, 4], [5, 6]]
    assert poly("1 2", F.lit(5.0), F.lit(2.0)) == [[0, 0], [5, 0], [5, 2], [0, 2]]
    assert poly(None) == []
