"""Queries at size: what is joined, shuffled and drawn, and that the faster ways give the same."""

import hashlib
import os
import random

from pyspark.sql import functions as F

import __spark_entry__
from quillspark.functions import alignment, md5, text
from quillspark.operators import evaluation
from quillspark.plans import derive, pipelines, queries
from quillspark.sources import contracts


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_raster_rows_are_made_once(spark, small):
    found = __spark_entry__.queries()["pages_to_documents"](spark, small)
    assert optimized(found).count("AS pixels#") == 1
    # A document's rows stay where its line lengths were shuffled to.
    assert "Join" not in optimized(derive.raster_rows(spark, small))
    rows = derive.raster_rows(spark, small).where("page_id < 20")
    head = rows.select("page_id").distinct().select("page_id", F.lit(9).alias("century"), *(F.lit("x").alias(c) for c in ("document_type", "language", "source")), F.lit(48).alias("image_width"), F.lit(400).alias("image_height"))
    apart = pipelines.rows_to_documents(rows, head).orderBy("document_id").collect()
    assert len(apart) == 20 and apart == pipelines.pages_to_documents(rows.join(head, "page_id")).orderBy("document_id").collect()


def test_raster_rows_of_an_id_twice(spark, tmp_path):
    """Line lengths of documents that share an id: the greater one of each line."""
    texts = [(1, "a\nbb bb\n\nc"), (1, "aaaa\nb"), (2, None), (3, " ".join(["w"] * 41))]
    spark.createDataFrame([(i, "x", "y", t) for i, t in texts], "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = derive.raster_rows(spark, str(tmp_path))
    assert {r["page_id"]: r["n"] for r in rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 72, 2: 18, 3: 18}
    inked = {(r["page_id"], r["row_idx"]): r["n"] for r in rows.select("page_id", "row_idx", F.size(F.filter("pixels", lambda p: p == 0)).alias("n")).collect()}
    assert [inked[1, 18 * k + 4] for k in range(4)] == [15, 15, 9, 9] and inked[1, 3] == inked[1, 16] == 0
    assert inked[2, 4] == 11 and inked[3, 4] == 48 and {p for p, in rows.select(F.size("pixels")).distinct().collect()} == {48}


def test_contract_documents_shuffle_texts(spark, small, tmp_path):
    """Confidences and candidates are made after the lines are gathered, and files are compressed."""
    docs = queries._contract_documents(spark, small)
    gathered = [x for x in optimized(docs).splitlines() if "collect_list" in x]
    assert gathered and not any("char_confidences" in x for x in gathered)
    path = str(tmp_path / "out")
    few = docs.where("document_id < 'd12'")
    contracts.write_contracts(few, path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    back = contracts.read_contracts(spark, path, lines=True).select(*few.columns)
    assert back.orderBy("document_id").collect() == few.orderBy("document_id").collect()
    lines = {r["l"]["line_id"]: r["l"] for r in queries._contract_lines(spark, small).where("doc_id < 12").select("l").collect()}
    assert lines == {x["line_id"]: x for r in docs.where("document_id IN ('d0', 'd1', 'd2', 'd3', 'd4', 'd5', 'd6', 'd7', 'd8', 'd9', 'd10', 'd11')").collect() for x in r["lines"]}


def test_md5_of_many_texts():
    tails = [f":{k}:{'é' * (k % 90)}".encode() for k in range(400)]
    for prefix in (b"7", b"123", b"12345"):
        by_blocks = {}
        for t in tails:
            by_blocks.setdefault(md5.n_blocks(len(t) + len(prefix)), []).append(t)
        assert len(by_blocks) > 2
        for some in by_blocks.values():
            words = md5.digests(md5.blocks(some, len(prefix)), prefix, len(some))
            right = [hashlib.md5(prefix + t).hexdigest() for t in some]
            for start, digits in ((0, 12), (0, 6), (6, 6), (12, 6), (24, 6)):
                assert md5.leading(words, digits, start).tolist() == [int(r[start : start + digits], 16) for r in right]


def test_bootstrap_shuffles_no_draws(spark, monkeypatch):
    """The held numbers give what the join of all draws gives, unknown distances included."""
    rows = [(f"l{k}", None if k % 7 == 0 else k % 5, 10 + k % 300) for k in range(300)]
    for some, kind in ((rows, "line_id string, dist long, chars long"), ([(a, None, c) for a, _, c in rows[:3]], "line_id string, dist long, chars long")):
        errors = spark.createDataFrame(some, kind)
        held = evaluation.bootstrap(errors, ("line_id",), 30)
        assert "Join" not in optimized(held) and "explode" not in optimized(held)
        monkeypatch.setattr(evaluation, "MOST_HELD", 0)
        joined = evaluation.bootstrap(errors, ("line_id",), 30)
        monkeypatch.undo()
        assert "Join" in optimized(joined) and held.orderBy("iteration").collect() == joined.orderBy("iteration").collect()


def test_poisson_bootstrap_makes_no_row_a_draw(spark):
    errors = spark.createDataFrame([(f"l{k}" * (1 + k % 40), k % 5, 10 + k % 9) for k in range(120)], "line_id string, dist long, chars long")
    drawn = evaluation.poisson_bootstrap(errors.repartition(3), ("line_id",), 57)
    assert "explode" not in optimized(drawn)
    right, given = [], errors.collect()
    for i in range(57):
        u = [int(hashlib.md5(f"{i // 5}:{r['line_id']}:42".encode()).hexdigest()[6 * (i % 5) : 6 * (i % 5) + 6], 16) for r in given]
        times = [sum(x >= p for p in evaluation.POISSON if p < 1 << 24) for x in u]
        right.append(sum(t * r["dist"] for t, r in zip(times, given)) / sum(t * r["chars"] for t, r in zip(times, given)))
    assert [r["cer"] for r in drawn.orderBy("iteration").collect()] == right


def test_many_alignments_at_once(spark, monkeypatch):
    """The banded tables of many pairs give align()'s and fuse()'s results, one pair a batch or all; align() isn't called for them."""
    rng, pairs = random.Random(5), [("", ""), ("", "ab"), ("a𝒳é", ""), ("aab", "ab"), ("x" * 90, "y" * 7), ("ab" * 40, "ba" * 40)]
    for n in range(300):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(40)))
        b = a.replace("ab", "⁊").replace("é ", "x") if n % 2 else "".join(rng.choice("ab𝒳") for _ in range(rng.randrange(30)))
        pairs.append((a, b))
    rows = [(k, a, [((k + i * 7) % 11) / 10 for i in range(len(a))], b, [((k + i * 5) % 11) / 10 for i in range(len(b))]) for k, (a, b) in enumerate(pairs)]
    right = [(alignment.align(a, b), alignment.fuse(a, p, b, q)) for _, a, p, b, q in rows]
    steps = [[1 if y is None else 2 if x is None else 0 for x, y in r[0]] for r in right]
    codes = [[alignment._codes(t) for t in side] for side in zip(*pairs)]
    assert [s.tolist() for s in alignment.align_many(*codes)] == steps
    monkeypatch.setattr(alignment, "CELLS", 1)
    assert [s.tolist() for s in alignment.align_many(*codes)] == steps
    monkeypatch.undo()
    monkeypatch.setattr(alignment, "align", None)
    df = spark.createDataFrame(rows, "k int, a string, p array<double>, b string, q array<double>").repartition(2)
    found = df.select("k", alignment.alignment(F.col("a"), F.col("b")).alias("s"), alignment.fusion(F.col("a"), F.col("p"), F.col("b"), F.col("q")).alias("f")).orderBy("k").collect()
    assert [([tuple(x) for x in r["s"]], (r["f"]["text"], r["f"]["confidences"])) for r in found] == right


def test_corrections_by_lookup(spark, monkeypatch):
    """A lookup a position gives what trying each option gives; corrected() is left to other options and to capital sigmas."""
    rng, rows, known = random.Random(3), [], ("de", "sa", "le", "la", "e", "roi", "que")
    for k in range(400):
        t = "".join(rng.choice("dslaeo    é") for _ in range(rng.randrange(25)))
        places = [rng.randrange(28) for _ in range(rng.randrange(12))]
        confidences = [rng.choice((0.1, 0.69, 0.7, 0.9)) for _ in range(max(0, len(t) - rng.randrange(3)))]
        rows.append((k, None if k == 7 else t, None if k == 8 else confidences, None if k == 9 else [(p, ["a", "e", "O"]) for p in places]))
    kind = "k int, t string, p array<double>, c array<struct<position:int,options:array<string>>>"
    as_dicts = lambda c: [{"position": p, "options": o} for p, o in c]
    right = [t if t is None or c is None else text.corrected(t, p or (), as_dicts(c), 0.7, frozenset(known)) for _, t, p, c in rows]
    assert sum(x != r[1] for x, r in zip(right, rows)) > 20
    found = lambda rows: [r["x"] for r in spark.createDataFrame(rows, kind).select("k", text.correct(F.col("t"), F.col("p"), F.col("c"), lexicon=known).alias("x")).orderBy("k").collect()]
    other = [(k, t, p, c and [(q, o[: 1 + q % 3] + ["ue"]) for q, o in c]) for k, t, p, c in rows]
    assert found(other) == [t if t is None or c is None else text.corrected(t, p or (), as_dicts(c), 0.7, frozenset(known)) for _, t, p, c in other]
    monkeypatch.setattr(text, "corrected", None)
    assert found(rows) == right
