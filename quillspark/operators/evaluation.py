"""Error rates over corpora: micro averages, intervals, paired tests, stages, exploratory statistics.

Edit distances are computed once a row; everything after is sums of integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import md5, metrics, sequences, text
from ..functions.fixed_values import CER_EXCELLENT, CER_TARGET, WER_TARGET


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0: a corpus without characters has no error."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def with_errors(df: DataFrame, reference: str = "reference", prediction: str = "prediction", words: bool = True) -> DataFrame:
    """df with dist and chars, and word_dist and words, of each row."""
    out = df.withColumn("dist", metrics.char_distance(F.col(reference), F.col(prediction))).withColumn("chars", F.length(reference).cast("long"))
    if words:
        out = metrics.with_word_distance(out, reference, prediction)
    return out


def corpus_cer(errors: DataFrame, *by: str) -> DataFrame:
    """Micro-averaged character error rate, by the given columns."""
    sums = errors.groupBy(*by).agg(F.sum("dist").alias("dist"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n_lines"))
    return sums.withColumn("cer", ratio(F.col("dist"), F.col("chars")))


def corpus_wer(errors: DataFrame, *by: str) -> DataFrame:
    """Micro-averaged word error rate, by the given columns."""
    sums = errors.groupBy(*by).agg(F.sum("word_dist").alias("word_dist"), F.sum("words").alias("words"))
    return sums.withColumn("wer", ratio(F.col("word_dist"), F.col("words")))


def corpus_cer_rollup(errors: DataFrame, *by: str) -> DataFrame:
    """Extension: the same for every prefix of the columns and overall, told apart by level (columns kept)."""
    level = F.lit(len(by)) - sum((F.grouping(c) for c in by), F.lit(0))
    sums = errors.rollup(*by).agg(level.cast("int").alias("level"), F.sum("dist").alias("dist"), F.sum("chars").alias("chars"))
    return sums.withColumn("cer", ratio(F.col("dist"), F.col("chars")))


def paired(left: DataFrame, right: DataFrame, key: str = "line_id") -> DataFrame:
    """Positional pairs as an equi-join; a row without its counterpart fails the query as lists of unequal length would."""
    a, b = left.withColumn("__in_left", F.lit(True)), right.withColumn("__in_right", F.lit(True))
    joined = a.join(b, key, "full_outer")
    whole = F.col("__in_left").isNotNull() & F.col("__in_right").isNotNull()
    return joined.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("no counterpart: "), F.col(key).cast("string"))).cast("boolean"))).drop("__in_left", "__in_right")


# Bootstrap

#: Rows that one task numbers, on average.
BUCKET_ROWS = 1_000_000


def bucket_digits(rows: int) -> int:
    """Hex digits of a hash that cut so many rows into buckets of at most BUCKET_ROWS on average, two at least."""
    digits = 2
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    return digits


def _hex_int(hashed: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(hashed, start, length), 16, 10).cast("long")


def dense_index(df: DataFrame, *keys: str, count: int | None = None) -> DataFrame:
    """df with idx from 0 without gaps, in the order (hash bucket of the keys, keys).

    Rows are numbered within buckets in parallel, 256 or as many as the rows need; the buckets' sizes, all that meets in
    one place, shift them. count: the rows, if they are known.
    """
    bucket = _hex_int(F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys))), 1, bucket_digits(df.count() if count is None else count))
    rows = df.withColumn("bucket", bucket)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)))
    # Broadcast: a row a bucket.
    return numbered.join(F.broadcast(before), "bucket").withColumn("idx", F.col("before") + F.col("rank") - 1).drop("bucket", "rank", "before")


#: Rows up to which every worker holds the corpus' (dist, chars), 2 to 4 bytes a row where lines are short; the slots and iterations of a unit of work.
MOST_HELD, SLOTS, TURNS = 100_000_000, 1 << 15, 50


def bootstrap(errors: DataFrame, keys: tuple[str, ...], iterations: int = 1000, seed: int = 42) -> DataFrame:
    """(iteration, cer) of samples with replacement as large as the corpus. Draws are hashes, the same on every engine and partitioning.

    iterations times the corpus' rows are drawn, in NumPy; the numbers they are drawn from are broadcast, so that no draw is
    shuffled. Beyond MOST_HELD rows draws are joined to them. multinomial_bootstrap() draws from the same distribution
    without a draw a row.
    """
    n = errors.count()
    indexed = dense_index(errors, *keys, count=n).select("idx", "dist", "chars")
    if n > MOST_HELD:
        draws = indexed.select(F.col("idx").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
        drawn = draws.select("iteration", F.pmod(_hex_int(F.md5(F.concat_ws(":", "iteration", "slot", F.lit(seed))), 1, 12), F.lit(n)).alias("idx"))
        sums = drawn.join(indexed, "idx").groupBy("iteration").agg(F.sum("dist").alias("dist"), F.sum("chars").alias("chars"))
    else:
        sums = _drawn(indexed, n, iterations, seed)
    return sums.select("iteration", ratio(F.col("dist"), F.col("chars")).alias("cer"))


def _held(indexed: DataFrame, n: int) -> list:
    """dist, chars, and whether dist is known, in the order of idx, as narrow arrays; the last one is left out where all are known."""
    import numpy as np
    import pyarrow as pa

    def packed(batches):
        for batch in batches:
            cells = [batch.column(0).to_numpy()]
            cells += [c.fill_null(0).to_numpy() for c in (batch.column(1), batch.column(2))]
            cells.append(batch.column(1).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
            if len(cells[0]):
                cells = [c.astype(np.min_scalar_type(int(c.max()))) for c in cells]
                yield pa.RecordBatch.from_pydict({"kinds": [",".join(c.dtype.str for c in cells)], "cells": pa.array([[c.tobytes() for c in cells]], pa.list_(pa.binary()))})

    found = [[np.frombuffer(c, k) for k, c in zip(r["kinds"].split(","), r["cells"])] for r in indexed.select("idx", F.col("dist").cast("long"), F.col("chars").cast("long")).mapInArrow(packed, "kinds string, cells array<binary>").collect()]
    held = []
    for k in (1, 2, 3):
        values = np.zeros(n, np.min_scalar_type(max((int(f[k].max()) for f in found), default=0)))
        for f in found:
            values[f[0]] = f[k]
        held.append(values)
    return held[:2] if n and held[2].all() else held


def _drawn(indexed: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """(iteration, dist, chars): the sums over n draws from the n indexed rows."""
    import numpy as np
    import pandas as pd

    context = indexed.sparkSession.sparkContext
    held, blocks = context.broadcast(_held(indexed, n)), -(-iterations // TURNS)
    slots_a_unit, turns = SLOTS, TURNS

    def draw(batches):
        values = held.value
        for pdf in batches:
            rows = []
            for unit in pdf["id"]:
                low, first = int(unit) // blocks * slots_a_unit, int(unit) % blocks * turns
                tails, parts = [f":{slot}:{seed}".encode() for slot in range(low, min(low + slots_a_unit, n))], {}
                for iteration in range(first, min(first + turns, iterations)):
                    prefix = str(iteration).encode()
                    if len(prefix) not in parts:
                        parts[len(prefix)] = md5.blocks(tails, len(prefix))
                    idx = (md5.leading(md5.digests(parts[len(prefix)], prefix, len(tails)), 12) % np.uint64(n)).astype(np.int64)
                    sums = [int(v[idx].sum(dtype=np.int64)) for v in values]
                    rows.append((iteration, sums[0], sums[1], sums[2] if len(sums) > 2 else len(tails)))
            yield pd.DataFrame(rows, columns=["iteration", "dist", "chars", "known"])

    units = -(-n // SLOTS) * blocks
    tasks = max(1, min(units, max(4 * context.defaultParallelism, units // 40)))
    sums = indexed.sparkSession.range(units, numPartitions=tasks).mapInPandas(draw, "iteration int, dist long, chars long, known long")
    sums = sums.groupBy("iteration").agg(F.sum("dist").alias("dist"), F.sum("chars").alias("chars"), F.sum("known").alias("known"))
    return sums.select("iteration", F.when(F.col("known") > 0, F.col("dist")).alias("dist"), "chars")


#: Cumulated probabilities of the Poisson distribution with mean 1, from 0 on, in units of 2^-24.
POISSON = tuple(round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * (1 << 24)) for k in range(9))


def poisson_bootstrap(errors: DataFrame, keys: tuple[str, ...], iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Extension: (iteration, cer) with each row drawn a Poisson(1) number of times. One pass, no join; what is shuffled is a row an iteration and task."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    # Five draws of six hex digits from each hash, of (iteration / 5, keys, seed).
    rows = errors.select(F.concat_ws(":", F.lit(""), *(F.col(k).cast("string") for k in keys), F.lit(seed)).alias("tail"), F.col("dist").cast("long").alias("dist"), F.col("chars").cast("long").alias("chars"))
    limits = [np.uint32(p) for p in POISSON if p < 1 << 24]

    def draw(batches):
        sums, known, seen = np.zeros((iterations, 2), np.int64), 0, 0
        for batch in batches:
            seen += batch.num_rows
            tails = [t.encode() for t in batch.column(0).to_pylist()]
            values = np.stack([batch.column(k).fill_null(0).to_numpy() for k in (1, 2)], axis=1)
            known += len(tails) - batch.column(1).null_count
            for width in range(1, len(str(max(iterations - 1, 0) // 5)) + 1):
                by_blocks: dict = {}
                for k, tail in enumerate(tails):
                    by_blocks.setdefault(md5.n_blocks(len(tail) + width), []).append(k)
                for some in by_blocks.values():
                    # Sums of whole numbers below 2^53 are exact in doubles.
                    parts, these = md5.blocks([tails[k] for k in some], width), values[some].astype(float).T
                    for group in range(10 ** (width - 1) if width > 1 else 0, min(10**width, -(-iterations // 5))):
                        words = md5.digests(parts, str(group).encode(), len(some))
                        for r in range(min(5, iterations - 5 * group)):
                            u, times = md5.leading(words, 6, 6 * r).astype(np.uint32), np.zeros(len(some), np.uint8)
                            for limit in limits:
                                times += u >= limit
                            sums[5 * group + r] += (these @ times.astype(float)).astype(np.int64)
        if seen:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"iteration": np.arange(iterations, dtype=np.int32), "dist": sums[:, 0], "chars": sums[:, 1], "known": known}), preserve_index=False)

    sums = rows.mapInArrow(draw, "iteration int, dist long, chars long, known long").groupBy("iteration").agg(F.sum("dist").alias("dist"), F.sum("chars").alias("chars"), F.sum("known").alias("known"))
    return sums.select("iteration", ratio(F.when(F.col("known") > 0, F.col("dist")), F.col("chars")).alias("cer"))


#: Distinct (dist, chars) pairs up to which the multinomial draws are made; the pairs are bounded by the lines' lengths.
MOST_PAIRS = 1_000_000


def multinomial_bootstrap(errors: DataFrame, keys: tuple[str, ...] = (), iterations: int = 1000, seed: int = 42) -> DataFrame:
    """(iteration, cer) as bootstrap() draws, without a draw a row: a sample's rate depends only on how often each distinct (dist, chars) pair is drawn, and these counts are multinomial.

    One aggregate over the corpus; then each iteration draws its counts in a task of its own, from a generator seeded by
    (seed, iteration). Beyond MOST_PAIRS distinct pairs (lines of thousands of characters) rows are drawn a Poisson number
    of times, by the keys, instead.
    """
    import numpy as np
    import pandas as pd

    pairs = errors.groupBy("dist", "chars").agg(F.count(F.lit(1)).alias("n"))
    held = pairs.orderBy("dist", "chars").limit(MOST_PAIRS + 1).toPandas()
    if len(held) > MOST_PAIRS:
        return poisson_bootstrap(errors, keys, iterations, seed)
    dist, chars, n = (held[c].to_numpy(dtype=float) for c in ("dist", "chars", "n"))
    total = int(n.sum())

    def draw(batches):
        for pdf in batches:
            rates = []
            for iteration in pdf["iteration"]:
                times = np.random.default_rng((seed, int(iteration))).multinomial(total, n / total)
                below = float(chars @ times)
                rates.append(float(dist @ times) / below if below else 0.0)
            yield pd.DataFrame({"iteration": pdf["iteration"].astype("int32"), "cer": rates})

    spark = errors.sparkSession
    turns = spark.range(iterations if total else 0, numPartitions=max(1, min(iterations, 2 * spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "iteration")
    return turns.mapInPandas(draw, "iteration int, cer double")


def interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """(low, high): exact percentiles with linear interpolation, 0 of none."""
    tail = (1 - level) / 2
    at = lambda p: F.coalesce(F.percentile("cer", F.lit(p)), F.lit(0.0))
    return replicates.agg(at(tail).alias("low"), at(1 - tail).alias("high"))


# Paired comparison


def mcnemar(df: DataFrame, reference: str, a: str, b: str) -> DataFrame:
    """(n01, n10, statistic): n01 has a wrong and b right; with continuity correction, 0 without discordant rows."""
    right_a, right_b = F.col(a).eqNullSafe(F.col(reference)), F.col(b).eqNullSafe(F.col(reference))
    counts = df.agg(F.count_if(~right_a & right_b).alias("n01"), F.count_if(right_a & ~right_b).alias("n10"))
    return counts.withColumn("statistic", mcnemar_statistic(F.col("n01"), F.col("n10")))


def mcnemar_statistic(n01: Column, n10: Column) -> Column:
    """(|n01 - n10| - 1)^2 / (n01 + n10)."""
    return ratio(F.pow(F.abs(n01 - n10) - 1, F.lit(2)).cast("double"), n01 + n10)


def chi2_tail(statistic: float) -> float:
    """The upper tail of the chi-square distribution with one degree of freedom."""
    return math.erfc(math.sqrt(statistic / 2))


def compare(df: DataFrame, reference: str, a: str, b: str) -> DataFrame:
    """Both models' sums and McNemar's counts in one pass: dist_a, dist_b, chars, cer_a, cer_b, n01, n10, statistic, best (a, b or equal)."""
    ref = F.col(reference)
    right_a, right_b = F.col(a).eqNullSafe(ref), F.col(b).eqNullSafe(ref)
    sums = df.agg(
        F.coalesce(F.sum(metrics.char_distance(ref, F.col(a))), F.lit(0)).alias("dist_a"),
        F.coalesce(F.sum(metrics.char_distance(ref, F.col(b))), F.lit(0)).alias("dist_b"),
        F.coalesce(F.sum(F.length(ref).cast("long")), F.lit(0)).alias("chars"),
        F.count_if(~right_a & right_b).alias("n01"),
        F.count_if(right_a & ~right_b).alias("n10"),
    )
    out = sums.withColumn("cer_a", ratio(F.col("dist_a"), F.col("chars"))).withColumn("cer_b", ratio(F.col("dist_b"), F.col("chars")))
    best = F.when(F.col("cer_a") < F.col("cer_b"), a).when(F.col("cer_b") < F.col("cer_a"), b).otherwise("égalité")
    return out.withColumn("statistic", mcnemar_statistic(F.col("n01"), F.col("n10"))).withColumn("best", best)


def compare_report(df: DataFrame, reference: str, a: str, b: str) -> dict:
    """compare() as a report with the p value, rounded to 4 digits after all decisions."""
    r = compare(df, reference, a, b).first()
    p = chi2_tail(r["statistic"]) if r["n01"] + r["n10"] else 1.0
    return {f"cer_{a}": round(r["cer_a"], 4), f"cer_{b}": round(r["cer_b"], 4), "best": r["best"], "n01": r["n01"], "n10": r["n10"], "statistic": r["statistic"], "p_value": round(p, 4), "significant": p < 0.05}


def report(df: DataFrame, keys: tuple[str, ...], reference: str = "reference", prediction: str = "prediction", iterations: int = 1000, seed: int = 42) -> dict:
    """CER, WER, the CER's 95 % interval and verdicts on the unrounded rates."""
    errors = with_errors(df, reference, prediction).select(*keys, "dist", "chars", "word_dist", "words").persist()
    sums = errors.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dist", "chars", "word_dist", "words")), F.count(F.lit(1)).alias("n")).first()
    rate = lambda x, n: x / n if n else 0.0
    cer, wer = rate(sums["dist"], sums["chars"]), rate(sums["word_dist"], sums["words"])
    bounds = interval(multinomial_bootstrap(errors, keys, iterations, seed)).first()
    errors.unpersist()
    return {"CER": round(cer, 4), "WER": round(wer, 4), "CER_IC95": [round(bounds["low"], 4), round(bounds["high"], 4)], "CER_sous_15pct": cer < CER_TARGET, "CER_sous_8pct": cer < CER_EXCELLENT, "WER_sous_25pct": wer < WER_TARGET, "n_lignes": sums["n"]}


# Stages


def stage_transitions(versions: DataFrame, line_id: str = "line_id", order: str = "stage_ord", stage: str = "stage", content: str = "text") -> DataFrame:
    """From (line, stage order, stage, text): for each pair of consecutive stages the mean of the lines' distances (each relative to the earlier text), lines changed and lines."""
    by_line = Window.partitionBy(line_id).orderBy(order)
    pairs = versions.select(order, stage, content, F.lead(stage).over(by_line).alias("next_stage"), F.lead(content).over(by_line).alias("next_text")).where("next_stage IS NOT NULL")
    far = pairs.select(F.concat_ws("→", stage, "next_stage").alias("transition"), F.length(content).alias("n"), F.length("next_text").alias("m"), metrics.char_distance(F.col(content), F.col("next_text")).alias("dist"))
    d = far.withColumn("d", metrics.rate(F.col("dist"), F.col("n"), F.col("m")))
    return d.groupBy("transition").agg(F.avg("d").alias("mean_distance"), F.sum("dist").alias("dist"), F.count_if(F.col("d") > 0).alias("n_changed"), F.count(F.lit(1)).alias("n_lines"))


def wide_transitions(rows: DataFrame, stages: dict[str, str]) -> DataFrame:
    """stage_transitions() of lines that have every stage in a column of their own (stage -> column, in order): no text is shuffled."""
    names, columns = list(stages), list(stages.values())
    steps = F.array(*(F.struct(F.lit(f"{names[k]}→{names[k + 1]}").alias("transition"), F.col(columns[k]).alias("a"), F.col(columns[k + 1]).alias("b")) for k in range(len(names) - 1)))
    pairs = rows.select(F.explode(steps).alias("s")).select("s.*").where("a IS NOT NULL AND b IS NOT NULL")
    far = pairs.select("transition", F.length("a").alias("n"), F.length("b").alias("m"), metrics.char_distance(F.col("a"), F.col("b")).alias("dist"))
    d = far.withColumn("d", metrics.rate(F.col("dist"), F.col("n"), F.col("m")))
    return d.groupBy("transition").agg(F.avg("d").alias("mean_distance"), F.sum("dist").alias("dist"), F.count_if(F.col("d") > 0).alias("n_changed"), F.count(F.lit(1)).alias("n_lines"))


def report_row(errors: DataFrame, replicates: DataFrame) -> DataFrame:
    """report() as a row, for errors(dist, chars, word_dist, words) and their replicates; verdicts on the unrounded rates."""
    sums = errors.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dist", "chars", "word_dist", "words")), F.count(F.lit(1)).alias("n_lignes"))
    cer, wer = ratio(F.col("dist"), F.col("chars")), ratio(F.col("word_dist"), F.col("words"))
    # One row each.
    whole = sums.select("n_lignes", cer.alias("cer"), wer.alias("wer"), F.lit(1).alias("one")).join(interval(replicates).withColumn("one", F.lit(1)), "one")
    rounded = lambda c: sequences.rounded(F.col(c), 4)
    return whole.select(
        rounded("cer").alias("CER"), rounded("wer").alias("WER"), rounded("low").alias("CER_low"), rounded("high").alias("CER_high"), (F.col("cer") < CER_TARGET).alias("CER_sous_15pct"),
        (F.col("cer") < CER_EXCELLENT).alias("CER_sous_8pct"), (F.col("wer") < WER_TARGET).alias("WER_sous_25pct"), "n_lignes",
    )


def stage_cer(versions: DataFrame, reference: str = "reference", stage: str = "stage", content: str = "text") -> DataFrame:
    """Micro-averaged CER of each stage against the reference."""
    return corpus_cer(with_errors(versions, reference, content, words=False), stage)


# Exploration


def explore(lines: DataFrame, *by: str) -> DataFrame:
    """Counts, confidences, review rate, text length and unresolved abbreviations of contract lines."""
    return lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.avg("confidence").alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.avg(F.col("needs_review").cast("int")).alias("review_rate"),
        F.avg(F.length("text")).alias("mean_length"),
        F.sum(text.abbreviation_count(F.col("text")).cast("long")).alias("n_abbreviations"),
    )


def by_century(lines: DataFrame) -> DataFrame:
    """Lines of each century, "inconnu" where it is missing."""
    return lines.groupBy(F.coalesce(F.col("century").cast("string"), F.lit("inconnu")).alias("century")).agg(F.count(F.lit(1)).alias("n_lines"))


def explore_report(lines: DataFrame) -> dict:
    """explore() and by_century() as a rounded report; only n_lignes for no lines."""
    r = explore(lines).first()
    if not r or not r["n_lines"]:
        return {"n_lignes": 0}
    return {
        "n_lignes": r["n_lines"], "confiance_moyenne": round(r["mean_confidence"], 4), "confiance_min": round(r["min_confidence"], 4), "confiance_max": round(r["max_confidence"], 4),
        "taux_needs_review": round(r["review_rate"], 4), "longueur_moyenne_lignes": round(r["mean_length"], 1), "nb_abreviations_residuelles": r["n_abbreviations"],
        "distribution_siecles": {c["century"]: c["n_lines"] for c in by_century(lines).collect()},
    }


def entity_f1(truth: DataFrame, found: DataFrame, *key: str, kind: str = "type") -> DataFrame:
    """Extension: entity-level precision, recall and F1 by type, an entity being right if all of its key and its type agree."""
    t, f = truth.select(*key, kind).distinct().withColumn("t", F.lit(1)), found.select(*key, kind).distinct().withColumn("f", F.lit(1))
    sums = t.join(f, [*key, kind], "full_outer").groupBy(kind).agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return sums.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
