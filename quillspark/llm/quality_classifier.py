"""Quality classifier (operator 10): co-training of a text view and a metadata view.

The text view sees shape statistics of the content, the metadata view only language, source and size. Features of all
documents are taken in one pass and kept as a narrow table. Both views are fitted on the driver from a bounded sample of
labelled documents (at most `max_labelled`, those below a hash threshold). Over some rounds each view then judges all
other documents, and what it is confident about joins the other view's training rows: confident rows are counted by kind
and stratum (hashed language and source), and a hash threshold a stratum lets some `taught` rows of each kind pass, spread
evenly over the strata, so no source or language is left out at any size. Each view is calibrated on labelled rows that it
wasn't trained on, and the views' log odds are added, as for independent evidence (the prior counted once), to score every
document.

Defined cases: a null text counts as empty; null metadata are a value of their own; labels that are null or name no
document are unused; of several documents with a labelled id one, the same in every run, is fitted on; without labels, or
with labels of one kind, every score is the (smoothed) share of good labels; rows with the same doc_id are scored by
themselves; an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .gbt import Boosted
from .shared import Workspace, private, table, texts
from .tokens import forget

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"
STOPS = b".,;:"
SOURCE_SLOTS, LANG_SLOTS = 64, 16
TEXT_FEATURES, META_FEATURES = 13, SOURCE_SLOTS + LANG_SLOTS + 2


@dataclass(frozen=True)
class Settings:
    """Bounds of the fitted sample, and how the views teach one another."""

    max_labelled: int = 20_000
    rounds: int = 3
    #: A view teaches what it holds for good or bad with at least this probability; some so many rows of either kind, view and round are fitted on.
    confidence: float = 0.97
    taught: int = 1_000
    #: Documents whose probability of being good is below this are rejected.
    threshold: float = 0.5


def text_features(raw: bytes) -> list[float]:
    """Shape statistics of a whole text in UTF-8."""
    size = len(raw)
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * TEXT_FEATURES
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        share(SYMBOLS),
        share(UPPER),
        share(b"0123456789"),
        share(STOPS),
        share(b"!?"),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        raw.count(b"http") / n,
    ]


def metadata_features(lang: str | None, source: str | None, size: int) -> list[float]:
    """Hashed language and source, and the text's size."""
    found = [0.0] * META_FEATURES
    found[zlib.crc32(repr(lang).encode()) % LANG_SLOTS] = 1.0
    found[LANG_SLOTS + zlib.crc32(repr(source).encode()) % SOURCE_SLOTS] = 1.0
    found[-2] = float(np.log1p(size))
    found[-1] = float(np.log1p(size) ** 2)
    return found


class Logistic:
    """L2-regularised logistic regression by Newton's method on standardised columns."""

    def fit(self, x: np.ndarray, y: np.ndarray, l2: float = 10.0) -> "Logistic":
        self.mean, spread = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])
        self.weights, penalty = np.zeros(z.shape[1]), np.diag([1e-6, *[l2] * x.shape[1]])
        for _ in range(15):
            p = 1 / (1 + np.exp(-z @ self.weights))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:], -30, 30)
        return 1 / (1 + np.exp(-z))


class Constant:
    """A view without anything to learn from."""

    def __init__(self, p: float):
        self.p = p

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class CoTrained:
    """Two calibrated views; views: (model, slope, offset) of text and metadata."""

    prior: float
    views: list[tuple[object, float, float]]

    def view(self, n: int, x: np.ndarray) -> np.ndarray:
        """A view's calibrated probability."""
        model, slope, offset = self.views[n]
        return 1 / (1 + np.exp(-np.clip(slope * log_odds(model.predict(x)) + offset, -30, 30)))

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The combined probability of being good."""
        prior = log_odds(np.array([self.prior]))[0]
        return 1 / (1 + np.exp(-np.clip(log_odds(self.view(0, text)) + log_odds(self.view(1, meta)) - prior, -30, 30)))


def _fit_view(n: int, x: np.ndarray, y: np.ndarray):
    if len(y) == 0 or y.min() == y.max():
        return Constant(float((y.sum() + 1) / (len(y) + 2)))
    return Boosted(rounds=60, depth=3).fit(x, y) if n == 0 else Logistic().fit(x, y)


def confident(teacher: int, models: list, views: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows that a view is sure of, and what it holds them for."""
    p = models[teacher].predict(views[teacher])
    at = np.flatnonzero(np.maximum(p, 1 - p) >= settings.confidence)
    return at, p[at] >= 0.5


def in_memory(pool: list[np.ndarray], settings: Settings):
    """What picks from a pool held as one array a view: for each teacher, both views of what it is sure of, and its labels."""

    def pick(models: list, turn: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
        found = [confident(teacher, models, pool, settings) for teacher in (0, 1)]
        return [([v[at] for v in pool], good.astype(float)) for at, good in found]

    return pick


def co_train(labelled: list[np.ndarray], y: np.ndarray, pick, settings: Settings = Settings()) -> CoTrained:
    """labelled: one array a view; pick: gives pseudo-labelled rows, see in_memory(). A fifth of the labelled rows is held out to calibrate."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    held = np.arange(len(y)) % 5 == 4
    x = [v[~held] for v in labelled]
    t = [y[~held], y[~held]]
    models = [_fit_view(n, x[n], t[n]) for n in (0, 1)]
    for turn in range(settings.rounds):
        if all(isinstance(m, Constant) for m in models):
            break
        taught = False
        for teacher, (rows, label) in enumerate(pick(models, turn)):
            pupil = 1 - teacher
            # As many of either kind as the prior has, or the pupil would learn the teacher's bias.
            good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
            good = good[: max(1, int(len(bad) * prior / max(1 - prior, 1e-6)))] if len(bad) else good[:0]
            picked = np.concatenate([good, bad])
            if len(picked):
                taught = True
                x[pupil] = np.vstack([x[pupil], rows[pupil][picked]])
                t[pupil] = np.concatenate([t[pupil], label[picked]])
        if not taught:
            break
        models = [_fit_view(n, x[n], t[n]) for n in (0, 1)]
    views = []
    for n, model in enumerate(models):
        z, target = log_odds(model.predict(labelled[n][held])), y[held]
        if isinstance(model, Constant) or len(target) < 20 or target.min() == target.max():
            views.append((model, 1.0, 0.0))
            continue
        platt = Logistic().fit(z[:, None], target, l2=1.0)
        slope = platt.weights[1] / platt.scale[0]
        views.append((model, float(slope), float(platt.weights[0] - slope * platt.mean[0])))
    return CoTrained(prior, views)


FEATURES = "x array<double>, lang string, source string, size long"


def _plain(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))


def document_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A narrow row for each row of docs: doc_id, x (the text view), lang, source, size."""
    import pyarrow as pa

    def run(batches):
        forget()
        for b in batches:
            found = [(text_features(r), len(r)) for r in texts(b.column(1))]
            x, sizes = pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), x, b.column(2), b.column(3), sizes], names=["doc_id", "x", "lang", "source", "size"])

    plain = _plain(docs, doc_id, text, lang, source)
    return plain.mapInArrow(run, f"doc_id {plain.dtypes[0][1]}, {FEATURES}")


def _views(x, lang, source, size) -> list[np.ndarray]:
    """Both views of columns of features."""
    meta = [metadata_features(a, b, n) for a, b, n in zip(lang, source, size)]
    return [np.array(x, float).reshape(-1, TEXT_FEATURES), np.array(meta, float).reshape(-1, META_FEATURES)]


def _batch_views(b, at: int) -> list[np.ndarray]:
    """Both views of an Arrow batch whose columns from at on are x, lang, source and size."""
    x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, TEXT_FEATURES)
    return [x, _views([], *(b.column(k).to_pylist() for k in range(at + 1, at + 4)))[1]]


def _strata(meta: np.ndarray) -> np.ndarray:
    """Of each row of the metadata view, the number of its language's and source's slots."""
    return meta[:, :LANG_SLOTS].argmax(axis=1) * SOURCE_SLOTS + meta[:, LANG_SLOTS : LANG_SLOTS + SOURCE_SLOTS].argmax(axis=1)


def _from_all(rows: DataFrame, settings: Settings):
    """What picks pseudo-labelled rows from all rows(x, lang, source, size): counts by view, kind and stratum, then a hash threshold in each."""
    import pyarrow as pa

    cells = LANG_SLOTS * SOURCE_SLOTS
    columns = ("x", "lang", "source", "size")

    def pick(models: list, turn: int):
        def count(batches):
            for b in batches:
                views = _batch_views(b, 0)
                stratum = _strata(views[1])
                for teacher in (0, 1):
                    at, good = confident(teacher, models, views, settings)
                    n = np.bincount((2 * teacher + good) * cells + stratum[at], minlength=4 * cells)
                    cell = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n[cell], pa.int64())], names=["cell", "n"])

        # At most 4,096 cells.
        counts = {r["cell"]: r["n"] for r in rows.select(*columns).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        share = np.zeros(4 * cells)
        for kind in range(4):
            mine = [c for c in counts if c // cells == kind]
            for c in mine:
                share[c] = settings.taught / len(mine) / counts[c]

        def choose(batches):
            for b in batches:
                views = _batch_views(b, 0)
                stratum, draw = _strata(views[1]), b.column(4).to_numpy()
                for teacher in (0, 1):
                    at, good = confident(teacher, models, views, settings)
                    cell = (2 * teacher + good) * cells + stratum[at]
                    chosen = draw[at] < share[cell]
                    which = pa.array(at[chosen])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[chosen] // cells, pa.int64()), *(b.column(k).take(which) for k in range(5))], names=["kind", *columns, "draw"])

        draw = F.pmod(F.xxhash64(F.lit(turn), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))
        told = rows.select(*columns, draw.alias("draw")).mapInArrow(choose, f"kind long, {FEATURES}, draw double")
        # Rows of the same features have the same draw: they count once, so that no repeated document crowds the driver.
        found = told.distinct().orderBy("draw", "kind", "x").limit(8 * settings.taught).collect()
        out = []
        for teacher in (0, 1):
            mine = [r for r in found if r["kind"] // 2 == teacher]
            out.append((_views(*([r[c] for r in mine] for c in columns)), np.array([r["kind"] % 2 for r in mine], float)))
        return out

    return pick


def train_on(features: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> CoTrained:
    """Fit both views; features: a kept table of document_features()."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("quality")).where("id IS NOT NULL AND quality IN (0, 1)")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = known.where(share < F.lit(min(1.0, settings.max_labelled / max(1, known.count()))))
    # Broadcast: at most max_labelled ids.
    chosen = few.groupBy("id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(settings.max_labelled)
    chosen = features.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    rows = features.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("id", "quality").agg(F.min(F.struct("x", F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"), "size", "lang", "source")).alias("row"))
    found = sorted(rows.collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    others = features.join(F.broadcast(chosen.select("id")), F.col("doc_id") == F.col("id"), "left_anti")
    views = _views(*([r["row"][c] for r in found] for c in ("x", "lang", "source", "size")))
    return co_train(views, np.array([r["quality"] for r in found], float), _from_all(others, settings), settings)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> CoTrained:
    """Fit both views on documents."""
    ws = Workspace(docs.sparkSession, "classifier")
    features = ws.keep(document_features(docs, doc_id, text, lang, source), "features")
    model = train_on(features, labels, settings)
    ws.drop(features)
    return model


def score_features(features: DataFrame, model: CoTrained, settings: Settings = Settings()) -> DataFrame:
    """A row for each row of features: doc_id, text_score, metadata_score, score, kept."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x, m = _batch_views(b, 1)
            score = model.score(x, m)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.float64()) for v in (model.view(0, x), model.view(1, m), score)), pa.array(score >= settings.threshold)], names=["doc_id", "text_score", "metadata_score", "score", "kept"])

    return features.mapInArrow(run, f"doc_id {features.dtypes[0][1]}, text_score double, metadata_score double, score double, kept boolean")


def score_documents(docs: DataFrame, model: CoTrained, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, text_score, metadata_score, score, kept."""
    return score_features(document_features(docs, doc_id, text, lang, source), model, settings)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Fit on docs and labels; the documents that the model accepts, with all their columns.

    Texts are split once: features are kept beside the rows, the model is fitted on the narrow columns, and the filter reads
    rows and features back.
    """
    import pyarrow as pa

    ws = Workspace(spark, "classifier-filter")
    names = private(docs, "__x", "__size")
    at, own = docs.columns.index(text), docs.columns

    def run(batches):
        forget()
        for b in batches:
            found = [(text_features(r), len(r)) for r in texts(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([k for _, k in found], pa.int64())], names=[*own, *names])

    schema = StructType([*docs.schema.fields, StructField(names[0], ArrayType(DoubleType())), StructField(names[1], LongType())])
    wide = ws.keep(docs.mapInArrow(run, schema), "wide")
    features = wide.select(F.col(doc_id).alias("doc_id"), F.col(names[0]).alias("x"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(names[1]).alias("size"))
    model = train_on(features, labels, settings)

    @F.pandas_udf("double")
    def score(x: pd.Series, lang: pd.Series, source: pd.Series, size: pd.Series) -> pd.Series:
        known = lambda c: [v if isinstance(v, str) else None for v in c]
        return pd.Series(model.score(*_views(list(x), known(lang), known(source), size)))

    return wide.where(score(names[0], F.col(lang).cast("string"), F.col(source).cast("string"), names[1]) >= settings.threshold).select(*docs.columns)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views' and the combined score of every document."""
    features = Workspace(spark, "classifier").keep(document_features(table(spark, sf_dir, "documents")), "features")
    return score_features(features, train_on(features, table(spark, sf_dir, "labels")))
