"""URL filters (operator 4): allow and block rules, and gradient-boosted trees on lexical features for all other URLs.

Rules are Catalyst expressions. The trees are trained from labelled URLs: a table (url, label), 1 for block, or by
default the URLs that the rules decide. At most `max_labelled` distinct ones are used: the table is counted, a hash
threshold lets some so many through, and only these reach the driver, in however many partitions the table is. Features:
lengths, depth, digit ratio, entropy, counts of parameters and signs, and the share of blocked URLs by the host's last
label, its last two labels and the path's first segment. In training, a row's shares come from the other four fifths of the
rows, so that the trees learn how far such statistics can be trusted instead of the rows' own labels.

Defined cases: a null URL or one without "://" has an empty host and path, fits no rule and is judged by the model on
its (empty) text; repeated rows are rows of their own; with no labelled URLs, or labels of one kind, the model is a
constant and ties go to allow; an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .gbt import Boosted
from .shared import table


@dataclass(frozen=True)
class Rule:
    """For a host with its subdomains, and paths that begin with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))
MAX_LABELLED = 20_000
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "dots", "fragment", "longest_segment", "last_label_rate", "last_two_rate", "first_segment_rate")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    # The only non-ASCII letters that lower() would turn into ASCII ones are kept as they are by translate().
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _affixes(host: str, path: str) -> tuple[str, str, str]:
    """What statistics are kept of: the host's last label, its last two, and the path's first segment."""
    labels = host.rsplit(".", 2)
    return labels[-1], ".".join(labels[-2:]), "/" + path.lstrip("/").partition("/")[0]


@dataclass
class UrlModel:
    """The trees, and the training rows' affix statistics: at most three affixes a training row."""

    trees: Boosted
    rates: dict[str, float]
    prior: float

    def features(self, url: str, host: str, path: str) -> list[float]:
        counts = Counter(url)
        total = len(url) or 1
        entropy = -sum(n / total * math.log2(n / total) for n in counts.values())
        query = url.partition("?")[2].partition("#")[0]
        segments = [x for x in path.split("/") if x]
        return [
            len(url), len(host), len(path), len(segments), sum(map(str.isdigit, url)) / total, entropy, len([x for x in query.split("&") if x]),
            host.count("-"), host.count("."), float("#" in url), max(map(len, segments), default=0), *(self.rates.get(s, self.prior) for s in _affixes(host, path)),
        ]

    def predict(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        """The probability of block for (url, host, path) each."""
        if not rows:
            return np.zeros(0)
        return self.trees.predict(np.array([self.features(*r) for r in rows], float))


#: Rows that an affix needs before its own rate outweighs the prior.
AFFIX_WEIGHT = 20.0
FOLDS = 5


def affix_rates(rows: list[tuple[str, str, str, int]], prior: float) -> dict[str, float]:
    """The smoothed share of blocked rows by affix."""
    seen: Counter = Counter()
    blocked: Counter = Counter()
    for _, host, path, label in rows:
        for s in set(_affixes(host, path)):
            seen[s] += 1
            blocked[s] += label
    return {s: (blocked[s] + AFFIX_WEIGHT * prior) / (n + AFFIX_WEIGHT) for s, n in seen.items()}


def train(rows: list[tuple[str, str, str, int]], seed_trees: Boosted | None = None) -> UrlModel:
    """From (url, host, path, label) rows on the driver."""
    labels = np.array([r[3] for r in rows], float)
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    model = UrlModel(seed_trees or Boosted(), affix_rates(rows, prior), prior)
    x = np.zeros((len(rows), len(FEATURES)))
    for fold in range(FOLDS):
        apart = UrlModel(model.trees, affix_rates([r for n, r in enumerate(rows) if n % FOLDS != fold], prior), prior)
        for n in range(fold, len(rows), FOLDS):
            x[n] = apart.features(*rows[n][:3])
    model.trees.fit(x, labels)
    return model


def bounded_sample(known: DataFrame, most: int) -> DataFrame:
    """At most `most` distinct rows of known(url, label), those below a hash threshold: what any partition gives is a small part of them."""
    draw = F.pmod(F.xxhash64("url"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = known.where(draw < F.lit(min(1.0, most / max(1, known.count()))))
    return few.distinct().orderBy(F.xxhash64("url"), "url", "label").limit(most)


def labelled_by_rules(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(url, label) of those rows of urls(url) that a rule decides."""
    _, verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    return urls.select("url", verdict.alias("verdict")).where("verdict IS NOT NULL").select("url", (F.col("verdict") == "block").cast("int").alias("label"))


def url_filter(spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A row for each row of pages: page_id, host, path, rule, block_probability, verdict."""
    import pyarrow as pa

    plain = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    known = (labelled if labelled is not None else labelled_by_rules(plain, rules)).where("url IS NOT NULL AND label IS NOT NULL")
    sample = bounded_sample(known.select("url", "label"), max_labelled).select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label").collect()
    model = train([(r["url"], r["host"], r["path"], int(r["label"])) for r in sample])

    def run(batches):
        for b in batches:
            rows = [(u or "", h, p) for u, h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(model.predict(rows), pa.float64())], names=["page_id", "host", "path", "block_probability"])

    parts = plain.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parts.mapInArrow(run, f"page_id {plain.schema['page_id'].dataType.simpleString()}, host string, path string, block_probability double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("block_probability") > 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), "block_probability", F.coalesce(verdict, by_model).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter(spark, table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
