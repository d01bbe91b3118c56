"""Quality rules (operator 1): rule failures by host, shrunk with an empirical beta prior, joined back to documents.

Counts come from one Arrow pass over whole texts. Hosts are pre-aggregated to (documents, failures), the beta prior is
fitted to their failure rates by moments, less the spread that sampling alone gives hosts of one common rate, and each host
gets the posterior mean of its rate. A document is kept if it breaks no rule and its host isn't blocked.

Defined cases: a null text counts as empty (no words, so it fails the base rule); a null source is a host of its own; a
null or repeated doc_id is judged row by row; an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, long_column, private, table, texts
from .tokens import forget

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Texts of more words than this are windowed in NumPy, which takes 40 bytes a word and no Python object.
LONG_TEXT = 50_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rules:
    """Limits; ratios are integers per hundred so that every engine decides alike."""

    min_words: int = 10
    max_repeat_pct: int = 20
    max_symbols_pct: int = 20
    max_dup_lines_pct: int = 60
    max_word_chars: int = 15
    #: A host is blocked when its shrunk failure rate is above this.
    max_host_rate: float = 0.8
    #: Bound of the prior's weight, in documents; the moments give no finite weight when all hosts fail alike.
    max_prior: float = 1000.0
    #: Up to so many blocked hosts are broadcast; beyond, they are joined by a shuffle with the documents salted.
    broadcast_hosts: int = 100_000


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) > LONG_TEXT:
        return _repeated_long(words)
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    once: set = set()
    twice = {w for w in windows if w in once or once.add(w)}
    if not twice:
        return 0
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + WINDOW - max(i, covered)
            covered = i + WINDOW
    return total


def _repeated_long(words: list[bytes]) -> int:
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, WINDOW))
    order = np.lexsort(rows.T)
    same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    hit = np.zeros(len(rows), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:-WINDOW][hit] += 1
    edge[WINDOW:][hit] -= 1
    return int((np.cumsum(edge) > 0).sum())


def count_text(raw: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8. bytes.split() cuts at exactly the six ASCII white-space characters."""
    words = raw.split()
    word_bytes = sum(map(len, words))
    characters = len(raw) if raw.isascii() else len(raw.decode())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        characters - (len(raw) - word_bytes),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def with_counts(docs: DataFrame, text: str, names: list[str], keep: list[str]) -> DataFrame:
    """The columns in keep, and the counts under the given names."""
    import pyarrow as pa

    needed = list(dict.fromkeys([*keep, text]))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` long" for n in names])

    def run(batches):
        forget()
        for b in batches:
            rows = [count_text(x) for x in texts(b.column(needed.index(text)))]
            counts = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(needed.index(c)) for c in keep] + [long_column(x) for x in counts], names=[*keep, *names])

    return docs.select(*needed).mapInArrow(run, schema)


def base_failed(c: dict[str, Column], rules: Rules) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_pct * c["n_words"])


def rule_failed(c: dict[str, Column], rules: Rules) -> Column:
    """Any rule of a document by itself."""
    return (
        base_failed(c, rules)
        | (100 * c["n_symbols"] > rules.max_symbols_pct * c["n_words"])
        | (100 * c["n_dup_lines"] > rules.max_dup_lines_pct * c["n_lines"])
        | (c["word_chars"] > rules.max_word_chars * c["n_words"])
    )


def prior_of(total: int, fails: int, squares: float, rules: Rules, hosts: int = 1) -> tuple[float, float]:
    """Mean and weight of the beta prior from the sums over hosts of n, fails and fails^2 / n, and the number of hosts.

    The mean is the failure rate of all documents; the weight follows from the spread of the hosts' rates, each host
    weighing as many as its documents. Of that spread m(1 - m)(hosts - 1) / total is what binomial draws of one rate have.
    """
    if not total:
        return 0.0, rules.max_prior
    mean = fails / total
    spread = (squares - mean * fails - mean * (1 - mean) * (hosts - 1)) / total
    return mean, min(rules.max_prior, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else rules.max_prior


def host_rates(ws: Workspace, failures: DataFrame, rules: Rules) -> DataFrame:
    """From rows (host, failed): a row a host with n, fails, its shrunk rate and whether it is blocked. The driver gets four sums."""
    hosts = ws.keep(failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("fails")), "hosts")
    sums = hosts.agg(F.sum("n"), F.sum("fails"), F.sum(F.col("fails") * (F.col("fails") / F.col("n"))), F.count(F.lit(1))).first()
    mean, weight = prior_of(sums[0] or 0, sums[1] or 0, sums[2] or 0.0, rules, sums[3])
    shrunk = (F.col("fails") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("rate", shrunk).withColumn("blocked", F.col("rate") > rules.max_host_rate)


def join_blocked(df: DataFrame, host: str, hosts: DataFrame, flag: str, rules: Rules) -> DataFrame:
    """df with a boolean column flag: whether its host is blocked."""
    key, hit, salt, copy = private(df, "__host", "__blocked", "__salt", "__copy")
    blocked = hosts.where("blocked").select(F.col("host").alias(key), F.lit(True).alias(hit))
    few = blocked.limit(rules.broadcast_hosts + 1).count() <= rules.broadcast_hosts
    if few:
        joined = df.join(F.broadcast(blocked), df[host].eqNullSafe(F.col(key)), "left")
    else:
        salts = 32
        salted = df.withColumn(salt, F.pmod(F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind)), F.lit(salts)))
        spread = blocked.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        joined = salted.join(spread, salted[host].eqNullSafe(F.col(key)) & (F.col(salt) == F.col(copy)), "left")
    return joined.select(*df.columns, F.coalesce(F.col(hit), F.lit(False)).alias(flag))


def quality_rules(spark: SparkSession, docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed, kept, host_blocked."""
    ws = Workspace(spark, "quality-rules")
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("host"), F.col(text).alias("text"))
    counts = ws.keep(with_counts(plain, "text", list(COUNTS), ["doc_id", "host"]), "counts")
    c = {n: F.col(n) for n in COUNTS}
    hosts = host_rates(ws, counts.select("host", rule_failed(c, rules).alias("failed")), rules)
    out = join_blocked(counts, "host", hosts, "host_blocked", rules)
    return out.select("doc_id", *COUNTS[:-1], base_failed(c, rules).alias("base_failed"), (~rule_failed(c, rules) & ~F.col("host_blocked")).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, rules: Rules = Rules(), text: str = "text", source: str = "source") -> DataFrame:
    """Only the documents that quality_rules keeps, with all their columns.

    Texts are split once and not shuffled: the counts are kept beside the rows, from where the hosts' rates are taken and
    then the rows.
    """
    ws = Workspace(spark, "quality-filter")
    names = private(docs, *(f"__{n}" for n in COUNTS))
    c = {n: F.col(p) for n, p in zip(COUNTS, names)}
    wide = ws.keep(with_counts(docs, text, names, docs.columns), "counts")
    hosts = host_rates(ws, wide.select(F.col(source).alias("host"), rule_failed(c, rules).alias("failed")), rules)
    judged = wide.where(~rule_failed(c, rules)).select(*docs.columns)
    (flag,) = private(docs, "__flag")
    return join_blocked(judged, source, hosts, flag, rules).where(~F.col(flag)).select(*docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules(spark, table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT x) AS n_unique FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM words)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT a.doc_id, a.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines - n_unique, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM words a LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 60 * n_lines OR word_chars > 15 * n_words AS failed
  FROM counts
), hosts AS (
  SELECT source, count(*) AS n, sum(failed::INT) AS fails FROM judged GROUP BY source
), moments AS (
  SELECT sum(fails)::DOUBLE / sum(n) AS m, (sum(fails * (fails::DOUBLE / n)) - sum(fails)::DOUBLE / sum(n) * sum(fails) - sum(fails)::DOUBLE / sum(n) * (1 - sum(fails)::DOUBLE / sum(n)) * (count(*) - 1)) / sum(n) AS v FROM hosts
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM moments
), blocked AS (
  SELECT source FROM hosts, prior WHERE (fails + m * k) / (n + k) > 0.8
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT failed AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.source IS NOT DISTINCT FROM j.source) AS kept
FROM judged j
"""
