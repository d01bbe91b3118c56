"""HTML extraction (operator 6): consensus host paths.

Each page's containers are scored by the text that stands in them (links count against it, an ancestor gets a decaying
share, article and main weigh more). A container's path of tags and classes, digits left out, is its generalised path;
every page votes for those that score at least half of its best, votes are added up by host in Spark, and each host's
winning path says which containers of each of its pages are extracted: all that have it and more text than links, in page
order. A page without such a container, or with next to no text in the best of them, falls back to its own best path.

Left out wherever they stand: scripts, styles, forms, menus, headers, footers and sidebars by their tags, adverts and
readers' comments by their class or id. Other such names (html_parse.HARDLY) go unless the page has its title or nearly all
of its text inside; names that may as well be the article's (html_parse.PERHAPS: a search, a paywall, a disclaimer) go only
if the host's pages agree, that is if most pages with that path say the same there. Character references are decoded,
white space inside a block becomes one space, blocks are joined by one space; nothing else is dropped or cut.

Defined cases: null html counts as empty and gives empty text; unclosed and stray tags are read as browsers do, in time
linear in the page's length whatever its markup and depth; a null url belongs to the host ""; repeated rows are rows of
their own; an empty table gives an empty result; further columns are never read. Only pages of at most `broadcast_hosts`
winning hosts get them by broadcast, beyond that by a salted join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_parse import Page, dropped_marks, parse
from .shared import Workspace, table, values
from .url_filter import host_of

#: What an ancestor gets of a container's score: with three sevenths as much text beside it, it is the better one.
DECAY = 0.7
#: A path of PERHAPS is boilerplate if at least so many pages of the host have it, and so many a different text.
REPEATS = 3


def scores(page: Page, dropped: list[bool]) -> list[float]:
    """Of each container: its blocks' text without links, and a decaying share of the text of containers inside."""
    found = [0.0] * len(page.paths)
    for text, linked, c, mark in page.blocks:
        if mark >= 0 and dropped[mark]:
            continue
        worth, n = max(0, len(text) - 2 * linked), c
        while n >= 0 and worth > 0.01:
            found[n] += worth
            worth *= DECAY
            n = page.parents[n]
    return [s * w for s, w in zip(found, page.weights)]


def extract(page: Page, path: int | None, repeated: frozenset = frozenset()) -> str:
    """The text of all containers with that path, in page order; of those with the path of the page's best one if they hold next to nothing."""
    dropped = dropped_marks(page, repeated)
    found = scores(page, dropped)
    if not page.blocks:
        return ""
    rank = sorted(range(len(found)), key=lambda c: (-found[c], c))
    best = next((c for c in rank if page.paths[c] == path and found[c] >= 0.2 * found[rank[0]]), rank[0])
    inside = [False] * len(page.paths)
    for c in range(len(page.paths)):  # parents come first
        inside[c] = c == best or page.paths[c] == page.paths[best] and found[c] > 0 or page.parents[c] >= 0 and inside[page.parents[c]]
    return " ".join(text for text, _, c, mark in page.blocks if inside[c] and not (mark >= 0 and dropped[mark]))


def ballot(page: Page) -> list[tuple[int, str | None, float, int | None]]:
    """A page's rows (path, label, weight, text's digest): its votes, and what stands at the paths of PERHAPS, which have a digest."""
    from xxhash import xxh64, xxh64_intdigest

    found = scores(page, dropped_marks(page))
    top = max(found, default=0)
    each: dict[int, tuple[float, int]] = {}
    for c, (s, p) in enumerate(zip(found, page.paths)):
        if top and s >= 0.5 * top and s / top > each.get(p, (0, 0))[0]:
            each[p] = (s / top, c)
    rows: list = [(p, page.label(c), w, None) for p, (w, c) in each.items()]
    soft = {k: xxh64() for k, kind in enumerate(page.mark_kinds) if kind == 1}
    if soft:
        nearest = [k if kind == 1 else (-1 if page.mark_parents[k] < 0 else None) for k, kind in enumerate(page.mark_kinds)]
        for k, n in enumerate(nearest):
            if n is None:
                nearest[k] = nearest[page.mark_parents[k]]
        for text, _, _, mark in page.blocks:
            if mark >= 0 and nearest[mark] >= 0:
                soft[nearest[mark]].update(text)
        rows += [(page.mark_paths[k], None, 1.0, xxh64_intdigest(h.digest()) >> 1) for k, h in soft.items()]
    return rows


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, label, weight, digest) of pages(host, html)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            hosts, rows = [], []
            for host, raw in zip(values(b.column(0), 100), values(b.column(1), 100)):
                mine = ballot(parse(raw or ""))
                rows += mine
                hosts += [host] * len(mine)
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds))], names=["host", "path", "label", "weight", "digest"])

    return pages.select("host", "html").mapInArrow(run, "host string, path long, label string, weight double, digest long")


def winners(ballots: DataFrame) -> DataFrame:
    """(host, path, label, repeated): the path with the most votes of each host, ties going to the first in order, and the paths of PERHAPS whose text most pages repeat."""
    sums = ballots.groupBy("host", "path", "digest").agg(F.round(F.sum("weight"), 6).alias("weight"), F.max("label").alias("label"), F.count(F.lit(1)).alias("n"))
    paths = sums.groupBy("host", "path", F.col("digest").isNull().alias("vote")).agg(F.max("weight").alias("weight"), F.max("label").alias("label"), F.sum("n").alias("pages"), F.count(F.lit(1)).alias("texts"))
    same = ~F.col("vote") & (F.col("pages") >= REPEATS) & (F.col("pages") >= REPEATS * F.col("texts"))
    best = F.min(F.when(F.col("vote"), F.struct((-F.col("weight")).alias("w"), "label", "path")))
    won = paths.where("vote OR pages >= %d" % REPEATS).groupBy("host").agg(best.alias("best"), F.sort_array(F.collect_list(F.when(same, F.col("path")))).alias("repeated"))
    return won.select("host", "best.path", "best.label", "repeated")


def extract_pages(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_hosts: int = 100_000) -> DataFrame:
    """A row for each row of pages: page_id, url, path (the last steps of the host's winning one), text."""
    import pyarrow as pa

    ws = Workspace(spark, "html")
    plain = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(F.col(url)).alias("host"))
    won = ws.keep(winners(votes(plain)), "winners").select(F.col("host").alias("won_host"), F.struct("path", "label", "repeated").alias("won"))
    # Counted in hosts and repeated paths.
    told_of = won.agg(F.sum(1 + F.size("won.repeated"))).first()[0] or 0
    if told_of <= broadcast_hosts:
        told = plain.join(F.broadcast(won), F.col("host") == F.col("won_host"), "left")
    else:
        salts = 32
        spread = won.withColumn("won_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = plain.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(salts)).cast("int"))
        told = salted.join(spread, (F.col("host") == F.col("won_host")) & (F.col("salt") == F.col("won_salt")), "left")

    def run(batches):
        for b in batches:
            labels, found = [], []
            for raw, won in zip(values(b.column(2), 100), values(b.column(3), 100)):
                won = won or {"path": None, "label": None, "repeated": None}
                labels.append(won["label"])
                found.append(extract(parse(raw), won["path"], frozenset(won["repeated"] or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(labels, pa.string()), pa.array(found, pa.string())], names=["page_id", "url", "path", "text"])

    kind = plain.dtypes[0][1]
    return told.select("page_id", "url", "html", "won").mapInArrow(run, f"page_id {kind}, url string, path string, text string")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(spark, table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
