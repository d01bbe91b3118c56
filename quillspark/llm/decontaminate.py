"""Benchmark decontamination (operator 3): canonical templates of windows, hash join, slot consistency.

Words become canonical: numbers, names and units turn into typed placeholders, all else into its lower-cased letters. A
window is `window` words in a row. Each is hashed twice: by its plain lower-cased words, whatever they are (verbatim), and,
if at least half of its canonical words are literal, by these (template). Where a document's window begins with a name or
unit, it is also hashed with that word as literal (opening): an item's first word always is, whatever stands before its
copy, be it a heading line, a comma, a quotation or a number. All windows of the benchmark's items and
of every document are hashed; a Bloom filter of the items' hashes, sized by their number, spares the documents' other
windows, and what passes is hash-joined with the items' windows in Spark, so false positives of the filter cost time but
change nothing.
Matches of a document and an item on one diagonal (document position minus item position) are one occurrence. There, each
word under a placeholder of the item must stand for one word of the document, kind by kind: a question with other numbers,
names or units is caught, also if two of them become equal, unrelated text that happens to share a pattern isn't. A pair
counts when consistent occurrences hold at least `min_cover` of the item's windows, or of those that have a template, or
`min_run` windows in a row.

A name is a capitalised (not all-capital) word that doesn't begin a sentence; a number is digits with signs, or a number
word; a unit is a word of measure with its multiples and plural, short signs (km, h, t) only right behind a number. Items
with fewer words than a window give one window of all their words; those under `min_words` are too common to be told from
ordinary text inside of one, so they match only a document that has no other words.

A window that more than `most_items` different items share (an instruction before each question) doesn't tell which item a
document has. It doesn't count, neither as found nor as one to be found, unless the item has no other.

Defined cases: a null text counts as empty; documents are told apart by doc_id and text, so the filter removes a row for
its own text only, whatever its id, null or not; the report has a row for each doc_id and item_id, the best of any text;
items are told apart by text, each of its ids is reported, null ids included; an empty documents or benchmark table gives
an empty result; further columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, identity, private, table, values
from .tokens import Growing, Places, of_worker, ragged

#: Units of measure that take multiples.
BASES = "meter metre gram gramme liter litre second watt volt ampere joule newton pascal hertz byte bit calorie".split()
MULTIPLES = ("", "kilo", "centi", "milli", "mega", "giga", "tera", "micro", "nano", "deci")
#: Other units, and signs that count behind a number only.
OTHERS = "inch inche foot feet yard mile pound ounce gallon quart pint acre hectare ton tonne minute hour day week month year decade century centurie dollar euro cent degree percent".split()
SIGNS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs k c f % usd eur gbp mph kmh hz khz mhz ghz w kw mw v a j kj kb mb gb tb kcal".split())
UNITS = frozenset(m + b + s for m in MULTIPLES for b in BASES for s in ("", "s")) | frozenset(b + s for b in OTHERS for s in ("", "s"))
#: Number words.
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = frozenset([*ONES, *TENS, *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion".split(), *(f"{t}-{o}" for t in TENS for o in ONES)])
LITERAL, NUMBER, UNIT, NAME, SIGN = 0, 1, 2, 3, 4
WORD = re.compile(rf"[+-]?\d+(?:[.,]\d+)*|\b(?i:(?:{'|'.join(TENS)})-(?:{'|'.join(ONES)}))\b|[^\W\d_]+(?:['’][^\W\d_]+)*|%")
ENDS = re.compile(r"[.!?:][\"'”’)\]]*$")
#: Words of the Bloom filter, 64 bits each, of which a hash has a quarter: 2 MB at least and 128 MB at most.
LEAST_BLOOM, MOST_BLOOM = 1 << 18, 1 << 24
#: Words of it that come to the driver as one row.
BLOOM_BLOCK = 1 << 12
MIX = 0x9E3779B97F4A7C15
#: Forms of a window.
TEMPLATE, VERBATIM, OPENING = 0, 1, 2
#: Openings meet templates.
SEEDS = (0x51, 0x6D, 0x51)


@dataclass(frozen=True)
class Settings:
    """Window and thresholds."""

    window: int = 8
    min_words: int = 5
    min_cover: float = 0.3
    #: Six windows of eight words are 13 words in a row.
    min_run: int = 6
    #: Windows that more different items share count only where an item has no other.
    most_items: int = 16


def _hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode(), 0)


class Canonical:
    """Turns texts into arrays of canonical words; keeps what it found for some max_chunks distinct chunks and starts anew beyond."""

    def __init__(self, max_chunks: int = 300_000):
        self.max_chunks = max_chunks
        self.marks = np.array([0, *(_hash(f"<{k}>") for k in ("number", "unit", "name"))], np.uint64)
        self._clear()

    @classmethod
    def of_worker(cls) -> "Canonical":
        """The Python worker's own."""
        return of_worker(("canonical",), cls)

    def _clear(self) -> None:
        self.places, self.chunks = Places(), []
        # Of chunks: the first of their words and how many. Of words: hash, kind, whether capitalised or ending a sentence.
        self.first, self.count = Growing(np.int64), Growing(np.int64)
        self.hashes, self.kinds, self.capital, self.ends = Growing(np.uint64), Growing(np.int8), Growing(bool), Growing(bool)

    def _learn(self) -> None:
        fresh, self.places.fresh = self.places.fresh, []
        if not fresh:
            return
        counts, rows = [], []
        for chunk in fresh:
            found = WORD.findall(chunk)
            counts.append(len(found))
            last = len(found) - 1 if ENDS.search(chunk) else -1
            for n, w in enumerate(found):
                low = w.lower()
                kind = NUMBER if w[-1].isdigit() or low in NUMBERS else SIGN if low in SIGNS else UNIT if low in UNITS else LITERAL
                rows.append((_hash(low), kind, w[0].isupper() and not (len(w) > 1 and w.isupper()), n == last))
        n = np.array(counts, np.int64)
        self.first.add(len(self.hashes) + np.cumsum(n) - n)
        self.count.add(n)
        self.chunks += fresh
        for table, column in zip((self.hashes, self.kinds, self.capital, self.ends), zip(*rows)):
            table.add(column)

    def encode(self, texts: list[str]):
        """For all texts in a row: where each begins, canonical and plain hashes, kinds, and for word_of() the words' chunks and places there."""
        if len(self.places) > self.max_chunks:
            self._clear()
        place = self.places.__getitem__
        split = [t.replace("\n", " ").split(" ") for t in texts]
        at = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(place, c), np.int64, len(c)) for c in split)])
        self._learn()
        n = self.count.values[at]
        word = ragged(self.first.values[at], n)
        totals = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum([len(c) for c in split])]).astype(np.int64)]
        starts = totals[:-1][totals[:-1] < len(word)]
        begins = np.zeros(len(word), bool)  # the first word of a text or sentence
        begins[1:] = self.ends.values[word[:-1]]
        begins[starts] = True
        kind = self.kinds.values[word]
        behind = np.zeros(len(word), bool)  # right behind a number
        behind[1:] = kind[:-1] == NUMBER
        behind[starts] = False
        kind = np.where(kind == SIGN, np.where(behind, np.int8(UNIT), np.int8(LITERAL)), kind)
        kind[(kind == LITERAL) & self.capital.values[word] & ~begins] = NAME
        plain = self.hashes.values[word]
        canonical = np.where(kind == LITERAL, plain, self.marks[kind])
        return totals, canonical, plain, kind, word

    def word_of(self, row: int) -> str:
        """The word in a row of the words' tables."""
        chunk = int(np.searchsorted(self.first.values, row, side="right")) - 1
        while not self.count.values[chunk]:  # chunks without a word begin where the one before them does
            chunk -= 1
        return WORD.findall(self.chunks[chunk])[row - int(self.first.values[chunk])]


def window_hashes(words: np.ndarray, sizes: tuple[int, ...], seed: int, at: np.ndarray | None = None, first: np.ndarray | None = None):
    """Of each size in ascending order, a hash for each window of so many words; or only for those that begin at (ascending) at, with first instead of their first words."""
    h = np.full(len(words) if at is None else len(at), seed, np.uint64)
    for k in range(min(max(sizes, default=0), len(words))):
        column = words[k:] if at is None else words[at[: np.searchsorted(at, len(words) - k)] + k] if k else first
        h = h[: len(column)] * np.uint64(MIX) + column
        h ^= h >> np.uint64(29)
        if k + 1 in sizes:
            yield k + 1, h


def _bits(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of a hash in a Bloom filter of so many words: word, and a mask of two bits."""
    word = (h >> np.uint64(20)) & np.uint64(words - 1)
    one = np.uint64(1)
    return word, (one << (h & np.uint64(63))) | (one << ((h >> np.uint64(6)) & np.uint64(63)))


def _windows(coder: Canonical, texts: list[str], sizes: tuple[int, ...], openings: bool, whole_below: int, passes=None):
    """(text's place, form, hash, pos, size, slots, templated) of the windows whose hash passes; below a size only of whole texts."""
    totals, canonical, plain, kind, word = coder.encode(texts)
    lengths = np.diff(totals)
    row = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(row)) - totals[row]
    left = lengths[row] - pos
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    for form, words in ((TEMPLATE, canonical), (VERBATIM, plain), *([(OPENING, canonical)] if openings else [])):
        begin = np.flatnonzero((kind == NAME) | (kind == UNIT)) if form == OPENING else None
        for size, h in window_hashes(words, sizes, SEEDS[form], begin, None if begin is None else plain[begin]):
            at = slice(len(h)) if begin is None else begin[: len(h)]
            good = left[at] >= size
            if size < whole_below:
                good &= lengths[row[at]] == size
            templated = 2 * (literal[size:][at] - literal[at] + (form == OPENING)) >= size
            if form != VERBATIM:
                good &= templated
            if passes is not None:
                good &= passes(h)
            for k in np.flatnonzero(good):
                w = int(k if begin is None else begin[k])
                yield int(row[w]), form, int(h[k].view(np.int64)), int(pos[w]), size, [] if form == VERBATIM else _slots(coder, kind, word, w, size, form == OPENING), bool(templated[k])


def _slots(coder: Canonical, kind: np.ndarray, word: np.ndarray, at: int, size: int, opening: bool) -> list[str]:
    """The words under a template's placeholders: place, kind and lower-cased word. An opening's first word has none."""
    return [f"{k}:{kind[at + k]}:{coder.word_of(int(word[at + k])).lower()}" for k in range(int(opening), size) if kind[at + k] != LITERAL]


SCHEMA = "form int, hash long, pos int, size int, slots array<string>, templated boolean"


def _found(rows: list[tuple], ids: dict):
    """An Arrow batch of rows (place in the columns ids, form, hash, pos, size, slots, templated)."""
    import pyarrow as pa

    c = list(zip(*rows)) or [()] * 7
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_())
    return pa.RecordBatch.from_arrays([*(i.take(pa.array(c[0], pa.int64())) for i in ids.values()), *map(pa.array, c[1:], kinds)], names=[*ids, "form", "hash", "pos", "size", "slots", "templated"])


def item_windows(benchmark: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    """(item, form, hash, pos, size, slots, templated) of all windows of the different items; item is a hash of the text."""
    sizes = tuple(range(1, settings.window + 1))

    def run(batches):
        coder = Canonical.of_worker()
        for b in batches:
            out = list(_windows(coder, [t or "" for t in b.column(1).to_pylist()], sizes, False, settings.window))
            yield _found(out, {"item": b.column(0)})

    rows = benchmark.select(F.xxhash64(text).alias("item"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(run, f"item long, {SCHEMA}")


def telling(windows: DataFrame, most_items: int) -> DataFrame:
    """windows without those that more than most_items items share, but for items that have no other."""
    shared = windows.groupBy("form", "hash").agg(F.count_distinct("item").alias("items")).where(F.col("items") > most_items).select("form", "hash", F.lit(True).alias("shared"))
    marked = windows.join(shared, ["form", "hash"], "left").withColumn("own", F.col("shared").isNull())
    # A verbatim window tells nothing either where its template doesn't: both forms of a place go together.
    places = marked.groupBy("item", "pos", "size").agg(F.bool_and("own").alias("own_place"))
    items = places.groupBy("item").agg(F.bool_or("own_place").alias("has_own"))
    kept = places.join(items, "item").where("own_place OR NOT has_own").select("item", "pos", "size")
    return windows.join(kept, ["item", "pos", "size"]).select(*windows.columns)


def bloom(windows: DataFrame) -> np.ndarray:
    """The filter of all hashes: it comes to the driver in blocks, MOST_BLOOM words at most."""
    import pyarrow as pa

    words = LEAST_BLOOM
    total = windows.count()
    while words < MOST_BLOOM and 4 * words < total:
        words *= 2

    def fold(rows):
        word, bits = _bits(rows.column("hash").to_numpy().view(np.uint64), words)
        block = np.zeros(BLOOM_BLOCK, np.uint64)
        np.bitwise_or.at(block, (word % np.uint64(BLOOM_BLOCK)).astype(np.int64), bits)
        return pa.table({"block": rows.column("block").slice(0, 1), "bits": pa.array([block.tobytes()], pa.binary())})

    block = F.shiftrightunsigned(F.shiftrightunsigned("hash", 20).bitwiseAND(F.lit(words - 1)), 12)
    out = np.zeros(words, np.uint64)
    for r in windows.select(block.alias("block"), "hash").distinct().groupBy("block").applyInArrow(fold, "block long, bits binary").collect():
        out[r["block"] * BLOOM_BLOCK : (r["block"] + 1) * BLOOM_BLOCK] = np.frombuffer(r["bits"], np.uint64)
    return out


def document_windows(docs: DataFrame, mask: np.ndarray, sizes: tuple[int, ...], min_words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, id_a, id_b, form, hash, pos, size, slots, templated) of the documents' windows that pass the filter."""
    held = docs.sparkSession.sparkContext.broadcast(mask)  # at most MOST_BLOOM words

    def blocks(column):
        part, at, chars = [], 0, 0
        for t in values(column):
            part.append(t or "")
            chars += len(part[-1])
            if chars >= 1_000_000:
                yield at, part
                part, at, chars = [], at + len(part), 0
        if part:
            yield at, part

    def run(batches):
        coder, bits = Canonical.of_worker(), held.value

        def passes(h):
            place, want = _bits(h, len(bits))
            return bits[place] & want == want

        for b in batches:
            out = []
            for first, part in blocks(b.column(3)):
                out += [(first + r[0], *r[1:]) for r in _windows(coder, part, sizes, True, min_words, passes)]
            yield _found(out, dict(zip(("doc_id", "id_a", "id_b"), b.columns)))

    kind = docs.schema[doc_id].dataType.simpleString()
    a, b = identity(doc_id, text)
    return docs.select(F.col(doc_id).alias("doc_id"), a.alias("id_a"), b.alias("id_b"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, id_a long, id_b long, {SCHEMA}")


def _caught(ws: Workspace, docs: DataFrame, benchmark: DataFrame, settings: Settings, doc_id: str, text: str, item_text: str) -> DataFrame:
    """(doc_id, id_a, id_b, item, ...) of the documents and items found."""
    items = ws.keep(telling(ws.keep(item_windows(benchmark, settings, item_text), "all-items"), settings.most_items), "items")
    mask = bloom(items)
    sizes = tuple(sorted(r["size"] for r in items.select("size").distinct().collect()))
    found = ws.keep(document_windows(docs, mask, sizes, settings.min_words, doc_id, text), "windows")
    item = items.select(F.col("form").alias("meets"), "hash", F.col("size").alias("item_size"), "item", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "templated")
    met = F.when(F.col("form") == OPENING, TEMPLATE).otherwise(F.col("form"))
    met = ws.keep(found.drop("templated").withColumn("meets", met).join(item, ["meets", "hash"]).where("size = item_size AND size(slots) = size(item_slots)").drop("meets", "hash", "item_size"), "met")
    # A slot as (kind, item's word, document's word); both arrays have the same places and kinds, as the hashes agree.
    cut = lambda s, n: F.split(s, ":", 3)[n]
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(cut(z["item_slots"], 1).alias("kind"), cut(z["item_slots"], 2).alias("a"), cut(z["slots"], 2).alias("b")))
    # On one diagonal there are at most as many matches of a form as the item has windows. Verbatim ones have no slots, so what they add never makes a diagonal inconsistent.
    # What openings add counts where it agrees with the rest of the diagonal, and else leaves the rest as it is.
    opening, place, every = F.col("form") == OPENING, F.struct("item_pos", "templated"), lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    pair = ["doc_id", "id_a", "id_b", "item"]
    diagonal = met.groupBy(*pair, (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set(F.when(~opening, place)).alias("places"), every(F.when(~opening, pairs)).alias("map"), F.min(F.when(~opening, F.col("pos"))).alias("first_word"),
        F.collect_set(place).alias("all_places"), every(pairs).alias("all_map"), F.min("pos").alias("all_first_word"),
    )
    # Each word of the item stands for one word of the document; two may stand for the same.
    steady_map = lambda m: F.size(F.array_distinct(F.transform(m, lambda p: F.struct(p["kind"], p["a"])))) == F.size(m)
    used = [F.when(steady_map("all_map"), F.col(f"all_{c}")).otherwise(F.col(c)).alias(c) for c in ("places", "map", "first_word")]
    same = F.forall("map", lambda p: p["a"] == p["b"])
    steady = diagonal.select(*pair, "shift", *used).where(steady_map("map")).withColumn("same", same).withColumn("run", F.size("places"))
    # Only the item's own places are gathered: at most its windows, however often a document repeats it.
    counted = steady.select(*pair, "shift", "first_word", "same", "run", F.explode("places").alias("at"))
    by_place = counted.groupBy(*pair, "at.item_pos").agg(F.bool_or("at.templated").alias("templated"), F.min("first_word").alias("first_word"), F.count_distinct("shift").alias("n"), F.max("run").alias("run"), F.bool_and("same").alias("same"))
    # What has a template is counted apart too: in a copy with other numbers only templates can be met.
    by_item = by_place.groupBy(*pair).agg(F.count(F.lit(1)).alias("windows"), F.count_if("templated").alias("templates"), F.min("first_word").cast("long").alias("first_word"), F.max("n").alias("occurrences"), F.max("run").alias("run"), F.bool_and("same").alias("verbatim"))
    whole = items.groupBy(F.col("item").alias("whole_item")).agg(F.count_if(F.col("form") == VERBATIM).alias("of"), F.count_if(F.col("form") == TEMPLATE).alias("of_templates"))
    cover = F.greatest(F.col("windows") / F.col("of"), F.when(F.col("of_templates") > 0, F.col("templates") / F.col("of_templates")))
    told = by_item.join(whole, F.col("item") == F.col("whole_item")).withColumn("cover", cover)
    return told.where((F.col("cover") >= settings.min_cover) | (F.col("run") >= settings.min_run))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, first_word, occurrences, windows, cover, verbatim (no slot differs)."""
    caught = _caught(Workspace(spark, "decontaminate"), docs, benchmark, settings, doc_id, text, item_text)
    ids = benchmark.select(F.xxhash64(item_text).alias("of_item"), F.col(item_id).alias("item_id")).distinct()
    best = F.max(F.struct("cover", "windows", (-F.col("first_word")).alias("before"), "occurrences", "verbatim")).alias("best")
    named = caught.join(ids, F.col("item") == F.col("of_item")).groupBy("doc_id", "item_id").agg(best)
    return named.select("doc_id", "item_id", (-F.col("best.before")).alias("first_word"), "best.occurrences", "best.windows", "best.cover", "best.verbatim")


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", broadcast_docs: int = 1_000_000) -> DataFrame:
    """The documents without any benchmark item, with all their columns. Up to broadcast_docs found rows are broadcast, more are joined by a shuffle."""
    ws = Workspace(spark, "decontaminate-filter")
    a, b = private(docs, "__id_a", "__id_b")
    found = ws.keep(_caught(ws, docs, benchmark, settings, doc_id, text, "text").select(F.col("id_a").alias(f"{a}_"), F.col("id_b").alias(f"{b}_")).distinct(), "found")
    few = found.limit(broadcast_docs + 1).count() <= broadcast_docs
    named = docs.withColumns(dict(zip((a, b), identity(doc_id, text))))
    clean = named.join(F.broadcast(found) if few else found, (F.col(a) == F.col(f"{a}_")) & (F.col(b) == F.col(f"{b}_")), "left_anti")
    return clean.select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, and which."""
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
