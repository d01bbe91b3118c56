"""SimHash near-dedup (operator 5): fingerprints, meet-in-the-middle ball hashing, components.

A fingerprint has 64 bits and links to others at r = 3 or fewer differing bits. Each fingerprint emits all its variants
within half the radius: those within one bit (near, 65 of them), and if it has an odd number of set bits also those within
two (2,016 more). Of two fingerprints at three bits one has an odd number, so every linked pair meets on some variant. A
variant's bucket of which one member is near links for certain (1 + 2 <= 3), so a star from the least near member stands
for all its pairs; every link is still verified over all 64 bits. A bucket has at most 2,081 members, as no more
fingerprints are within two bits of anything, so there are no hot buckets, however many near copies the corpus has.

On average that is 1,073 variants a fingerprint, nearly all of which nothing else meets. So variants are shuffled in two
steps: first 32-bit digests of them, sorted and delta-coded in blocks, from chunks of fingerprints to buckets of digests
(some two bytes a variant); a bucket tells each chunk which of its digests were seen twice; the chunk then emits only those
variants whole. Digests that agree by chance cost rows but change nothing.

Exact copies have one fingerprint and count as one vertex. Defined cases: a null or empty text has fingerprint zero; rows
with the same doc_id are rows of their own; null doc_ids take part but never name a component (null if it has no other);
an empty table gives an empty result; further columns are never read.

keep_distinct() is for near copies in the usual sense, a similarity of 0.8 or more of five-word shingles. Three bits are
little for fingerprints of shingles, of which a changed word changes several; there fingerprints are of distinct words, six
a text by different hashes, linked at two bits (a ball of 65 variants each), and what they link is verified by the shingles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace, identity, long_column, private, table, texts
from .tokens import forget

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Shingles whose bits are counted at a time, which bounds the memory of a very long text.
BLOCK = 65_536
#: Fingerprints a chunk: at least, and at most (more than the least only where there are very many buckets).
CHUNK, MOST_CHUNK = 1024, 65_536
#: Digests a bucket, on average: what one task sorts at a time.
BUCKET_DIGESTS = 4_000_000
#: Variants of a fingerprint on average: 65, and 2,016 of every second one.
VARIANTS = 1073
#: Near copies: words of a shingle, and the least similarity (shared shingles of all that either text has).
COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
#: Word fingerprints of a text, and the bits at which they link: any two within two bits meet among their variants of one bit.
WORD_HASHES, WORD_RADIUS = 6, 2


def fingerprint(raw: bytes) -> int:
    """Of one text in UTF-8, unsigned. bytes.lower() and bytes.split() touch ASCII only, as the definition asks."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    total = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        hashes = np.array([xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(SHINGLE)))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, id_a, id_b, fp): the row's identity, and the fingerprint as a signed 64-bit integer."""
    import pyarrow as pa

    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        forget()
        for b in batches:
            fps = np.array([fingerprint(x) for x in texts(b.column(3))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], long_column(fps)], names=["doc_id", "id_a", "id_b", "fp"])

    a, b = identity(doc_id, text)
    plain = docs.select(F.col(doc_id).alias("doc_id"), a.alias("id_a"), b.alias("id_b"), F.col(text).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, id_a long, id_b long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """What the variants within one bit differ in, and those at two bits."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate([np.zeros(1, np.uint64), bits]), bits[i] | bits[j]


class Ball:
    """All variants of some fingerprints: keys, and of each place among them the fingerprint and whether it is near."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS):
        near, far = _masks()
        self.fps, self.odd = fps, fps[np.bitwise_count(fps) % 2 == 1] if radius == RADIUS else fps[:0]
        self.near, self.far = len(fps) * len(near), len(far)
        self.keys = np.concatenate([(fps[:, None] ^ near).ravel(), (self.odd[:, None] ^ far).ravel()])
        self.per = len(near)

    def owners(self, at: np.ndarray) -> np.ndarray:
        """The fingerprints of the variants at places at."""
        close = at < self.near
        out = np.empty(len(at), np.uint64)
        out[close] = self.fps[at[close] // self.per]
        out[~close] = self.odd[(at[~close] - self.near) // self.far]
        return out

    def codes(self, buckets: int) -> np.ndarray:
        """Of each variant: its bucket, and below it a digest of 32 bits."""
        h = self.keys * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = h & np.uint64(0xFFFFFFFF)
        h >>= np.uint64(32)
        h %= np.uint64(buckets)
        h <<= np.uint64(32)
        h |= low
        return h


def _coded(digests: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, byte plane by byte plane, which Spark's shuffle compresses."""
    return np.diff(digests, prepend=np.zeros(1, np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _decoded(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _told(chunks: DataFrame, buckets: int, radius: int) -> DataFrame:
    """(bucket, chunk, digests) of all variants."""
    import pyarrow as pa

    def run(batches):
        forget()
        for b in batches:
            for chunk, fps in zip(b.column(0).to_pylist(), b.column(1)):
                codes = Ball(fps.values.to_numpy(zero_copy_only=False).view(np.uint64), radius).codes(buckets)
                codes.sort()
                bucket = codes >> np.uint64(32)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1]) if len(codes) else np.zeros(0, np.int64)
                digests = codes.astype(np.uint32)
                parts = [_coded(x) for x in np.split(digests, starts[1:])] if len(codes) else []
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array(np.full(len(parts), chunk, np.int64)), pa.array(parts, pa.binary())], names=["bucket", "chunk", "digests"])

    return chunks.mapInArrow(run, "bucket long, chunk long, digests binary")


def _seen_twice(blocks):
    """Of one bucket's blocks: for each, its digests that are found twice or more in the bucket."""
    import pyarrow as pa

    lists = [_decoded(x.as_buffer()) for x in blocks.column("digests")]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    if len(twice):
        for n, digests in enumerate(lists):
            hits = digests[twice[np.minimum(np.searchsorted(twice, digests), len(twice) - 1)] == digests]
            if len(hits):
                rows.append((n, _coded(hits)))
    which = pa.array([n for n, _ in rows], pa.int64())
    return pa.table({"bucket": blocks.column("bucket").take(which), "chunk": blocks.column("chunk").take(which), "digests": pa.array([x for _, x in rows], pa.binary())})


def _whole(chunks: DataFrame, buckets: int, radius: int) -> DataFrame:
    """(key, fp, near): the variants of chunks(chunk, fps, hits) whose digests are among the hits."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for fps, hits in zip(b.column(1), b.column(2).to_pylist()):
                ball = Ball(fps.values.to_numpy(zero_copy_only=False).view(np.uint64), radius)
                wanted = np.sort(np.concatenate([_decoded(h["digests"]).astype(np.uint64) | np.uint64(h["bucket"] << 32) for h in hits]))
                codes = ball.codes(buckets)
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)] == codes)
                for k in range(0, len(at), 100_000):
                    part = at[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([long_column(ball.keys[part].view(np.int64)), long_column(ball.owners(part).view(np.int64)), pa.array(part < ball.near)], names=["key", "fp", "near"])

    return chunks.mapInArrow(run, "key long, fp long, near boolean")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(ws: Workspace, fps: DataFrame, bucket_digests: int = BUCKET_DIGESTS, chunk: int = CHUNK, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fps(fp) whose components are those of all pairs within radius bits, RADIUS or WORD_RADIUS."""
    total, variants_each = fps.count(), VARIANTS if radius == RADIUS else 65
    buckets = max(1, -(-total * variants_each // bucket_digests))
    # Some hundred digests a block, where memory allows.
    size = min(max(chunk, 100 * buckets // variants_each), MOST_CHUNK)
    n = max(1, -(-total // size))
    tasks = min(n, max(3 * ws.spark.sparkContext.defaultParallelism, -(-n // 16)))
    grouped = fps.groupBy(F.pmod(F.xxhash64("fp"), F.lit(n)).alias("chunk")).agg(F.collect_list("fp").alias("fps"))
    chunks = ws.keep(grouped, "chunks")
    told = _told(chunks.repartition(tasks, "chunk"), buckets, radius).repartition(min(buckets, 20_000), "bucket")
    twice = told.groupBy("bucket").applyInArrow(_seen_twice, "bucket long, chunk long, digests binary")
    hits = ws.keep(twice.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "digests")).alias("hits")), "hits")
    variants = ws.keep(_whole(chunks.join(hits, "chunk").repartition(tasks, "chunk"), buckets, radius), "variants")
    centres = variants.groupBy("key").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("u"), F.count(F.lit(1)).alias("n")).where("u IS NOT NULL AND n >= 2")
    stars = variants.select("key", F.col("fp").alias("v")).join(ws.keep(centres.select("key", "u"), "centres"), "key").where("u <> v")
    return stars.where(_distance(F.col("u"), F.col("v")) <= radius).select("u", "v").distinct()


def _components(ws: Workspace, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """fingerprints() of the rows, kept; and (fp, first) with first the row that comes first in the fingerprint's component: the smallest doc_id, nulls last."""
    prints = ws.keep(fingerprints(docs, doc_id, text), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "id_a", "id_b")
    firsts = ws.keep(prints.groupBy("fp").agg(F.min(row).alias("first")), "firsts")
    reached = ws.keep(components(ws, links(ws, firsts.select("fp"))), "reached")
    rooted = ws.keep(firsts.join(reached, firsts["fp"] == reached["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    named = ws.keep(rooted.groupBy("root").agg(F.min("first").alias("least")), "named")
    return prints, ws.keep(rooted.join(named, "root").select("fp", F.col("least").alias("first")), "by-print")


def simhash_components(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, fp (signed), component_id (the smallest doc_id reachable)."""
    prints, by_print = _components(Workspace(spark, "simhash"), docs, doc_id, text)
    return prints.join(by_print, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the smallest doc_id (nulls last), with all its columns.

    Rows are told apart by id and text, so a row that shares its doc_id with another stays or goes by its own text; of rows
    with the same id and text one stays.
    """
    ws = Workspace(spark, "simhash-filter")
    prints, by_print = _components(ws, docs, doc_id, text)
    return _only(docs, prints, ws.keep(by_print.select("first.id_a", "first.id_b").distinct(), "kept"), doc_id, text)


def word_fingerprints(words: list[bytes], count: int) -> list[int]:
    """Of a text's distinct words, signed, by different hashes: a bit is 1 if set in over half of the words' hashes."""
    from xxhash import xxh64_intdigest

    distinct = list(set(words))
    ones = np.zeros((count, 64), np.int64)
    for at in range(0, len(distinct), BLOCK):
        first = np.array([xxh64_intdigest(w, SEED) for w in distinct[at : at + BLOCK]], "<u8")
        for n in range(count):
            hashes = first if n == 0 else _mixed(first + np.uint64(n))
            ones[n] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(distinct), axis=1, bitorder="little").view("<i8").ravel().tolist()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other hashes of what has the hashes h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of a text's distinct shingles; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    found = np.array([xxh64_intdigest(b" ".join(words[k : k + size]), SEED) for k in range(max(1, len(words) - size + 1))], np.uint64)
    return np.unique(found).view(np.int64)


def _word_prints(docs: DataFrame, doc_id: str, text: str, count: int) -> DataFrame:
    """(doc_id, id_a, id_b, body, fps): the row's identity, a hash of its lower-cased words, and its word fingerprints."""
    import pyarrow as pa

    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        forget()
        for b in batches:
            bodies, fps = [], []
            for raw in texts(b.column(3)):
                words = raw.lower().split()
                bodies.append(fingerprint_of_whole(words))
                fps.append(word_fingerprints(words, count))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], long_column(bodies), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "id_a", "id_b", "body", "fps"])

    a, b = identity(doc_id, text)
    plain = docs.select(F.col(doc_id).alias("doc_id"), a.alias("id_a"), b.alias("id_b"), F.col(text).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, id_a long, id_b long, body long, fps array<long>")


def fingerprint_of_whole(words: list[bytes]) -> int:
    """A signed hash of a whole sequence of words."""
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(b" ".join(words), SEED))


def _shingle_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int, broadcast_docs: int) -> DataFrame:
    """(body, shingles) of the rows that wanted(id_a, id_b, body) names, one a body."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for body, raw in zip(b.column(0).to_pylist(), texts(b.column(1))):
                found = shingle_set(raw.lower().split(), size)
                yield pa.RecordBatch.from_arrays([long_column([body]), pa.array([found], pa.list_(pa.int64()))], names=["body", "shingles"])

    a, b = identity(doc_id, text)
    few = wanted.limit(broadcast_docs + 1).count() <= broadcast_docs
    named = docs.select(a.alias("a"), b.alias("b"), F.col(text).alias("text"))
    side = F.broadcast(wanted) if few else wanted.hint("merge")
    # Rows of the same id and text are alike: any of them will do.
    return named.join(side, (F.col("a") == F.col("id_a")) & (F.col("b") == F.col("id_b"))).select("body", "text").mapInArrow(run, "body long, shingles array<long>").dropDuplicates(["body"])


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(u, v) of bodies whose shingles are alike. v's come first, as u may be the centre of a large group."""
    left = sets.select(F.col("body").alias("u"), F.col("shingles").alias("of_u"))
    right = sets.select(F.col("body").alias("v"), F.col("shingles").alias("of_v"))
    both = pairs.join(right.hint("merge"), "v").join(left.hint("merge"), "u")
    # Sizes first: texts of very different lengths can't be alike.
    near = F.least(F.size("of_u"), F.size("of_v")) >= similarity * F.greatest(F.size("of_u"), F.size("of_v"))
    shared = F.size(F.array_intersect("of_u", "of_v"))
    return both.where(near).where(shared >= similarity * (F.size("of_u") + F.size("of_v") - shared)).select("u", "v")


def keep_distinct(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashes: int = WORD_HASHES, shingle: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY, broadcast_docs: int = 1_000_000) -> DataFrame:
    """One document of each group of exact and near copies, that with the smallest doc_id (nulls last), with all its columns.

    Texts with the same lower-cased words are copies. Others are near copies if links of WORD_RADIUS bits between word
    fingerprints lead from one to the other and their shingles' similarity is enough. Verified are each text against
    the first of its linked group, and where that fails against what it was linked with; groups are what verified pairs
    connect. Up to broadcast_docs texts that have links are found by broadcast, more by a shuffle. Texts without a word are
    copies of one another; a text shorter than a shingle only has exact copies; rows are told apart by id and text.
    """
    ws = Workspace(spark, "simhash-distinct")
    prints = ws.keep(_word_prints(docs, doc_id, text, hashes), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "id_a", "id_b")
    bodies = ws.keep(prints.groupBy("body").agg(F.min(row).alias("first"), F.min("fps").alias("fps")), "bodies")

    # Fingerprints by different hashes stand in one table: what agrees by chance doesn't pass the shingles.
    own = bodies.select("body", F.explode(F.array_distinct("fps")).alias("fp"))
    least = ws.keep(own.groupBy("fp").agg(F.min("body").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    between = links(ws, least.select("fp"), radius=WORD_RADIUS).join(least.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    within = own.join(least.where("n > 1"), "fp").where("body <> least")
    linked = ws.keep(between.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(within.select(F.col("least").alias("u"), F.col("body").alias("v"))).distinct(), "linked")
    reached = ws.keep(components(ws, linked), "reached")
    members = ws.keep(reached.unionByName(reached.select(F.col("root").alias("node"), "root").distinct()).join(bodies.select(F.col("body").alias("node"), "first"), "node"), "members")
    heads = ws.keep(members.groupBy("root").agg(F.min(F.struct("first", "node")).alias("head")).select("root", F.col("head.node").alias("u")), "heads")
    sets = ws.keep(_shingle_sets(docs, members.select("first.id_a", "first.id_b", F.col("node").alias("body")), doc_id, text, shingle, broadcast_docs), "sets")
    pairs = ws.keep(members.join(heads, "root").where("node <> u").select("u", F.col("node").alias("v")), "pairs")
    to_head = ws.keep(_alike(pairs, sets, similarity), "to-head")
    failed = ws.keep(pairs.select(F.col("v").alias("node")).join(to_head.select(F.col("v").alias("node")), "node", "left_anti"), "failed")
    either = linked.join(failed.withColumnRenamed("node", "u"), "u", "left_semi").unionByName(linked.join(failed.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v"))
    verified = to_head.unionByName(_alike(either.distinct(), sets, similarity))
    alike = ws.keep(components(ws, verified), "alike")

    grouped = bodies.join(alike, bodies["body"] == alike["node"], "left").groupBy(F.coalesce("root", "body").alias("root")).agg(F.min("first").alias("first"))
    return _only(docs, prints, ws.keep(grouped.select("first.id_a", "first.id_b").distinct(), "kept"), doc_id, text)


def _only(docs: DataFrame, prints: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs that kept(id_a, id_b) names, one of those with the same id and text. The join is a sort-merge join at every size: what it shuffles is the texts, once."""
    a, b = private(docs, "__id_a", "__id_b")
    named = docs.withColumns(dict(zip((a, b), identity(doc_id, text))))
    repeated = prints.groupBy("id_a", "id_b").count().where("count > 1").join(kept, ["id_a", "id_b"])
    if not repeated.isEmpty():
        # Before the join, where it reduces each task's rows before they are shuffled.
        named = named.dropDuplicates([a, b])
    wanted = kept.select(F.col("id_a").alias(f"{a}_"), F.col("id_b").alias(f"{b}_")).hint("merge")
    return named.join(wanted, (F.col(a) == F.col(f"{a}_")) & (F.col(b) == F.col(f"{b}_")), "left_semi").select(*docs.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_components(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
