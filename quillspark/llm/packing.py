"""Best-fit packing (operator 9): token sequences of at most 4,096 ids from whole documents, by swap-based local search.

Documents are encoded and cut into pieces (only those longer than a sequence). Only the pieces' sizes and checksums go on:
they are dealt evenly, whatever their ids, to tasks of some 100,000 pieces, each of which begins with best fit and then
searches locally. From the least filled sequence up, a search moves a piece into a gap, or exchanges it one for one, one
for two or two for one with pieces of another underfull sequence, always so that the fuller sequence gains tokens: the sum
of squared fills grows with every step, so the search ends, and least filled sequences empty. It ends when no sequence has
a step left or when there are no more sequences than the tokens need. What a round leaves underfull meets again in fewer
tasks, until there is one task or a round empties no sequence.

Defined cases: a null or empty text is a single piece of the end token; rows with the same doc_id, null or not, are packed
as rows of their own; an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, table, values
from .tokens import ChunkCoder, encode_blocks

ROOM, END_TOKEN = 4096, 1
#: Pieces that one task packs.
TASK_PIECES = 100_000


def tokenizer_path() -> str:
    """The vocabulary file that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, room: int = ROOM, end: int = END_TOKEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    import pyarrow as pa

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        coder = ChunkCoder.of_worker(path)
        for b in batches:
            parent, rows = [], []
            for n, ids in enumerate(encode_blocks(coder, (t or "" for t in values(b.column(1))))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), room)):
                    part = ids[at : at + room]
                    parent.append(n)
                    rows.append((k, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(parent, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of row numbers: longest pieces first, each into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    open_by_gap: dict[int, list[int]] = defaultdict(list)
    gaps = 0  # bit g is set if a bin with g free tokens exists
    for row in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[row])
        fits = gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[b].append(row)
        else:
            b, gap = len(bins), room
            bins.append([row])
        if gap > size:
            open_by_gap[gap - size].append(b)
            gaps |= 1 << (gap - size)
    return bins


class LocalSearch:
    """Exchanges among underfull bins. Every step moves tokens from a bin to one at least as full, so squared fill grows."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, room: int):
        self.size, self.room = np.asarray(lengths, np.int64), room
        self.bin = np.zeros(len(self.size), np.int64)
        for n, b in enumerate(bins):
            self.bin[b] = n
        self.fill = np.bincount(self.bin, self.size, len(bins)).astype(np.int64)
        self.least = -(-int(self.fill.sum()) // room)

    def run(self) -> list[list[int]]:
        used, failed, moved = int((self.fill > 0).sum()), set(), True
        # No search can go below the number of sequences that the tokens need.
        while moved and used > self.least:
            moved = False
            for victim in np.argsort(self.fill, kind="stable").tolist():
                if used <= self.least:
                    break
                if not 0 < self.fill[victim] < self.room:
                    continue
                # What has failed since the last step fails again, and so does any other sequence of the same sizes.
                if self._sizes(victim) in failed:
                    continue
                while self.fill[victim] and self._step(victim):
                    moved = True
                    failed.clear()
                used -= not self.fill[victim]
                if self.fill[victim]:
                    failed.add(self._sizes(victim))
        order = np.argsort(self.bin, kind="stable")
        cuts = np.flatnonzero(np.diff(self.bin[order])) + 1
        return [x.tolist() for x in np.split(order, cuts)] if len(order) else []

    def _sizes(self, victim: int) -> tuple:
        return tuple(sorted(self.size[np.flatnonzero(self.bin == victim)].tolist()))

    def _shift(self, out: list[int], victim: int, back: list[int], other: int) -> None:
        self.bin[out], self.bin[back] = other, victim
        gained = int(self.size[out].sum() - self.size[back].sum())
        self.fill[victim] -= gained
        self.fill[other] += gained

    def _step(self, victim: int) -> bool:
        """The first move, else the exchange that moves the most tokens, one or two for one before one for two; False if there is none."""
        mine = np.flatnonzero(self.bin == victim)
        mine = mine[np.argsort(-self.size[mine], kind="stable")]
        eligible = (self.fill < self.room) & (self.fill >= self.fill[victim])
        eligible[victim] = False
        others = np.flatnonzero(eligible)
        others = others[np.argsort(-self.fill[others], kind="stable")]  # small gaps are closed before large ones
        for a in mine.tolist():
            fits = np.flatnonzero(self.fill[others] + self.size[a] <= self.room)
            if len(fits):
                self._shift([a], victim, [], int(others[fits[0]]))
                return True
        theirs = np.flatnonzero(eligible[self.bin])
        if not len(theirs):
            return False
        gaps = (self.room - self.fill)[self.bin[theirs]]
        outs = [[a] for a in mine.tolist()] + [[a, c] for k, a in enumerate(mine.tolist()) for c in mine[k + 1 :].tolist()]
        found = self._best(outs, self.size[theirs], gaps)
        if found is not None:
            out, k = found
            self._shift(out, victim, [int(theirs[k])], int(self.bin[theirs[k]]))
            return True
        # Pairs of neighbours in a bin, at any distance there.
        theirs = theirs[np.argsort(self.bin[theirs], kind="stable")]
        step = 1
        while True:
            first, second = theirs[:-step], theirs[step:]
            same = self.bin[first] == self.bin[second] if step < len(theirs) else np.zeros(0, bool)
            if not same.any():
                return False
            first, second = first[same], second[same]
            found = self._best(outs[: len(mine)], self.size[first] + self.size[second], (self.room - self.fill)[self.bin[first]])
            if found is not None:
                out, k = found
                self._shift(out, victim, [int(first[k]), int(second[k])], int(self.bin[first[k]]))
                return True
            step += 1

    def _best(self, outs: list[list[int]], sizes: np.ndarray, gaps: np.ndarray) -> tuple[list[int], int] | None:
        """Which of outs against which of the rows with those sizes and gaps gains the most."""
        best, found = 0, None
        for out in outs:
            gain = int(self.size[out].sum()) - sizes
            gain[gain > gaps] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = int(gain[k]), (out, k)
        return found


def pack(lengths: np.ndarray, room: int = ROOM) -> list[list[int]]:
    """Bins of row numbers."""
    if not len(lengths):
        return []
    return LocalSearch(best_fit(lengths, room), lengths, room).run()


def _packed(todo: DataFrame, room: int, turn: int, kind: str) -> DataFrame:
    """todo in its partitions, with sequence_id, offset and the sequence's fill."""
    import pyarrow as pa

    def run(batches):
        parts = list(batches)
        if not parts or not sum(b.num_rows for b in parts):
            return
        rows = pa.Table.from_batches(parts)
        lengths = rows.column("length").to_numpy()
        bins = pack(lengths, room)
        order = np.array([r for b in bins for r in b], np.int64)
        counts = np.array([len(b) for b in bins])
        first = np.repeat(np.cumsum(counts) - counts, counts)
        before = np.cumsum(lengths[order]) - lengths[order]
        offsets = before - before[first]
        fills = np.repeat(np.add.reduceat(lengths[order], np.cumsum(counts) - counts), counts)
        base = (turn << 56) | (TaskContext.get().partitionId() << 32)
        out = rows.take(pa.array(order))
        for name, values in (("sequence_id", base + np.repeat(np.arange(len(bins)), counts)), ("offset", offsets), ("fill", fills)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        yield from out.to_batches(max_chunksize=50_000)

    return todo.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long")


def pack_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, room: int = ROOM, end: int = END_TOKEN, task_pieces: int = TASK_PIECES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ws = Workspace(spark, "packing")
    kind = docs.schema[doc_id].dataType.simpleString()
    todo = ws.keep(pieces(docs, path or tokenizer_path(), room, end, doc_id, text), "pieces")
    columns, done, turn = todo.columns, [], 0
    left, sequences = todo.count(), None
    while True:
        tasks = max(1, -(-left // task_pieces))
        result = ws.keep(_packed(todo.repartition(tasks).sortWithinPartitions("length", "doc_id", "piece", "ids_crc32"), room, turn, kind), "packed")
        underfull = F.col("fill") < room
        made, again, open_after = result.agg(F.count_if(F.col("offset") == 0), F.count_if(underfull), F.count_if(underfull & (F.col("offset") == 0))).first()
        if tasks == 1 or again == 0 or (sequences is not None and made >= sequences):
            done.append(result)
            break
        done.append(result.where(~underfull))
        todo, left, sequences, turn = result.where(underfull).select(*columns), again, open_after, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    return pack_documents(spark, table(spark, sf_dir, "documents"))
