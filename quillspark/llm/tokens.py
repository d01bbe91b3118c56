"""Token ids of whole texts by a public tokenizer.

Where the vocabulary file lower-cases composed text and never joins over white space (which is read from it), a text is cut
at spaces and newlines; each distinct chunk is encoded once for as long as the vocabulary holds it, and a text's ids are
gathered from its chunks' ids. The result equals encoding the text whole, which is what happens with any other file.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata
from collections.abc import Iterable

import numpy as np


def of_worker(key: tuple, make):
    """What the tasks of a Python worker share under key, made by the first of them. A worker keeps one such thing at a time, to bound its memory."""
    cache = sys.modules.setdefault("_quillspark_worker", types.ModuleType("_quillspark_worker"))
    if getattr(cache, "key", None) != key:
        cache.key = cache.held = None
        cache.held = make()
        cache.key = key
    return cache.held


def forget() -> None:
    """Drop what the worker holds for its tasks, in stages that need their memory for other things."""
    cache = sys.modules.get("_quillspark_worker")
    if cache is not None:
        cache.key = cache.held = None


class Places(dict):
    """Numbers chunks as they come; fresh holds those that came since it was emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n


#: Letters before this one are in every version of Unicode that a tokenizer may follow.
LATIN_END = "\u0250"


class Growing:
    """An array that rows are appended to."""

    def __init__(self, kind, room: int = 1 << 14):
        self.buffer, self.used = np.zeros(room, kind), 0

    def __len__(self) -> int:
        return self.used

    def add(self, rows) -> None:
        while self.used + len(rows) > len(self.buffer):
            self.buffer = np.concatenate([self.buffer, np.zeros_like(self.buffer)])
        self.buffer[self.used : self.used + len(rows)] = rows
        self.used += len(rows)

    @property
    def values(self) -> np.ndarray:
        return self.buffer[: self.used]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the runs that begin at starts and have those lengths."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _parted(chunk: str) -> tuple[str, str]:
    """A lower-cased word and the one sign behind it, where that gives the same ids as the chunk: for composed letters whose lower case doesn't depend on their place."""
    if chunk.isalpha():
        core, tail = chunk, ""
    else:
        core, tail = chunk[:-1], chunk[-1:]
        if tail != "," and tail != "." or not core.isalpha():
            return chunk, ""
    if core.isascii():
        return core.lower(), tail
    if "Σ" not in core and unicodedata.is_normalized("NFC", core):
        low = core.lower()
        if len(low) == len(core):
            return low, tail
    return chunk, ""


def cuts_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those that cutting at white space and lower-casing relies on."""
    steps = (settings.get("normalizer") or {}).get("normalizers") or []
    cuts = ((settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and (cuts.get("type"), cuts.get("behavior"), cuts.get("invert")) == ("Split", "Removed", True)
        # Every alternative of the pattern is letters, or has no white space and no letter but in the quoted endings.
        and (cuts.get("pattern") or {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and settings.get("model", {}).get("end_of_word_suffix") == "</w>"
        and settings.get("post_processor") is None
    )


class ChunkCoder:
    """Encodes texts; keeps the ids of some max_chunks distinct chunks and starts anew beyond."""

    def __init__(self, path: str, max_chunks: int = 900_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.max_chunks = Tokenizer.from_file(path), max_chunks
        with open(path, encoding="utf-8") as f:
            self.chunked = cuts_at_spaces(json.load(f))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    @classmethod
    def of_worker(cls, path: str) -> "ChunkCoder":
        """The worker's own coder for that vocabulary."""
        return of_worker(("coder", path), lambda: cls(path))

    def _clear(self) -> None:
        self.places = Places()
        self.ids, self.lengths, self.starts = Growing(np.uint32), Growing(np.int32), Growing(np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and the numbers of ids."""
        plain = [w.isalpha() and (w.isascii() or max(w) < LATIN_END) for w in words]
        done = self._plain([w for w, p in zip(words, plain) if p])
        other = self._any([w for w, p in zip(words, plain) if not p])
        lengths = np.zeros(len(words), np.int64)
        is_plain = np.array(plain, bool)
        lengths[is_plain], lengths[~is_plain] = done[1], other[1]
        starts = np.zeros(len(words), np.int64)
        starts[is_plain] = np.cumsum(done[1]) - done[1]
        starts[~is_plain] = len(done[0]) + np.cumsum(other[1]) - other[1]
        return np.concatenate([done[0], other[0]])[ragged(starts, lengths)], lengths

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of Latin letters only: each word is one pre-token, whose last id is one that ends a word, so a run of words is encoded as one text."""
        texts = [" ".join(words[at : at + 200]) for at in range(0, len(words), 200)]
        ids = np.array([x for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for x in e.ids], np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):
            return self._any(words)
        return ids, np.diff(ends, prepend=-1)

    def _any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of whatever has no space."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(coded.ids, np.uint32))
            lengths.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self) -> None:
        fresh, self.places.fresh = self.places.fresh, []
        if not fresh:
            return
        parted = [_parted(c) for c in fresh]
        bases, tails_of = zip(*parted)
        words = {w: n for n, w in enumerate(dict.fromkeys(bases))}
        rows = np.fromiter(map(words.__getitem__, bases), np.int64, len(bases))
        tails = {t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in (".", ",")}
        ids, lengths = self._encoded(list(words))
        starts = np.cumsum(lengths) - lengths
        signs = np.fromiter(map({"": 0, ".": 1, ",": 2}.__getitem__, tails_of), np.int64, len(tails_of))
        # Behind the words' ids stand those of the two signs; a chunk is a word's run and maybe a sign's.
        tail_ids = [tails["."], tails[","]]
        pool = np.concatenate([ids, *tail_ids])
        tail_starts, tail_lengths = np.array([0, len(ids), len(ids) + len(tail_ids[0])]), np.array([0, *map(len, tail_ids)])
        runs = np.stack([starts[rows], tail_starts[signs]], axis=1).ravel()
        sizes = np.stack([lengths[rows], tail_lengths[signs]], axis=1).ravel()
        both = sizes[0::2] + sizes[1::2]
        self.starts.add(len(self.ids) + np.cumsum(both) - both)
        self.lengths.add(both)
        self.ids.add(pool[ragged(runs, sizes)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.chunked:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.places) > self.max_chunks:
            self._clear()
        place = self.places.__getitem__
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        rows = [np.fromiter(map(place, c), np.int64, len(c)) for c in chunks]
        self._learn()
        ids, starts, lengths = self.ids.values, self.starts.values, self.lengths.values
        return [ids[ragged(starts[r], lengths[r])] for r in rows]


def encode_blocks(coder: ChunkCoder, texts: Iterable[str], block_chars: int = 1_000_000):
    """The ids of each text in order, encoded in blocks of bounded size."""
    block: list[str] = []
    held = 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= block_chars:
            yield from coder.encode(block)
            block, held = [], 0
    if block:
        yield from coder.encode(block)
