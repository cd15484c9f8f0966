"""Encoding whole texts by their words, each distinct word encoded once per worker while it stays in a bounded cache."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text encoded at a time; twice as many where a look at the words has a cost of its own.
CHUNK_CHARS = 1 << 21
#: Bytes (estimated) of a generation of remembered words; there are two of them.
CACHED_BYTES = 32 << 20
#: Bytes that an entry takes besides its characters: a string, a bytes object and its share of the dictionary.
ENTRY = 190


class Remembered:
    """Ids of words in two generations of bounded bytes.

    New words, and old ones that occur again, go to the young generation; when that is full it becomes the old one, whose
    words are forgotten unless they have occurred meanwhile. Frequent words so stay, and rare ones don't push them out.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHED_BYTES):
        self.encode, self.limit, self.young, self.old, self.bytes = encode, limit, {}, {}, 0

    def learn(self, words: set[str]) -> None:
        """Puts words that the young generation lacks into it."""
        again = words.intersection(self.old)
        known = {w: self.old[w] for w in again}
        if fresh := list(words - again):
            known.update(zip(fresh, self.encode(fresh), strict=True))
        self.young.update(known)
        self.bytes += ENTRY * len(known) + sum(map(len, known)) + sum(map(len, known.values()))

    def settle(self) -> None:
        """Ends a chunk: the generations change places if the young one is full."""
        if self.bytes > self.limit:
            self.young, self.old, self.bytes = {}, self.young, 0

    def look(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: ids side by side, where each word's begin there, and how many it has."""
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        self.learn(set(words).difference(self.young))
        found = list(map(self.young.__getitem__, words))
        self.settle()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes


class WordTable:
    """Ids of words in Arrow and numpy columns, about 40 bytes a word, looked up a chunk at a time.

    Beyond the limit the half of the words that were used last stays.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHED_BYTES):
        self.encode, self.limit, self.chunks = encode, limit, 0
        self.words, self.flat = pa.array([], pa.large_string()), np.empty(0, "<u4")
        self.starts, self.sizes, self.used = (np.empty(0, np.int64) for _ in range(3))

    def look(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: ids side by side, where each word's begin there, and how many it has."""
        self._forget()
        self.chunks += 1
        at = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            words = distinct.take(pa.array(fresh))
            made = self.encode(words.to_pylist())
            sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
            at[fresh] = len(self.words) + np.arange(len(fresh))
            self.words = pa.concat_arrays([self.words, words])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), "<u4")])
        self.used[at] = self.chunks
        return self.flat, self.starts[at], self.sizes[at]

    def _forget(self) -> None:
        if self.words.nbytes + self.flat.nbytes + 24 * len(self.words) <= self.limit:
            return
        kept = np.sort(np.argsort(-self.used, kind="stable")[: len(self.words) // 2])
        sizes = self.sizes[kept]
        self.flat = self.flat.take(places(self.starts[kept], sizes))
        self.words, self.used, self.sizes, self.starts = self.words.take(pa.array(kept)), self.used[kept], sizes, np.cumsum(sizes) - sizes


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of whole numbers from each start on, one after the other."""
    place = np.arange(int(sizes.sum()), dtype=np.int64)
    place += np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return place


class WordCache:
    """split gives the words of some texts, one text after the other, and how many each has; encode gives, for distinct
    words, their ids as little-endian 32-bit integers."""

    def __init__(self, split: Callable[[list[str]], tuple[pa.Array, np.ndarray]], encode: Callable[[list[str]], list[bytes]], remember: Callable = Remembered, chars: int = CHUNK_CHARS):
        self.split, self.words, self.chars = split, remember(encode), chars

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; a null text has none. Texts are whole, whatever their length."""
        chunk: list[str] = []
        chars = 0
        for text in texts:
            chunk.append(text or "")
            chars += len(chunk[-1])
            if chars >= self.chars:
                yield from self._chunk(chunk)
                chunk, chars = [], 0
        if chunk:
            yield from self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> Iterator[bytes]:
        """Each distinct word of the chunk is looked up once; the rest is gathering in numpy."""
        words, counts = self.split(texts)
        coded = words.dictionary_encode()
        flat, starts, sizes = self.words.look(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[codes]
        ids = flat.take(places(starts[codes], n)).tobytes()
        at = 4 * np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield ids[a:b]
