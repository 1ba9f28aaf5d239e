"""How many words each of some queries shares with rows of words: numpy within the task that reads the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_CELLS = 2_000_000  # rows times queries that are counted at once
_CUES = 3  # as many hits of cues count


class Counter:
    """Queries as lists by word; of each query the best ``limit`` rows so far, by overlap, cue hits and id."""

    def __init__(self, asked: pa.Table, limit: int):
        words = asked["token"].combine_chunks().dictionary_encode()
        self.ids, code = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
        at = words.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        self.words, self.queries = words.dictionary, code[order]
        self.size = np.bincount(at, minlength=len(self.words))
        self.first = np.cumsum(self.size) - self.size
        self.limit = limit

    def start(self) -> None:
        self.best = tuple(np.empty(0, np.int64) for _ in range(3))  # query, key, id
        self.floor = np.zeros(len(self.ids), np.int64)

    def _counts(self, lists: pa.Array) -> np.ndarray:
        """(rows, queries) of shared words."""
        rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        found = pa.compute.index_in(lists.flatten(), self.words).fill_null(-1).to_numpy()
        rows, found = rows[found >= 0], found[found >= 0]
        n = self.size[found]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        query = self.queries[np.repeat(self.first[found], n) + within]
        width = len(self.ids)
        return np.bincount(np.repeat(rows, n) * width + query, minlength=len(lists) * width).reshape(-1, width)

    def see(self, ids: np.ndarray, lists: list[pa.Array]) -> None:
        step = max(1, _CELLS // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            key = self._counts(lists[0].slice(a, step)) * (_CUES + 1)
            if len(lists) > 1:
                key += np.minimum(self._counts(lists[1].slice(a, step)), _CUES)
            row, query = np.nonzero((key > 0) & (key >= self.floor))
            self._take(query, key[row, query], ids[a : a + step][row])

    def _take(self, query: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        query, key, ids = (np.concatenate(x) for x in zip(self.best, (query, key, ids), strict=True))
        by = np.lexsort((-ids, -key, query))
        query, key, ids = query[by], key[by], ids[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.floor[query[place == self.limit - 1]] = key[place == self.limit - 1]
        self.best = tuple(x[place < self.limit] for x in (query, key, ids))

    def found(self) -> pa.RecordBatch:
        query, key, ids = self.best
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[query], ids, key // (_CUES + 1), key % (_CUES + 1))], ["query_id", "id", "overlap", "cue"])


def counted(batches: Iterator[pa.RecordBatch], counter: Counter) -> Iterator[pa.RecordBatch]:
    """Batches of (id, words, and words of cues)."""
    counter.start()
    for b in batches:
        counter.see(b.column(0).to_numpy(zero_copy_only=False), [b.column(k) for k in range(1, b.num_columns)])
    yield counter.found()
