"""The nearest of many vectors by cosine, block by block: numpy within the tasks that hold the stored ones."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

_ROWS, _COLUMNS = 2048, 1024  # of a block of products
_SLACK = 2e-6  # more than rounding to six places and another order of summing can change


def rounded(x: np.ndarray) -> np.ndarray:
    """Half up at six places of the shortest decimal, as Spark rounds a double."""
    scaled = np.abs(x) * 1e6
    out = np.copysign(np.floor(scaled + 0.5) / 1e6, x) + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return out


def unit_groups(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, unit vectors) for each size of vector; size -1 are those without a length: null, or with a null in them."""
    at = np.arange(len(vectors))
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        lengths = np.where((lengths > 0) & (holes[starts + np.maximum(lengths, 0)] > holes[starts]), -1, lengths)
    for size in np.unique(lengths):
        places = at[lengths == size]
        if size < 0:
            yield -1, places, np.zeros((len(places), 0))
            continue
        v = values[starts[places][:, None] + np.arange(size)]
        norm = np.zeros(len(places))
        for i in range(size):  # in this order, as the sums of the products
            norm = norm + v[:, i] * v[:, i]
        with np.errstate(divide="ignore", invalid="ignore"):
            yield int(size), places, v / np.sqrt(norm)[:, None]


class Asked:
    """The asked vectors of a block, by size; of each query the best ``limit`` stored ones so far, their number bounded by that."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, limit: int):
        self.ids, self.limit, self.count = ids, limit, len(ids)
        self.groups = list(unit_groups(vectors))

    def start(self) -> None:
        self.best = None  # query, similarity to sort by, stored id
        self.floor = np.full(self.count, -np.inf)  # of the last one that a full list holds; nothing below it counts
        self.full = np.zeros(self.count, bool)

    def _take(self, query: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        if self.best:
            query, key, ids = (np.concatenate(x) for x in zip(self.best, (query, key, ids), strict=True))
        by = np.argsort(ids, kind="stable")
        by = by[np.argsort(-key[by], kind="stable")]
        by = by[np.argsort(query[by], kind="stable")]
        query, key, ids = query[by], key[by], ids[by]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.limit
        self.best = query, key, ids = query[kept], key[kept], ids[kept]
        last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == self.limit - 1)
        self.floor[query[last]], self.full[query[last]] = key[last], True

    def see(self, ids: np.ndarray, vectors: pa.Array) -> None:
        """Stored vectors of a batch."""
        for size, places, units in unit_groups(vectors):
            for other, asked, wanted in self.groups:
                if size < 0 or size != other:
                    self._without(ids[places], asked)
                    continue
                for a in range(0, len(places), _ROWS):
                    for b in range(0, len(asked), _COLUMNS):
                        self._block(ids[places[a : a + _ROWS]], units[a : a + _ROWS], asked[b : b + _COLUMNS], wanted[b : b + _COLUMNS])

    def _without(self, ids: np.ndarray, asked: np.ndarray) -> None:
        """Pairs without a similarity come last, by id."""
        asked = asked[~self.full[asked] | np.isneginf(self.floor[asked])]
        least = np.sort(ids)[: self.limit]
        self._take(np.repeat(asked, len(least)), np.full(len(asked) * len(least), -np.inf), np.tile(least, len(asked)))

    def _block(self, ids: np.ndarray, units: np.ndarray, asked: np.ndarray, wanted: np.ndarray) -> None:
        with np.errstate(invalid="ignore"):
            near = units @ wanted.T
            near[np.isnan(near)] = np.inf  # above all numbers, as in a sort
            floor = self.floor[asked]
            if len(ids) >= self.limit and not self.full[asked].all():
                floor = np.maximum(floor, np.partition(near, len(ids) - self.limit, axis=0)[len(ids) - self.limit])
            rows, columns = np.nonzero(near >= floor - _SLACK)
        for k in range(0, len(rows), 1 << 20):
            row, column = rows[k : k + (1 << 20)], columns[k : k + (1 << 20)]
            dot = np.zeros(len(row))
            for i in range(units.shape[1]):
                dot = dot + wanted[column, i] * units[row, i]
            odd = np.isnan(dot)
            key = np.where(odd, np.inf, rounded(np.where(odd, 0.0, dot)))
            self._take(asked[column], key, ids[row])

    def found(self, schema: pa.Schema) -> pa.RecordBatch:
        query, key, ids = self.best or (np.empty(0, np.int64), np.empty(0), [])
        sims = pa.array(np.where(np.isposinf(key), np.nan, key), mask=np.isneginf(key))
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(query)).cast(schema.field(0).type), pa.array(list(ids), schema.field(1).type), sims], schema=schema)
