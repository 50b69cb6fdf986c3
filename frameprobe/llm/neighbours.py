"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from frameprobe.llm.tables import ROW, numbered, written

#: The index is fitted on a sample of about this many rows, and of about this many components in all.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000

#: Most centroids of a half. Up to that, about one for every two by square root of the rows, a power of two.
CENTROIDS = 256

#: Rounds of k-means; queries of the sample that set how far a search goes.
ROUNDS, TRIALS = 12, 300

#: Share of the sample's true neighbours that the search must reach there. A sample's neighbours are farther
#: off than those among all rows, so that the share is higher over the whole table.
REACH = 0.97

#: Entries of an index block, queries of a query block, and index entries that meet a query block together.
BLOCK_ROWS, QUERY_ROWS, GROUP_ROWS = 8192, 256, 1 << 19

#: Groups of buckets of a length at least, as far as there are buckets: a query is copied to each that it visits.
GROUPS = 64

#: A search over more than one in so many entries sorts all cells; a narrower one takes them from a heap.
WIDE = 16

#: Query blocks whose least scores a task remembers.
REMEMBERED = 2048


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, points by centroids."""
    found = (points ** 2).sum(axis=1)[:, None] + (centroids ** 2).sum(axis=1) - 2 * points @ centroids.T
    return np.maximum(found, 0)


def k_means(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most ``k`` centroids, the first ones distinct points of the sample."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centroids = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds if len(points) > k else 0):
        nearest = _squares(points, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        held = np.bincount(nearest, minlength=len(centroids))
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
    return centroids


def _popped(near: np.ndarray, far: np.ndarray, held: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cells with entries in both sorted lists of distances, by their sum, until they hold ``wanted``.

    The multi-sequence walk: the pair with the least sum leaves the heap and its two successors
    enter it once both their predecessors are out.
    """
    near, far, held = near.tolist(), far.tolist(), held.tolist()
    heap, seen, cells = [(near[0] + far[0], 0, 0)], 0, []
    out = [-1] * len(near)  # the last column that left the heap, of each row
    while heap and seen < wanted:
        _, r, c = heapq.heappop(heap)
        out[r] = c
        if held[r][c]:
            seen += held[r][c]
            cells.append((r, c))
        if c + 1 < len(far) and (r == 0 or out[r - 1] > c):
            heapq.heappush(heap, (near[r] + far[c + 1], r, c + 1))
        if r + 1 < len(near) and out[r + 1] == c - 1:
            heapq.heappush(heap, (near[r + 1] + far[c], r + 1, c))
    rows, columns = np.array(cells, np.int64).reshape(-1, 2).T
    return rows, columns


def _sorted(near: np.ndarray, far: np.ndarray, held: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``_popped``, by one sort of all cells with entries."""
    held = held.ravel()
    some = np.flatnonzero(held)
    order = some[np.argsort((near[:, None] + far).ravel()[some], kind="stable")]
    return np.divmod(order[:np.searchsorted(np.cumsum(held[order]), wanted) + 1], len(far))


@dataclass
class Codebook:
    """Centroids of both halves of the vectors of one length, and the share of all entries that a search visits."""

    scale: float
    first: np.ndarray
    second: np.ndarray
    share: float = 1.0

    @classmethod
    def fitted(cls, sample: np.ndarray, rows: float, k: int, reach: float) -> "Codebook":
        half = sample.shape[1] // 2
        scale = float(np.abs(sample).max())
        sample = sample / scale
        most = min(CENTROIDS, 1 << max(0, int(np.log2(max(1.0, rows)) / 2) - 1))
        book = cls(scale, k_means(sample[:, :half], most), k_means(sample[:, half:], most))
        book.share = book._needed(sample, k, reach) if reach < 1 else 1.0
        return book

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self._halves(vectors)
        return one.argmin(axis=1), two.argmin(axis=1)

    def _halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vectors, half = vectors / self.scale, self.first.shape[1]
        return _squares(vectors[:, :half], self.first), _squares(vectors[:, half:], self.second)

    def walks(self, vectors: np.ndarray, counts: np.ndarray, wanted: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector its cells, as two arrays, in the order of summed distance until they hold ``wanted`` entries."""
        one, two = self._halves(vectors)
        left, right = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        ordered = _sorted if wanted * WIDE > counts.sum() else _popped
        for a, b, x, y in zip(left, right, one, two):
            r, c = ordered(x[a], y[b], counts[np.ix_(a, b)], wanted)
            yield a[r], b[c]

    def visits(self, vectors: np.ndarray, counts: np.ndarray, wanted: float) -> Iterator[list[tuple[int, int]]]:
        """``walks`` as a list of cells for each vector."""
        for i, j in self.walks(vectors, counts, wanted):
            yield list(zip(i.tolist(), j.tolist()))

    def _needed(self, sample: np.ndarray, k: int, reach: float) -> float:
        """The share of the sample's entries within which ``reach`` of the neighbours of TRIALS rows lie."""
        i, j = self.cells(sample * self.scale)
        counts = np.zeros((len(self.first), len(self.second)), np.int64)
        np.add.at(counts, (i, j), 1)
        trials = np.random.default_rng(11).permutation(len(sample))[:TRIALS]
        needed = []
        for t, cells in zip(trials, self.visits(sample[trials] * self.scale, counts, len(sample))):
            far = _squares(sample[t:t + 1], sample)[0]
            far[t] = np.inf
            number = min(k, len(sample) - 1)
            near = np.argpartition(far, number - 1)[:number] if number else []
            place = {cell: n for cell, n in zip(cells, np.cumsum([counts[c] for c in cells]))}
            needed += [place[i[n], j[n]] for n in near]
        if not needed:
            return 1.0
        return float(np.sort(needed)[min(len(needed) - 1, int(np.ceil(reach * len(needed))))]) / len(sample)


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, first places and the flat values of an array of vectors."""
    sizes = np.asarray(vectors.value_lengths())
    return sizes, np.cumsum(sizes) - sizes, vectors.flatten().to_numpy(zero_copy_only=False)


def _by_size(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the length, the places of its vectors, and these as a matrix of doubles."""
    sizes, begins, flat = _matrix(vectors)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, flat[begins[at][:, None] + np.arange(dim)].astype(float)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, without overflow of the squares."""
    with np.errstate(over="ignore"):
        apart = rows - query
        most = np.abs(apart).max(axis=1)
        odd = (most > 1e140) | ((most > 0) & (most < 1e-140))
        found = np.sqrt((apart * apart).sum(axis=1))
        if odd.any():
            exponent = np.frexp(most[odd])[1]
            scaled = np.ldexp(apart[odd], -exponent[:, None])
            found[odd] = np.ldexp(np.sqrt((scaled * scaled).sum(axis=1)), exponent)
    return found


def _fitted(rows: DataFrame, vector: str, k: int, reach: float) -> dict[int, Codebook]:
    """A codebook for each length of vectors that the sample holds twice."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    if not facts.n:
        return {}
    share = min(1.0, min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // facts.dim)) / facts.n)
    chance = F.pmod(F.xxhash64("id", ROW), F.lit(1 << 40)) / float(1 << 40)
    found = rows.where(chance < share).orderBy(F.xxhash64("id", ROW), ROW).select(vector).toArrow()
    books = {}
    if len(found):
        for dim, at, values in _by_size(found.column(0).combine_chunks()):
            if len(at) > 1:
                books[dim] = Codebook.fitted(values, len(at) / share, k, reach)
    return books


@dataclass
class Groups:
    """Runs of buckets (first centroids) of one length whose entries meet a query together: where each
    begins, and the end of the last; the second centroids; the parts that the entries of each come in."""

    begins: np.ndarray
    width: int
    parts: list[int]

    @classmethod
    def fitted(cls, counts: np.ndarray) -> "Groups":
        held = counts.sum(axis=1)
        most = min(GROUP_ROWS, -(-int(held.sum()) // GROUPS))
        begins, size = [], 0
        for i, n in enumerate(held.tolist()):
            if not begins or size + n > most:
                begins.append(i)
                size = 0
            size += n
        sizes = np.add.reduceat(held, begins)
        return cls(np.array([*begins, len(held)]), counts.shape[1], (1 + sizes // GROUP_ROWS).tolist())

    def of(self, i: int) -> int:
        return int(np.searchsorted(self.begins, i, "right")) - 1


#: Of a length without a codebook.
ALONE = Groups(np.array([0, 1]), 1, [1])


def _packed(k: int, groups: dict[int, Groups], kind: type, vector: str):
    """Sorted rows to index blocks of one group. Of equal vectors the k + 1 first stay: the others cannot be among k."""
    names = ["dim", "g", "part", "cells", "ids", "rows", "vectors"]

    def made(dim, g, block, held):
        cells, ids, rows, vectors = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([g], pa.int32()), pa.array([block % groups.get(dim, ALONE).parts[g]], pa.int32()),
             *(pa.array([x.tobytes()], pa.binary()) for x in (cells.astype(np.int32), ids, rows, vectors.astype(kind)))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, held, size = TaskContext.get().partitionId(), None, [], 0
        bucket, last, copies = None, None, 0
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("dim", "i")], axis=1)
            j, ids, rows = (batch.column(c).to_numpy() for c in ("j", "id", ROW))
            sizes, begins, flat = _matrix(batch.column(vector))
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                dim, i = where[a].tolist()
                group = groups.get(dim, ALONE)
                g = group.of(i)
                if (dim, g) != key:
                    if held:
                        yield made(*key, block, held)
                        block += 1
                    key, held, size = (dim, g), [], 0
                if (dim, i) != bucket:
                    bucket, last = (dim, i), None
                cells = (i - int(group.begins[g])) * group.width + j[a:b]
                values = flat[begins[a]:begins[b - 1] + dim].reshape(-1, dim).astype(float) + 0.0
                number = np.zeros(b - a, np.int64)  # place of a row among those with its vector
                same = np.empty(b - a, bool)
                same[0], same[1:] = last is not None and (values[0] == last).all(), (values[1:] == values[:-1]).all(axis=1)
                begin = np.where(same, 0, np.arange(b - a))
                number = np.arange(b - a) - np.maximum.accumulate(begin)
                lead = int(np.argmin(same)) if not same.all() else b - a
                number[:lead] = np.arange(lead) + copies
                last, copies = values[-1], int(number[-1]) + 1
                stay = np.flatnonzero(number <= k)
                while len(stay):
                    some, stay = stay[:BLOCK_ROWS - size], stay[BLOCK_ROWS - size:]
                    held.append((cells[some], ids[a:b][some], rows[a:b][some], values[some]))
                    size += len(some)
                    if size == BLOCK_ROWS:
                        yield made(*key, block, held)
                        block, held, size = block + 1, [], 0
        if held:
            yield made(*key, block, held)

    return run


def _asked(books: dict[int, Codebook], counts: dict[int, np.ndarray], groups: dict[int, Groups], k: int, kind: type, vector: str):
    """Queries to blocks of them, one for each group, and part of it, that their walks visit: with the visited cells as bits."""
    names = ["dim", "g", "part", "q_rows", "q_ids", "q_vectors", "visited"]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id").to_numpy(), batch.column(ROW).to_numpy()
            for dim, at, values in _by_size(batch.column(vector)):
                book, group = books.get(dim), groups.get(dim, ALONE)
                for n in range(0, len(at), QUERY_ROWS):
                    some, asked = at[n:n + QUERY_ROWS], values[n:n + QUERY_ROWS]
                    bits = np.full((len(some), int(group.begins[-1]), group.width), 0 if book else 1, np.uint8)
                    if book:
                        wanted = max(k + 1, np.ceil(book.share * counts[dim].sum()))
                        for own, cells in zip(bits, book.walks(asked, counts[dim], wanted)):
                            own[cells] = 1
                    for g, parts in enumerate(group.parts):
                        own = bits[:, group.begins[g]:group.begins[g + 1]].reshape(len(some), -1)
                        met = np.flatnonzero(own.any(axis=1))
                        if len(met):
                            block = [x.tobytes() for x in (rows[some[met]], ids[some[met]], asked[met].astype(kind),
                                                           np.packbits(own[met], axis=1, bitorder="little"))]
                            columns = [[dim] * parts, [g] * parts, list(range(parts)), *([x] * parts for x in block)]
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def _ranked(k: int, kind: type):
    """Pairs of an index block and a query block to the nearest visited entries of each query, k at most, without
    those farther off than k others that the task has met."""
    names = ["q_row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, bytes], np.ndarray] = {}  # the k least scores of each query of a block
        for batch in batches:
            for dim, cells, ids, rows, vectors, q_rows, q_ids, q_vectors, visited in zip(*(c.to_pylist() for c in batch.columns)):
                block = dim, q_rows
                cells, ids, rows = np.frombuffer(cells, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
                vectors, queries = (np.frombuffer(x, kind).reshape(-1, dim).astype(float) for x in (vectors, q_vectors))
                q_rows, q_ids = np.frombuffer(q_rows, np.int64), np.frombuffer(q_ids, np.int64)
                bits = np.unpackbits(np.frombuffer(visited, np.uint8).reshape(len(q_rows), -1), axis=1, bitorder="little")
                known = least.get(block)
                if known is None:
                    known = np.full((len(q_rows), k), np.inf)
                scale = max(np.abs(vectors).max(), np.abs(queries).max())
                near = _squares(queries / scale, vectors / scale)
                near[(bits[:, cells] == 0) | (q_rows[:, None] == rows)] = np.inf
                # squared distances of scaled vectors are at most 4 * dim and wrong by a few units of the last place of that
                error = 64 * dim * (dim + 8) * 2.0 ** -52
                with np.errstate(over="ignore"):
                    limit = (known[:, -1] / scale) ** 2
                if len(ids) > k:
                    limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
                close = (near <= limit[:, None] + error) & (near < np.inf)
                total, first, out, fresh = np.cumsum(close.sum(axis=1)), 0, [], np.full(known.shape, np.inf)
                while first < len(q_rows):  # a run of queries with about BLOCK_ROWS entries
                    before = total[first - 1] if first else 0
                    end = max(first + 1, int(np.searchsorted(total, before + BLOCK_ROWS, "right")))
                    at, entry = np.nonzero(close[first:end])
                    at += first
                    score = distances(vectors[entry], queries[at])
                    order = np.lexsort((ids[entry], score, at))
                    at, entry, score = at[order], entry[order], score[order]
                    place = np.arange(len(at)) - np.searchsorted(at, at)
                    stay = np.flatnonzero((place < k) & (score <= known[at, -1]))
                    at, entry, score = at[stay], entry[stay], score[stay]
                    fresh[at, place[stay]] = score
                    out.append((at, ids[entry], score))
                    first = end
                if block not in least and len(least) >= REMEMBERED:
                    least.clear()
                least[block] = np.sort(np.hstack([known, fresh]), axis=1)[:, :k]
                at, found, score = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_rows[at]), pa.array(q_ids[at]), pa.array(found), pa.array(score)], names=names)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            reach: float = REACH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row that ``is_query`` marks.

    Both halves of a vector are quantised by k-means centroids of their own, fitted on a sample of
    SAMPLE_ROWS rows. A row lies in the cell of its pair of centroids; every row is in the index. A
    query walks the cells by summed distance of the halves until they hold a share of all entries
    that the fit found to reach ``reach`` of the sample's neighbours, and its entries are ranked
    by the distances of the original vectors. ``reach`` 1 visits every cell and is exact.

    Index and query blocks meet by a merge join. Its hint keeps Spark from a broadcast of the query
    blocks, whose size it takes for that of the queries before they are copied to their groups.

    Candidates of a query are all rows but itself, also those that share its id or its vector; equal
    scores rank by smaller id. Of equal vectors the index keeps at least the k + 1 with the smallest
    ids, since no other one can be among k. Null, empty and zero vectors, those with null or
    non-finite components and rows without an id take no part. Vectors of different lengths have
    no distance; a length that the sample holds once or never is searched wholly. A query without any
    candidate has no row. Rows that repeat are candidates each, and queries each. Vectors of any
    length are read whole. Extra columns are not read; a table without rows gives none.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    element = vectors.schema[vector].dataType.elementType
    kept = F.col(vector) if isinstance(element, (T.FloatType, T.DoubleType)) else F.col(vector).cast("array<double>")
    chosen = vectors.select(F.col(key).cast("long").alias("id"), kept.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = numbered(chosen.where(F.col("id").isNotNull() & usable("vector")), "vectors")
    books = _fitted(rows, "vector", k, reach)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, dims = (np.zeros(batch.num_rows, np.int32) for _ in range(3))
            for dim, at, values in _by_size(batch.column("vector")):
                dims[at] = dim
                if dim in books:
                    i[at], j[at] = books[dim].cells(values)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (dims, i, j))], names=[*batch.schema.names, "dim", "i", "j"])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("dim", "i", "j"))])
    entries = written(rows.mapInArrow(placed, schema), "entries")
    # as many numbers as pairs of centroids, for the lengths with a codebook
    counts = {dim: np.zeros((len(b.first), len(b.second)), np.int64) for dim, b in books.items()}
    held = entries.where(F.col("dim").isin(list(books))).groupBy("dim", "i", "j").count().toArrow()
    for dim, i, j, n in zip(*(c.to_numpy() for c in held.columns)):
        counts[dim][i, j] = n
    groups = {dim: Groups.fitted(n) for dim, n in counts.items()}
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64

    index = written(entries.repartitionByRange(parts, "dim", "i", "j", ROW).sortWithinPartitions("dim", "i", "j", "vector", "id").mapInArrow(
        _packed(k, groups, kind, "vector"), "dim int, g int, part int, cells binary, ids binary, rows binary, vectors binary"), "index")
    blocks = entries.where("asked").repartition(parts).mapInArrow(
        _asked(books, counts, groups, k, kind, "vector"), "dim int, g int, part int, q_rows binary, q_ids binary, q_vectors binary, visited binary")
    met = index.join(blocks.hint("merge"), ["dim", "g", "part"]).select(
        "dim", "cells", "ids", "rows", "vectors", "q_rows", "q_ids", "q_vectors", "visited").mapInArrow(
        _ranked(k, kind), "q_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q_row").orderBy("score", "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
