"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from frameprobe.llm.tables import ROW, numbered, written

#: Rows of an index block, queries of a query block, queries added up at a time.
BLOCK_ROWS, QUERY_ROWS, AT_ONCE = 8192, 512, 64

#: Lowest slices of an attribute that are left to the exact check of boundary rows.
LOW_SLICES = 3

#: Vectors with a quantised component from here on go to blocks of their own, with values of 64 bits; from HUGE on, to
#: blocks that keep the components as they are and are scored in Python integers.
WIDE, HUGE = 1 << 24, 1 << 62

#: Bound of every sum of a pair of blocks that is added up in 64 bits; beyond, scores are Python integers.
SAFE = 1 << 61


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null or empty, without null or non-finite components."""
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


BLOCK = "block long, dim int, ids binary, rows binary, values binary, kind string"


def _blocks(rows: int, scale: int):
    """Rows (id, row number, components) to blocks of one length and kind of values, one vector after another."""
    def made(block, dim, kind, held):
        ids, numbers, values = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([dim], pa.int32()),
             *(pa.array([x.tobytes()], pa.binary()) for x in (ids, numbers, values.astype(kind))), pa.array([kind])],
            ["block", "dim", "ids", "rows", "values", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: dict[tuple[int, str], list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            ids, numbers, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.asarray(vectors.value_lengths())
            flat = vectors.flatten().to_numpy().astype(float)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                plain = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                with np.errstate(over="ignore"):
                    values = np.floor(scale * plain)
                size = np.abs(values).max(axis=1)
                for kind, low, high in (("<i4", 0, WIDE), ("<i8", WIDE, HUGE), ("<f8", HUGE, np.inf)):
                    some = np.flatnonzero((size >= low) & ((size < high) | (kind == "<f8")))
                    key = dim, kind
                    while len(some):
                        now = some[:rows - sum(len(x) for x, _, _ in held.get(key, []))]
                        some = some[len(now):]
                        held.setdefault(key, []).append((ids[at[now]], numbers[at[now]], (plain if kind == "<f8" else values)[now]))
                        if sum(len(x) for x, _, _ in held[key]) == rows:
                            yield made(block, dim, kind, held.pop(key))
                            block += 1
        for (dim, kind), parts in held.items():
            yield made(block, dim, kind, parts)
            block += 1

    return run


class SlicedBlock:
    """Bit slices of a block: bitmaps over its rows for each attribute and bit."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values.astype(np.int64)
        self.numbers = numbers
        self.rows, self.dim = values.shape
        self.words = -(-self.rows // 64)
        self.low = self.values.min(axis=0)
        shifted = self.values - self.low
        self.bits = [int(x).bit_length() for x in shifted.max(axis=0)]
        self.slices = [[self._bitmap((shifted[:, d] >> b) & 1) for b in range(LOW_SLICES, n)]
                       for d, n in enumerate(self.bits)]
        self.present = self._bitmap(np.ones(self.rows, np.int64))
        self.order = np.argsort(numbers)

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.words * 8, np.uint8)
        made = np.packbits(bits.astype(np.uint8), bitorder="little")
        packed[:len(made)] = made
        return packed.view(np.uint64)

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Bit slices (queries x words) of the weighted sums of all attributes.

        An attribute enters with the size of its weight; under a negative weight with its
        complement, which adds the same constant for all rows. Slices of equal weight are reduced
        by full adders, three to one and a carry.
        """
        stacks: list[list[np.ndarray]] = []

        def add(place: int, bitmap: np.ndarray) -> None:
            while True:
                while len(stacks) <= place:
                    stacks.append([])
                stack = stacks[place]
                stack.append(bitmap)
                if len(stack) < 3:
                    return
                x, y, z = stack
                half = x ^ y
                stacks[place] = [half ^ z]
                place, bitmap = place + 1, (x & y) | (half & z)

        none, every = np.uint64(0), ~np.uint64(0)
        size = np.abs(queries)
        for d in range(self.dim):
            flip = np.where(queries[:, d] < 0, every, none)[:, None]
            weights = [(a, np.where((size[:, d] >> a) & 1, every, none)[:, None])
                       for a in range(int(size[:, d].max()).bit_length()) if ((size[:, d] >> a) & 1).any()]
            for b, bitmap in enumerate(self.slices[d]):
                signed = bitmap[None, :] ^ flip
                for a, mask in weights:
                    add(a + b, signed & mask)
        out, carry = [], None
        place = 0
        while place < len(stacks) or carry is not None:
            stack = (stacks[place] if place < len(stacks) else []) + ([carry] if carry is not None else [])
            carry = None
            if len(stack) == 3:
                half = stack[0] ^ stack[1]
                carry = (stack[0] & stack[1]) | (half & stack[2])
                stack = [half ^ stack[2]]
            elif len(stack) == 2:
                carry = stack[0] & stack[1]
                stack = [stack[0] ^ stack[1]]
            out.append(stack[0] if stack else np.zeros((len(queries), self.words), np.uint64))
            place += 1
        return out

    def top(self, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query, by its row number: its place repeated, ids and exact scores of its k best other rows.

        Going down from the highest slice, the rows with the bit are taken if k of them are
        left, else they are put aside and the search goes on among the others; that
        yields the k-th largest sum. Rows whose sum is within the weight of the low slices of it
        may belong to the result and are scored exactly; ties go to the smaller id.
        """
        queries = queries.astype(np.int64)
        sums = self.sums(queries)
        here = np.broadcast_to(self.present, (len(own), self.words)).copy()
        at = np.searchsorted(self.numbers[self.order], own)
        for i, a in enumerate(at.tolist()):
            if a < self.rows and self.numbers[row := int(self.order[a])] == own[i]:
                here[i, row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        need = np.full(len(own), k)
        tied = here
        kth = np.zeros(len(own), object)
        for place in range(len(sums) - 1, -1, -1):
            having = tied & sums[place]
            n = np.bitwise_count(having).sum(axis=1, dtype=np.int64)
            one = n >= need
            tied = np.where(one[:, None], having, tied & ~sums[place])
            need = np.where(one, need, need - n)
            kth[one] += 1 << place
        slack = (np.abs(queries) * (np.array([(1 << min(LOW_SLICES, n)) - 1 for n in self.bits]))).sum(axis=1)
        unit = 1 << LOW_SLICES
        bound = np.array([max(0, int(v) - -(-int(s) // unit)) for v, s in zip(kth, slack)], object)
        above, level = np.zeros_like(here), here.copy()
        for place in range(len(sums) - 1, -1, -1):
            one = np.array([(v >> place) & 1 for v in bound], bool)[:, None]
            above |= np.where(one, np.uint64(0), level & sums[place])
            level &= np.where(one, sums[place], ~sums[place])
        found = above | level
        for i in range(len(own)):
            rows = np.flatnonzero(np.unpackbits(found[i].view(np.uint8), bitorder="little"))
            scores = self.values[rows] @ queries[i]
            best = np.lexsort((self.ids[rows], -scores))[:k]
            yield np.full(len(best), i), self.ids[rows[best]], scores[best]


def _integers(values: np.ndarray, scale: int) -> list[int]:
    """Quantised components of a vector as Python integers; large ones have no fraction to begin with."""
    if values.dtype.kind == "i":
        return values.tolist()
    return [int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(scale * x)) for x in values.tolist()]


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """Quantised components in floating point, times a power of two that leaves no large ones."""
    exponent = -int(np.frexp(np.abs(values).max().astype(float))[1])
    if values.dtype.kind == "i":
        return np.ldexp(values.astype(float), exponent)
    near = np.abs(values) < 1 << 53
    return np.where(near, np.ldexp(np.floor(scale * np.where(near, values, 0)), exponent), np.ldexp(values, exponent) * scale)


def exact_top(ids: np.ndarray, numbers: np.ndarray, values: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int, scale: int):
    """``SlicedBlock.top`` for values of any size, scores as Python integers.

    Scores in floating point, with a bound of their error, leave the rows that may be among the k best.
    """
    x, y = _scaled(values, scale), _scaled(queries, scale)
    approx = x @ y.T
    error = (np.abs(x) @ np.abs(y).T) * (values.shape[1] + 16) * 2.0 ** -52 + 1e-280
    for i, row in enumerate(own):
        rows = np.flatnonzero(numbers != row)
        if len(rows) > k:
            low = approx[rows, i] - error[rows, i]
            rows = rows[approx[rows, i] + error[rows, i] >= np.partition(low, -k)[-k]]
        query = _integers(queries[i], scale)
        found = sorted((-sum(x * y for x, y in zip(_integers(values[r], scale), query)), int(ids[r])) for r in rows)[:k]
        yield (np.full(len(found), i), np.array([x for _, x in found], np.int64), np.array([-x for x, _ in found], object))


def _matched(k: int, scale: int):
    """Pairs of blocks to the k best rows of each query row: q_row, query_id, vec_id, over, score.

    ``over`` is the sign of a score beyond 64 bits, which stands at the end of the range, else 0.
    """
    least, most = -(1 << 63), (1 << 63) - 1

    def read(dim, ids, rows, values, kind):
        return np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(values, kind).reshape(-1, dim)

    def size(values):
        return max(16, int(np.abs(values).max())) if values.dtype.kind == "i" else SAFE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                name, dim, *parts = (batch.column(c)[r].as_py() for c in range(10))
                if name != known:
                    known, block = name, None
                    ids, numbers, values = read(dim, *parts[:4])
                q_ids, q_rows, q_values = read(dim, *parts[4:])
                safe = 2 * dim * size(values) * size(q_values) < SAFE
                if safe and block is None:
                    block = SlicedBlock(ids, numbers, values)
                for i in range(0, len(q_ids), AT_ONCE):
                    asked = q_rows[i:i + AT_ONCE], q_values[i:i + AT_ONCE]
                    found = list(block.top(*asked, k) if safe else exact_top(ids, numbers, values, *asked, k, scale))
                    at, vec_ids, scores = (np.concatenate(x) for x in zip(*found))
                    at = at + i
                    over = np.zeros(len(at), np.int64)
                    if not safe:
                        over = np.array([(x > most) - (x < least) for x in scores], np.int64)
                        scores = np.array([min(max(x, least), most) for x in scores], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_rows[at]), pa.array(q_ids[at]), pa.array(vec_ids), pa.array(over), pa.array(scores)],
                        names=["q_row", "query_id", "vec_id", "over", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id",
          vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every row that ``is_query`` marks.

    Each block of the index meets each block of queries of the same dimension once; vectors of
    different lengths have no product. A query's candidates are all rows but itself, also those that
    share its id. Vectors that are null, empty, or have null or non-finite components take no part,
    nor do rows without an id; all other vectors do, whatever their size. A score of the result
    beyond 64 bits raises an error. Equal scores rank by smaller id; rows that repeat rank each,
    and a query row that repeats has a ranking of its own. Extra columns are not read.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                            F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = numbered(chosen.where(F.col("id").isNotNull() & usable("vector")), "vectors")

    def blocks(df, number, label, spread):
        return written(df.select("id", ROW, "vector").repartition(spread).mapInArrow(_blocks(number, scale), BLOCK), label)

    index = blocks(rows, BLOCK_ROWS, "index", parts)
    asked = blocks(rows.where("asked"), QUERY_ROWS, "queries", 1 + parts // 8)
    asked = asked.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "values", "kind")])
    pairs = index.select("block", "dim").join(asked, "dim").drop("dim").withColumnRenamed("block", "b")
    met = (index.join(pairs, F.col("block") == F.col("b")).drop("b").select(
        "block", "dim", "ids", "rows", "values", "kind", "q_ids", "q_rows", "q_values", "q_kind")
           .mapInArrow(_matched(k, scale), "q_row long, query_id long, vec_id long, over long, score long"))
    order = Window.partitionBy("q_row").orderBy(F.col("over").desc(), F.col("score").desc(), "vec_id")
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", score.alias("score")))
