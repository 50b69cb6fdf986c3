"""SimHash near duplicates: pivot distance tables over fingerprints, and linked components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField
from xxhash import xxh64_intdigest

from frameprobe.llm.arrays import bytes_of
from frameprobe.llm.tables import ROW, guarded, map_texts, numbered, settled, small

#: A-Z to lower case, and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Reference fingerprints: seeded random ones, the same in every run.
PIVOTS = 16

#: Fingerprints that share a block key are compared with one another up to this many.
BLOCK_ROWS = 1_000


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of all shingles; 0 for a text without words."""
    parts = text.translate(LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(parts) - width + 1)
    ends = ends[-k:].tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[:k].tolist(), ends)), np.uint64, k)
    ones = np.zeros(64, np.int64)
    for i in range(0, k, 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > k, bitorder="little").tobytes(), "little")


def _scan(column: pa.Array) -> list:
    data, offsets = bytes_of(column)
    raw = data.tobytes()
    found = [fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return [np.array(found, np.uint64).view(np.int64)]


def fingerprinted(docs: DataFrame, drop_text: bool = True) -> DataFrame:
    """The rows, numbered and written, with ``__fp``."""
    return numbered(map_texts(docs, "text", [StructField("__fp", LongType())], _scan, drop_text), "simhash")


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 64, n, dtype=np.uint64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def with_pivot_table(prints: DataFrame) -> DataFrame:
    """``prints`` (fp) with ``table``: its distance to each pivot, one byte each."""
    schema = "fp long, table binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = pivots()
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            table = _distance(fp[:, None], reference[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in table], pa.binary())], ["fp", "table"])

    return prints.select("fp").mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) as one pair (member, smallest member) for all but one member of a component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(names))
    return names[own], names[root[own]]


def close_pairs(key: np.ndarray, fp: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one key at ``most`` or fewer differing bits, as a forest.

    By the triangle inequality such fingerprints differ by ``most`` at most in their distance to
    any pivot. Sorted by the first distance, each one meets those ahead of it while that
    holds; the other distances discard pairs before the bits are compared.
    """
    order = np.lexsort((table[:, 0], key))
    key, fp, table = key[order], fp[order], table[order].astype(np.int16)
    left, out_a, out_b = np.arange(len(fp)), [], []
    lag = 1
    while len(left):
        left = left[left + lag < len(fp)]
        right = left + lag
        near = (key[left] == key[right]) & (table[right, 0] - table[left, 0] <= most)
        left, right = left[near], right[near]
        a, b = left, right
        for p in range(1, table.shape[1]):
            if not len(a):
                break
            ok = np.abs(table[a, p] - table[b, p]) <= most
            a, b = a[ok], b[ok]
        ok = _distance(fp[a], fp[b]) <= most
        out_a.append(fp[a[ok]])
        out_b.append(fp[b[ok]])
        if lag % 64 == 0:
            out_a, out_b = ([x] for x in _forest(np.concatenate(out_a), np.concatenate(out_b)))
        lag += 1
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(out_a), np.concatenate(out_b))


def _linked_blocks(most: int):
    def links(key, fp, table):
        a, b = close_pairs(key, fp.view(np.uint64), table, most)
        return pa.RecordBatch.from_arrays([a.view(np.int64), b.view(np.int64)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(),
                   np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on
            if cut:
                yield links(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held is not None:
            yield links(*held)

    return run


def links(prints: DataFrame, most: int = 2) -> DataFrame:
    """Edges a, b between distinct fingerprints that connect all that lie within ``most`` bits.

    ``most`` bits that differ leave one of most + 1 bands of bits untouched, so fingerprints
    meet under the value of a band and are compared by pivot tables. A band value of more than
    BLOCK_ROWS fingerprints (variants of one text) takes another exact way, for ``most`` = 2:
    its members meet under the 65 values within one bit of them, which two fingerprints share
    if and only if they lie within two bits; at most 65 meet at one value. Whole groups of
    equal fingerprints are one fingerprint here.
    """
    if most != 2:
        raise ValueError("links are defined for 2 differing bits")
    spark = prints.sparkSession
    tables = settled(with_pivot_table(prints))
    edges = [0, 21, 42, 64]
    keys = F.array(*[F.shiftrightunsigned(F.col("fp"), a).bitwiseAND(F.lit((1 << (b - a)) - 1))
                     .bitwiseOR(F.lit(i << 22)) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    banded = tables.select(F.explode(keys).alias("key"), "fp", "table")
    sizes = settled(banded.groupBy("key").count().where("count > 1"))
    large = small(sizes.where(F.col("count") > BLOCK_ROWS).select("key"))
    blocks = (banded.join(sizes.where(F.col("count") <= BLOCK_ROWS).select("key"), "key")
              .select("key", "fp", "table"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = (blocks.repartition(parts, "key").sortWithinPartitions("key")
            .mapInArrow(_linked_blocks(most), "a long, b long"))
    ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    members = banded.join(large, "key", "left_semi").select("fp").distinct()
    met = (members.select("fp", F.explode(ball).alias("near")).groupBy("near")
           .agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
           .select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b"))
    return near.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its smallest reachable node) for the nodes of edges a, b that aren't roots.

    Alternating stars: first every larger neighbour, then every smaller one, is linked to the
    smallest neighbour, until nothing changes. Smallest neighbours come from aggregates that
    combine before the shuffle; the joins back are plain joins that Spark splits where skewed.
    """
    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = state(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        low = low.select("n", F.least("n", "m").alias("m"))
        large = (both.join(low, F.col("a") == F.col("n")).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = settled(large)
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        linked = large.join(low, F.col("a") == F.col("n"))
        after = settled(linked.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        found = state(after)
        now = after
        if found == mark:
            break
        mark = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(scan: DataFrame) -> DataFrame:
    """fp, component_id (smallest doc_id of its component; null if no row has one)."""
    prints = settled(scan.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least")))
    roots = settled(components(links(prints)))
    rooted = (prints.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    lowest = (rooted.join(roots.select("root").distinct(), "root", "left_semi")
              .groupBy("root").agg(F.min("least").alias("component_id")))
    return (rooted.join(lowest, "root", "left")
            .select("fp", F.coalesce("component_id", "least").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows are
    reported each. Rows with a null doc_id link others but never name a component.
    """
    scan = fingerprinted(docs.select("doc_id", "text"))
    found = classes(scan)
    return (scan.join(found, F.col("__fp") == F.col("fp"))
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that with its smallest doc_id (of repeated rows, one)."""
    rows, back = guarded(docs, "doc_id", "text")
    scan = fingerprinted(rows, drop_text=False)
    found = classes(scan)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    names = found.select(F.col("fp").alias("__f"), "component_id")
    # rows that stay: per fingerprint first, then per component
    first = scan.groupBy("__fp").agg(F.min(rank).alias("r"))
    stays = (first.join(names, F.col("__fp") == F.col("__f"))
             .groupBy(F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("__fp").cast("string"))))
             .agg(F.min("r").alias("r")).select(F.col(f"r.{ROW}").alias(ROW)))
    gone = small(scan.select(ROW).join(stays, ROW, "left_anti"))
    return back(scan.join(gone, ROW, "left_anti"))
