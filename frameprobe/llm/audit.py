"""What filters remove together: survival words of documents, counted by carry-save adders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from frameprobe.llm.tables import short_batches, small, written

# The filters, and the limits of the first three.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
SYMBOLS = b"#$%&*|"

SUBSETS = 1 << len(FILTERS)
EVERY = SUBSETS - 1

#: A text whose copies are at least this share of all rows is joined by broadcast: there are 1,000 such at most.
HOT_SHARE = 1_000

#: Partial counts that a task holds; beyond, it hands them on.
HELD_COUNTS = 10_000

#: Words of a text up to this many bytes are listed at once, of a longer one found one by one.
LISTED_BYTES = 1 << 22

_UPPER = bytes(range(65, 91))
_INNER = bytes(range(128, 192))  # bytes of a character after its first
_WORD = re.compile(rb"[^ \t-\r]+")


def _words(text: bytes) -> tuple[int, int]:
    """Words and distinct words; white space is the blank and the characters 9 to 13."""
    if len(text) <= LISTED_BYTES:
        words = text.split()
        return len(words), len(set(words))
    n, distinct = 0, set()
    for m in _WORD.finditer(text):
        n += 1
        distinct.add(m[0])
    return n, len(distinct)


def failed(text: bytes) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    n, distinct = _words(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))
    return (n < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * n) << 1 | (100 * upper > MOST_UPPER * points) << 2 | (
        len(text.translate(None, SYMBOLS)) < len(text)) << 3


#: For each set of failed filters the word whose bit s is 1 if a document survives the subset s of filters.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` have each of the 32 bits, by carry-save adders.

    Three words of one weight make one of it, their sum without carries, and one of twice the
    weight, the carries. At most two words of each weight are left, whose bits are counted.
    """
    out = np.zeros(32, np.int64)
    weight, words = 1, words.astype(np.uint32)
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            x, y, z = words[:third], words[third:2 * third], words[2 * third:3 * third]
            half = x ^ y
            carries.append((x & y) | (half & z))
            words = np.concatenate([half ^ z, words[3 * third:]])
        out += weight * ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return out


def _facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, failed filters A to D of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fails = [], []
            for value in batch.column("text").cast(pa.large_binary()):
                text = value.as_py() or b""
                digests.append(sha256(text).digest())
                fails.append(failed(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(fails, pa.int32())],
                names=["doc_id", "part", "digest", "fails"])

    short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(
        run, f"doc_id {kind}, part string, digest binary, fails int")


def _with_copies(facts: DataFrame) -> DataFrame:
    """``facts`` with bit 4 of ``fails`` where the same text has a smaller doc_id.

    Only texts that occur twice are joined. Those with many copies, few by arithmetic, come by
    broadcast, so that no task gets all copies of a text.
    """
    total = facts.count()
    texts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    texts = written(texts.withColumn("hot", F.col("n") * HOT_SHARE > total), "copied")
    hot = small(texts.where("hot").select("digest", "first"), HOT_SHARE)
    later = (F.col("doc_id") > F.col("first")).cast("int") * 16
    rest = facts.join(hot, "digest", "left_anti").join(texts.where("not hot").select("digest", "first"), "digest", "left")
    both = facts.join(hot, "digest").unionByName(rest)
    return both.select("doc_id", "part", (F.col("fails") + F.coalesce(later, F.lit(0))).alias("fails"))


def _with_labels(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """``facts`` with ``label``: 1 for quality 1, plus 2 for toxic 1, in any row of ``labels`` for the document."""
    def is_one(column: str):
        return F.max(F.coalesce(F.col(column) == 1, F.lit(False)).cast("int"))

    by_id = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        (is_one("quality") + 2 * is_one("toxic")).alias("label")).where("label > 0")
    known = facts.where("doc_id IS NOT NULL").join(by_id, "doc_id", "left")
    return known.select("part", "fails", F.coalesce("label", F.lit(0)).alias("label")).unionByName(
        facts.where("doc_id IS NULL").select("part", "fails", F.lit(0).alias("label")))


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, label (all, good, toxic), survivors: for every subset of the filters the documents that it keeps.

    ``survivors`` is an array; element s + 1 belongs to the subset with the bits of s, bit 0 for A.
    Every part has three rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed():
            rows = [(part, label, held[part][i]) for part in held for i, label in enumerate(("all", "good", "toxic"))]
            held.clear()
            part, label, counts = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(label), pa.array(list(counts), pa.list_(pa.int64()))], names=["part", "label", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("part").dictionary_encode()
            part, label = coded.indices.to_numpy(), batch.column("label").to_numpy()
            words = SURVIVAL[batch.column("fails").to_numpy()]
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(len(coded.dictionary) + 1))
            for i, name in enumerate(coded.dictionary.to_pylist()):
                here = order[cuts[i]:cuts[i + 1]]
                word, kind = words[here], label[here]
                counts = np.stack([positional_popcount(w) for w in (word, word[kind & 1 > 0], word[kind & 2 > 0])])
                held[name] = held[name] + counts if name in held else counts
            if len(held) > HELD_COUNTS:
                yield handed()
        if held:
            yield handed()

    facts = _with_labels(_with_copies(written(_facts(docs), "facts")), labels)
    partial = facts.mapInArrow(run, "part string, label string, counts array<bigint>")
    sums = partial.groupBy("part", "label").agg(*[F.sum(F.col("counts")[s]).alias(f"n{s}") for s in range(SUBSETS)])
    return sums.select("part", "label", F.array(*[f"n{s}" for s in range(SUBSETS)]).alias("survivors"))


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, subset before the step, bit of its filter) of all orders and steps."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(FILTERS[j] for j in order), step, before, 1 << i))
            before |= 1 << i
    return rows


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters, by letter: A under 200 words, B under half of the words distinct, C over 3 % capital
    letters, D a symbol, E a text that a smaller doc_id has. Each document's word of surviving
    subsets is counted bit by bit, and every number is a difference of such counts. A part is a
    language, null as the empty string; each has all 120 orders of 5 steps.

    A null text is empty: it fails A. A row without doc_id has no smaller or larger one, hence it
    passes E, and has no label. Rows that repeat a doc_id are documents each and do not make each
    other copies, being no smaller; a label counts if any row of the labels for the document has it.
    Very long texts are read whole, word by word. Extra columns of both tables are not read. An
    empty table has no parts and gives no rows.
    """
    steps = _orders()
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    order, step, before, bit = zip(*steps)
    before, bit = np.array(before), np.array(bit)
    orders_of = {s: factorial(bin(s).count("1")) * factorial(len(FILTERS) - 1 - bin(s).count("1")) for s in range(EVERY)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *kinds in zip(*(batch.column(c).to_pylist() for c in ("part", "all", "good", "toxic"))):
                n, good, toxic = (np.array(k, np.int64) for k in kinds)
                removed = n[before] - n[before | bit]
                shapley = {b: sum(orders_of[s] * (n[s] - n[s | b]) for s in range(SUBSETS) if not s & b) for b in set(bit.tolist())}
                columns = [order, step, n[before | bit], removed, n[0] - n[bit] - removed, n[EVERY ^ bit] - n[EVERY],
                           good[before] - good[before | bit], toxic[before] - toxic[before | bit], [shapley[b] for b in bit.tolist()]]
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps), pa.string()), *map(pa.array, columns, kinds)], names=["part", *names])

    wide = survivors(docs, labels).groupBy("part").agg(
        *[F.max(F.when(F.col("label") == x, F.col("survivors"))).alias(x) for x in ("all", "good", "toxic")])
    return wide.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                "unique_fails long, good_lost long, toxic_lost long, shapley long")
