"""Quality rules: repetition inside a text, and lines that many documents of a host share."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from frameprobe.llm.arrays import chunks, mix64, words
from frameprobe.llm.tables import ROW, guarded, map_texts, numbered, settled, small

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Lines are compared in lower case (A-Z), digits as 0, runs of white space as one blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))

#: Words of a window, for repetition inside a text.
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINE = StructType([StructField("line", LongType()), StructField("whole", LongType()), StructField("words", LongType())])


def _repeated(text: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows, by their first words ``at``, that occur again in the same text.

    They are sorted by a hash and neighbours compared word by word; should two windows of one hash
    differ, they are sorted by their words instead.
    """
    key = mix64(text[at].astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        key = mix64(key + word[at + k].astype(np.uint64) * np.uint64(2 * k + 3))

    def neighbours(order: np.ndarray) -> np.ndarray:
        a, b = at[order[:-1]], at[order[1:]]
        equal = text[a] == text[b]
        for k in range(WINDOW):
            equal &= word[a + k] == word[b + k]
        return equal

    order = np.argsort(key, kind="stable")
    equal = neighbours(order)
    if (equal != (key[order[1:]] == key[order[:-1]])).any():
        order = np.lexsort([*(word[at + k] for k in range(WINDOW)), text[at]])
        equal = neighbours(order)
    again = np.zeros(len(at), bool)
    again[order[1:]] = equal
    again[order[:-1]] |= equal
    return at[again]


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each text, as rows; words and lines are compared by their bytes."""
    n = len(offsets) - 1
    out = np.zeros((len(COUNTS), n), np.int64)
    starts, ends, text = words(data, offsets)
    out[0] = np.bincount(text, minlength=n)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    out[1] = np.bincount(text, leads[ends] - leads[starts], n).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(SYMBOLS[data], dtype=np.int64)])
    out[2] = sums[offsets[1:]] - sums[offsets[:-1]]
    raw, cuts = data.tobytes(), offsets.tolist()
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    codes = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        out[3, i] = len(lines) - len(set(lines))
        codes.append(np.fromiter(map(number.__getitem__, raw[a:b].split()), np.int64, int(out[0, i])))
    if len(starts) >= WINDOW:
        last = len(starts) - WINDOW + 1
        at = _repeated(text, np.concatenate(codes), np.flatnonzero(text[:last] == text[WINDOW - 1:]))
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        out[4] = np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def _digest(data: bytes) -> int:
    return int.from_bytes(md5(data).digest()[:8], "big")


def folded_lines(text: bytes) -> dict[int, tuple[int, int]]:
    """hash of each normalised line with a word -> (words in all its copies, hash of the document).

    The hash of a document is that of the set of its lines, so copies of one document count once
    when documents are counted, and documents that differ in any line count each.
    """
    found: dict[int, int] = {}
    for line in text.translate(FOLD).split(b"\n"):
        if parts := line.split():
            key = _digest(b" ".join(parts))
            found[key] = found.get(key, 0) + len(parts)
    whole = _digest(b"".join(k.to_bytes(8, "big") for k in sorted(found)))
    return {k: (n, whole) for k, n in found.items()}


def _scan(column: pa.Array) -> list:
    parts, lists = [], []
    for _, data, offsets in chunks(column):
        parts.append(counts(data, offsets))
        raw = data.tobytes()
        lists += [folded_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    made = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
    flat = [(k, w, n) for found in lists for k, (n, w) in found.items()]
    table = np.array([x[:2] for x in flat], np.uint64).reshape(-1, 2).view(np.int64)
    lines = pa.StructArray.from_arrays(
        [table[:, 0].copy(), table[:, 1].copy(), np.array([x[2] for x in flat], np.int64)], ["line", "whole", "words"])
    starts = np.cumsum([0, *map(len, lists)])
    return [*made, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines)]


def judged(docs: DataFrame, host: str = "source", least_words: int = 20, most_repeated: int = 30,
           line_share: float = 0.005, least_documents: int = 10, least_left: float = 0.3,
           drop_text: bool = True, with_lines: bool = False) -> DataFrame:
    """Every row of ``docs`` with the COUNTS, base_failed, removed_words and kept.

    A text fails the base rules with fewer than ``least_words`` words or more than
    ``most_repeated`` percent of them in repeated windows. A line is above the limit of its host
    if more than ``line_share`` of the host's documents, and more than ``least_documents``, hold it;
    such lines are removed, and a document with less than ``least_left`` of its words left is
    rejected. Documents of the same lines count once (see ``folded_lines``), among those that hold a line
    and among those of the host: copies neither make boilerplate nor hide it. A null text is empty and fails; a null
    host is a host of its own; repeated rows are judged alike. ``with_lines`` adds __gone, the hashes
    of a row's lines above the limit, null if it has none.
    """
    fields = [StructField(c, LongType()) for c in COUNTS]
    wanted = docs.drop(*COUNTS, "base_failed", "removed_words", "kept")
    scan = numbered(map_texts(wanted, "text", [*fields, StructField("__lines", ArrayType(LINE))], _scan, drop_text), "quality")
    lines = scan.select(F.col(host).alias("host"), ROW, F.explode("__lines").alias("l")).select("host", ROW, "l.*")
    contents = scan.select(F.col(host).alias("host"), F.try_element_at("__lines", F.lit(1))["whole"].alias("whole")).distinct()
    sizes = small(contents.groupBy("host").agg(F.count("*").alias("documents")))
    common = (lines.select("host", "line", "whole").distinct().groupBy("host", "line")
              .agg(F.count("*").alias("holders")).where(F.col("holders") > least_documents))
    above = small(common.join(sizes.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
                  .where(F.col("holders") > line_share * F.col("documents")).select(F.col("host").alias("h"), F.col("line").alias("x")))
    gone = [F.collect_list("line").alias("__gone")] * with_lines
    removed = (lines.join(above, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("x")))
               .groupBy(ROW).agg(F.sum("words").alias("removed_words"), *gone))
    if with_lines:  # rows of any width: no size to broadcast by
        removed = settled(removed)
    else:
        removed = small(removed)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words") >= least_left * F.col("n_words")
    return (scan.drop("__lines").join(removed, ROW, "left").drop(ROW)
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
            .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & left))


def without(text: str, gone: set[int]) -> str:
    """``text`` without the lines whose hash is in ``gone``."""
    raw = text.encode("utf-8")
    pairs = zip(raw.split(b"\n"), raw.translate(FOLD).split(b"\n"))
    return b"\n".join(line for line, plain in pairs if _digest(b" ".join(plain.split())) not in gone).decode("utf-8")


def kept(docs: DataFrame, host: str = "source", **settings) -> DataFrame:
    """The rows of ``docs`` that the rules keep, texts without the lines above the limit."""
    rows, back = guarded(docs, "text", host)
    found = judged(rows, host, drop_text=False, with_lines=True, **settings).where("kept").select(*rows.columns, "__gone")
    names = rows.columns
    at, hashes = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if not g.is_valid else without(t.as_py(), {x % (1 << 64) for x in g.as_py()})
                     for t, g in zip(batch.column(at), batch.column(hashes))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(hashes)], names=names)

    return back(found.mapInArrow(run, rows.schema))
