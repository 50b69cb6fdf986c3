"""CSV records that run over several lines, put together in every file split by itself.

Whether a line begins inside a quoted cell depends on all lines before it. But a line is a function of
that one bit, so that each split of a file is read without the others: one scan finds what every
split does to the bit, the bits at the borders follow from the splits before, and a second scan joins
the lines of each record. Only records that cross a border are gathered from two splits or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from re import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Where a record begins: its file, split, and number among the records that begin there.
PLACE = ("file", "block", "at")

#: A line of these characters alone is blank.
CONTROLS = "".join(map(chr, range(33)))


def _patterns(sep: str) -> tuple[str, str, str]:
    """Patterns of a line that opens a quoted cell and does not close it: from outside of one, and from
    inside, once the open cell is closed; and of a line that does not close the open cell.

    A cell is quoted only if it begins with a quote, so that quotes elsewhere do not count. All loops
    are possessive: nothing is tried twice, and long lines need no deep stack.
    """
    s = "\\t" if sep == "\t" else escape(sep)
    body = '(?:[^"]++|"")*+'
    opened = f'(?:(?:"{body}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"{body}$'
    return f"(?s)^{opened}", f'(?s)^{body}"[^{s}]*+{s}{opened}', f"(?s)^{body}$"


def opens_quote(line: Column, sep: str) -> Column:
    """Whether a line that begins outside of quotes ends inside a quoted cell."""
    return line.contains('"') & line.rlike(_patterns(sep)[0])


def _lines(spark: SparkSession, path: str | list[str], sep: str, encoding: str) -> DataFrame:
    """file, block, opens (from outside it ends inside), stays (from inside it ends inside), value."""
    _, reopened, unclosed = _patterns(sep)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        opens_quote(value, sep).alias("opens"),
        (~value.contains('"') | value.rlike(unclosed) | value.rlike(reopened)).alias("stays"), value.alias("value"))


def states(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line ends inside a quoted cell.

    A line sets the bit, keeps it or turns it; since the last one that set it, the turns count.
    """
    turns = np.cumsum(opens & ~stays) % 2
    setter = np.maximum.accumulate(np.where(opens == stays, np.arange(len(opens)), -1))
    before = np.where(setter >= 0, opens[setter], inside)
    return before ^ (turns != np.where(setter >= 0, turns[setter], 0))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, str, int, np.ndarray, np.ndarray, pa.Array]]:
    """Whether a part of a batch begins a file split; file, block, opens, stays and lines of the part."""
    known = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        code = files.indices.to_numpy()
        opens, stays = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in (2, 3))
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = files.dictionary[int(code[a])].as_py(), int(blocks[a])
            yield key != known, *key, opens[a:b], stays[a:b], batch.column(4).slice(a, b - a)
            known = key


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, after_outside, after_inside (the bit at the end), closes (whether an open cell ends), filled."""
    rows = []
    for begins, file, block, opens, stays, lines in _by_split(batches):
        if begins:
            rows.append([file, block, False, True, False, False])
        row = rows[-1]
        inside = states(opens, stays, row[3])
        row[2], row[3] = bool(states(opens, stays, row[2])[-1]), bool(inside[-1])
        row[4] = row[4] or not inside.all()
        row[5] = row[5] or any(x.strip(CONTROLS) for x in lines.to_pylist())
    kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                                     names=["file", "block", "after_outside", "after_inside", "closes", "filled"])


def borders(lines: DataFrame) -> tuple[dict[tuple[str, int], int], list[tuple[str, int]]]:
    """Splits that begin inside a record, with the block in which it begins; file and block of each header.

    One scan; a row for each file split comes to the driver, which planned each of them before.
    """
    facts = lines.mapInArrow(_facts, "file string, block long, after_outside boolean, after_inside boolean, "
                                     "closes boolean, filled boolean").collect()
    within, headers, known = {}, [], None
    for r in sorted(facts, key=lambda r: (r.file, r.block)):
        if r.file != known:
            known, inside, headless, owner = r.file, False, True, r.block
        if headless and r.filled:
            headless = False
            headers.append((r.file, r.block))
        if inside:
            within[r.file, r.block] = owner
        if not inside or r.closes:
            owner = r.block
        inside = r.after_inside if inside else r.after_outside
    return within, headers


def _assembled(within: dict[tuple[str, int], int]):
    """Lines to records that are not blank: file, block, at, value, and part, the split that has a part of a record
    that crosses a border, else null."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*PLACE, "value", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []  # lines of the record that is open
        split, inside, at, rest = None, False, 0, False  # rest: the open record began in an earlier split

        def open_part():
            owner = within[split] if rest else split[1]
            return split[0], owner, None if rest else at, "\n".join(held), split[1]

        for begins, file, block, opens, stays, lines in _by_split(batches):
            rows = []
            if begins:
                if held:
                    rows.append(open_part())
                split, held, at = (file, block), [], 0
                inside = rest = split in within
            values = lines.to_pylist()
            after = states(opens, stays, inside)
            first = 0
            for end in np.flatnonzero(~after).tolist():  # the lines that end a record
                lone = end == first and not held
                held += values[first:end + 1]
                if rest:
                    rows.append(open_part())
                elif not lone or values[end].strip(CONTROLS):
                    rows.append((file, block, at, values[end] if lone else "\n".join(held), None))
                    at += 1
                first, held, rest = end + 1, [], False
            held += values[first:]
            inside = bool(after[-1])
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([open_part()])

    return run


def read_records(spark: SparkSession, path: str | list[str], sep: str, encoding: str) -> tuple[str, DataFrame]:
    """The header of the files, and file, block, at, value of all other records that are not blank.

    Records end with a line feed outside of quoted cells; a carriage return before it goes, while line
    breaks inside of cells stay as they are. A quote that is never closed takes the rest of its file.
    """
    lines = _lines(spark, path, sep, encoding)
    within, headers = borders(lines)
    made = lines.mapInArrow(_assembled(within), "file string, block long, at long, value string, part long")
    # a record that crosses borders has as many parts as splits that it touches
    crossing = made.where("part IS NOT NULL").groupBy("file", "block").agg(
        F.max("at").alias("at"), F.array_sort(F.collect_list(F.struct("part", "value"))).alias("parts"))
    joined = crossing.select(*PLACE, F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    records = made.where("part IS NULL").select(*PLACE, "value").unionByName(joined) if within else made.select(*PLACE, "value")
    records = records.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    heads = F.broadcast(spark.createDataFrame([(*h, 0) for h in headers], "file string, block long, at long"))  # a row for each file
    header = records.join(heads, list(PLACE)).select("value").first()
    return header.value if header else "", records.join(heads, list(PLACE), "left_anti")
