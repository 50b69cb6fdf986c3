"""Repeated passages by prefix-free parsing: phrases, their dictionary, and the order of what is left.

Every window of ``match`` bytes picks one trigger, the gram inside it with the least rolling hash,
so equal windows pick equal triggers at equal places. A phrase is the stretch of text whose
windows share a trigger; every window lies in exactly one phrase. Equal phrases are one entry of
the dictionary: all but the first are repeated as a whole. Windows of two different phrases can
only be equal if they share the trigger, so a phrase whose trigger occurs in no other phrase is
settled. The others are gathered by trigger with their bytes, and their windows are put in order: by
fingerprint of the window, then by place in the corpus. A trigger with very many phrases would
make one task large; the windows of those phrases are dealt out by fingerprint instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window, functions as F

from frameprobe.llm.arrays import CHUNK_BYTES, SpanHash, bytes_of, mix64
from frameprobe.llm.tables import ROW, numbered, settled, small, written

#: Bytes of a trigger.
GRAM = 24

#: Bytes of text that a task parses before it hands on its phrases.
HELD_BYTES = 16 << 20

#: Phrases of one trigger that are gathered in one place: from one task's text, and from all.
HOT_HERE, HOT_IN_ALL = 64, 4_096

#: Buckets of phrases for each shuffle partition, and bytes of text for a bucket: what a task holds at a time.
BUCKETS, BUCKET_BYTES = 8, 4 << 20

#: Documents without an id come after all others, as one id.
LAST = np.iinfo(np.int64).max

# A place in a document in 64 bits: start, number of windows, and the text's number among those of its doc_id.
START, COUNT = np.uint64(33), np.uint64(26)
MARKS = 1 << 26

PHRASE = np.dtype([("trigger", "<u4"), ("phrase", "<u8"), ("doc", "<i8"), ("place", "<u8")])
PLACE = np.dtype([("low", "<u8"), ("high", "<u8"), ("doc", "<i8"), ("place", "<u8")])

TEXT = np.dtype([("trigger", "<u4"), ("doc", "<i8"), ("place", "<u8")])

PHRASES, TEXTS, WINDOWS, REMOVED, OPEN, OPEN_HOT = range(6)

# What a record without windows says of its trigger: its phrases are sent with their bytes, or as windows.
HAS_TEXTS, IS_HOT = 0, 1
RESULT = "kind int, bucket int, doc long, mark int, start long, end long, data binary"


def _place(start: np.ndarray, count: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return (start.astype(np.uint64) << START) | (count.astype(np.uint64) << COUNT) | mark.astype(np.uint64)


def _start(place: np.ndarray) -> np.ndarray:
    return (place >> START).astype(np.int64)


def _count(place: np.ndarray) -> np.ndarray:
    return ((place >> COUNT) & np.uint64(127)).astype(np.int64)


def _mark(place: np.ndarray) -> np.ndarray:
    return (place & np.uint64(MARKS - 1)).astype(np.int64)


def in_order(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by keys and place; which of them have an equal entry at an earlier place,
    and which stand for all at the earliest one."""
    order = np.lexsort((place, doc, *reversed(keys)))
    n = len(order)
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    doc, place = doc[order], place[order]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    later = (doc != doc[first]) | (_start(place) != _start(place)[first])
    again = np.zeros(n, bool)
    again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
    return order, later, ~later & ~again


def _rows(kind: int, doc, place, ends) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int32()), pa.array(doc),
         pa.array(_mark(place).astype(np.int32)), pa.array(_start(place)), pa.array(ends), pa.nulls(n, pa.binary())],
        names=["kind", "bucket", "doc", "mark", "start", "end", "data"])


def _data_rows(kind: int, buckets: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(buckets.astype(np.int32)), none, pa.nulls(n, pa.int32()),
         none, none, pa.array(blobs, pa.binary())],
        names=["kind", "bucket", "doc", "mark", "start", "end", "data"])


def _blobs(kind: int, bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    cuts = np.append(starts, len(order))
    records = records[order]
    return _data_rows(kind, names, [records[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])


def _removed(doc: np.ndarray, place: np.ndarray, match: int) -> pa.RecordBatch:
    """Stretches that overlap or touch as one."""
    order = np.lexsort((place, _mark(place), doc))
    doc, place = doc[order], place[order]
    start, mark = _start(place), _mark(place)
    end = start + _count(place) - 1 + match
    new = np.ones(len(doc), bool)
    # counts of windows are bounded, so ends grow with starts up to that bound; a running maximum per document
    base = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])) if len(doc) else doc
    reach = np.maximum.accumulate(end + (base << 33)) - (base << 33) if len(doc) else end
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    ends = reach[np.append(at[1:] - 1, len(doc) - 1)] if len(doc) else end
    return _rows(REMOVED, doc[at], place[at], ends)


def parsed(data: np.ndarray, offsets: np.ndarray, match: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrases of the texts: first window, number of windows, trigger, hash of the phrase."""
    width = match - gram + 1
    n = len(data)
    if n < match:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    hashes = SpanHash(data, 2)
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[:len(key) - (width - size)], key[width - size:])
    inside = np.ones(len(key), bool)
    for end in offsets[1:-1]:
        inside[max(0, end - match + 1):end] = False
    starts = np.flatnonzero(inside)
    picked = (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    new = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (np.diff(starts) != 1)]))
    counts = np.diff(np.append(new, len(starts)))
    first = starts[new]
    return first, counts, mix64(grams[picked[new]]), hashes.of(first, first + counts - 1 + match)


def windows(data: np.ndarray, at: np.ndarray, counts: np.ndarray, match: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Window fingerprints (two 64-bit halves) of phrases that begin at ``at``: low, high, phrase, nth window."""
    step = max(1, CHUNK_BYTES // (2 * match))
    for i in range(0, len(at), step):
        some, number = at[i:i + step], counts[i:i + step]
        sizes = number - 1 + match
        ends = np.cumsum(sizes)
        begin = ends - sizes
        own = np.repeat(np.arange(len(some)), sizes)
        text = data[np.arange(ends[-1]) - begin[own] + some[own]]
        of = np.repeat(np.arange(len(some)), number)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
        start = begin[of] + nth
        yield SpanHash(text, 3).of(start, start + match), SpanHash(text, 4).of(start, start + match), of + i, nth


def _window_rows(data, at, counts, doc, place, match: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows of phrases: removed where an earlier one is here, else for their bucket."""
    for low, high, of, nth in windows(data, at, counts, match):
        where = _place(_start(place[of]) + nth, np.ones(len(of), np.int64), _mark(place[of]))
        order, later, stay = in_order([low, high], doc[of], where)
        gone = order[later]
        yield _removed(doc[of][gone], where[gone], match)
        held = order[stay]
        records = np.empty(len(held), PLACE)
        records["low"], records["high"], records["doc"], records["place"] = low[held], high[held], doc[of][held], where[held]
        yield _blobs(WINDOWS, (low[held] >> np.uint64(20)) % np.uint64(buckets), records)


class _Held:
    """Parsed text of a task until it is handed on."""

    def __init__(self, match: int, gram: int, buckets: int):
        self.match, self.gram, self.buckets = match, gram, buckets
        self.texts, self.parts, self.size = [], [], 0

    def add(self, doc: np.ndarray, mark: np.ndarray, base: np.ndarray, data: np.ndarray, offsets: np.ndarray,
            most: int | None = None) -> None:
        """Texts ``doc`` that begin at byte ``base`` of their documents; ``most`` bounds the windows."""
        first, counts, trigger, phrase = parsed(data, offsets, self.match, self.gram)
        if most is not None:
            counts = np.minimum(counts, most - first)
            ok = counts > 0
            first, counts, trigger, phrase = first[ok], counts[ok], trigger[ok], phrase[ok]
            cut = first + counts == most  # its hash covers what was cut off; such a phrase equals none
            phrase = np.where(cut, mix64(phrase + np.uint64(1)), phrase)
        text = np.searchsorted(offsets, first, "right") - 1
        self.parts.append((trigger, phrase, doc[text], _place(first - offsets[text] + base[text], counts, mark[text]),
                           self.size + first))
        self.texts.append(data)
        self.size += len(data)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        trigger, phrase, doc, place, at = (np.concatenate(x) for x in zip(*self.parts))
        data = np.concatenate(self.texts)
        self.texts, self.parts, self.size = [], [], 0
        order, later, stay = in_order([trigger, phrase], doc, place)
        gone, held = order[later], order[stay]
        yield _removed(doc[gone], place[gone], self.match)
        trigger, phrase, doc, place, at = (x[held] for x in (trigger, phrase, doc, place, at))
        several, number = _shared(trigger, phrase)
        hot = several & (number > HOT_HERE)
        own = np.flatnonzero(hot)
        yield from _window_rows(data, at[own], _count(place[own]), doc[own], place[own], self.match, self.buckets)
        own = np.flatnonzero(several & ~hot)
        yield from _text_rows(data, at[own], trigger[own], doc[own], place[own], self.match, self.buckets)
        if not len(trigger):
            return
        lead = several & np.concatenate([[True], trigger[1:] != trigger[:-1]])
        phrase = np.where(several, np.where(hot, np.uint64(IS_HOT), np.uint64(HAS_TEXTS)), phrase)
        place = np.where(several, np.uint64(0), place)
        send = ~several | lead
        records = np.empty(int(send.sum()), PHRASE)
        low = trigger & LOW
        records["trigger"], records["phrase"], records["doc"], records["place"] = low[send], phrase[send], doc[send], place[send]
        yield _blobs(PHRASES, _bucket(trigger[send], self.buckets), records)


LOW = np.uint64(0xFFFFFFFF)


def _bucket(trigger: np.ndarray, buckets: int) -> np.ndarray:
    return (trigger >> np.uint64(32)) % np.uint64(buckets)


def _gathered(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of stretches of ``data``, one after another."""
    begin = np.cumsum(sizes) - sizes
    return data[np.arange(int(sizes.sum())) + np.repeat(at - begin, sizes)]


def _text_rows(data, at, trigger, doc, place, match: int, buckets: int, bucket=None) -> Iterator[pa.RecordBatch]:
    """Phrases with their bytes for the bucket of their trigger: number, TEXT records, bytes."""
    if not len(at):
        return
    bucket = _bucket(trigger, buckets) if bucket is None else bucket
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    blobs = []
    for part in np.split(order, starts[1:]):
        records = np.empty(len(part), TEXT)
        records["trigger"], records["doc"], records["place"] = trigger[part] & LOW, doc[part], place[part]
        text = _gathered(data, at[part], _count(place[part]) - 1 + match)
        blobs.append(np.int64(len(part)).tobytes() + records.tobytes() + text.tobytes())
    yield _data_rows(TEXTS, names, blobs)


def _texts(blobs: list[bytes], match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TEXT records, their bytes one after another, and where each begins."""
    records, texts = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        records.append(np.frombuffer(blob, TEXT, n, 8))
        texts.append(np.frombuffer(blob, np.uint8, offset=8 + n * TEXT.itemsize))
    records = np.concatenate(records)
    sizes = _count(records["place"]) - 1 + match
    return records, np.concatenate(texts), np.cumsum(sizes) - sizes


def _shared(trigger: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the trigger of an entry occurs with more than one phrase, and with how many; sorted by both."""
    if not len(trigger):
        return np.zeros(0, bool), np.zeros(0)
    group = np.cumsum(np.concatenate([[True], trigger[1:] != trigger[:-1]])) - 1
    differs = np.concatenate([[False], (trigger[1:] == trigger[:-1]) & (phrase[1:] != phrase[:-1])])
    number = np.bincount(group, differs)[group]
    return number > 0, number + 1


def _parse(match: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(match, gram, buckets)
        for batch in batches:
            doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            data, offsets = bytes_of(batch.column(2))
            i, n = 0, len(doc)
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
                if offsets[j] - offsets[i] <= CHUNK_BYTES:
                    held.add(doc[i:j], mark[i:j], np.zeros(j - i, np.int64), data[offsets[i]:offsets[j]].copy(),
                             offsets[i:j + 1] - offsets[i])
                else:  # one long text, in stretches that share match - 1 bytes
                    for a in range(offsets[i], offsets[j], CHUNK_BYTES):
                        part = data[a:min(a + CHUNK_BYTES + match - 1, offsets[j])].copy()
                        held.add(doc[i:j], mark[i:j], np.array([a - offsets[i]]), part,
                                 np.array([0, len(part)]), CHUNK_BYTES)
                        if held.size >= HELD_BYTES:
                            yield from held.flush()
                if held.size >= HELD_BYTES:
                    yield from held.flush()
                i = j
        yield from held.flush()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]) -> Iterator[tuple | pa.RecordBatch]:
    """(bucket, blobs of each of ``kinds``) of a sorted partition; rows of other kinds as they are."""
    bucket, parts = None, None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        other = np.flatnonzero(~np.isin(kind, kinds))
        if len(other):
            yield batch.take(pa.array(other))
        for i in np.flatnonzero(np.isin(kind, kinds)):
            name = batch.column("bucket")[int(i)].as_py()
            if parts is None or name != bucket:
                if parts is not None:
                    yield bucket, *parts
                bucket, parts = name, [[] for _ in kinds]
            parts[kinds.index(int(kind[i]))].append(batch.column("data")[int(i)].as_py())
    if parts is not None:
        yield bucket, *parts


def _settle_phrases(match: int, buckets: int):
    """Phrases of each trigger: repeated ones are removed, those of triggers with one phrase are done."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_bucket(batches, (PHRASES, TEXTS)):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            bucket, phrases, texts = found
            records = np.concatenate([np.frombuffer(x, PHRASE) for x in phrases])
            sign = _count(records["place"]) == 0
            marked = records["trigger"][sign]
            hot = marked[records["phrase"][sign] == IS_HOT]
            trigger, phrase, doc, place = (records[c][~sign].copy() for c in PHRASE.names)
            order, later, stay = in_order([trigger, phrase], doc, place)
            gone, held = order[later], order[stay]
            yield _removed(doc[gone], place[gone], match)
            trigger, phrase, doc, place = (x[held] for x in (trigger, phrase, doc, place))
            several, number = _shared(trigger, phrase)
            hot = np.union1d(hot, trigger[number > HOT_IN_ALL])
            unsettled = several | np.isin(trigger, marked)
            for kind, some in ((OPEN_HOT, unsettled & np.isin(trigger, hot)), (OPEN, unsettled & ~np.isin(trigger, hot))):
                rows = _rows(kind, doc[some], place[some], (trigger[some].astype(np.int64) << 7) | _count(place[some]))
                yield rows.set_column(1, "bucket", pa.array(np.full(rows.num_rows, bucket, np.int32)))
            if texts:
                records, data, at = _texts(texts, match)
                warm = np.isin(records["trigger"], hot)
                for some in (np.flatnonzero(warm),):
                    yield from _window_rows(data, at[some], _count(records["place"][some]), records["doc"][some],
                                            records["place"][some], match, buckets)
                some = np.flatnonzero(~warm)
                yield from _text_rows(data, at[some], records["trigger"][some].astype(np.uint64), records["doc"][some],
                                      records["place"][some], match, buckets, np.full(len(some), bucket))

    return run


def _settle_windows(match: int):
    """Windows of gathered phrases, and windows dealt out by fingerprint: all but the first are removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, blobs in _by_bucket(batches, (TEXTS, WINDOWS)):
            if blobs:
                records = np.concatenate([np.frombuffer(x, PLACE) for x in blobs])
                doc, place = records["doc"].copy(), records["place"].copy()
                order, later, _ = in_order([records["low"].copy(), records["high"].copy()], doc, place)
                yield _removed(doc[order[later]], place[order[later]], match)
            if texts:
                records, data, at = _texts(texts, match)
                order = np.argsort(records["trigger"], kind="stable")
                new = np.flatnonzero(np.diff(records["trigger"][order], prepend=-1))
                cuts = [0, *new[np.searchsorted(new, np.arange(TOGETHER, len(order), TOGETHER), "right") - 1], len(order)]
                for a, b in zip(cuts, cuts[1:]):
                    some = order[a:b]
                    if not len(some):
                        continue
                    low, high, of, nth = (np.concatenate(x) for x in zip(*windows(
                        data, at[some], _count(records["place"][some]), match)))
                    place, doc = records["place"][some][of], records["doc"][some][of]
                    where = _place(_start(place) + nth, np.ones(len(of), np.int64), _mark(place))
                    order_, later, _ = in_order([low, high], doc, where)
                    yield _removed(doc[order_[later]], where[order_[later]], match)

    return run


#: Phrases whose windows are ordered at a time; those of one trigger stay together.
TOGETHER = 5_000


def _open_windows(match: int, buckets: int):
    """Texts with their open phrases (kind, bucket, start, end) to rows with their bytes or windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                some = batch.slice(first, 1000)
                data, offsets = bytes_of(some.column("text"))
                lists = some.column("phrases")
                row = np.repeat(np.arange(some.num_rows), np.asarray(lists.value_lengths()))
                flat = lists.flatten()
                kind, bucket, start, end = (flat.field(i).to_numpy() for i in range(4))
                doc = some.column("doc").to_numpy()[row]
                mark = some.column("mark").to_numpy()[row]
                place, at = _place(start, end & 127, mark), offsets[row] + start
                warm = np.flatnonzero(kind == OPEN_HOT)
                yield from _window_rows(data, at[warm], end[warm] & 127, doc[warm], place[warm], match, buckets)
                cold = np.flatnonzero(kind == OPEN)
                yield from _text_rows(data, at[cold], (end[cold] >> 7).astype(np.uint64), doc[cold], place[cold],
                                      match, buckets, bucket[cold])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by document and start, merged where they overlap or touch."""
    now = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_numpy().tolist() for c in ("doc", "mark", "start", "end"))):
            if now and now[:2] == list(row[:2]) and row[2] <= now[3]:
                now[3] = max(now[3], row[3])
            else:
                if now:
                    out.append(now)
                now = list(row)
        if out:
            yield _merged(out)
    if now:
        yield _merged([now])


def _merged(rows: list[list[int]]) -> pa.RecordBatch:
    doc, mark, start, end = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(mark, pa.int32()), pa.array(start, pa.int64()),
                                       pa.array(end, pa.int64())], names=["doc", "mark", "start", "end"])


def _keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc, mark, doc_id, text of the rows, written once, and the bytes of all texts.

    ``doc`` gives the order of documents, and ``mark`` numbers the distinct texts of a doc_id: equal rows
    share both, all others differ. Nearly all marks are 0; the others are found by counts for each
    written part, so that rows of one doc_id, or without one, need not come into one task. Rows without
    a doc_id come last; from MARKS texts of them on, in blocks of that many.
    """
    seen = Observation()
    rows = numbered(docs.select("doc_id", "text").observe(seen, F.sum(F.octet_length("text")).alias("bytes")), "texts")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    ids = rows.select(doc.alias("doc"), ROW, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    several = ids.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    texts = settled(ids.join(several, "doc"))
    leads = texts.groupBy("doc", "digest").agg(F.min(ROW).alias("lead")).withColumn("part", F.shiftright("lead", 33))
    earlier = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = leads.groupBy("doc", "part").agg(F.count("*").alias("n")).select(
        "doc", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    nth = F.col("base") + F.row_number().over(Window.partitionBy("doc", "part").orderBy("lead")) - 1
    numbers = leads.join(bases, ["doc", "part"]).select("doc", "digest", nth.alias("nth")).where("nth > 0")
    marks = small(texts.join(numbers, ["doc", "digest"]).select(ROW, "nth"))
    block = F.when(F.col("nth") < MARKS, F.lit(0)).when(F.col("doc_id").isNull(), F.shiftright("nth", 26)).otherwise(
        F.raise_error(F.lit(f"more than {MARKS} texts of one doc_id")).cast("long"))
    keyed = rows.join(marks, ROW, "left").withColumn("nth", F.coalesce("nth", F.lit(0).cast("long"))).select(
        (doc - block).alias("doc"), F.col("nth").bitwiseAND(MARKS - 1).cast("int").alias("mark"), "doc_id", "text")
    return keyed, seen.get["bytes"] or 0


def repeated_spans(keyed: DataFrame, size: int, match: int = 100, gram: int = GRAM) -> DataFrame:
    """doc, mark, spans: the maximal runs of bytes that an earlier ``match``-byte string repeats.

    ``keyed`` has doc, mark and text, ``size`` bytes in all.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts * BUCKETS, size // BUCKET_BYTES)
    parse = keyed.select("doc", "mark", "text").mapInArrow(_parse(match, gram, buckets), RESULT)
    # rows that need no bucket stay spread over all of them
    spread = F.coalesce("bucket", F.pmod(F.hash("doc", "start"), F.lit(buckets)))
    settled_phrases = written(parse.repartition(parts, spread).sortWithinPartitions("bucket")
                              .mapInArrow(_settle_phrases(match, buckets), RESULT), "phrases")
    unsettled = (settled_phrases.where(F.col("kind").isin(OPEN, OPEN_HOT)).groupBy("doc", "mark")
                 .agg(F.collect_list(F.struct("kind", "bucket", "start", "end")).alias("phrases")))
    texts = keyed.join(settled(unsettled), ["doc", "mark"]).select("doc", "mark", "text", "phrases")
    made = written(texts.mapInArrow(_open_windows(match, buckets), RESULT), "windows")
    kinds = F.col("kind").isin(TEXTS, WINDOWS)
    every = settled_phrases.where(kinds).unionByName(made.where(kinds))
    last = (every.repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_settle_windows(match), RESULT))
    gone = (settled_phrases.where(F.col("kind") == REMOVED).unionByName(made.where(F.col("kind") == REMOVED))
            .unionByName(last).select("doc", "mark", "start", "end"))
    merged = (gone.repartition(parts, "doc", "mark").sortWithinPartitions("doc", "mark", "start", "end")
              .mapInArrow(_merge, "doc long, mark int, start long, end long"))
    return merged.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def deduplicated(docs: DataFrame, match: int = 100, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end), kept_sha256 and, if asked for, kept (binary).

    Texts are UTF-8 bytes, null is empty. A byte goes if a ``match``-byte string over it also
    starts earlier: at a smaller doc_id, or an earlier byte of the same doc_id. Rows that repeat a
    doc_id are one document by that rule, but judged each by its own bytes; equal starts are not
    earlier, so equal rows are judged alike. Rows without a doc_id come last, as one document (from
    MARKS of them on, as one for every MARKS). Texts shorter than ``match`` are kept; very long ones are
    parsed in stretches. Extra columns are not read; a table without rows gives none.
    """
    keyed, size = _keyed(docs)
    spans = repeated_spans(keyed, size, match)
    joined = keyed.join(settled(spans), ["doc", "mark"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    schema += ", kept binary" * with_kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            removed, digests, all_kept = [], [], []
            for i, found in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                left, done = [], 0
                for s in found or ():
                    left.append(text[done:s["start"]])
                    done = s["end"]
                kept = b"".join([*left, text[done:]]) if left else text
                removed.append(len(text) - len(kept))
                digests.append(sha256(kept).hexdigest())
                all_kept.append(kept)
            arrays = [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), batch.column(2), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            if with_kept:
                arrays.append(pa.array(all_kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, schema).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")))
