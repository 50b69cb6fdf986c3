"""Best-fit packing: bin completion over the histogram of piece lengths."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from frameprobe.llm.tables import short_batches, small, written

#: Tokens of a sequence.
CAPACITY = 2048

#: Steps that the search for fillings may take in all; the best packing so far stands then.
SEARCH_STEPS = 1_500_000

#: Words of a worker's cache from words to ids, in two generations: words that come again move to the young one,
#: which takes the place of the old one when it is half of this.
CACHE_WORDS = 600_000

#: New words that are encoded as one string, and about the bytes of texts that are encoded at a time.
JOINED_WORDS, CHUNK_BYTES = 500, 4 << 20

Ids = bytes  # little-endian 32-bit


class _Known(dict):
    """Ids of words, in two generations."""

    def __init__(self, limit: int = CACHE_WORDS):
        super().__init__()
        self.old: dict[str, Ids] = {}
        self.limit = limit

    def missing(self, words: Iterable[str]) -> set[str]:
        """The words without ids; those of the old generation become young again."""
        left = [w for w in words if w not in self]
        old = self.old.get
        again = [(w, ids) for w in left if (ids := old(w)) is not None]
        self.update(again)
        return set(left).difference([w for w, _ in again])

    def age(self) -> None:
        if 2 * len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class _Encoder:
    """Ids of texts by a tokenizers file, with the ids of single words kept.

    The pattern of byte-level files cuts before a blank that something else than white space
    follows, and around a single line break between other characters. So the words between single
    blanks can be encoded apart, or many new ones in one string, in which a token that begins with
    a blank begins a word. Texts with runs of blanks, a blank at the end, or an added token are
    encoded whole.
    """

    _open: dict[str, "_Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.later = _Known(), _Known()
        self.comma, self.stop, self.line = self._raw([",", ".", "\n"])
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        blank = self.tokenizer.id_to_token(self.tokenizer.encode(" ", add_special_tokens=False).ids[0])[0]
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for name, i in names.items() if name.startswith(blank)]] = True

    @classmethod
    def at(cls, path: str) -> "_Encoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _raw(self, texts: list[str]) -> list[Ids]:
        return [pack(f"<{len(e)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], mark: str) -> Iterator[Ids]:
        """Ids of each word after a ``mark``, a blank or a line break, which the words do not hold."""
        line = np.frombuffer(self.line, "<u4")
        for i in range(0, len(words), JOINED_WORDS):
            group = words[i:i + JOINED_WORDS]
            ids = self._raw([mark + mark.join(group)])[0]
            flat = np.frombuffer(ids, "<u4")
            at = np.flatnonzero(self.begins[flat] if mark == " " else flat == line[0]) * 4
            if len(at) == len(group) and len(line) == 1:
                skip = 0 if mark == " " else 4
                for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)]):
                    yield ids[a + skip:b]
            else:  # white space that the pattern joins with the mark
                yield from self._raw([" " + w if mark == " " else w for w in group])

    def _learn(self, heads: Iterable[str], tails: Iterable[str]) -> None:
        """Give ids to words at the beginning of a text or line, and to words after a blank."""
        new = self.later.missing(tails)
        lines = {w: w.split("\n") for w in new if "\n" in w}
        lines = {w: p for w, p in lines.items() if len(p) > 1 and p == w.split()}
        heads = self.first.missing({*heads, *(x for p in lines.values() for x in p[1:])})
        broken = [w for w in heads if len(w.split()) != 1]
        self.first.update(zip(broken, self._raw(broken)))
        heads = list(heads.difference(broken))
        self.first.update(zip(heads, self._joined(heads, "\n")))
        new = (new - lines.keys()) | self.later.missing(p[0] for p in lines.values())
        # letters and one mark are two tokens' worth of text for the pattern, so the letters are encoded once
        ended = [w for w in new if w[-1:] in (",", ".") and w[:-1].isalpha()]
        plain = list(new.difference(ended) | self.later.missing([w[:-1] for w in ended]))
        self.later.update(zip(plain, self._joined(plain, " ")))
        self.later.update((w, self.later[w[:-1]] + (self.comma if w[-1] == "," else self.stop)) for w in ended)
        self.later.update((w, self.later[p[0]] + b"".join(self.line + self.first[x] for x in p[1:])) for w, p in lines.items())

    def _apart(self, texts: pa.Array) -> Iterator[Ids]:
        """Ids of texts whose words can be encoded apart: each distinct word is looked up once."""
        parts = pc.split_pattern(texts, " ")
        begins = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        heads = pc.list_element(parts, 0).to_pylist()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        self._learn(heads, words)
        held = [*map(self.later.__getitem__, words), *map(self.first.__getitem__, heads)]
        self.first.age()
        self.later.age()
        code = coded.indices.to_numpy().copy()
        code[begins[:-1]] = len(words) + np.arange(len(heads))
        table = np.frombuffer(b"".join(held), "<u4")
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        n = sizes[code]
        ends = np.cumsum(n)
        at = np.arange(ends[-1], dtype=np.int32 if max(ends[-1], len(table)) < 1 << 31 else np.int64)
        at += np.repeat(((np.cumsum(sizes) - sizes)[code] - ends + n).astype(at.dtype), n)
        flat = table[at].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[begins]).tolist()
        return (flat[a:b] for a, b in zip(cuts, cuts[1:]))

    def __call__(self, texts: pa.Array) -> list[Ids]:
        """Ids of each text; null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " "))
        for added in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, added))
        apart = texts.filter(pc.invert(whole))
        made = [self._apart(apart) if len(apart) else iter(()), iter(self._raw(texts.filter(whole).to_pylist()))]
        return [next(made[w]) for w in whole.to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows anew in batches of about CHUNK_BYTES of text each, a row at least."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + (not held), int(np.searchsorted(ends, done + CHUNK_BYTES - size, "right")))
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1] - done)
            if last < batch.num_rows:
                yield joined()
                held, size = [], 0
            first = last
    if held:
        yield joined()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
           with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for), part, rank of every piece.

    The first piece of a longer document takes what is left over, so all others are full.
    ``rank`` numbers the pieces of one length inside ``part``, the task that made them.
    """
    schema = "doc_id {}, piece int, start long, length long, ids_crc32 long, part int, rank long".format(
        docs.schema["doc_id"].dataType.simpleString()) + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _Encoder.at(tokenizer), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for some in _chunks(batches, 1):
            rows = []
            for i, ids in enumerate(encode(some.column(1))):
                ids += end
                n = len(ids) // 4
                start = 0
                for k in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if k == 0 else capacity
                    cut = ids[4 * start:4 * (start + length)]
                    rows.append((i, k, start, length, zlib.crc32(cut), seen[length], cut))
                    seen[length] += 1
                    start += length
            at, k, start, length, crc, rank, cut = zip(*rows)
            arrays = [some.column(0).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                      pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                      pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(c, "<i4") for c in cut], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


Packing = list[tuple[list[int], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing over lengths: (lengths of a bin, number of such bins)."""
    open_bins: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []

    def put(room, held, number):
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_bins[room].append((held, number))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_right(rooms, length - 1)
            if k < len(rooms):
                room = rooms[k]
                held, number = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(k)
            else:
                room, held, number = capacity, [], left
            each = room // length
            full = min(number, left // each)
            rest = min(left - full * each, each - 1) if full < number else 0
            if full:
                put(room - each * length, held + [length] * each, full)
            if rest:
                put(room - rest * length, held + [length] * rest, 1)
            if number - full - bool(rest) and held:
                put(room, held, number - full - bool(rest))
            left -= full * each + rest
    return [(held, n) for group in open_bins.values() for held, n in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each t up to half a bin, the lengths above capacity - t are
    alone, those above half a bin are apart, and the lengths from t on fill what those leave."""
    number = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        number[length] = n
    count, size = np.cumsum(number), np.cumsum(number * np.arange(capacity + 1))
    half = capacity // 2
    least = -(-int(size[-1]) // capacity)
    for t in range(1, half + 1):
        middle = int(count[capacity - t] - count[half])
        room = middle * capacity - int(size[capacity - t] - size[half])
        rest = int(size[half] - size[t - 1]) - room
        least = max(least, int(count[-1] - count[half]) + max(0, -(-rest // capacity)))
    return least


class _Search:
    """Steps that are left."""

    def __init__(self, steps: int):
        self.steps = steps


def fillings(room: int, lengths: list[int], counts: dict[int, int], waste: int, search: _Search) -> Iterator[list[int]]:
    """Undominated fillings of ``room`` that waste ``waste`` at most, fullest first.

    One length that fits dominates every shorter one and every set that it outweighs, so sets
    count only above the longest length that fits. ``lengths`` ascend. The sums that the first j
    lengths can make, as bits of one number for each j, keep the search for a sum off dead ends.
    """
    fit = lengths[:bisect_right(lengths, room)]
    longest = fit[-1] if fit else 0
    all_sums = (1 << (room + 1)) - 1
    sums = [1]
    for a in fit:
        now, left, step = sums[-1], min(counts[a], room // a), 1
        while left:
            step = min(step, left)
            now |= (now << (a * step)) & all_sums
            left -= step
            step *= 2
        sums.append(now)
    search.steps -= len(fit) + 1

    def exact(total: int, j: int) -> Iterator[list[int]]:
        search.steps -= 1
        if total == 0:
            yield []
            return
        for i in range(min(j, bisect_right(fit, total)) - 1, -1, -1):  # the longest length of the rest
            a = fit[i]
            for k in range(min(counts[a], total // a), 0, -1):
                if (sums[i] >> (total - k * a)) & 1:
                    for more in exact(total - k * a, i):
                        yield [a] * k + more
            if not (sums[i] >> total) & 1:
                return

    for total in range(room, max(longest, room - waste) - 1, -1):
        if (sums[-1] >> total) & 1:
            yield from exact(total, len(fit))


#: Fillings of a bin that the first pass of the search looks at, each in as many bins at once as the counts allow.
FIRST_FILLINGS = 3


def complete_bins(counts: dict[int, int], capacity: int, steps: int = SEARCH_STEPS) -> Packing:
    """Bins for all lengths by bin completion, branch and bound.

    The longest length left is completed by its fillings in turn. The first pass takes one of the
    first FIRST_FILLINGS, in as many bins at once as the counts allow. Where its tree runs out,
    passes of limited discrepancy follow: the k-th filling costs k, each bin less costs 1, and a
    path may cost 1, 2, 4 and so on, until a pass left nothing out. A branch ends when the
    waste of its bins exceeds what one bin less than the incumbent would leave. The incumbent
    starts as best-fit decreasing; a dive whose steps run out is finished by best fit. The
    search ends at the lower bound, after a whole pass, or after ``steps`` steps.
    """
    best = best_fit(counts, capacity)
    least, search, budget = lower_bound(counts, capacity), _Search(steps), 0
    whole = not counts
    while not whole and search.steps > 0 and sum(n for _, n in best) > least:
        best, whole = _pass(counts, capacity, least, best, search, budget)
        budget = max(1, 2 * budget)
    return best


def _pass(counts: dict[int, int], capacity: int, least: int, best: Packing, search: _Search, budget: int) -> tuple[Packing, bool]:
    """The best packing after one pass of the search, and whether the pass left nothing out.

    ``budget`` is what a path may cost; 0 stands for the first pass.
    """
    total = sum(k * n for k, n in counts.items())
    most = sum(n for _, n in best)
    left, lengths = dict(counts), sorted(counts)
    done: Packing = []
    bins = wasted = spent = 0
    whole = True
    stack: list[Iterator[tuple[list[int], int, int]]] = []
    costs: list[int] = []

    def allowed() -> int:
        return (most - 1) * capacity - total - wasted

    def first_choices(longest: int) -> Iterator[tuple[list[int], int, int]]:
        """(bin, how many of it, 0) for the first fillings."""
        nonlocal whole
        left[longest] -= 1
        fits = lengths if left[longest] else lengths[:-1]
        options = list(islice(fillings(capacity - longest, fits, left, max(0, allowed()), search), FIRST_FILLINGS))
        left[longest] += 1
        whole = whole and len(options) < FIRST_FILLINGS

        def taken():
            nonlocal whole
            for filling in options:
                held = [longest, *filling]
                number = min(left[a] // held.count(a) for a in set(held))
                whole = whole and number == 1
                number = number if number * (capacity - sum(held)) <= allowed() else 1
                yield held, number if number * (capacity - sum(held)) <= allowed() else 0, 0

        return taken()

    def choices(longest: int, room: int) -> Iterator[tuple[list[int], int, int]]:
        """(bin, how many of it, cost) of all fillings within ``room``."""
        nonlocal whole
        rest = dict(left)
        rest[longest] -= 1
        fits = lengths if rest[longest] else lengths[:-1]
        for i, filling in enumerate(fillings(capacity - longest, fits, rest, max(0, allowed()), search)):
            if i > room:
                whole = False
                return
            held = [longest, *filling]
            waste = capacity - sum(held)
            number = min(left[a] // held.count(a) for a in set(held))
            for cost in range(number):
                if i + cost > room:
                    whole = False
                    break
                if (number - cost) * waste <= allowed():
                    yield held, number - cost, i + cost

    def open_next() -> None:
        stack.append(choices(lengths[-1], budget - spent) if budget else first_choices(lengths[-1]))

    def take(held: list[int], number: int, sign: int) -> None:
        nonlocal bins, wasted
        for a in held:
            left[a] -= sign * number
        for a in set(held):
            if left[a] == 0 and sign > 0:
                lengths.remove(a)
            elif sign < 0 and left[a] > 0 and (not (k := bisect_right(lengths, a)) or lengths[k - 1] != a):
                lengths.insert(bisect_right(lengths, a), a)
        bins += sign * number
        wasted += sign * number * (capacity - sum(held))

    def undo() -> None:
        nonlocal spent
        take(*done.pop(), -1)
        spent -= costs.pop()

    open_next()
    while stack and most > least:
        if search.steps <= 0:
            rest = best_fit({a: n for a, n in left.items() if n}, capacity)
            if bins + sum(n for _, n in rest) < most:
                best = done + rest
            return best, False
        choice = next(stack[-1], None)
        search.steps -= 1
        if choice is None:
            stack.pop()
            if done:
                undo()
            continue
        held, number, cost = choice
        if not number:
            continue
        done.append((held, number))
        costs.append(cost)
        spent += cost
        take(held, number, 1)
        if not lengths:
            best, most = list(done), bins
            undo()
        else:
            open_next()
    return best, whole


def places(packing: Packing) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length a bin, offset), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for held, number in packing:
        offset = 0
        for length in sorted(set(held), reverse=True):
            each = held.count(length)
            rows.append((length, used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + each * number
            offset += each * length
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
           with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece.

    Documents are their ids and ``end_id``; null and empty texts are ``end_id`` alone. Only
    documents beyond ``capacity`` are cut. Pieces of one length are interchangeable, so bins are
    found for the counts of lengths, at most ``capacity`` numbers on the driver whatever
    the input, and a piece finds its bin by its rank among those of its length. Repeated
    rows are packed each.
    """
    short_batches(docs.sparkSession)
    table = written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    parts = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = places(complete_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = small(parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base")))
    ranked = table.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    result = ranked.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1 << 48)
        keys = plan[:, 0] * shift + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length * shift + rank, "right") - 1]
            nth = rank - row[:, 1]
            arrays = [batch.column(c) for c in names]
            arrays += [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, result.schema)
