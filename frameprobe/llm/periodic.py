"""Periodic runs of words: a suffix automaton whose link tree is kept by link-cut access."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from frameprobe.llm.arrays import chunks, spans
from frameprobe.llm.tables import short_batches

#: A run is at least this long, and at least this many times its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period.

    The suffix automaton takes one word after another. Its link tree is cut into paths of states
    that ended last at the same place, each a splay tree ordered by length (``left``, ``right``,
    ``up``; ``up`` of a path's root is the state above the path; ``last`` counts at the root).
    Access from the state of the whole prefix turns all paths above it into one that ends here.
    On the way, a path that ended ``period`` words ago and whose longest state here has ``size``
    words tells that the last ``size + period`` words have this period, and no longer stretch up
    to here has. The end before was the latest one, so that the period is the smallest of a stretch of
    LEAST_EXPONENT periods. The same start and period, met again at each further word, extend a run.
    """
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    left, right, up, last = [-1], [-1], [-1], [-1]
    found: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if p < 0:
                return
            x_left = left[p] == x
            if not x_left and right[p] != x:
                return
            g = up[p]
            top = p
            if g >= 0 and (left[g] == p or right[g] == p):
                top = g
                above = up[g]
                if (left[g] == p) == x_left:  # the parent goes over the grandparent first
                    if x_left:
                        left[g] = c = right[p]
                        right[p] = g
                    else:
                        right[g] = c = left[p]
                        left[p] = g
                    if c >= 0:
                        up[c] = g
                    up[g] = p
                    if x_left:
                        left[p] = c = right[x]
                        right[x] = p
                    else:
                        right[p] = c = left[x]
                        left[x] = p
                    if c >= 0:
                        up[c] = p
                    up[p] = x
                else:
                    if x_left:
                        left[p] = c = right[x]
                        right[g] = d = left[x]
                        right[x], left[x] = p, g
                    else:
                        right[p] = c = left[x]
                        left[g] = d = right[x]
                        left[x], right[x] = p, g
                    if c >= 0:
                        up[c] = p
                    if d >= 0:
                        up[d] = g
                    up[p] = up[g] = x
            else:
                above = g
                if x_left:
                    left[p] = c = right[x]
                    right[x] = p
                else:
                    right[p] = c = left[x]
                    left[x] = p
                if c >= 0:
                    up[c] = p
                up[p] = x
            up[x] = above
            if above >= 0:
                if left[above] == top:
                    left[above] = x
                elif right[above] == top:
                    right[above] = x
                else:
                    last[x] = last[top]
                    return
            else:
                last[x] = last[top]
                return

    state = 0
    for i, word in enumerate(words):
        new = len(link)
        follow.append({})
        length.append(length[state] + 1)
        link.append(0)
        for column in (left, right, up, last):
            column.append(-1)
        p = state
        while p >= 0 and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if p >= 0:
            q = follow[p][word]
            if length[q] != length[p] + 1:
                clone = len(link)  # a state between q and the state above it, which ended where q did
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                splay(q)
                right.append(-1)
                last.append(-1)
                c = left[q]
                left.append(c)
                if c >= 0:
                    up[c] = clone
                up.append(q)
                left[q] = clone
                link[q] = clone
                while p >= 0 and follow[p].get(word) == q:
                    follow[p][word] = clone
                    p = link[p]
                q = clone
            link[new] = q
        up[new] = link[new]
        state = new
        # access: every path above the new state is cut below its longest state here, and joined to one
        below, x = new, link[new]
        while x > 0:
            splay(x)
            end = last[x]
            period, size = i - end, length[x]
            if size >= (LEAST_EXPONENT - 1) * period and size + period >= LEAST_LENGTH:
                found[i - period - size + 1, period] = i
            cut = right[x]
            if cut >= 0:
                last[cut] = end
            right[x] = below
            below, x = x, up[x]
        if x == 0:
            splay(0)
            cut = right[0]
            if cut >= 0:
                last[cut] = last[0]
            right[0] = below
            below = 0
        last[below] = i
    return sorted((start, i - start + 1, period) for (start, period), i in found.items())


def where_to_look(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the sequences that hold all runs: starts, ends, index of the sequence.

    In a run of period q, all words but the first q have appeared at most q words before, and there
    are LEAST_EXPONENT - 1 times q of these at least. For q between two powers of two, the
    stretches of such words, with as many words before, hold all runs whole.
    """
    n = len(codes)
    index = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((codes, index)) if n else np.zeros(0, np.int64)
    same = (codes[order][1:] == codes[order][:-1]) & (index[order][1:] == index[order][:-1])
    back = np.full(n, n + 1)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    edges = np.zeros(n + 1, np.int64)
    longest = int(np.diff(offsets).max()) if len(offsets) > 1 else 0
    most, fewest = 1, 1  # periods of this round
    while LEAST_EXPONENT * fewest <= longest:
        starts, ends, _ = spans(back > most, offsets)
        long = ends - starts >= max(LEAST_LENGTH - most, (LEAST_EXPONENT - 1) * fewest)
        starts, ends = starts[long], ends[long]
        np.add.at(edges, np.maximum(starts - most, offsets[index[starts]]), 1)
        np.add.at(edges, ends, -1)
        most, fewest = 2 * most, most + 1
    return spans(np.cumsum(edges[:-1]) == 0, offsets)


def _found(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each text."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = [t.split() for t in texts]
    codes = np.array([c for w in words for c in map(number.__getitem__, w)], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for a, b, k in zip(*(x.tolist() for x in where_to_look(codes, offsets))):
        first = a - int(offsets[k])
        runs.setdefault(k, []).extend((first + s, n, p) for s, n, p in runs_of(codes[a:b].tolist()))
    for k, w in enumerate(words):
        here = runs.get(k, [])
        if here:
            stay = np.ones(len(w), bool)
            for start, n, period in here:
                stay[start + period:start + n] = False
            w = [w[i] for i in np.flatnonzero(stay)]
        yield here, b" ".join(w)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, runs (start, length, period), collapsed: the runs of words of each text.

    Words are separated by the blank and the characters 9 to 13, and numbered from 0. A run is a
    stretch of words with smallest period q, at least LEAST_LENGTH and LEAST_EXPONENT times q
    long, that no neighbour extends; ``runs`` is ordered by start, then period. Runs of different
    periods may overlap and start at one word. ``collapsed`` has the words that no run holds
    after its first q, joined by one blank.

    A null text is empty: no runs and an empty text; so is a text of white space. Each row is a
    document of its own, with or without key, also where rows repeat. Very long texts are
    searched whole; memory grows with the words of the longest text. Extra columns are not
    read. A table without rows gives none.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(key, text)
    schema = StructType([rows.schema.fields[0], StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                runs, collapsed = zip(*_found([raw[a:b] for a, b in zip(at, at[1:])]))
                flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in runs])])
                values = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(struct))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(runs)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                     pc.cast(pa.array(collapsed, pa.large_binary()), pa.large_string()).cast(pa.string())],
                    names=[key, "runs", "collapsed"])

    return rows.mapInArrow(run, schema)
