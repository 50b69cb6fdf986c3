"""Secrets by corpus-wide ownership of candidate values."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from hashlib import md5
from math import log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, IntegerType, LongType, StringType, StructField, StructType)

from frameprobe.llm.tables import ROW, guarded, map_texts, numbered, small

# The patterns of the kinds that are always reported, and the order of all kinds.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "loose")

#: Which texts to look at closer, in one linear scan each.
HINTS = (r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=]""", r"AKIA[A-Z0-9]{16}",
         r"[0-9a-f]{24}", r"[A-Za-z0-9+/_=-]{20}")

#: A value outside any pattern: this long, of three kinds of characters, of this entropy a character.
LOOSE = r"[A-Za-z0-9+/_=-]{20,}"
LOOSE_BITS = 3.5

SPAN = StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()),
                   StructField("end", IntegerType()), StructField("value", LongType())])

_assign, _access, _hex, _loose = (re.compile(x, re.ASCII) for x in (ASSIGN, ACCESS, HEX, LOOSE))


def value_hash(value: str) -> int:
    return int.from_bytes(md5(value.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


def looks_random(value: str) -> bool:
    """Upper case, lower case and digits, with LOOSE_BITS or more bits a character."""
    if not (any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)
            and any("0" <= c <= "9" for c in value)):
        return False
    n = len(value)
    return -sum(k / n * log2(k / n) for k in Counter(value).values()) >= LOOSE_BITS


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, hash of the value) of the kinds that are always reported, by start."""
    found = [(0, m.start(), m.end(), value_hash(m[1])) for m in _assign.finditer(text) if len(m[1]) >= 6]
    found += [(1, m.start(), m.end(), value_hash(m[0])) for m in _access.finditer(text)]
    found += [(2, m.start(), m.end(), value_hash(m[0])) for m in _hex.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def loose_spans(text: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Random-looking values that no base span touches."""
    out, ends = [], sorted((s[1], s[2]) for s in taken)
    for m in _loose.finditer(text):
        if looks_random(m[0]):
            k = bisect_right(ends, (m.end() - 1, 1 << 62))
            if not any(e > m.start() for _, e in ends[:k]):
                out.append((3, m.start(), m.end(), value_hash(m[0])))
    return out


def _scan(column: pa.Array) -> list:
    texts = pc.fill_null(column, "")
    hits = [pc.match_substring_regex(texts, x).to_numpy(zero_copy_only=False) for x in HINTS]
    base, loose = [[] for _ in texts], [[] for _ in texts]
    for i in (hits[0] | hits[1] | hits[2] | hits[3]).nonzero()[0]:
        text = texts[int(i)].as_py()
        base[i] = base_spans(text)
        loose[i] = loose_spans(text, base[i]) if hits[3][i] else []
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                               ("value", pa.int64())]))

    def listed(rows):
        return pa.array([[dict(zip(("kind", "start", "end", "value"), s)) for s in r] for r in rows], kind)

    return [listed(base), listed(loose)]


def scanned(docs: DataFrame, drop_text: bool) -> DataFrame:
    """The rows, numbered and written, with their base and loose spans."""
    fields = [StructField("__base", ArrayType(SPAN)), StructField("__loose", ArrayType(SPAN))]
    return numbered(map_texts(docs, "text", fields, _scan, drop_text), "secrets")


def ownership(scan: DataFrame, owner: str, repository: str) -> DataFrame:
    """value, owners, repositories, hits of every candidate value of the corpus.

    Each value is reduced to one row per owner and repository before it is counted, so a value
    that a third of the rows hold costs one row per task, owner and repository.
    """
    spans = scan.select(F.col(owner).alias("owner"), F.col(repository).alias("repository"),
                        F.explode(F.concat("__base", "__loose")).alias("s"))
    each = spans.groupBy(F.col("s.value").alias("value"), "owner", "repository").agg(F.count("*").alias("hits"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("hits").alias("hits"))
    return by_owner.groupBy("value").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("hits").alias("hits"))


def verdict(most_owners: int, most_repositories: int) -> Column:
    """live for values of few owners and repositories, example for widely copied ones."""
    few = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    return F.when(few, "live").otherwise("example")


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = 2,
            most_repositories: int = 10, drop_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``spans``: kind, start, end, value, class, by start and kind.

    Base kinds are always reported, as live or example. A loose value (random-looking, matched
    by no base pattern) is reported only if it is live: at most ``most_owners`` owners and
    ``most_repositories`` repositories in the whole corpus hold it. A null text is empty; a null
    owner or repository counts as one of its own; repeated rows are reported each. Positions
    are code points, end exclusive. ``text`` is left out unless ``drop_text`` is false.
    """
    scan = scanned(docs, drop_text)
    verdicts = small(ownership(scan, owner, repository)
                     .select("value", verdict(most_owners, most_repositories).alias("class")))
    marked = (scan.select(ROW, F.explode(F.concat("__base", "__loose")).alias("s"))
              .select(ROW, "s.*").join(verdicts, "value")
              .where((F.col("kind") < KINDS.index("loose")) | (F.col("class") == "live")))
    by_row = small(marked.groupBy(ROW).agg(F.array_sort(F.collect_list(
        F.struct("start", "kind", "end", "value", "class"))).alias("spans")), weight=1 + F.size("spans"))
    empty = F.expr("filter(array(named_struct('start', 0, 'kind', 0, 'end', 0, 'value', 0L, 'class', '')), x -> false)")
    return (scan.drop("spans").join(by_row, ROW, "left").drop(ROW, "__base", "__loose")
            .withColumn("spans", F.coalesce("spans", empty)))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, mark: str = "<SECRET>", owner: str = "source", repository: str = "doc_id",
           **settings) -> DataFrame:
    """``docs`` with each span replaced by ``mark``; overlapping spans by one mark."""
    rows, back = guarded(docs, "text", owner, repository)
    found = secrets(rows, owner, repository, drop_text=False, **settings)
    where = [f.name for f in found.schema.fields]
    at = where.index("text")

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(where.index("spans"))
            for i in pc.greater(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False).nonzero()[0]:
                out, done, text = [], 0, texts[i]
                for s in spans[int(i)].as_py():
                    if s["start"] >= done:
                        out += [text[done:s["start"]], mark]
                    done = max(done, s["end"])
                texts[i] = "".join([*out, text[done:]])
            arrays = [pa.array(texts, pa.string()) if k == at else batch.column(k)
                      for k, name in enumerate(where) if name != "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n in where if n != "spans"])

    return back(found.mapInArrow(run, found.drop("spans").schema))
