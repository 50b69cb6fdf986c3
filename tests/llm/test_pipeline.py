"""Every stage, and the whole run, against plain Python."""

import math
import random
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from . import test_mixing, test_quality, test_secrets, test_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kept boolean, spans string, size long"


def table_of(rows):
    return [(i, t, "en", s, len(t or ""), True, "x", 7) for i, t, s in rows]


def corpus():
    r = random.Random(11)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))

    banner = prose(12)
    rows = []
    for i in range(60):
        lines = [prose(r.randrange(5, 30)) for _ in range(r.randrange(1, 5))]
        if r.random() < 0.4:
            lines.insert(r.randrange(len(lines)), banner.upper() if r.random() < 0.5 else "  " + banner)
        if r.random() < 0.3:
            lines.append(r.choice(["password: {}", "see {} there", "secret={}"]).format(r.choice(["q9Xw7Rt2Lm4Zk8Vb3Nc6Ty1", f"Z{i}kT4" + prose(1) + "W8xLm5Qp2Rt6Vb"])))
        rows.append((i, "\n".join(lines), r.choice(["a", "b", "c", None])))
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(8)]  # copies
    rows += [(120 + i, rows[i][1].replace(" ", "  ", 1), "b") for i in range(4)]  # equal words
    rows += [(130, None, "a"), (131, "", None), (132, " \n ", "a"), (133, "word " * 60, "c"), (134, prose(3000), "c"), (135, prose(25), None)]
    r.shuffle(rows)
    return rows


def without_lines(rows):
    """quality rules: what they keep, without the lines above the limit."""
    def folded(line):
        return " ".join(test_quality.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else "0" if c in "0123456789" else c for c in line)))

    verdicts = test_quality.verdicts(rows)
    hosts, held = {}, {}
    for _, text, host in rows:
        lines = frozenset(filter(None, map(folded, (text or "").split("\n"))))
        hosts.setdefault(host, set()).add(lines)
        for line in lines:
            held.setdefault((host, line), set()).add(lines)
    gone = {k for k, v in held.items() if len(v) > 10 and len(v) > 0.005 * len(hosts[k[0]])}
    return [(i, "\n".join(x for x in text.split("\n") if (host, folded(x)) not in gone), host)
            for i, text, host in rows if verdicts[i][0]]


def without_near_copies(rows):
    prints = {test_simhash.brute(t) for _, t, _ in rows}
    root = test_simhash.component_of(prints)
    least = {}
    for i, t, _ in rows:
        c = root[test_simhash.brute(t)]
        least[c] = min(i, least.get(c, i))
    return [row for row in rows if row[0] in least.values()]


def without_secrets(rows):
    spans = {i: s for i, s, _ in test_secrets.owned(rows)}
    out = []
    for i, text, source in rows:
        parts, done = [], 0
        for span in filter(None, spans[i].split(",")):
            _, a, b = span.split(":")
            if int(a) >= done:
                parts += [text[done:int(a)], "<SECRET>"]
            done = max(done, int(b))
        out.append((i, "".join([*parts, text[done:]]), source))
    return out


def mixed(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(test_mixing.WORD.findall(text))
    target = test_mixing.filled(sizes)
    out = []
    for row in rows:
        rate = target[row[2]] / sizes[row[2]] if sizes[row[2]] else 0
        draw = int(md5(f"mix:{row[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [row] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    return out


def pieces(rows):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, _ in rows:
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return want


def check_packed(rows, docs):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces(docs)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        ends = [0]
        for offset, length in sorted(held):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def test_stages_and_run_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(table_of(rows), SCHEMA).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = [without_lines, without_near_copies, without_secrets, mixed]
    sizes = [len(rows)]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs, rows = spark.read.parquet(f"{tmp_path}/{name}"), brute(rows)
        got = docs.collect()
        assert sorted(((r.doc_id, r.text, r.source) for r in got), key=repr) == sorted(rows, key=repr), name
        assert all(r.n_chars == len(r.text) and (r.lang, r.kept, r.spans, r.size) == ("en", True, "x", 7) for r in got)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] and sizes[4] > sizes[3]
    assert any("<SECRET>" in t for _, t, _ in rows)
    check_packed(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), rows)
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), rows)


@pytest.mark.parametrize("stage", range(5))
def test_awkward_rows_pass_every_stage(spark, awkward, nothing, stage):
    """Nulls in any column, empty and very long texts, repeats, clashing names; and no rows at all."""
    function = corpus_pipeline.STAGES[stage][1]
    out = function(spark, awkward, "")
    assert out.count() > 0
    if stage < 4:
        assert set(out.columns) <= set(awkward.columns) and {r.doc_id for r in out.collect()} <= {r.doc_id for r in awkward.collect()}
    assert function(spark, nothing, "").count() == 0
