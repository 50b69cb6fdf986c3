import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from frameprobe.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a  b", "a \n b\n", "end ", " start", "x  y", "don't  stop's", "<|endoftext|> x", "\t\tb c", "𝄞 é ü　z", "a\n\n b", "\n", "12 3.5e-7 !?"]


def test_words_apart_give_the_ids_of_the_whole():
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice(["a", "Bc", " ", "  ", "\n", "'s", "9", ".", "é", " "]) for _ in range(30)) for _ in range(400)]
    texts += [" ".join(r.choice(["Ab", "cd,", "ef.", "g\nHi", "9\n", "\tx", "\u0085", "j.\nK,\nL", "\x1c", "###"]) for _ in range(12)) for _ in range(400)]
    texts += [None, "", *(f"w{i}" for i in range(30)), " ".join(f"w{i} v{i}\nu{i}" for i in range(1500))]
    plain = Tokenizer.from_file(PATH)
    encode = packing._Encoder(PATH)
    encode.first.limit = encode.later.limit = 50  # generations change with every call
    made = [ids for k in range(0, len(texts), 9) for ids in encode(pa.array(texts[k:k + 9]))]
    for t, ids in zip([x or "" for x in texts], made, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_packed_rows(awkward, nothing):
    plain = Tokenizer.from_file(PATH)
    docs = awkward.drop("size")
    rows = packing.packed(docs, PATH, capacity=256).collect()
    want = Counter()
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.packed(nothing, PATH).count() == 0


def fewest(items, capacity):
    """Fewest bins, by trying all."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                k = rooms.index(r)
                go(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1:])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_bin_completion_is_optimal_on_small_inputs(seed):
    r = random.Random(seed)
    items = [r.randrange(3, 70) for _ in range(r.randrange(1, 12))]
    counts = dict(Counter(items))
    got = packing.complete_bins(counts, 100)
    used = Counter()
    for held, n in got:
        assert sum(held) <= 100 and n > 0
        for x in held:
            used[x] += n
    assert used == Counter(items)
    assert sum(n for _, n in got) == fewest(items, 100) >= packing.lower_bound(counts, 100)


@pytest.mark.parametrize("seed, low, high", [(9, 1, 2048), (1, 50, 1400), (2, 100, 900)])
def test_many_lengths_come_near_the_lower_bound(seed, low, high):
    r = random.Random(seed)
    counts = {k: r.randrange(1, 60) for k in range(low, high)}
    got = sum(n for _, n in packing.complete_bins(counts, 2048))
    assert got <= packing.lower_bound(counts, 2048) * 1.003 + 1
    assert got <= sum(n for _, n in packing.best_fit(counts, 2048))


@pytest.mark.parametrize("seed, number, capacity, best", [(1695, 14, 500, 5), (3760, 14, 100, 5), (2191, 17, 500, 7)])
def test_search_goes_on_after_the_first_fillings(seed, number, capacity, best):
    r = random.Random(seed)
    m = r.randrange(12, 40)
    assert (m, r.choice([100, 200, 500])) == (number, capacity)
    counts = dict(Counter(r.randrange(capacity // 12, capacity * 6 // 10) for _ in range(m)))
    got = packing.complete_bins(counts, capacity)
    used = Counter()
    for held, n in got:
        assert sum(held) <= capacity
        for x in held:
            used[x] += n
    assert used == Counter(counts) and sum(n for _, n in got) == best == packing.lower_bound(counts, capacity)


def test_nothing_to_pack():
    assert packing.complete_bins({}, 100) == [] and packing.places([]).shape == (0, 5)
