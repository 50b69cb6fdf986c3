import random
import re
from collections import Counter

import numpy as np

from corpus_pipeline import quality_rules
from frameprobe.llm import quality

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            inside.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))


def test_counts_match_brute_force(awkward):
    for r in quality.judged(awkward, drop_text=False).collect():
        n = tuple(r[c] for c in quality.COUNTS)
        assert n == brute(r.text), r
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_frequent_lines_remove_documents_but_copies_do_not(spark):
    own = [(i, f"head {i} a\n" + " ".join(f"w{i}x{k}" for k in range(40)), "h") for i in range(40)]
    copies = [(100 + i, "one line of many words here " + " ".join(map(str, range(30))) + "\nand its other line, too", "h") for i in range(30)]
    spam = [(200 + i, f"Buy {10 + i} now and get the other for free today my friend while it lasts and tell all of your family and friends\n"
             f"only {'abcdefghij'[i % 10]} {'xyz'[i // 10]}", "h") for i in range(30)]
    docs = spark.createDataFrame(own + copies + spam, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judged(docs, line_share=0.05).collect()}
    assert all(got[i].kept for i in list(range(40)) + list(range(100, 130)))
    assert all(not got[i].kept and not got[i].base_failed for i in range(200, 230))
    assert all(got[i].removed_words == 23 and got[i].n_words == 26 for i in range(200, 230))


def test_templates_of_any_size_are_counted_by_document(spark):
    def word(n):
        return "".join("abcdefghij"[int(c)] for c in str(n))

    rows, want = [], {}
    for shared in (1, 2, 5, 30):
        template = [f"template {word(shared)} line {word(k)}" for k in range(shared)]
        for i in range(12):
            rows += [(f"{shared}:{i}:{copy}", "\n".join([*template, f"own {word(shared)} {word(i)} " + "x " * 20]), f"h{shared}") for copy in range(2)]
    for host in {h for _, _, h in rows}:
        holders = {}
        for _, text, h in rows:
            for line in text.split("\n") if h == host else ():
                holders.setdefault(line.strip(), set()).add(text)
        for i, text, h in rows:
            if h == host:
                want[i] = sum(len(x.split()) for x in text.split("\n") if len(holders[x.strip()]) > 10)
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = {r.doc_id: r.removed_words for r in quality.judged(docs).collect()}
    assert got == want and set(want.values()) == {4, 8, 20, 120}


def test_kept_rows_keep_their_columns(awkward, nothing):
    judged = quality.judged(awkward.select("doc_id", "text", "source")).where("kept").count()
    out = quality.kept(awkward)
    assert out.columns == awkward.columns and out.count() == judged
    assert quality.kept(nothing).count() == 0


def test_kept_texts_lose_the_lines_above_the_limit(spark):
    body = " ".join(f"kept {c}" for c in "abcdefghijklmnopqrst")
    rows = [(i, f"Ünï  Banner {i}\n{chr(97 + i)} own line {body}\n\n ünï banner 7 \nÜnï banner 7\nlast {chr(97 + i)}", "h", 5) for i in range(12)]
    rows += [(50, f"no banner here {body}\n\nend", "h", 5), (51, f"Ünï  Banner 3\n{body}", "other", 5), (52, "Ünï Banner 1\nshort", "h", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r for r in quality_rules(spark, docs, "").collect()}
    want = {i: t for i, t, _, _ in rows if i in (50, 51)}
    want |= {i: f"Ünï  Banner {i}\n" * (i > 9) + f"{chr(97 + i)} own line {body}\n\nlast {chr(97 + i)}" for i in range(12)}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert quality_rules(spark, docs, "").schema == docs.schema


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_lines_that_polynomial_hashes_mix_up_differ(spark):
    texts = ["\n".join([thue_morse(n), thue_morse(n, True)]) for n in (1024, 2048, 8192)]
    texts += [" ".join([thue_morse(1024), *"cdefghi", thue_morse(1024, True), *"cdefghi"]), "x y z w v u t s r " * 3]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in quality.judged(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    texts = [t.encode() for t in ("a b c d e f g h i a b c d e f g h", "q w e r t y u i o p", "", "z " * 20)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    want = quality.counts(data, offsets)
    monkeypatch.setattr(quality, "mix64", lambda x: np.zeros_like(x))
    assert (quality.counts(data, offsets) == want).all()
    assert [tuple(x) for x in want.T.tolist()] == [brute(t.decode()) for t in texts]


def verdicts(rows):
    """kept and removed words of each row, line by line, over distinct documents."""
    def folded(line):
        return " ".join(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else "0" if c in "0123456789" else c for c in line)))

    held, hosts = {}, {}
    for _, text, host in rows:
        lines = frozenset(filter(None, map(folded, (text or "").split("\n"))))
        hosts.setdefault(host, set()).add(lines)
        for line in lines:
            held.setdefault((host, line), set()).add(lines)
    out = {}
    for i, text, host in rows:
        n, _, _, _, repeated = brute(text)
        gone = 0
        for line in (text or "").split("\n"):
            holders = len(held.get((host, folded(line)), ()))
            if holders > 10 and holders > 0.005 * len(hosts[host]):
                gone += len(WORD.findall(line))
        out[i] = not (n < 20 or 100 * repeated > 30 * n) and n - gone >= 0.3 * n, gone
    return out


def test_verdict_against_brute_force_with_copies_in_the_host(spark):
    """Copies of another document neither hide a shared line nor make one."""
    r = random.Random(5)

    def prose(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    shared = [prose(12) for _ in range(3)]
    rows = [(i, "\n".join([*r.sample(shared, r.randrange(1, 4)), prose(r.randrange(5, 40))]), r.choice(["h", "h", None])) for i in range(60)]
    copied = prose(30) + "\n" + prose(30)
    rows += [(1000 + i, copied, "h") for i in range(8000)] + [(9500 + i, r.choice(["", None, " \n"]), "h") for i in range(50)]
    rows += [(9600 + i, shared[0] + "\n" + prose(30), "rare") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: (x.kept, x.removed_words) for x in quality.judged(docs).collect()}
    assert got == verdicts(rows)
    assert {v[1] > 0 for v in got.values()} == {True, False} and not all(v[0] for i, v in got.items() if i < 60)
