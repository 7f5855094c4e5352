"""Toxicity grammar, spelling variants and periodic runs: brute force, held-out accuracy and edge cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from glyphmill.llm import periodic_runs, spelling, toxicity
from glyphmill.llm import queries as Q
from glyphmill.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# periodic runs -------------------------------------------------------------------------------------------------------


def brute_runs(w):
    n, seen = len(w), {}
    for q in range(1, n // 4 + 1):
        x = 0
        while x < n - q:
            y = x
            while y < n - q and w[y] == w[y + q]:
                y += 1
            if y - x + q >= max(6, 4 * q) and y > x:
                seen.setdefault((x, y - x + q), q)
            x = max(y, x + 1)
    return sorted(((s, n_, q) for (s, n_), q in seen.items()), key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    numbers = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(r.randint(1, 5)):
            n, k = r.choice([0, 1, 3, 10, 30, 60]), r.choice([1, 2, 3, 5])
            d = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // (3 + r.randrange(8))
                d = [d[x] if x < a else d[a + (x - a) % p] for x in range(n)]
            docs.append(d)
        t, s, length, q = periodic_runs.runs_of(np.array(sum(docs, []), np.int32), np.array([len(d) for d in docs], np.int64))
        for i, d in enumerate(docs):
            assert sorted((int(a), int(b), int(c)) for x, a, b, c in zip(t, s, length, q) if x == i) == sorted(brute_runs(d))


def test_few_places_at_once(monkeypatch):
    monkeypatch.setattr(periodic_runs, "TRIED", 7)
    w = np.array([0, 1] * 40 + [2] * 9 + [3, 4, 5] * 8)
    t, s, length, q = periodic_runs.runs_of(w, np.array([len(w)]))
    assert list(zip(s.tolist(), length.tolist(), q.tolist())) == [(0, 80, 2), (80, 9, 1), (89, 24, 3)]


def test_run_digests(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a a", " a a a a a\x0ba\x0c", "x y x y x y x y z", "é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é", "a a a a a", "k " * 3000, "a b " * 5 + "b " * 9]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(1, 90))) for _ in range(150)] + ["a b " * 5 + "b " * 9] * 2
    ids = [None, None, *range(2, len(texts) - 1), 2]
    docs = frame(spark, texts, ids)
    got = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_made_runs(docs))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_digest(i, t) for i, t in zip(ids, texts)), key=str)


def test_runs_keep_columns_and_empty_tables(spark):
    docs = frame(spark, ["a a a a a a b"]).selectExpr("doc_id", "text", "7 AS runs", "8 AS collapsed", "9 AS row", "10 AS w")
    row = periodic_runs.find_runs(periodic_runs.with_made_runs(docs)).first()
    assert (row.doc_id, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (0, 7, [(0, 6, 1)], "a b")
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {tuple(r) for r in Q.op13_periodic_runs(spark, SF).collect()}
    some = [d for d, t in docs.items() if len(t) < 12000]
    assert {brute_digest(d, docs[d]) for d in some} <= got and len(got) == len(docs)


# spelling variants ---------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, spoil):
    count = {}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if spoil and i is not None:
                h = zlib.crc32(f"{i}:{w}".encode())
                if h % 199 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] = count.get(w, 0) + 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return rows


def some_texts(r, n):
    words = ["colour", "color", "colours", "coloor", "aaaaaa", "aaaaaaa", "aaaaaab", "größer", "grösser", "Étaient", "étaient", "etaient", "zebras", "zebra×s"]
    words += ["".join(r.choice("ab") for _ in range(r.randint(5, 8))) for _ in range(60)]
    weights = [r.choice([1, 5, 30]) for _ in words]
    return [(i % 7 or None, r.choice([" ", "\n", "-", "1"]).join(r.choices(words, weights, k=r.randint(0, 80)))) for i in range(n)]


@pytest.mark.parametrize(("seed", "size"), [(1, 50_000), (2, 5), (3, 17)])
def test_variants_are_those_of_all_pairs(spark, seed, size):
    docs = some_texts(random.Random(seed), 90) + [(3, None), (4, ""), (5, "a" * 3000 + " " + ("b" * 3000 + " ") * 6)]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, word int, n int")
    got = spelling.variants(table, spoil=True, size=size).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == brute_variants(docs, True)


def test_no_words(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [None, "", "short words"])).count() == 0


def test_copies_are_few(spark):
    """Copies that the merged trie holds: at most 3 log2 V + 1 of a word."""
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcdef") for _ in range(r.randint(3, 7))) for _ in range(4000)})
    n = sum(1 for _ in spelling.copies(words, {}, {}))
    assert n <= len(words) * (3 * np.log2(len(words)) + 1)
    table = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    near = {x.word: x.n_near for x in spelling.near_words(Scratch(spark, "t"), table, 300).collect()}
    known = set(words)
    for w in r.sample(words, 150):
        edits = {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in ("", *"abcdef")} - {w}
        assert near.get(w, 0) == len(edits & known)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_spelling_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Q.op12_errata_spelling(spark, SF).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == brute_variants(docs, True)


# toxicity ------------------------------------------------------------------------------------------------------------


def tags(text):
    model = toxicity.Model({}, toxicity.START)
    return [[t for t, _ in tagged] for _, _, tagged in toxicity.matches(text, toxicity.Lexicon(model))[1]]


def test_grammar_reads_clauses():
    assert tags("You are an idiot.") == [["i@"]]
    assert tags("An idiot, you.") == [["i@"]]
    assert tags("An idiot. You there") == [["i"]]
    assert tags("you are not an idiot") == [["i-@"]]
    assert tags("not that I know of any idiot") == [["i"]]  # out of the negation's scope
    assert tags("she said you are an idiot") == [["i~@"]]
    assert tags("the word “idiot” is old, a scum") == [["i~", "i"]]
    assert tags("I will hurt you") == [["h@"]]
    assert tags("I will never hurt you") == [["h-@"]]
    assert tags("hurt you") == [["h@"]] and tags("it may hurt") == [] and tags("") == [] and tags("hello there.") == []


def test_composition_is_reading_twice():
    r = random.Random(2)
    parts = [toxicity.threat(), toxicity.negation(), toxicity.report(), toxicity.target()]
    for _ in range(200):
        symbols = [r.choice("ooqtnrmvi") for _ in range(r.randint(0, 14))]
        one = symbols
        for p in parts:
            one = p.read(one)
        assert toxicity.GRAMMAR.read(symbols) == one


def test_negated_and_reported_count_less(spark):
    model = toxicity.Model({}, toxicity.START)
    texts = ["you idiot", "you are not an idiot", "he wrote: fine. she said you idiot", "a plain text", None, ""]
    found = {r.doc_id: r for r in toxicity.score(frame(spark, texts), model).collect()}
    assert found[0].score > found[1].score > found[3].score and found[0].score > found[2].score
    assert found[3].score == found[4].score == found[5].score
    assert [tuple(c)[:3] for c in found[0].clauses] == [(0, 9, ["i@"])]


def test_fit_finds_stems(spark):
    r = random.Random(3)
    plain = ["mira", "tolun", "varek", "sodi", "kelum", "daro", "pinel", "ruska"]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(plain) for _ in range(40)]
        bad = i % 5 == 0 or i % 7 == 0 and i % 2 == 0
        if bad:
            w[r.randrange(40)] = "grumb" + r.choice(["al", "o", "ix", "ung"])
        docs.append((i, " ".join(w) + ".", None, None, None))
        labels.append((i, 0, int(bad)))
    docs += [(None, "grumbal", "x", None, None), (5000, None, None, None, None), (5000, "", None, None, None), (5000, "mira " * 50000 + "grumbo", None, None, None)]
    labels += [(None, 0, 1), (3, None, None), (8, 0, 0), (8, 0, 0)]
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.judge(d, y).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels if i is not None and t is not None}
    held = [x for x in got if x.doc_id is not None and x.held_out and x.doc_id < 900]
    assert len(held) > 100 and all((x.score >= 0.5) == (truth[x.doc_id] == 1) == bool(x.predicted) for x in held)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert not [x.held_out for x in got if x.doc_id is None][0] and all(0 <= x.score <= 1 for x in got)


def test_without_labels(spark):
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.judge(frame(spark, ["you idiot, you scum", "well"]), y).collect()}
    assert got[1] == 0
    assert toxicity.judge(frame(spark, []), y).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op11_clause_toxicity(spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(x.predicted, truth[x.doc_id]) for x in got if x.held_out and x.doc_id in truth]
    right = sum(p == t for p, t in held) / len(held)
    assert right > 0.95, right
    found = sum(p for p, t in held if t == 1) / max(1, sum(t for _, t in held))
    assert found > 0.6, found
