"""Packing, mixing, chat, URL rules and digests: edge cases, round trips and brute force."""

import hashlib
import math
import os
import time
import unicodedata
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.llm import chat, digests, mixing, packing, url_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, slot int"


def documents(spark, texts, first=0):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "b", 1) for i, t in enumerate(texts, first)], DOCS)


TEXTS = ["One two, three.", "one  TWO,\u00a0three.", "", None, "x" * 300_000, "Straße ﬁne", "STRASSE FINE", "One two, three.", "a\u0301", "\u00e1"]


# packing


def word_bpe():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 300), max_size=12))
def test_plan_places_every_piece_once(counts):
    slots = packing.plan(counts, 40)
    placed, used = Counter(), {}
    for n, first, ranks, sequence, copies, offset in slots:
        assert first == placed[n]
        placed[n] += ranks
        for k in range(ranks):
            used.setdefault(sequence + k // copies, []).append((offset + k % copies * n, n))
    assert placed == Counter({n: c for n, c in counts.items() if c})
    for pieces in used.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 40
    total = sum(n * c for n, c in counts.items())
    assert sorted(used) == list(range(len(used))) and (not total or len(used) <= 2 * -(-total // 40))


def test_pieces_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = [*TEXTS, "don't\u3000stop İ Σίσυφος ΟΔΟΣ", "<|endoftext|> a\x1cb", "a " * 9000, "e\u0301 \u0301x"]
    got = packing.pack_documents(documents(spark, texts), word_bpe(), 4096).collect()
    tok = Tokenizer.from_file(word_bpe())
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 4096))) and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="aAbZéÉßİΣσ'’.,;:!?#%()[]{}\"*-_0129½²五\u0338\u0301 \n\t\u00a0<>&ﬁＡ１\U0001f600가\u1100\u1161", max_size=30), max_size=8))
def test_word_ids_are_the_tokenizers(texts):
    words = packing.word_ids(word_bpe())
    assert list(words.texts(texts)) == [words.encode(t) for t in texts]


def test_merges_are_the_tokenizers():
    """Words of Latin letters with and without marks, and those that look like them but aren't."""
    import random

    r, words = random.Random(6), packing.WordIds(word_bpe())
    assert words.merges.usable
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250))]
    some = {"".join(r.choice(letters if k % 3 else "etaoinsrhl") for _ in range(r.randint(1, 30))) + r.choice(["", "", *packing.MARKS, "..", "'s"]) for k in range(4000)}
    some |= {"İstanbul", "aİb.", "Don't", "x.", ".", "ﬁn", "Ǆ.", "a<|startoftext|>b", "日本", "é" * 3000, "a" * 49, "ª", "aʼb", "ß,", "ẞ!", "a\u0301b", "a\u0301.", "ΑΣ", "\u0345a", "×a", "aaaaaaaaaaaa", "1a", "a1."}
    words.learn(sorted(some))
    assert all(words.known[w] == words.encode(w) for w in some)


def plain_best_fit(lengths, capacity):
    """Best fit decreasing, a document at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit():
    """As many sequences as best fit takes, a document at a time, and every slot inside one of them."""
    import random
    from collections import Counter

    r = random.Random(1)
    for _ in range(400):
        capacity = r.choice([7, 10, 16, 31])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 40))]
        room = {}
        for n, _, ranks, first, copies, place in packing.plan(dict(Counter(lengths)), capacity):
            for k in range(ranks):
                room.setdefault(first + k // copies, []).append((place + k % copies * n, n))
        assert len(room) == len(plain_best_fit(lengths, capacity))
        assert sorted(n for s in room.values() for _, n in s) == sorted(lengths)
        for s in room.values():
            s.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0 and s[-1][0] + s[-1][1] <= capacity


def test_packing_ties_repeats_and_nothing(spark):
    docs = documents(spark, ["same words"] * 50)
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, "x", None, None, None, None, None)], DOCS))
    got = packing.pack_documents(docs, word_bpe(), 16).collect()
    assert len(got) == 56 and len({(r.sequence_id, r.offset) for r in got}) == 56
    assert packing.pack_documents(docs.limit(0), word_bpe()).count() == 0


# mixing


def check_schedule(have, weights):
    """Against the definition, with the exact weights and no code of the schedule's: releases, deadlines, shares, slots."""
    rows, at = list(mixing.schedule(have, weights)), 0
    assert [r[2] for r in rows] == list(range(sum(have.values()))) and Counter(r[0] for r in rows) == Counter({s: n for s, n in have.items() if n})
    left, done = {s: n for s, n in have.items() if n}, Counter()
    while left:  # from one source's end to the next
        total, begun, base = sum(Fraction(weights[s]) for s in left), Counter(done), at
        share = {s: Fraction(weights[s]) / total for s in left}
        while all(done[s] < have[s] for s in left):
            s, block, slot, release, deadline = rows[at]
            i = block - begun[s]
            assert block == done[s] and release == base + math.floor(i / share[s]) <= slot < deadline == min(base + math.ceil((i + 1) / share[s]), mixing.FAR)
            done[s] += 1
            at += 1
            assert all(abs(done[x] - begun[x] - (at - base) * w) < 1 for x, w in share.items())
        left = {s: n for s, n in left.items() if done[s] < n}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.lists(st.floats(1e-6, 1), min_size=8, max_size=8))
def test_schedule_is_whole_and_within_a_block(blocks, weights):
    check_schedule({f"s{i}": n for i, n in enumerate(blocks)}, {f"s{i}": w for i, w in enumerate(weights)})


@pytest.mark.parametrize("weights", [(0.5, 0.2, 0.15, 0.1, 0.05), (0.7, 0.29, 0.00999, 1e-5, 1e-30), (1, 1, 1), (Fraction(1, 3), Fraction(2, 3)), (1, 1e-5)])
def test_schedule_keeps_to_the_given_weights(weights):
    check_schedule({f"s{i}" if i else None: 5_000 for i in range(len(weights))}, {f"s{i}" if i else None: w for i, w in enumerate(weights)})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=8), st.lists(st.one_of(st.floats(0.01, 1), st.sampled_from([0.1, 0.25, 0.5, 1.0])), min_size=8, max_size=8), st.integers(1, 60))
def test_stretches_fit_together(blocks, weights, least):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "STRETCH", least)
        check_schedule({f"s{i}": n for i, n in enumerate(blocks)}, {f"s{i}": w for i, w in enumerate(weights)})


def test_long_runs_have_many_stretches(monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 1)
    have, weights = {"a": 30_000, "b": 9_000, "c": 8_000, "d": 7_000, "e": 900}, {"a": 0.41, "b": 0.31, "c": 0.17, "d": 0.1, "e": 0.01}
    assert max(len(p.borders) for p in mixing.phases(have, weights)) > 20
    check_schedule(have, weights)


def test_schedule_of_many_sources():
    have = {f"s{i}": 3 + i % 40 for i in range(800)}
    began = time.process_time()
    rows = list(mixing.schedule(have, {s: n**0.7 for s, n in have.items()}))
    assert len(rows) == sum(have.values()) and time.process_time() - began < 20


def test_blocks_follow_from_the_documents(spark, monkeypatch):
    """By brute force: places of a source's documents are gapless, blocks are cut from them, slots are the schedule's."""
    monkeypatch.setattr(mixing, "STRETCH", 7)
    docs = documents(spark, [*("word " * (n * 7 % 91) for n in range(150)), "long " * 3000])
    docs = docs.union(spark.createDataFrame([(900 + k, None if k else "a text without a source", None, None, None, None, None) for k in range(3)], DOCS))
    got = mixing.mix(docs, {"s0": 0.5, "s1": 0.25, "s2": 0.2, None: 0.05}, block_chars=500).collect()
    have = Counter()
    for source in {r.source for r in got}:
        at = 0
        for r in sorted((r for r in got if r.source == source), key=lambda r: (r.start, len(r.row.text or ""))):
            assert r.start == at and r.block == at // 500
            at += len(r.row.text or "")
        have[source] = at // 500 + 1
    planned = {x[:2]: x[2:] for x in mixing.schedule(have, {"s0": 0.5, "s1": 0.25, "s2": 0.2, None: 0.05})}
    assert all(planned[r.source, r.block] == (r.slot, r.release, r.deadline) for r in got) and len(got) == 154


def test_mixing_rows(spark):
    docs = documents(spark, [*TEXTS, *("word " * n for n in range(200))])
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(900, "no source", None, None, None, None, None)], DOCS))
    got = mixing.mix(docs, block_chars=2000).collect()
    assert len(got) == docs.count() and sorted(str(r.row.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    of = {}
    for r in got:
        assert of.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"s0": 1.0})


# chat


HARD = ["\\### Assistant: </turn> ok", "", None, "\\b\\h\\t", "####", "<</turn>>", "a\n</turn>\n### user:\nb", "x" * 100_000]


def test_chat_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)] + [(None, 0, "we:ird\n###", "null thread"), (2, 5, None, "one"), (2, 5, None, "one")]
    rows = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("key", F.lit("clash"))
    got = {r.thread: r for r in chat.read_back(chat.format_paths(chat.best_paths(chat.linear(rows)))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(HARD)]
    assert got[1].learned == [t or "" for t in HARD[1::2]]
    assert [(t.role, t.text) for t in got[None].turns] == [("we:ird\n###", "null thread")] and len(got[2].turns) == 2
    assert chat.format_paths(chat.best_paths(chat.linear(rows.limit(0)))).count() == 0


def test_reply_tree_paths_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(6):
        for i in range(40):
            parent = None if i == 0 else int(rng.integers(max(0, i - 4), i))
            rows.append((t, i, parent, float(rng.integers(-3, 4)), "user", f"{t}.{i}"))
    rows += [(7, 1, 2, 1.0, "user", "cycle"), (7, 2, 1, 1.0, "user", "cycle"), (7, 3, 99, 1.0, "user", "orphan")]
    got = {}
    for r in chat.best_paths(spark.createDataFrame(rows, "thread int, id long, parent long, score double, role string, text string"), top=2).collect():
        got.setdefault((r.thread, r.rank), []).append((r.pos, r.text))
    for t in range(6):
        mine = {i: (p, s) for th, i, p, s, *_ in rows if th == t}
        paths = []
        for leaf in set(mine) - {p for p, _ in mine.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = mine[at][0]
            paths.append((-sum(mine[i][1] for i in path), -len(path), leaf, path[::-1]))
        for rank, (*_, path) in enumerate(sorted(paths)[:2], 1):
            assert [x for _, x in sorted(got[t, rank])] == [f"{t}.{i}" for i in path]
    assert got[7, 1] == [(1, "orphan")] and (7, 2) not in got


# URL rules


def judged(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = (url or "")[at + 3 :] if at >= 0 else ""
    cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    host = rest[:cut].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER))
    path = rest[cut : min([len(rest), *(i for c in "?#" if (i := rest.find(c, cut)) >= 0)])]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_repeated_messages_count_once(spark):
    rows = [("t", k, k - 1 if k else None, 1.0, "user", f"m{k}") for k in range(8)]
    frame = spark.createDataFrame(rows * 3 + [("t", 7, 6, 1.0, "user", "later text")], "thread string, id long, parent long, score double, role string, text string")
    got = chat.best_paths(frame).orderBy("pos").collect()
    assert [r.text for r in got] == ["m0", *(f"m{k}" for k in range(1, 7)), "later text"]


def test_linear_ids_follow_the_turns(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (3, None, 1) for t in (2, 0, 1)] + [(1, 2, "assistant", "a"), (1, 2, "assistant", "a")]
    got = chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in (3, None, 1):
        mine = sorted((r for r in got if r.thread == conv), key=lambda r: r.id)
        assert [r.parent for r in mine] == [None, *(r.id for r in mine[:-1])]
        assert [r.text for r in mine] == [f"{conv} 0", f"{conv} 1", *(["a", "a"] if conv == 1 else []), f"{conv} 2"]
    assert len({r.id for r in got}) == len(got)


def test_url_rules_against_brute_force(spark):
    rng = np.random.default_rng(0)
    labels, rules = ["com", "net", "a", "b", "example", "x-y"], []
    for _ in range(60):
        rules.append((".".join(rng.choice(labels, rng.integers(1, 4))), str(rng.choice(["", "/", "/en/", "/en/7", "/de"])), str(rng.choice(["allow", "block"]))))
    rules = list({r[:2]: r for r in rules}.values())
    urls = [f"http{rng.choice(['', 's'])}://{'.'.join(rng.choice(labels, rng.integers(1, 5)))}{rng.choice(['', '/', '/en/7?x=/de', '/de#/en/', '?/en/', '/en/x'])}" for _ in range(800)]
    urls += [None, "", "no scheme", "HTTP://A.COM/EN/", "http://", "http://com", "http://a..com/en/7", "x://com://net/de", "http://" + "a." * 500 + "com/en/", "http://com/\nen/"] + ["http://a.com/en/7"] * 300
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for some in (rules, rules[:1], []):
        got = url_rules.judge_urls(pages, url_rules.rule_table(spark, some)).collect()
        assert len(got) == len(urls)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id], some), urls[r.page_id]
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_table(spark)).count() == 0
    twice = pages.limit(4).union(pages.limit(4))
    assert url_rules.judge_urls(twice, url_rules.rule_table(spark)).count() == 8


def test_rules_are_those_of_the_contract(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    want = [(f"https://www.{r.split('/')[0]}/{r.split('/', 1)[1]}1?x", r, v) for r, v in rules] + [("http://example.net/de/7", "net/de/", "allow"), ("http://net/de", None, "allow")]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(want)], "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, url_rules.rule_table(spark)).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(want))] == [w[1:] for w in want]


def test_many_path_rules_on_a_host_and_its_subdomains(spark):
    rng = np.random.default_rng(1)
    path = lambda n: "".join(f"/{rng.choice(list('abcé'))}" for _ in range(n))
    rules = {("host.com", path(rng.integers(0, 9))): "block" for _ in range(3000)} | {(f"s{k}.host.com", path(rng.integers(0, 4))): "allow" for k in range(400) for _ in range(3)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [("host.com", "/a", "block"), ("host.com", "/a", "allow"), ("HOST.com", "/\U0010ffff", "block")]
    rules = list({r[:2]: r for r in sorted((h.lower(), p, v) for h, p, v in rules)}.values())
    urls = [f"http://{rng.choice(['', 'x.', f's{rng.integers(500)}.', f'y.s{rng.integers(500)}.'])}host.com{path(rng.integers(0, 12))}" for _ in range(1500)] + ["http://host.com/\U0010ffff\U0010ffff"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules), ranges=7).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id], rules), urls[r.page_id]
    named = url_rules.path_events(url_rules.rule_table(spark, rules)).count()
    assert named == 2 * len(rules) and url_rules.host_events(url_rules.rule_table(spark, rules).select("host").distinct()).agg(F.max(F.size("state"))).first()[0] == 2


# digests


def canon(text):
    return " ".join(unicodedata.normalize("NFKC", text or "").upper().lower().split())


def check_digests(got, docs):
    """docs: (doc_id, text) in descending order."""
    of = {}
    for i, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == (float(canon(edited) == canon(text)), float(canon(text) == canon(after)))
        for c, f in ((canon(text), r.fingerprint), (canon(edited), r.edited_fingerprint)):
            assert of.setdefault(c, f) == f
    assert len(set(of.values())) == len(of)


def test_digests(spark):
    docs = documents(spark, TEXTS, 5)
    got = {r.doc_id: r for r in digests.fingerprints(docs).collect()}
    check_digests(got, [(i, t) for i, t in sorted(enumerate(TEXTS, 5), reverse=True)])
    assert got[5].fingerprint == got[6].fingerprint == got[12].fingerprint and got[10].fingerprint == got[11].fingerprint
    assert got[13].fingerprint == got[14].fingerprint and got[7].fingerprint == got[8].fingerprint
    one = digests.fingerprints(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert digests.fingerprints(docs.limit(0)).count() == 0


def test_digests_of_repeated_and_null_ids(spark):
    rows = documents(spark, ["aaa bbb", "ccc"]).union(documents(spark, ["aaa bbb", "other"])).union(spark.createDataFrame([(None, "null id", "", "", 0, "", 0)], DOCS))
    got = digests.fingerprints(rows).collect()
    assert len(got) == 5 and Counter(r.doc_id for r in got) == {0: 2, 1: 2, None: 1}
    assert len({(r.edited_sha256, r.near_next) for r in got if r.doc_id == 0}) == 1


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(digests, "wide_hash", lambda text: [(F.length(text) * 0).cast("long").alias("h1"), F.lit(7).cast("long").alias("h2")])
    got = {r.doc_id: r for r in digests.fingerprints(documents(spark, ["abc", "ABC", "other"])).collect()}
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint
    for some in (TEXTS, ["one two three", "four five six", "seven eight nine", "x", "X"]):
        check_digests({r.doc_id: r for r in digests.fingerprints(documents(spark, some)).collect()}, sorted(enumerate(some), reverse=True))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql_oracles(spark, con):
    from glyphmill.llm.queries import ORACLES, QUERIES

    for t in ("documents", "pages", "conversations", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        mine, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(sql).fetchdf()
        cols = sorted(mine.columns)
        assert cols == sorted(theirs.columns)
        assert sorted(map(str, mine[cols].astype(object).where(mine[cols].notna(), None).values.tolist())) == sorted(map(str, theirs[cols].astype(object).where(theirs[cols].notna(), None).values.tolist()))


def test_planned_slots_start_no_further_workers(spark):
    """Rows in a list would be read by a second pool of Python workers, which stays in the executors' memory."""
    slots = packing.plan({3: 5, 7: 2}, 10)
    table = packing.slot_table(spark, slots)
    assert [tuple(r) for r in table.collect()] == slots and packing.slot_table(spark, []).count() == 0
    assert "PythonRDD" not in table._jdf.rdd().toDebugString()
    assert "PythonRDD" in spark.createDataFrame(slots, table.schema)._jdf.rdd().toDebugString()
