"""Operators 11 to 13: periodic runs, lexical search, BPE with word ends."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import WORD, pairs, same, sha
from emberway.llm import lexical_search, periodic_runs, queries, word_bpe
from tokenizers import Tokenizer

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def plain_runs(w):
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)), len(gone))


def generated(rng, kind):
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(0, 150))]
    if kind == 1:  # periods of many lengths side by side
        w = []
        for _ in range(rng.randrange(1, 8)):
            p = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
            w += (p * rng.randrange(1, 9))[: rng.randrange(1, 90)]
        return w
    if kind == 2:  # one long period, cut anywhere
        p = [rng.randrange(50) for _ in range(rng.randrange(1, 40))]
        return [rng.randrange(50) for _ in range(rng.randrange(30))] + p * rng.randrange(2, 9) + p[: rng.randrange(len(p) + 1)] + [1, 2]
    u = [0] * rng.randrange(1, 9) + [1]  # runs within runs
    v = u * rng.randrange(1, 6) + [2]
    return v * rng.randrange(1, 7) + u * rng.randrange(1, 7)


def test_runs_equal_those_of_all_periods():
    rng, n = random.Random(5), 0
    for i in range(1500):
        w = [b"w%d" % x for x in generated(rng, i % 4)]
        found = periodic_runs.runs(periodic_runs.numbered(w))
        assert found == plain_runs(w), w
        n += len(found)
    assert n > 2000


def test_runs_of_many_different_words():
    """Blocks of thousands of words in one automaton, spelt by several letters; a run at the end of each stretch."""
    w = [x for i in range(6000) for x in (f"a{i}", f"b{i}") * 2] + [f"c{i}" for i in range(900)] * 4
    w += [x for i in range(5000) for x in (f"d{i}",) * 2] + ["e"] * 9
    assert periodic_runs.runs(periodic_runs.numbered(w)) == [(24000, 3600, 900), (len(w) - 9, 9, 1)]


def test_runs_of_long_texts_take_no_square_of_their_words():
    w = ["a", "b", "c"] * 100_000
    assert periodic_runs.runs(periodic_runs.numbered(w)) == [(0, 300_000, 3)]


def test_runs_of_odd_documents(spark, odd_docs):
    same(periodic_runs.find_runs(odd_docs), [plain_row(d, t) for d, t in pairs(odd_docs) if d != 11] + [
        (11, 1, 0, 30_000, 1, 30_000_000, sha("0,30000,1\n"), sha("long"), 29_999)])
    assert periodic_runs.find_runs(odd_docs.limit(0)).collect() == []
    row = periodic_runs.find_runs(spark.createDataFrame([(1, "x a b\ta b\na b a b y")], "doc_id long, text string"), runs_too=True, texts=True).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 8, 2)] and row["collapsed"] == "x a b y"


def test_planted_words_are_those_of_the_contract(spark):
    rng = random.Random(2)
    docs = [(d, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 200))) if d % 7 else None) for d in range(300)]
    out = {r["doc_id"]: r["text"] for r in queries.planted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    bent = 0
    for d, text in docs:
        h, w = zlib.crc32(str(d).encode()), WORD.findall(text or "")
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            assert out[d].split(" ") == [w[i if i < a else a + (i - a) % p] for i in range(n)]
            bent += 1
        else:
            assert out[d] == text
    assert bent > 15


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
plain_terms = lambda t: TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_search(docs, items, k=50):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(1 for n in sizes if n), sum(sizes)
    out = []
    for item, text in items:
        scores = []
        weights = {}
        for term in set(plain_terms(text)):
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(term in b for _, b in bags) + 1)))
        for (d, bag), n in zip(bags, sizes):
            m = 50 + 50 * n * n_docs // n_terms if n else 0
            score = sum(w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t, w in weights.items() if t in bag)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


def search_rows(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["Ärger", "été", "x1", "naïve"]
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for d in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(60)]  # ties beyond the limit
    docs += [(None, docs[7][1]), (None, None), (n + 70, ""), (n + 71, "--- !"), (n + 71, "t1 t1, T1"), (n + 71, "t1 t1, T1"), (n + 72, "t2 " * 20_000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    return docs, items + [(90, None), (91, "..."), (92, "nowhere"), (93, docs[7][1] * 3), (93, "T1 x1"), (None, "été")]


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_scores_of_all_documents(spark, monkeypatch, small):
    if small:  # many blocks, rounds and levels of few documents
        monkeypatch.setattr(lexical_search, "FAN", 3)
        monkeypatch.setattr(lexical_search, "BLOCK", 1030)
    docs, items = search_rows(1 + small)
    found = lexical_search.search(
        spark.createDataFrame([(d, t, 1, "z", 0) for d, t in docs], "doc_id long, text string, row int, term string, score int"),
        spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, item int"), **({"at_once": 20} if small else {}))
    same(found, plain_search(docs, items))


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(none, items).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []
    same(lexical_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items), plain_search([(1, "a")], [(1, "a b")]))


def test_tree_opens_few_nodes():
    """Documents that share no term with an item, or are too weak, are not opened."""
    rng = np.random.default_rng(3)
    n = 4096
    doc = np.repeat(np.arange(n), 8)
    term = (rng.integers(0, 40, 8 * n) + 40 * (doc % 4)).astype(np.int64)
    key = np.unique(term * n + doc)
    term, doc = key // n, key % n
    value = rng.integers(1, 1000, len(key))
    trees = lexical_search.Trees(np.arange(n), term, doc, value)
    own, weights = np.array([3, 7, 11, 50]), np.array([5, 9, 2, 30])
    score = np.zeros(n, np.int64)
    for t, w in zip(own, weights):
        score[doc[term == t]] += w * value[term == t]
    opened = []
    monkey, lexical_search.heapq.heappop = lexical_search.heapq.heappop, lambda h: opened.append(1) or monkey(h)
    try:
        found = trees.top(own, weights, 10, 1)
    finally:
        lexical_search.heapq.heappop = monkey
    assert sorted(found, key=lambda r: (-r[0], r[1])) == sorted(((int(s), i) for i, s in enumerate(score) if s > 0), key=lambda r: (-r[0], r[1]))[:10]
    assert len(opened) < n // lexical_search.FAN // 2


def library_rows(docs):
    t = Tokenizer.from_file(WORD_BPE)
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t.decode(ids, skip_special_tokens=False))


ODD = ["Hello <|endoftext|> it's ΣΑΣ\x85x <|startoftext|>", "<|endoftext|><|endoftext|>a<|endof", "é" * 3000, "x" * 2000 + "ab " * 50, "é à́ ́x y　z\xa0w \x1c \x1f a\x0bb",
       "İstanbul ẞ ﬁ", "a\x00b\x00", "՘ Ɤ \U0003fc3f", "日本語テキスト 漢字", "don't we'LL 'S 123 4.5", "a <|endoftext|>'s '<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaab"]


def test_word_bpe_equals_the_library(spark, odd_docs):
    rng = random.Random(4)
    odd = ["".join(rng.choice([*"ab é9½漢🙂'", "'s", "\n", "Σ", "́", "ǅ", "<|endoftext|>", "<|", "​", chr(rng.randrange(0x20, 0xD7FF))]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(ODD + odd)), "doc_id long, text string"))
    same(word_bpe.encode(docs, WORD_BPE, ids=False), list(library_rows(pairs(docs))))
    same(word_bpe.encode(odd_docs, WORD_BPE, ids=False), list(library_rows(pairs(odd_docs))))
    assert word_bpe.encode(odd_docs.limit(0), WORD_BPE).collect() == []


def test_merges_are_the_leftmost_of_the_lowest_rank():
    bpe, rng = word_bpe.WordBpe(WORD_BPE), random.Random(6)
    bpe.merges = {(a, b): rng.randrange(20) for a in range(7) for b in range(7) if rng.random() < 0.6}
    bpe.result = [rng.randrange(7) for _ in range(20)]
    for _ in range(300):
        symbols = [rng.randrange(7) for _ in range(rng.randrange(1, 400 if _ % 9 == 0 else 40))]
        plain = symbols[:]
        while ranks := [(bpe.merges[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in bpe.merges]:
            rank, i = min(ranks)
            plain[i : i + 2] = [bpe.result[rank]]
        assert bpe.merged(symbols) == plain


def test_word_bpe_decodes_its_ids(spark):
    docs = spark.createDataFrame([(1, "Hello World <|endoftext|>"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in word_bpe.decode(word_bpe.encode(docs, WORD_BPE), WORD_BPE).collect()}
    assert out == {1: "hello</w> world</w> <|endoftext|>", 2: ""}
