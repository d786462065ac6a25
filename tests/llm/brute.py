"""Plain versions of the operators, over lists; used by tests only."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs):
    """(doc_id, n_shingles, component_id, n_links) of [(doc_id, text)]."""
    sets = [shingles(t) for _, t in docs]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    both = Counter()
    groups = Counter(tuple(v) for v in at.values() if len(v) > 1)
    for group, n in groups.items():
        for a, i in enumerate(group):
            for j in group[a + 1 :]:
                both[i, j] += n
    root, n_links = list(range(len(docs))), Counter()

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (i, j), n in both.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
            n_links.update((i, j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)), n_links[i]) for i, (d, _) in enumerate(docs)]


def repeats(docs, window=35):
    words = [WORD.findall(t or "") for _, t in docs]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def copies(docs):
    text = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, (d, t) in enumerate(docs):
        groups[text(t)].append((-len(t or ""), d is None, d if d is not None else 0, i))
    out = []
    for i, (d, t) in enumerate(docs):
        best = min(groups[text(t)])
        out.append((d, docs[best[3]][0], len(groups[text(t)]), sha(text(t))))
    return out


def levels(v):
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(64 * x) for x in v]


def best(vectors, k=20, every=20):
    """(query_id, rank, vec_id, score) of [(vec_id, embedding)]."""
    rows = [(i, levels(v)) for i, v in vectors if i is not None and levels(v)]
    out = set()
    for q, a in rows:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k]))
    return out


def targets(sizes):
    """{source: target} of {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            out.update({s: weight[s] * level for s in free})
            break
        out.update({s: 3.0 * sizes[s] for s in over})
        free -= over
    return out


def mixed(rows):
    """{row: copies} of [(row, source, size, u)]: whole copies, then by Pareto rank as many more as come nearest to the target."""
    sizes, out = defaultdict(list), {}
    for row, source, size, u in rows:
        sizes[source].append((row, size, u))
    goal = targets({s: sum(n for _, n, _ in rs) for s, rs in sizes.items()})
    for source, rs in sizes.items():
        total = sum(n for _, n, _ in rs)
        c = goal[source] / total if total else 0.0
        left, mean = (c - math.floor(c)) * total, total / len(rs)
        odds = {row: 2 * n / (n + mean) if n + mean else 0.0 for row, n, _ in rs}
        sure = set()  # rows whose odds would make them more than certain
        while True:
            w = sum(odds[row] * n for row, n, _ in rs if row not in sure)
            rest = left - sum(n for row, n, _ in rs if row in sure)
            more_sure = {row for row, n, _ in rs if n and row not in sure and w and odds[row] * rest / w >= 1}
            if not more_sure:
                break
            sure |= more_sure
        ranked, more, run = [], {row: 0 for row, _, _ in rs}, 0
        for row, n, u in rs:
            p = 0.0 if not w and not sure else 1.0 if row in sure else odds[row] * rest / w if n else c - math.floor(c)
            if p > 0:
                ranked.append((u / (1 - u) * (1 - p) / p, row, n))
        for _, row, n in sorted(ranked):
            if run < left and run + n - left <= left - run:
                more[row] = 1
            run += n
        gap = left - sum(more[row] * n for _, row, n in ranked)
        turn = [(abs(abs(gap) - n), q, row) for q, row, n in ranked if n and more[row] == (0 if gap > 0 else 1) and abs(abs(gap) - n) < abs(gap)]
        if turn:
            more[min(turn)[2]] ^= 1
        out.update({row: math.floor(c) + k for row, k in more.items()})
    return out


def records(pages):
    body = [(h or "").encode() for _, h in pages]
    first = {}
    for (p, _), b in zip(pages, body):
        if b not in first or first[b] is None or p is not None and p > first[b]:
            first[b] = p
    return [(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if first[b] == p else ("revisit", first[b]))) for (p, _), b in zip(pages, body)]


def chats(turns):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, t, r, x in turns:
        convs[c].append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, rows in convs.items():
        rows.sort()
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        out[c] = (len(rows), sha("".join(f"{r}\n{x}\n" for *_, r, x in rows)), len(loss), sha(loss))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(df, rows):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(map(tuple, rows), key=key)
