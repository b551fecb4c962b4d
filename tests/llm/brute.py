"""Plain Python versions of what the operators compute."""

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, n):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs):
    """Of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    inverse = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverse[x].append(i)
    both = Counter((a, b) for ids in inverse.values() for k, b in enumerate(ids) for a in ids[:k])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def lm_counts(docs):
    """N, V, unigram and bigram counts, context counts of training rows."""
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, t in docs:
        if fold(i, 10):
            w = [*words(lower(t)), None]
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
            ctx.update(["<s>", *w[:-1]])
    return sum(uni.values()), len(uni), uni, bi, ctx


def base_score(text, n, v, uni):
    w = [*words(lower(text)), None]
    return len(w), sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)


def rule_counts(text):
    text = text or ""
    w = words(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def js(p, q):
    keys = set(p) | set(q)
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in keys}
    part = lambda x: sum(v * math.log2(v / m[k]) for k, v in x.items() if v > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def best_fit(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fit = [(room, b) for b, (room, s, c) in enumerate(bins) if room >= size and room > 0 and (source is None or source not in s) and (cluster is None or cluster not in c)]
        if fit:
            b = min(fit)[1]
        else:
            b = len(bins)
            bins.append([capacity, set(), set()])
        bins[b][0] -= size
        bins[b][1].add(source)
        bins[b][2].add(cluster)
        out.append(b)
    return out


def sainte_lague(votes, seats):
    """votes: list of (name, n); ties to the lesser name."""
    got = {k: 0 for k, _ in votes}
    for _ in range(seats):
        k = min(votes, key=lambda x: (-x[1] / (2 * got[x[0]] + 1), x[0]))[0]
        got[k] += 1
    return got
