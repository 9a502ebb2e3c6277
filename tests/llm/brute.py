"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def blocks(docs, window):
    ws = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, ws, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def suffixes(docs, window):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(hash(b[i : i + window]) for b in texts for i in range(len(b) - window + 1))
    out = []
    for (doc, _), b in zip(docs, texts, strict=True):
        gone = {k for i in range(len(b) - window + 1) if seen[hash(b[i : i + window])] > 1 for k in range(i, i + window)}
        spans = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        out.append((doc, len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    return out


def shingles(text, n):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def joined(docs, n, percent):
    sets = [shingles(t, n) for _, t in docs]
    at = list(range(len(docs)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    links = [0] * len(docs)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                at[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
            if a and b and docs[i][0] is not None and docs[i][0] == docs[j][0]:
                at[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least.get(root(i)), links[i]) for i, (doc, _) in enumerate(docs)]


def contaminated(docs, items, n):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    grams = {}
    for item, text in items:
        w = cut(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, arity=16):
    """The nodes, their parents and so on up to one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def manifest(rows, arity=16):
    """rows: doc_id, source, lang, n_chars, text. Rows whose id's crc32 is divisible by 5 offer their text in lower case."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in held[s]], arity) for s in sources}
    top = levels([trees[s][-1][0] for s in sources], arity)
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(held[s]):
            path = []
            for tree, at in ((trees[s], i), (top, k)):
                for nodes in tree[:-1]:
                    run = nodes[at // arity * arity :][:arity]
                    path.append((run[: at % arity], run[at % arity + 1 :]))
                    at //= arity
            lowered = None if r[4] is None else re.sub("[A-Z]+", lambda m: m[0].lower(), r[4])
            folded = leaf((*r[:4], lowered)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for before, after in path:
                folded = digest(*before, folded, *after)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, digest(*(x for a, b in path for x in a + b)), folded, folded == root))
    return out


def negatives(rows, every=50, positives=5, wanted=3):
    """rows: id, label, vector, all of them usable."""
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for k, (anchor, label, v) in enumerate(rows):
        if anchor % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other, n) for n, (i, other, w) in enumerate(rows))
        for p in [x for x in ranked if x[2] == label and x[3] != k][:positives]:
            found = [x for x in ranked if x[2] != label and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:wanted]
            out += [(anchor, p[1], rank, x[1], -p[0], -x[0]) for rank, x in enumerate(found, 1)]
    return out


def pieces(docs, encode, capacity=2048):
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    out = []
    for doc, text in docs:
        ids = [*encode(text or ""), 0]
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return out
