"""Plain Python versions of what the operators compute."""

import hashlib
import re
import zlib

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(docs, size=5):
    """doc_id -> (set size, smallest linked id), all pairs compared; docs: (id, text)."""
    sets = [(i, shingle_set(t, size)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(a), top(i)) for i, a in sets}


def leaks(docs, items, size=10):
    """(doc_id, n_words, n_hit, n_items, digest) of each document."""
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()))
    return out


def secrets(text):
    """Base spans (start, kind number, end) of a text."""
    out, text = [], text or ""
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def periodic_runs(w, shortest=24, repeats=3):
    """Runs (start, length, period) of a word list, every lag compared."""
    out = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, repeats * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def tiled(doc, words):
    """The words with which op11 replaces a document's own ones."""
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def merkle(leaves, fan=16):
    """Root of a list of hashes and each one's proof, a list of (before, behind)."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, x in enumerate(at):
            run = nodes[x // fan * fan : x // fan * fan + fan]
            proofs[i].append(("".join(run[: x % fan]), "".join(run[x % fan + 1 :])))
        nodes = [sha(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        at = [x // fan for x in at]
    return nodes[0], proofs


def manifest(docs, fan=16):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in docs:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        built[s] = merkle([x[2] for x in trees[s]], fan)
    root, above = merkle([built[s][0] for s in names], fan) if names else (None, [])
    out = []
    for s, up in zip(names, above):
        for (_, _, own, r), proof in zip(trees[s], built[s][1]):
            seen = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                seen = leaf((*r[:4], r[4].translate(UPPER)))
            for before, behind in proof + up:
                seen = sha(before, seen, behind)
            out.append((r[0], own, built[s][0], root, sha(*[b + e for b, e in proof + up]), seen, seen == root))
    return out
