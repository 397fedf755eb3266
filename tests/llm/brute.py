"""Plain Python versions of the operators, for small tables of (doc_id, text)."""
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(rows, n=20):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(text or "")
        drop = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i: i + n])
            if k in seen:
                drop[i: i + n] = [True] * n
            seen.add(k)
        out[doc] = (len(w), sum(drop), sha(" ".join(x for x, d in zip(w, drop) if not d)))
    return out


def line_key(line):
    return line.strip(BLANK).translate(LOWER)


def lines(rows, least=10):
    first = {}
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = line_key(line)
            if len(k) >= least:
                first[k] = min(doc, first.get(k, doc))
                holders.setdefault(k, set()).add(doc)
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        keep = [x for x in parts if not (len(line_key(x)) >= least and len(holders[line_key(x)]) > 1 and first[line_key(x)] != doc)]
        out.append((doc, len(parts), len(parts) - len(keep), "\n".join(keep)))
    return out


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(nodes, linked):
    """Smallest member reachable from each node."""
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(rows, percent=75):
    sets = {doc: shingles(text) for doc, text in rows}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c, c == d) for d, c in groups(ids, pairs).items()}
