"""Small corpora with the awkward cases, and plain-Python definitions."""

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, grp string, bucket string, node string, key string, hash string"


def words(text):
    return WORD.findall(text or "")


def texts(seed=3):
    """Prose with exact and near copies, shared passages, repeats, nulls, blanks, marks and one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    out = [prose(rng.randint(5, 160)) for _ in range(60)]
    base, passage = prose(90), prose(50)
    out += [base] * 4 + [base.upper()]
    for k in range(12):  # near copies at several distances
        w = base.split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    out += [prose(20) + " " + passage + " " + prose(k) for k in range(1, 9)]
    out += ["ha " * 200, prose(34), prose(35), "one two three", "one two three", "One Two three", " \n\t ", "", None, None, "x", "\x0b\x1c a b   c", prose(9000)]
    return out


def table(spark, rows=None):
    """Documents of `texts` with a repeated row, a null id and other columns that have internal names."""
    rows = list(enumerate(texts())) + [(3, texts()[3]), (None, "a text without an id but with five words")] if rows is None else rows
    return spark.createDataFrame([(i, t, "g", "b", "n", "k", "h") for i, t in rows], DOCS), rows


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near(rows, percent=75):
    """(doc_id, n_shingles) -> component, comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    live = [(i, s) for i, s in sets if i is not None and s]
    pairs = [(a, b) for x, (a, s) in enumerate(live) for b, t in live[x + 1 :] if 100 * len(s & t) >= percent * len(s | t)]
    found = components(pairs, {i for i, _ in sets if i is not None})
    return Counter((i, len(s), found.get(i)) for i, s in sets)


def repeated_words(rows, k):
    """Multiset of (doc_id, kept words) after cutting repeated windows."""
    counts = Counter(tuple(w[i : i + k]) for _, t in rows for w in [words(t)] for i in range(len(w) - k + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if counts[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
