"""What the operators must return, the slow and plain way."""

import hashlib
import random
import re

SPACE = " \t\n\v\f\r"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def random_words(rng: random.Random, n: int, vocabulary: int = 2000) -> list[str]:
    return ["".join(random.Random(rng.randrange(vocabulary)).choices(LETTERS, k=6)) for _ in range(n)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def line_dedup(docs):
    split = {(i, k): (t or "").split("\n") for k, (i, t) in enumerate(docs)}
    owners = {}
    for (i, _), lines in split.items():
        if i is None:
            continue
        for line in lines:
            owners.setdefault(lower(line.strip(SPACE)), set()).add(i)
    out = []
    for (i, _), lines in split.items():
        def gone(x, i=i):
            key = lower(x.strip(SPACE))
            return i is not None and len(key) >= 10 and len(owners[key]) >= 2 and min(owners[key]) != i

        kept = [x for x in lines if not gone(x)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def components(docs):
    sets = []
    for i, t in docs:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), root(i)) for i, s in sets]


def repeats(docs, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs if i is not None]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, b in data:
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                cover[k : k + length] = b"\1" * length
        spans = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        out.append((i, len(b), sum(cover), spans, sha(bytes(x for x, c in zip(b, cover, strict=True) if not c))))
    return out


def hits(docs, items, width=10):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item) if item is not None else "null")
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


def phrases(text, wanted):
    w = words(text)
    return len(w), sorted((k, label) for p, label in wanted for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
