"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from math import log10

import xxhash

BLANKS = " \t\n\x0b\x0c\r"


def raws(rows):
    return [(i, (t or "").encode()) for i, t in rows]


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def order(i):
    return (i is None, i or 0)


def op1(rows, length=200):
    seen = Counter(b[p : p + length] for _, b in raws(rows) for p in range(len(b) - length + 1))
    out = []
    for i, b in raws(rows):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def op2(rows):
    docs = [(i, [*b.lower().split(), None]) for i, b in raws(rows)]
    counts = Counter(w for i, words in docs if fold(i, 7) != 2 for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(i, fold(i, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in docs]


def op4(rows, most=3):
    marks = []
    for i, b in raws(rows):
        w = b.lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        marks.append((i, sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))))
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= most:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(marks):
        if i is not None:
            r = find(k)
            least[r] = min(least.get(r, i), i)
    return [(i, f"{m:016x}", least.get(find(k))) for k, (i, m) in enumerate(marks)]


def op5(rows, file, capacity=4096):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(file), []
    for i, b in raws(rows):
        ids = [*tokenizer.encode(b.decode(), add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), capacity):
            part = ids[at : at + capacity]
            out.append((i, at // capacity, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def line_key(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def op6(rows, least=10):
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line_key(line)
            if len(k) >= least:
                first[k] = min(first.get(k, i), i, key=order)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < least or first[line_key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def op7(rows, size=13):
    docs, first = [(i, b.split()) for i, b in raws(rows)], {}
    for i, w in docs:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i, key=order)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if order(first[tuple(w[p : p + size])]) < order(i):
                gone[p : p + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def op3(rows):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    out = []
    for i, t in rows:
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        at = defaultdict(list)
        for p in range(len(words) - 4):
            at[tuple(words[p : p + 5])].append(p)
        covered = {q for places in at.values() if len(places) > 1 for p in places for q in range(p, p + 5)}
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)))
    return out
