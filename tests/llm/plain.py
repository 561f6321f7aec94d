"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def components(prints, radius):
    """id -> least id reachable, of (id, print) pairs."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(prints):
        for j, b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def repeats(texts, span=200):
    """(bytes, removed, runs, digest of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + span] for b in raw for k in range(len(b) - span + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                mark[k : k + span] = b"\1" * span
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


def counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen, covered = Counter(triples), set()
    for k, t in enumerate(triples):
        if seen[t] > 1:
            covered |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def shingles(text, n=5):
    """Distinct runs of n words, A-Z lower-cased; fewer words are one run, none are none."""
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def groups(sets, least):
    """id -> least id reachable over pairs of sets whose Jaccard similarity is ``least`` or more; empty sets are alike."""
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in (b for b in sets if b < a):
            either = len(sets[a] | sets[b])
            if root[a] != root[b] and (len(sets[a] & sets[b]) / either if either else 1) >= least:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root
