"""Slow and plain versions of what the operators compute."""

import itertools
import math
import re

import numpy as np
import xxhash


class Groups:
    """Union-find over any keys."""

    def __init__(self, keys):
        self.parent = {k: k for k in keys}

    def find(self, key):
        while self.parent[key] != key:
            key = self.parent[key]
        return key

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)

    def smallest(self):
        members = {}
        for key in self.parent:
            members.setdefault(self.find(key), []).append(key)
        return {key: min(group) for group in members.values() for key in group}


def fingerprint(text, size=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    if len(words) < size:
        shingles = [" ".join(words)]
    else:
        shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_prints(prints, bits=3):
    """Smallest key of each key's component, for a dict of key to fingerprint."""
    groups = Groups(prints)
    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            groups.join(a, b)
    return groups.smallest()


def contained(text, item, min_words=13, min_share=0.8):
    """Longest stretch over all alignments in which enough words agree, or 0."""
    a, b = (re.findall(r"\w+", t.lower()) for t in (text or "", item))
    best = 0
    for offset in range(-len(b) + 1, len(a)):
        pairs = [a[offset + i] == b[i] for i in range(len(b)) if 0 <= offset + i < len(a)]
        sums = list(itertools.accumulate(pairs, initial=0))
        for i, j in itertools.combinations(range(len(sums)), 2):
            if j - i > best and sums[j] - sums[i] >= min_share * (j - i) - 1e-9:
                best = j - i
    return best if b and best >= min(min_words, len(b)) else 0


def clean_lines(rows, sites_share, least_sites, min_chars):
    """Texts of (text, site) rows without the lines that stand on many sites."""
    white = " \t\n\v\f\r"
    needed = max(least_sites, math.ceil(round(sites_share * len({s for _, s in rows} - {None}), 6)))
    sites, whole = {}, {}
    for text, site in rows:
        if site is not None:
            whole.setdefault(text, set()).add(site)
            for line in (text or "").split("\n"):
                if len(bare := line.strip(white)) >= min_chars:
                    sites.setdefault(bare, set()).add(site)
    out = []
    for text, _ in rows:
        kept = [x for x in (text or "").split("\n") if len(sites.get(x.strip(white), ())) < needed]
        cleaned = "\n".join(kept)
        spared = not cleaned.strip(white) or len(whole.get(text, ())) >= needed
        out.append(text if text is None or spared else cleaned)
    return out


def cosine_links(vectors, least=0.9):
    """Pairs of keys whose vectors have at least that cosine."""
    keys = list(vectors)
    unit = np.array([vectors[k] for k in keys], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= least, 1)
    return {tuple(sorted((keys[i], keys[j]))) for i, j in zip(*np.nonzero(near))}
