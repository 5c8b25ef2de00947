"""Documents shorter than an item, against brute force that takes them whole."""

import re
from collections import Counter

import numpy as np

from contentloom.llm import decontamination


def shingles(words):
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def plain_leaks(items, text, threshold=0.8):
    words, found = re.findall(r"\w+", text.lower()), []
    for item, source in items:
        own, best = re.findall(r"\w+", source.lower()), None
        for start in range(max(len(words) - len(own), 0) + 1 if own and words else 0):
            end = min(start + len(own), len(words))
            a, b = shingles(words[start:end]), shingles(own)
            both = sum((a & b).values())
            sim = both / (sum(a.values()) + sum(b.values()) - both)
            if sim >= threshold and (best is None or sim > best[2]):
                best = (start, end, sim)
        if best:
            found.append((item, *best))
    return found


def test_trimmed_items_leak():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([1, 3, 4, 5, 6, 8, 9, 10, 16, 16, 20, 33, 59, 59])]
    index, met = decontamination.Index(items, 0.8, 24), 0
    for place, source in items:
        words = source.split()
        for first in range(4):
            for last in range(14):
                trimmed = " ".join(words[first : len(words) - last])
                assert index.leaks(trimmed) == plain_leaks(items, trimmed)
                met += first + last > 0 and any(leak[0] == place for leak in index.leaks(trimmed))
    assert met > 40
    assert index.leaks(" ".join(items[8][1].split()[:-1])) == [(8, 0, 15, 11 / 12)]
