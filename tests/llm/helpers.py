"""Brute-force versions of the operators and fixtures with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

FOLD = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, id string, n bigint, hash string, lang string, source string, n_chars bigint"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=1):
    """Documents with nulls, empty and very long texts, ties and repeated rows; columns that clash with inner names."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    texts = [None, "", "  \n\t ", "One", "one two", "ONE two", base, base.upper(), base + " x", "y " + base, sentence(rng, 30000, 9000), "a " * 500, "a b " * 300, "É é é É", base.replace("w1", "v1")]
    for _ in range(60):
        words = base.split()
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [sentence(rng, rng.randrange(1, 80)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (None, None), (6, base), (6, base)]
    rng.shuffle(rows)
    return [(i, t, "clash", 7, "clash", rng.choice(["en", "fr", None]), "s", len(t or "")) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if w]


def shingle_set(text, k=5):
    w = words(text)
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def clusters(sets):
    """key -> smallest key of its component under 100 * overlap >= 80 * union."""
    where, parent = defaultdict(list), {k: k for k in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, s in sets.items():
        for h in s:
            where[h].append(k)
    for k, s in sets.items():
        for other, both in Counter(o for h in s for o in where[h] if o > k).items():
            if 100 * both >= 80 * (len(s) + len(sets[other]) - both):
                a, b = sorted((find(k), find(other)))
                parent[b] = a
    return {k: find(k) for k in sets}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(i)
    sizes, out = {len(k) for k in windows}, []
    for i, t in docs:
        w, hit, found = item_words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                k = tuple(w[j : j + n])
                if k in windows:
                    hit.update(range(j, j + n))
                    found |= windows[k]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def check_packing(rows, ids, longest=2048):
    """Each id lies in exactly one piece, pieces in gapless sequences of a power of two; returns the tokens of each sequence."""
    at = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        x = ids[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    full = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == full.get(r["sequence_id"], 0) and r["length"] > 0
        full[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(full.values()) <= longest and all(n & (n - 1) == 0 for n in full.values())
    return full
