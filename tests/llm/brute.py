"""Plain versions of the operators, for small fixtures."""

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def removal(texts, n):
    """Kept words per text when all words in windows that occur twice are removed."""
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def sha(kept):
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def bag(text, run=5):
    w = words(text)
    return collections.Counter(tuple(w[i : i + run]) for i in range(max(1, len(w) - run + 1))) if w else None


def jaccard(a, b):
    common = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def near_groups(texts, threshold=0.8):
    """Group number per text: components of pairs at the threshold."""
    bags, group = [bag(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and group[i] != group[j] and jaccard(bags[i], bags[j]) >= threshold:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped = set()
    while True:
        free = sum(sizes.values()) - sum(cap * sizes[s] for s in stopped)
        rest = sum(weight[s] for s in order if s not in stopped)
        out = {s: cap * sizes[s] if s in stopped else free * weight[s] / rest for s in order}
        over = {s for s in order if s not in stopped and out[s] > cap * sizes[s]}
        if not over:
            return out
        stopped |= over


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copies(rng, groups=8):
    """Texts in groups of few edits, of all lengths, with repeats, nulls and empty texts."""
    texts = []
    for _ in range(groups):
        base = prose(rng, rng.choice([3, 30, 80, 200, 600])).split(" ")
        for _ in range(rng.choice([1, 2, 5, 20])):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(own))
    return [*texts, None, "", " \n", "a", "a"]


def seeded(seed):
    return random.Random(seed)
