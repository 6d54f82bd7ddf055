"""Slow, literal restatements of the rules in plain Python, to compare the Spark forms with."""

import hashlib
import math
import random
from collections import Counter

SIMPLE_H = {"AA": -7.9, "AT": -7.2, "TA": -7.2, "CA": -8.5, "GT": -8.4, "CT": -7.8, "GA": -8.2, "CG": -10.6, "GC": -9.8, "GG": -8.0}
SIMPLE_S = {"AA": -22.2, "AT": -20.4, "TA": -21.3, "CA": -22.7, "GT": -22.4, "CT": -21.0, "GA": -22.2, "CG": -27.2, "GC": -24.4, "GG": -19.9}


def rc(s):
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[b] for b in reversed(s))


def tm(s, strand=250.0, sodium=50.0, magnesium=0.0):
    h = s_ = 0.0
    for p in range(len(s) - 1):
        pair = s[p : p + 2]
        pair = pair if pair in SIMPLE_H else rc(pair)
        h, s_ = h + SIMPLE_H[pair], s_ + SIMPLE_S[pair]
    for end in (s[0], s[-1]):
        dh, ds = (2.3, 4.1) if end in "AT" else (0.1, -2.8)
        h, s_ = h + dh, s_ + ds
    if magnesium:
        sodium += 120 * math.sqrt(magnesium)
    s_ += 0.368 * (len(s) - 1) * math.log(sodium / 1000)
    return 1000 * h / (s_ + 1.987 * math.log(strand / 2 * 1e-9)) - 273.15


def best_run(a, partner, window):
    """(length, start, offset) by looking at every run on every diagonal."""
    n, runs = len(a), []
    for offset in range(-n + 1, n):
        cells = [0 <= i + offset < n and a[i] == partner[i + offset] for i in range(n)]
        i = 0
        while i < n:
            size = 0
            while i + size < n and cells[i + size]:
                size += 1
            if size and i + size - 1 >= n - window:
                runs.append((-size, offset, i))
            i += size or 1
    if not runs:
        return 0, 0, None
    size, offset, start = min(runs)
    return -size, start, offset


def longest_stem(s, gap):
    """The longest text that occurs both in ``s`` and in its reverse complement, every base more than ``gap``
    away from the one it would pair with."""
    n, partner = len(s), rc(s)
    return max(
        (
            size
            for size in range(1, n + 1)
            for i in range(n - size + 1)
            for j in range(n - size + 1)
            if s[i : i + size] == partner[j : j + size]
            and all(abs(n - 1 - (j + k) - (i + k)) > gap for k in range(size))
        ),
        default=0,
    )


def has_tandem(s, unit, copies):
    return any(s[i : i + unit] * copies == s[i : i + unit * copies] for i in range(len(s) - unit * copies + 1))


def conflicts(sequences, window, min_run, gate, limit, **chemistry):
    found = {}
    for j, b in enumerate(sequences):
        for i in range(j):
            size, start, _ = best_run(sequences[i], rc(b), window)
            if size >= max(min_run, gate):
                hot = tm(sequences[i][start : start + size], **chemistry)
                if hot > limit:
                    found[i, j] = hot
    return found


def greedy_set(sequences, edges):
    """Survivors: in each round everyone goes who outranks all that it conflicts with."""
    left, gone = {frozenset(e) for e in edges}, set()
    while left:
        count = Counter(v for e in left for v in e)
        beaten = {min(e, key=lambda v: (count[v], sequences[v])) for e in left}
        top = set(count) - beaten
        gone |= top
        left = {e for e in left if not e & top}
    return set(range(len(sequences))) - gone


def random_pool(count, length, seed, alphabet="ACGT"):
    rng, pool = random.Random(seed), []
    while len(pool) < count:
        text = "".join(rng.choice(alphabet) for _ in range(length))
        if text not in pool:
            pool.append(text)
    return pool


def pair_in_turn(sequences, fits, target, seed, stagnation, multiplier=50, scale=1.0):
    """(pairs, free, attempts, rejected, recycled) of drawing and swapping one after the other."""
    free, pairs, layer, budget = set(sequences), [], 1, max(1, len(sequences) * multiplier)
    attempts = rejected = recycled = since = 0

    def shuffled(texts, layer_no):
        return sorted(texts, key=lambda s: (int(hashlib.md5(f"{seed}-{layer_no}-{s}".encode()).hexdigest()[:15], 16), s))

    while len(free) >= 2 and len(pairs) < target and since < stagnation and budget - attempts >= len(free) // 2:
        start, before, made = set(free), len(pairs), 0
        couples = len(start) // 2
        layers = min(-(-max(stagnation, 2 * len(start)) // couples), (budget - attempts) // couples)
        for one in range(layer, layer + layers):
            order = shuffled(start, one)
            for u, v in zip(order[::2], order[1::2]):
                if u in free and v in free and len(pairs) < target:
                    made += 1
                    if fits(u, v):
                        pairs.append((u, v))
                        free -= {u, v}
        layer += layers
        attempts, rejected = attempts + made, rejected + made - (len(pairs) - before)
        since = 0 if len(pairs) > before else since + made
        if len(free) >= 2 and pairs and len(pairs) < target and scale > 0 and budget - attempts >= 2:
            order, before, made = shuffled(free, layer), len(pairs), 0
            old = [next(p for p in pairs if p[0] == s) for s in shuffled([p[0] for p in pairs], layer)]
            layer += 1
            couples = list(zip(order[::2], order[1::2]))
            for t in range(min(math.ceil(scale * max(stagnation, len(old))), (budget - attempts) // 2)):
                (u, v), (a, b) = couples[t % len(couples)], old[t % len(old)]
                if u in free and (a, b) in pairs and len(pairs) < target:
                    made += 2
                    for fresh in ([(u, a), (v, b)], [(u, b), (v, a)]):
                        if all(fits(*p) for p in fresh):
                            pairs = [p for p in pairs if p != (a, b)] + fresh
                            free -= {u, v}
                            break
            gained = len(pairs) - before
            attempts, rejected, recycled = attempts + made, rejected + made - 2 * gained, recycled + gained
            since = 0 if gained else since + made
    return set(pairs), free, attempts, rejected, recycled
