"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter

ASSIGN = re.compile(r"""(?i:(?a:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_duplicates(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    places: dict = {}
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in places.get(s, ()))
        for s in sets[i]:
            places.setdefault(s, []).append(i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    t = text or ""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def repeats(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """id -> (bytes, removed, spans, digest of the rest)."""
    seen: dict[bytes, tuple[int, int]] = {}
    out = {}
    for i, t in sorted(set(docs)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def statistics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def bench_words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contaminated(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, int, str, bool]:
    w, hit, met = bench_words(text), set(), set()
    for k, item in items:
        v = bench_words(item)
        m = min(10, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1 if windows else 0):
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                met.add(str(k))
    return len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def toxic_features(text):
    """Names of all features: words, pairs, triples, skip-grams and stems."""
    w = re.findall("[0-9a-z\u0080-\U0010ffff]+", text.lower())
    out = {("stem", n, x[:n]) for x in w for n in (3, 4, 5) if len(x) > n}
    for offsets in ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3)):
        out |= {(offsets, *[w[i + o] for o in offsets]) for i in range(len(w) - offsets[-1])}
    return out


def ftrl(rows, labels, epochs, alpha, beta, l1, l2):
    """FTRL-proximal, one coordinate at a time; the bias is not regularised."""
    z, n = {}, {}

    def weight(k):
        at, one, two = z.get(k, 0.0), *((0.0, 0.0) if k == "bias" else (l1, l2))
        return 0.0 if k != "bias" and abs(at) <= one else -(at - math.copysign(one, at)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + two)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {k: weight(k) for k in ["bias", *row]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k, v in w.items():
                before = n.get(k, 0.0)
                n[k] = before + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(before)) / alpha * v
    return {k: weight(k) for k in z}


def _best_cut(rows):
    """((gain, gap), feature, direction, threshold) of the best test, or None."""
    info = lambda p, n: math.log2((p + 1) / (n + 2))
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for lo, hi in zip(values, values[1:], strict=False):
            for up in (False, True):
                bad = [b for x, b in rows if (x[f] >= hi if up else x[f] <= lo)]
                p = sum(bad)
                gain = round(p * (info(p, len(bad)) - info(sum(b for _, b in rows), len(rows))), 9)
                if p and gain > 0 and (best is None or (gain, (hi - lo) / (values[-1] - values[0])) > best[0]):
                    best = (gain, (hi - lo) / (values[-1] - values[0])), f, up, (lo + hi) / 2
    return best


def covering(x, bad, least_precision=0.75, least_rows=4, max_rules=12, max_tests=4):
    """Sequential covering over lists: rules of (feature, direction, threshold)."""
    every = list(zip(x, bad, strict=True))
    grow, prune = [r for k, r in enumerate(every) if k % 3 < 2], [r for k, r in enumerate(every) if k % 3 == 2]
    holds = lambda rule, v: all(v[f] >= t if up else v[f] <= t for f, up, t in rule)
    caught = lambda rule, rows: [b for v, b in rows if holds(rule, v)]
    precision = lambda rule: (sum(caught(rule, prune)) + 1) / (len(caught(rule, prune)) + 2)
    rules = []
    while sum(b for _, b in grow) >= least_rows and len(rules) < max_rules:
        rule, left = [], grow
        while left and len(rule) < max_tests and not all(b for _, b in left) and (cut := _best_cut(left)):
            rule.append(cut[1:])
            left = [r for r in left if holds(rule, r[0])]
        while len(rule) > 1:
            without = [rule[:k] + rule[k + 1 :] for k in range(len(rule))]
            shorter = max(without, key=precision)
            if precision(shorter) < precision(rule):
                break
            rule = shorter
        if not rule or not caught(rule, grow) or precision(rule) < least_precision or sum(caught(rule, prune)) < 2:
            break
        rules.append(rule)
        grow, prune = ([r for r in rows if not holds(rule, r[0])] for rows in (grow, prune))
    return rules
