"""Plain versions of the text operators, for small tables."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def substring_dedup(rows, window):
    at = {}
    for d, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[p : p + window])
                at[k] = min(at.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if d is not None and at[tuple(w[p : p + window])] < d:
                gone.update(range(p, p + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def byte_dedup(rows, length):
    from collections import Counter

    seen = Counter(b[p : p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingles(text, n=4):
    w = [x.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for x in words(text)]
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(rows, percent=85):
    from collections import defaultdict

    sets = {d: shingles(t) for d, t in rows}
    have = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            have[x].append(d)
    links = []
    for a, s in sets.items():
        common = {}
        for x in s:
            for b in have[x]:
                if b < a:
                    common[b] = common.get(b, 0) + 1
        links += [(a, b) for b, n in common.items() if 100 * n >= percent * (len(s) + len(sets[b]) - n)]
    root = components(sets, links)
    return [(d, len(sets[d]), root[d]) for d, _ in rows]


def base_pii(text):
    """n_email, n_ip, n_card, n_phone and the listed base spans."""

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (2 if i % 2 else 1)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m)

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    counts, spans = [], []
    for kind, pattern, ok in rules:
        own = [m for m in re.finditer(pattern, text or "") if ok(m.group(0))]
        counts.append(len(own))
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in own]
    return (*counts, ",".join(spans))
