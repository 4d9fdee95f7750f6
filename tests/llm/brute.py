"""Plain versions of the operators, for small inputs."""

import re
from hashlib import sha256

BLANK = "[\x20\x09-\x0d]+"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(BLANK, low) if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(BLANK, " ", t or ""), []).append(i)
    return sorted(
        (i, min(g), len(g), i == min(g), sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g
    )


def near(rows, k, percent):
    """``n_shingles, component`` of each id by comparing all pairs."""
    held = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in held}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(held)
    for a in ids:
        for b in ids:
            if a < b and held[a] and held[b]:
                if 100 * len(held[a] & held[b]) >= percent * len(held[a] | held[b]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(held[i]), root(i)) for i in ids}


def merged(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeats(rows, length):
    """Removed spans and kept bytes of each id."""
    raw = {i: (t or "").encode() for i, t in rows}
    places = {}
    for i, b in raw.items():
        for p in range(len(b) - length + 1):
            places.setdefault(b[p : p + length], []).append((i, p))
    spans = {i: [] for i in raw}
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                spans[i].append((p, p + length))
    out = {}
    for i, b in raw.items():
        keep = bytearray(b)
        own = merged(spans[i])
        for s, e in reversed(own):
            del keep[s:e]
        out[i] = own, bytes(keep)
    return out


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (2 if n % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """Plain identifiers by the patterns as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def credentials(text):
    flags = re.ASCII | re.IGNORECASE
    rules = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", flags, lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, f, ok) in enumerate(rules) for m in re.finditer(p, text or "", f) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def containment(rows, items, k=5):
    docs = [(i, shingles(t, k)) for i, t in rows]
    return sorted(
        (d, i, len(s & own), len(own)) for i, t in items for own in [shingles(t, k)] if own
        for d, s in docs if 5 * len(s & own) >= 4 * len(own)
    )
