"""Plain Python versions of the operators' stated results."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(rows):
    """doc_id -> (number of shingles, smallest doc_id reachable)."""
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t))
        k = min(5, len(w))
        sets[d] = frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    of = {}
    for d, s in sets.items():
        for x in s:
            of.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in of.values() for i, a in enumerate(ds) for b in ds[:i]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c)
        total += (c * 2 - 9 if c > 4 else c * 2) if i % 2 else c
    return total % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m[0])


SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m)) <= 15),
]


def spans(text, kinds):
    """Counts by kind and the SHA-256 of the span text."""
    found = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))
    written = ",".join(f"{kinds[i][0]}:{a}:{b}" for a, i, b in found)
    return tuple(sum(i == k for _, i, _ in found) for k in range(len(kinds))), hashlib.sha256(written.encode()).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = WORD.findall(text or "")
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
