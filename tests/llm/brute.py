"""Plain, slow versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_duplicates(rows, k, percent):
    """doc_id -> (set size, smallest id reachable), by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    have = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            have[g].append(i)
    for i, s in sets.items():
        both = defaultdict(int)
        for g in s:
            for j in have[g]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def remove_repeats(rows, length=50):
    """doc_id -> (bytes, removed, spans, SHA-256 of what is kept)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted(texts):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def contaminated(docs, items, window=13, share=0.75, whole=8):
    """Pairs (doc_id, item_id) with a window of enough equal words on some alignment, all words for items under `whole`; all alignments are tried."""
    out = set()
    for i, t in docs:
        d = words(t)
        for j, u in items:
            b = words(u)
            if not b:
                continue
            size = min(window, len(b))
            need = -(-size * share // 1) if len(b) >= whole else len(b)
            for lead in range(-len(b) + 1, len(d)):
                equal = [0 <= lead + x < len(d) and d[lead + x] == b[x] for x in range(len(b))]
                if max(sum(equal[s : s + size]) for s in range(len(b) - size + 1)) >= need:
                    out.add((i, j))
                    break
    return out


def base_spans(text):
    """kind:start:end of the base kinds, by the plain patterns."""
    t = text or ""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out
