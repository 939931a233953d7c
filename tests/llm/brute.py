"""Plain Python versions of the operators' results, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    words = space_words(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for x in lines:
        if space_words(x):
            dups += x in seen
            seen.add(x)
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dups, "n_repeat_words": len(inside),
        "base_failed": n < 50 or 100 * len(inside) > 50 * n,
    }


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return {**{f"n_{k}": sum(x[1] == i for x in found) for i, k in enumerate(KINDS)}, "base_sha256": hashlib.sha256(said.encode()).hexdigest()}, said


WEAK = {
    "secret": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,64}={0,2}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"(?i)\bhttps?://[a-z0-9._~:/?#@!$&()*+,;=%-]+",
    "user": r"(?i)\b(?:user|username|login|client_?id)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9@._+-]{2,}",
}


def all_secrets(text, reach=400):
    """All spans, weak ones only next to complementary parts (of other places, at most `reach` code points between the starts)."""
    text = text or ""
    _, said = secrets(text)
    parts = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in said.split(",") if x)]
    strong = list(parts)
    parts += [(m.start(), k, m.end()) for k, p in WEAK.items() for m in re.finditer(p, text)]
    out = list(strong)
    for a, k, b in parts:
        if k in WEAK:
            near = {o for x, o, y in parts if abs(x - a) <= reach and (y <= a or x >= b)}
            secret, login = near & {"assign", "hex", "secret"}, near & {"access", "user"}
            if k == "secret" and ("access" in near or {"user", "endpoint"} <= near) or k == "endpoint" and secret and login or k == "user" and secret and "endpoint" in near:
                out.append((a, k, b))
    return sorted(out, key=lambda s: (s[0], [*KINDS, *WEAK].index(s[1]), s[2]))


def redacted(text, mark="[SECRET]"):
    out, at = "", 0
    for a, _, b in all_secrets(text):
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    return out + text[at:]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, size=10):
    windows = {}
    for item_id, text in items:
        words = bench_words(text)
        for i in range(max(1, len(words) - size + 1)) if words else ():
            windows.setdefault(tuple(words[i : i + size]), set()).add(item_id)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words, hit, own = bench_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if ids := windows.get(tuple(words[i : i + n])):
                    own |= ids
                    hit.update(range(i, i + n))
        out.append((doc_id, len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, most=4):
    """Smallest id reachable over links of at most `most` differing bits."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ids}
