"""Plain definitions that the operators are held against."""

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_classes(texts):
    """{doc_id: smallest doc_id of its class} by comparing every two texts."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    seqs = {k: tuple(words(t)) for k, t in texts.items()}
    up = {k: k for k in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if not sets[a] or not sets[b]:
                continue
            x, y = sets[a], sets[b]
            if seqs[a] == seqs[b] or len(x & y) >= 0.8 * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {k: top(k) for k in texts}


def repeated_bytes(texts, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    seen, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contamination(docs, items, window=13):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        ids = sorted(str(x) for x in found)
        out[doc] = (len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w))
    return out


KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)
