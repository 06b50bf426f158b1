"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def substrings(docs, window=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256), for op2."""
    seen, out = set(), {}
    for key, text in sorted(docs.items()):
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            s = text[i : i + window]
            if s in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(s)
        kept = bytes(c for c, g in zip(text, gone) if not g)
        out[key] = len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()
    return out


def passages(docs, window=13):
    """doc_id -> (n_words, n_removed, sha256), for op7."""
    seen, out = {}, {}
    for key, text in sorted(docs.items()):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            s = b" ".join(words[i : i + window])
            if seen.setdefault(s, key) < key:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[key] = len(words), sum(gone), hashlib.sha256(kept).hexdigest()
    return out


def simhash(text, k=3):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs, bits=3, k=3):
    """doc_id -> (fingerprint, component_id), for op5."""
    prints = {key: simhash(text, k) for key, text in docs.items()}
    root = {key: key for key in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {key: (f"{prints[key]:016x}", find(key)) for key in keys}


def near_components(docs, k=5, least=0.8):
    """doc_id -> component_id under Jaccard similarity of k-word shingle sets."""
    sets = {}
    for key, text in docs.items():
        words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in text))
        sets[key] = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    holders = {}
    for key, s in sets.items():
        for x in s:
            holders.setdefault(x, set()).add(key)
    root = {key: key for key in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [key for key, s in sets.items() if not s]
    for a, s in sets.items():
        near = set().union(*(holders[x] for x in s)) if s else set(empty)
        for b in near:
            both = len(s & sets[b])
            if b < a and both >= least * (len(s) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {key: find(key) for key in docs}


def kneser_ney(classes, discount):
    """text -> its log-likelihood under the interpolated bigram model of each class (a list of texts), for op3."""
    import math
    from collections import Counter, defaultdict

    def words(text):
        return re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text))

    times, contexts = [], []
    for texts in classes:
        times.append(Counter(p for t in texts for p in zip([None, *words(t)], words(t))))
        contexts.append(Counter(w for _, w in times[-1]))
    vocabulary = set().union(*contexts)
    total = {w: sum(c[w] for c in contexts) + 0.5 for w in [*vocabulary, "unseen"]}
    whole = sum(total.values())

    def likelihood(text, c):
        n = sum(contexts[c].values())
        kept = {w: max(k - discount, 0) / n for w, k in contexts[c].items()}
        left = 1 - sum(kept.values())
        after = defaultdict(dict)
        for (v, w), k in times[c].items():
            after[v][w] = k
        logs = 0.0
        for v, w in zip([None, *words(text)], words(text)):
            p = kept.get(w, 0) + left * total.get(w, 0.5) / whole
            if v in after:
                m = sum(after[v].values())
                share = {x: max(k - discount, 0) / m for x, k in after[v].items()}
                p = share.get(w, 0) + (1 - sum(share.values())) * p
            logs += math.log(p)
        return logs

    return lambda text: [likelihood(text, c) for c in range(len(classes))]


def piecewise(text, least, context, hashes):
    """The fingerprint of op8, place by place; ``hashes`` gives the module's hash of a run of bytes, for triggers and for chunks."""
    n, alphabet = len(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    if not n:
        return "0::"
    trigger, chunk = hashes

    def signature(k):
        out, start = "", 0
        for end in range(context, n + 1):
            h = trigger(text[end - context : end])
            far = end - start >= max(2**k // 4, n // (8 * least), 1)
            if far and h % 2**k == 0:
                out += alphabet[chunk(text[start:end]) >> 58]
                start = end
        return out + alphabet[chunk(text[start:]) >> 58] * (start < n)

    k = (n // least).bit_length()
    while k and len(signature(k)) < least:
        k -= 1
    return f"{k}:{signature(k)}:{signature(k + 1)}"
