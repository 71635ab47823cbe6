"""Plain versions of the operators, one text after another, for comparison on small inputs."""

import collections
import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import xxhash


def fold(key, parts):
    return zlib.crc32((str(key) if key is not None else "").encode()) % parts


def substring(rows, size=13):
    """{doc_id: (n_words, n_removed, sha256)} of (doc_id, text) rows with distinct ids."""
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][p : p + size]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def unigrams(rows, is_train):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}."""
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    counts = collections.Counter(w for i, ws in tokens.items() if is_train(i) for w in ws)
    total, types = sum(counts.values()), len(counts)
    return {
        i: (
            len(ws),
            sum(counts[w] > 0 for w in ws),
            total,
            sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws),
        )
        for i, ws in tokens.items()
    }


def top_k(rows, k=10, step=100, scale=1024):
    usable = [
        (i, [math.floor(scale * Fraction(float(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q, qv in usable:
        if q % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in usable if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def text_measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(runs)
    inside = set()
    for i, run in enumerate(runs):
        if counts[run] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
    )


def targets(sizes, max_rate=3):
    """{source: target} by water filling, sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(order)}
    everything, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        rest = everything - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > max_rate * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: max_rate * sizes[s] for s in over}


def simhash(rows, size=3, distance=2):
    """{doc_id: (fingerprint, component)}."""
    prints = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        runs = [b" ".join(w[j : j + size]) for j in range(max(len(w) - size + 1, 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def forward(model, symbols):
    """log10 probability of one symbol sequence, without scaling tricks beyond logarithms."""
    state = np.log(model.start) + np.log(model.emit[:, symbols[0]])
    for s in symbols[1:]:
        state = np.array(
            [np.logaddexp.reduce(state + np.log(model.move[:, k])) for k in range(len(state))]
        ) + np.log(model.emit[:, s])
    return np.logaddexp.reduce(state) / math.log(10)


def baum_welch(model, symbols, sums):
    """Adds the expected counts of one whole sequence, by plain forward and backward recursions in logarithms."""
    move, emit, n = np.log(model.move), np.log(model.emit), len(symbols)
    ahead = [np.log(model.start) + emit[:, symbols[0]]]
    for s in symbols[1:]:
        ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + move, axis=0) + emit[:, s])
    behind = [np.zeros(len(move))]
    for s in symbols[:0:-1]:
        behind.insert(0, np.logaddexp.reduce(move + emit[:, s] + behind[0], axis=1))
    total = np.logaddexp.reduce(ahead[-1])
    for t, s in enumerate(symbols):
        sums["emit"][:, s] += np.exp(ahead[t] + behind[t] - total)
    for t in range(n - 1):
        sums["move"] += np.exp(ahead[t][:, None] + move + emit[:, symbols[t + 1]] + behind[t + 1] - total)
    sums["start"] += np.exp(ahead[0] + behind[0] - total)
    sums["log"] += total / math.log(10)
    sums["tokens"] += n
