"""The operators' results in plain Python, one document or pair at a time."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

from sheaf.llm import bytecnn, langid

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def trigrams(text: str) -> Counter:
    b = [32 if x < 65 or 91 <= x < 97 or 123 <= x < 128 else x + 32 if x < 91 else x for x in text.encode()]
    codes = [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]
    return Counter((c * 2654435761 & 0xFFFFFFFF) >> 19 for c in codes if c != 0x202020)


def mixture(model: langid.LanguageModel, text: str) -> list[float]:
    """Proportions by expectation-maximisation, the set grown while the penalised likelihood rises."""
    counts, total, langs = trigrams(text), sum(trigrams(text).values()), range(len(model.names))
    p = model.probs.astype(float)
    fit = lambda t: sum(c * math.log(max(sum(t[k] * p[k, g] for k in langs), 1e-30)) for g, c in counts.items()) / 3
    single = [sum(c * math.log(p[k, g]) for g, c in counts.items()) for k in langs]
    t = [float(k == int(np.argmax(single))) for k in langs]
    best, size = max(single) / 3, 1
    while total and size < len(p):
        gain = [-math.inf if t[k] > 0 else sum(c * p[k, g] / sum(t[j] * p[j, g] for j in langs) for g, c in counts.items()) / total for k in langs]
        new = int(np.argmax(gain))
        if gain[new] <= 1:
            break
        u = [x * size / (size + 1) for x in t]
        u[new] = 1 / (size + 1)
        for _ in range(12):
            u = [u[k] * sum(c * p[k, g] / sum(u[j] * p[j, g] for j in langs) for g, c in counts.items()) / total for k in langs]
        u = [x / sum(u) for x in u]
        if fit(u) - best <= 2 + 0.5 * math.log(max(total / 3, 2)):
            break
        t, best, size = u, fit(u), size + 1
    return t


def quality(model: bytecnn.ByteCnn, text: str) -> float:
    """A forward pass over one document's chunks."""
    if model.fixed is not None:
        return model.fixed
    w, b = {k: v.astype(float) for k, v in model.w.items()}, list(text.encode())
    n = max(1, -(-(max(len(b), 1) - bytecnn.WIDTH) // bytecnn.STRIDE) + 1)
    b += [0] * ((n - 1) * bytecnn.STRIDE + bytecnn.WIDTH - len(b))
    top = np.zeros(bytecnn.FILTERS)
    for at in range(0, n * bytecnn.STRIDE, bytecnn.STRIDE):
        x = np.concatenate([w["embed"][c] for c in b[at : at + bytecnn.WIDTH]])
        size = min(bytecnn.SPAN, len(b) - at)
        agree = [np.float32(sum(w["echo"][b[i]] @ w["echo"][b[i - lag]] for i in range(at, at + size) if i >= lag)) / np.float32(size) for lag in bytecnn.LAGS]
        top = np.maximum(top, x @ w["filters"] + np.rint(np.array(agree, np.float32) * 256) / 256 @ w["lags"] + w["bias"])
    return 1 / (1 + math.exp(-(top @ w["out"] + w["base"][0])))


def similar(texts, n=3, percent=70):
    """Size of the set, number of links and component of each document."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    root, degree = {i: i for i in sets}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                degree[a] += 1
                degree[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), degree[i], find(i)) for i in sets}


def repeats(texts, n=200, keep_first=False):
    """Which bytes of each document go: those of strings that start elsewhere too, or earlier."""
    raw, starts = {i: texts[i].encode() for i in sorted(texts)}, defaultdict(list)
    for i, b in raw.items():
        for k in range(len(b) - n + 1):
            starts[b[k : k + n]].append((i, k))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            same = starts[b[k : k + n]]
            if same[0] != (i, k) if keep_first else len(same) > 1:
                gone[k : k + n] = True
        out[i] = gone
    return out


def left(text: str, gone: np.ndarray) -> bytes:
    return bytes(x for x, g in zip(text.encode(), gone) if not g)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
