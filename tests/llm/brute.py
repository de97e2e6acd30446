"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections import Counter, defaultdict
from functools import lru_cache

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


@lru_cache(maxsize=1)
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    return own


def token_row(text):
    own = tokenizer()
    ids = own.encode(text or "", add_special_tokens=False).ids
    back = own.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, distance=2):
    """Smallest id reachable from each row; ``ids`` may hold None, which comes last."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) for i in range(len(ids))], [find(i) for i in range(len(ids))]


def near_groups(rows):
    """Smallest id of each group of near copies of (doc_id, text): five-word shingles, similarity 0.8; all pairs are compared."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return sorted(min(g) for g in groups.values())


def base_facts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def verdicts(rows, least=20, share=0.0, left=0.3, per="texts"):
    """(facts, removed, kept) of each (text, host)."""
    return judged(rows, least, share, left, per)[0]


def judged(rows, least=20, share=0.0, left=0.3, per="texts"):
    """``verdicts``, and each text without its common lines."""
    normal = lambda line: " ".join(WORD.findall(line)).lower()
    texts, docs = defaultdict(set), defaultdict(set)
    for i, (text, host) in enumerate(rows):
        one = i if per == "documents" else text or ""
        for line in (text or "").split("\n"):
            if normal(line):
                texts[host, normal(line)].add(one)
                docs[host].add(one)
    common = {k for k, v in texts.items() if len(v) > least and len(v) > share * len(docs[k[0]])}
    out, rest = [], []
    for text, host in rows:
        facts = base_facts(text)
        own = [x for x in (text or "").split("\n") if (host, normal(x)) not in common]
        rest.append(text if len(own) == len((text or "").split("\n")) else "\n".join(own))
        gone = sum(len(normal(x).split(" ")) for x in (text or "").split("\n") if (host, normal(x)) in common)
        out.append((facts, gone, not facts["base_failed"] and not facts["n_words"] - gone < left * facts["n_words"]))
    return out, rest


def targets(sizes, budget):
    """Targets by repeated sharing of what capped sources leave."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, open_ = {}, set(names)
    left = budget
    while open_:
        total = sum(weight[s] for s in open_)
        capped = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not capped:
            return out | {s: left * weight[s] / total for s in open_}
        for s in capped:
            out[s] = float(2 * sizes[s])
            left -= out[s]
        open_ -= capped
    return out


def mix(rows, seed="mix"):
    """taken words of each (doc_id, source, text)."""
    size = [len(WORD.findall(t or "")) for _, _, t in rows]
    by = defaultdict(list)
    for i, (d, s, t) in enumerate(rows):
        key = int(hashlib.md5(f"{seed}:{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        by[s].append((key, size[i], i))
    total = {s: sum(x[1] for x in v) for s, v in by.items()}
    budget = 1.5 * sum(total.values())
    target = targets(total, budget)
    order = {s: i for i, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}
    items = []
    for s, v in by.items():
        run = 0
        for repeat in range(2):
            for key, n, i in sorted(v):
                run += n
                if n and target[s]:
                    items.append((run / target[s], order[s], key, n, i))
    taken, run = [0] * len(rows), 0
    for *_, n, i in sorted(items):
        run += n
        if run > budget:
            break
        taken[i] += n
    return size, [target[s] for _, s, _ in rows], taken
