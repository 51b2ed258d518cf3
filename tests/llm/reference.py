"""Plain forms of the operators, for comparison."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def fingerprint(text):
    words = tokens(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """doc_id -> smallest doc_id reachable, from (doc_id, fingerprint)."""
    group = {d: d for d, _ in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 2:
                u, v = sorted((find(a), find(b)))
                group[v] = u
    return {d: find(d) for d, _ in prints}


def contamination(docs, items):
    windows = defaultdict(set)
    for item_id, text in items:
        words = terms(text)
        for i in range(max(1, len(words) - 12) if words else 0):
            windows[tuple(words[i : i + 13])].add(str(item_id))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        words, hit, found = terms(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                who = windows.get(tuple(words[i : i + size]))
                if who:
                    hit.update(range(i, i + size))
                    found |= who
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


def licenses(text, phrases):
    words = terms(text)
    places = []
    for phrase, label in phrases.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def secrets(text):
    """Base spans as (start, end, kind)."""
    text = text or ""
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[0], order.index(x[2])))


def repeats(docs, size=50):
    """(doc_id, first, end) of runs of words in windows found twice or more."""
    count, lists = Counter(), [(d, tokens(t)) for d, t in docs]
    for _, w in lists:
        count.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for d, w in lists:
        run = None
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                if run and i <= run[1]:
                    run[1] = i + size
                else:
                    run = [i, i + size]
                    out.append((d, run))
    return sorted((d, *r) for d, r in out)


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
