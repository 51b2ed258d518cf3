"""Language identification recomputed by hand: counts, reliabilities, shares and the posterior of every row."""

import math
import re
from collections import Counter, defaultdict

import pytest

from terradelta.llm import language, queries

LANGS = language.LANGUAGES


def letters(text: str) -> bytes:
    raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    return b" " + b" ".join(raw.split()) + b" "


def triples(text: str) -> Counter:
    plain = letters(text)
    out = Counter()
    for i in range(len(plain) - 2):
        code = (plain[i] << 16 | plain[i + 1] << 8 | plain[i + 2]) * 2654435761 & 0xFFFFFFFF
        out[code >> 18] += 1
    return out


def page_text(html: str) -> str:
    html = re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)|&\w*;?", " ", html)
    return html


def by_hand(docs, pages):
    """(doc_id, page_id) -> (language, confidence, by_text)."""
    counts = {x: Counter() for x in LANGS}
    for d in docs:
        if d["lang"] in LANGS:
            counts[d["lang"]].update(triples(d["text"] or ""))
    total = {x: sum(c.values()) + language.BUCKETS for x, c in counts.items()}
    items = [((d["doc_id"], None), d["text"] or "", d["source"] or "", None, None) for d in docs]
    for p in pages:
        url = p["url"] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        declared = re.search(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", p["html"] or "")
        step = re.match(r"/([A-Za-z]{2})(?:/|$)", path)
        mark = (step[1] if step else host.split(".")[-1]).lower() or None
        items.append(((None, p["page_id"]), page_text(p["html"] or ""), host, declared and declared[1].lower(), mark))
    lik, by_text = [], []
    for _, text, *_ in items:
        found = triples(text)
        weight = min(found.total(), language.EVIDENCE) / max(found.total(), 1)
        lik.append([weight * sum(n * math.log((counts[x][b] + 1) / total[x]) for b, n in found.items()) for x in LANGS])
        by_text.append(LANGS[max(range(len(LANGS)), key=lambda i: (lik[-1][i], -i))])
    overall = Counter(by_text)
    base = [(overall[x] + 1) / (len(items) + len(LANGS)) for x in LANGS]

    def smoothed(seen, above):
        return [(seen[x] + language.PRIOR * a) / (seen.total() + language.PRIOR) for x, a in zip(LANGS, above)]

    hosts, domains = defaultdict(Counter), defaultdict(Counter)
    for (_, _, host, *_), t in zip(items, by_text):
        hosts[host][t] += 1
        domains[".".join(host.split(".")[-2:])][t] += 1

    def reliability(column):
        table = {m: {x: 1 for x in LANGS} for m in LANGS}
        for item, t in zip(items, by_text):
            if item[column] in table:
                table[item[column]][t] += 1
        return {m: [math.log(table[m][x] / sum(r[x] for r in table.values())) for x in LANGS] for m in LANGS}

    declared, address = reliability(3), reliability(4)
    out = {}
    for (key, _, host, d, a), own, t in zip(items, lik, by_text):
        prior = smoothed(hosts[host], smoothed(domains[".".join(host.split(".")[-2:])], base))
        none = [0.0] * len(LANGS)
        scores = [s + u + v + math.log(w) for s, u, v, w in zip(own, declared.get(d, none), address.get(a, none), prior)]
        best = max(scores)
        out[key] = (LANGS[scores.index(best)], 1 / sum(math.exp(s - best) for s in scores), t)
    return out


def test_every_posterior_by_hand(spark, sf_dir):
    docs, pages = (queries.table(spark, sf_dir, n) for n in ("documents", "pages"))
    odd = [(None, None, None), (-2, "http://de.example.de/fr/x", "<html lang=es-MX><script>the the</script><p>")]
    pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    want = by_hand([r.asDict() for r in docs.collect()], [r.asDict() for r in pages.collect()])
    got = language.identify(docs, pages).collect()
    assert len(got) == len(want) > 200
    for r in got:
        lang, confidence, by_text = want[r["doc_id"], r["page_id"]]
        assert r["by_text"] == by_text
        assert r["confidence"] == pytest.approx(confidence, rel=1e-6)
        assert r["language"] == lang or confidence < 0.5 + 1e-6
