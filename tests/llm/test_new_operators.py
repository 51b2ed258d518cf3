"""Exact duplicates, filter audit, ranked search and bitmaps against plain forms, on made tables with hard cases."""

import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from terradelta.llm import exact_dedup, filter_audit, membership, ranked_search
from tests.llm import reference as plain

ROWS = "doc_id long, text string, lang string, source string, digit string, part int, n string, rest int"


def made(spark, rows):
    """A table of (doc_id, text, lang) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "s", "d", 1, "n", 2) for r in rows], ROWS)


def hard_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["É", "ſs", "THE", "Data", "a#b", "50%", "x" * 700]
    body = [" ".join(rng.choices(words, k=rng.randint(1, 260))) for _ in range(60)]
    long = "long text " * 30_000
    rows = [(i, rng.choice(body), rng.choice(["en", "fr", None])) for i in range(10, 150)]
    rows += [(200, long + "a", "en"), (201, long + "b", "en"), (202, long + "a", "en"), (203, long, "en")]
    rows += [(210, "p" * 63, "en"), (211, "p" * 64, "en"), (212, "p" * 65, "en"), (213, "p" * 64, "en"), (214, "p" * 4160, "de"), (215, "p" * 4160, "de")]
    rows += [(1, None, None), (2, "", "en"), (3, "", None), (4, " \t\n\x0b\x0c\r ", "en"), (None, "lost", "en"), (None, "lost", "en"), (None, "", "en")]
    rows += [(5, "same id", "en"), (5, "another text", "en"), (6, "another text", "en"), (7, "twice", "en"), (7, "twice", "en"), (8, "twice", "fr")]
    rows += [(300 + i, "hot copy of a text that a third of all rows hold", "en") for i in range(100)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def hard(spark):
    return made(spark, hard_rows()).repartition(7).persist()


def sorted_rows(rows):
    return sorted(rows, key=repr)


# --- exact duplicates ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("first, growth", [(64, 64), (1, 2), (3, 5)])
def test_exact_duplicates(hard, first, growth):
    rows = hard_rows() if first == 64 else [r for r in hard_rows() if len(r[1] or "") < 5000]
    table = hard if first == 64 else hard.where("coalesce(length(text), 0) < 5000")
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(t or "", []).append(d)
    want = []
    for d, t, _ in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        want.append((d, keep, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    got = exact_dedup.duplicates(table, first, growth)
    assert sorted_rows(tuple(r) for r in got.collect()) == sorted_rows(want)


def test_distinct_texts(hard):
    got = exact_dedup.distinct_texts(hard)
    assert got.columns == hard.columns
    best = {}
    for d, t, _ in hard_rows():
        best[t or ""] = max(best.get(t or "", -1), -1 if d is None else d)
    found = [((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in got.collect()]
    assert sorted(found) == sorted((d, t) for t, d in best.items())
    empty = hard.limit(0)
    assert exact_dedup.distinct_texts(empty).count() == 0 and exact_dedup.duplicates(empty).count() == 0


# --- filter audit -------------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    judged = []
    for d, t, lang in rows:
        t = t or ""
        words = [w for w in plain.re.split(r"[\x20\x09-\x0D]+", t) if w]
        failed = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        failed += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        if d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows):
            failed += "E"
        judged.append((lang or "", failed, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        mine = [x[1:] for x in judged if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                fail = sum(f in x[0] for x in mine)
                alone = sum(x[0] == f for x in mine)
                out[part, order, step] = [len(left), len(gone), fail - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone), 0]
    for (part, order, step), row in out.items():
        row[6] = sum(out[part, o, o.index(order[step - 1]) + 1][1] for o in map("".join, permutations("ABCDE")))
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit(spark, hard):
    rng = random.Random(4)
    rows = hard_rows()
    labels = [(rng.choice([r[0] for r in rows]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)] + [(9999, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")).withColumn("hash", F.lit("y"))
    got = filter_audit.audit(hard, table)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)
    assert filter_audit.audit(hard.limit(0), table).count() == 0
    bare = filter_audit.audit(hard, table.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(bare) == (0, 0)


def test_sketch_clears_unique_texts_only(hard):
    got = filter_audit.possible_repeats(hard.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "again").collect()
    count = Counter(r["text"] for r in got)
    assert all(r["again"] for r in got if count[r["text"]] > 1) and not any(r["again"] for r in got if count[r["text"]] == 1)


# --- ranked search ------------------------------------------------------------------------------------------------


def plain_search(rows, items, best=10):
    texts = [(d, Counter(plain.terms(t))) for d, t, _ in rows if t is not None]
    texts = [(d, c) for d, c in texts if c]
    total, df = sum(c.total() for _, c in texts), Counter(w for _, c in texts for w in c)
    wanted = {}
    for item, text in items:
        if item is not None and text is not None:
            wanted.setdefault(item, set()).update(plain.terms(text))
    out = []
    for item, words in wanted.items():
        found = []
        for d, c in texts:
            m = 100 - 90 + 90 * c.total() * len(texts) // total
            weight = lambda w: math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * df[w] + 1)))
            score = sum(weight(w) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


ITEMS = [
    (1, "w1 w2 w3 W4 w5 w6 w7 data the"), (2, "É THE the w9"), (3, None), (4, ""), (5, "unknownword"), (None, "w1"), (6, "hot copy of a text"),
    (1, "w200"), (1, "w200"), (7, " ".join(f"w{i}" for i in range(300))), (8, "long"), (9, "...!"), (10, "p" * 64 + " twice lost"),
]


@pytest.mark.parametrize("max_terms", [100_000, 40])
def test_ranked_search(spark, hard, max_terms):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit("x"))
    got = ranked_search.search(hard, benchmark, max_terms=max_terms)
    assert sorted(tuple(r) for r in got.collect()) == plain_search(hard_rows(), ITEMS)
    assert ranked_search.search(hard.limit(0), benchmark).count() == 0
    assert ranked_search.search(hard, benchmark.limit(0)).count() == 0


def test_bounds_are_never_below_the_scores(spark, hard):
    found = {i: set(w.encode() for w in plain.terms(t)) for i, t in ITEMS if i and t}
    items = ranked_search.prepared(hard, found)
    bound = {}
    for row in ranked_search.signatures(hard).collect():
        for k, doc_id in enumerate(row["ids"]):
            values = ranked_search.bounds(items, row["width"], ranked_search.np.array(row["lengths"]), bytes(row["slices"]))[:, k]
            bound[doc_id] = [max(a, b) for a, b in zip(bound.get(doc_id, [0] * len(values)), values.tolist())]
    exact = plain_search(hard_rows(), [(i, b" ".join(w).decode()) for i, w in found.items()], best=10**6)
    tight = [bound[d][items.ids.index(i)] / s for i, _, d, s in exact]
    assert min(tight) >= 1 and sorted(tight)[len(tight) * 9 // 10] < 1.1


# --- bitmaps ------------------------------------------------------------------------------------------------------


def test_listed_rows_and_repeated_rows(spark, hard, monkeypatch):
    ids = [(i,) for i in (1, 5, 7, 7, 203, 9999)] + [(i,) for i in range(300, 350)] + [(None,)]
    listed = spark.createDataFrame(ids, "key long")
    want = sorted_rows((r["doc_id"], r["text"]) for r in hard.collect() if (r["doc_id"],) in ids and r["doc_id"] is not None)
    for bits, parts in ((1 << 26, 1 << 23), (64, 1 << 23), (1 << 26, 20), (64, 1)):  # one word: many levels; one key: a join
        monkeypatch.setattr(membership, "BITS", bits)
        got = membership.listed_rows(hard, "doc_id", listed, parts)
        assert got.columns == hard.columns
        assert sorted_rows((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert membership.listed_rows(hard, "doc_id", listed.limit(0)).count() == 0
    once = Counter(r["doc_id"] for r in membership.one_of_repeated(hard, "doc_id").collect())
    assert once.pop(None) == 3 and set(once.values()) == {1} and len(once) == len({r[0] for r in hard_rows()} - {None})
