"""Near copies of the pipeline against all pairs, with planted edits."""

import random

import corpus_pipeline
from terradelta.llm import near_copies
from tests.llm import reference as plain


def shingles(text):
    words = plain.tokens(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(docs):
    """The smallest doc_id of each group of texts with a Jaccard similarity of 0.8 or more."""
    group = {d: d for d, _ in docs}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    sets = [(d, shingles(t)) for d, t in docs]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                u, v = sorted((find(a), find(b)))
                group[v] = u
    return {find(d) for d in group}


def planted():
    rng = random.Random(8)
    made = []
    for i in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        made.append(base)
        for share in (0, 0.005, 0.01, 0.02, 0.03, 0.06):  # of words replaced; similarity 1 to about 0.5
            made.append([w if rng.random() >= share else f"x{rng.randrange(5000)}" for w in base])
        made.append(base[: len(base) * 5 // 6])
    crowd = [f"c{j}" for j in range(300)]
    made += [crowd[:k] + [f"e{k}"] + crowd[k + 1 :] for k in range(1, 300, 6)]  # one word each: all alike
    texts = [" ".join(w) for w in made] + ["", None, "One two", "one TWO", "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_edited_copies_leave_the_pipeline(spark, sf_dir):
    made = planted()
    table = spark.createDataFrame([*made, made[0], (None, "lost")], "doc_id long, text string")
    out = corpus_pipeline.one_of_each(spark, table, sf_dir)
    assert out.columns == table.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(None) == 1 and sorted(x for x in ids if x is not None) == sorted(kept(made))
    assert corpus_pipeline.one_of_each(spark, table.limit(0), sf_dir).count() == 0


def test_crowded_bands_are_compared_to_the_end(spark):
    rng = random.Random(9)
    sets = []
    for i in range(60):  # groups of three that share a band value with all others
        base = rng.sample(range(10**6), 90)
        sets += [(3 * i, base), (3 * i + 1, base[9:] + [10**6 + i]), (3 * i + 2, base[:-9] + [2 * 10**6 + i])]
    nodes = spark.createDataFrame(sets, "node long, hashes array<long>")
    members = nodes.selectExpr("7L AS band", "node")
    found = near_copies.components(near_copies.links(members, nodes)).collect()
    near = {(b, a) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})}
    assert len(near) >= 120 and {r["node"]: r["root"] for r in found} == {3 * i + k: 3 * i for i in range(60) for k in (1, 2)}


def test_grid_of_fingerprints_finds_and_ties(spark, monkeypatch):
    """The grid brings together what differs in two bits of a word; without bands its verified candidates alone make the groups."""
    rng = random.Random(10)
    made = []
    for i in range(40):
        base = [f"g{rng.randrange(9000)}" for _ in range(400)]
        made += [base, base[:200] + ["changed"] + base[201:], [f"h{rng.randrange(9000)}" for _ in range(60)]]
    texts = [" ".join(w) for w in made]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near_copies.shingles(t.encode()) for t in texts]
    words = [near_copies.fingerprint(s) for s in sets]
    nodes = [near_copies._digest(s) for s in sets]
    close = lambda a, b: any((x ^ y).bit_count() <= 2 for x, y in zip(words[a], words[b]))
    want = {(a, b) for a in range(len(texts)) for b in range(a) if close(a, b)}
    found = near_copies.grid_pairs(near_copies.signatures(docs).select("node", "words")).collect()
    at = {n: i for i, n in enumerate(nodes)}
    assert {tuple(sorted((at[r["hi"]], at[r["lo"]]), reverse=True)) for r in found} == want
    edited = {(3 * i + 1, 3 * i) for i in range(40)}
    assert len(want & edited) >= 30
    monkeypatch.setattr(near_copies, "shared_keys", lambda df, key, name: near_copies.staged(df.select(key).limit(0), name))
    groups = near_copies.groups(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in groups if r["doc_id"] != r["component_id"]} == want & edited


def test_words_of_a_fingerprint_by_hand():
    shingles_of = near_copies.shingles(b"one two three four five six seven")
    mixed = [[int(x) for x in near_copies._mixed(shingles_of, turn)] for turn in range(3)]
    for i, word in enumerate(near_copies.fingerprint(shingles_of)):
        assert word >> near_copies.BITS == sum(3 << 2 * b for b in range(8) if i >> b & 1)
        for bit in range(near_copies.BITS):
            byte, low = divmod(i * near_copies.BITS + bit, 8)
            turn, byte = divmod(byte, 8)
            ones = sum(x.to_bytes(8, "little")[byte] >> (7 - low) & 1 for x in mixed[turn])
            assert word >> (near_copies.BITS - 1 - bit) & 1 == (2 * ones > len(shingles_of))
    assert near_copies.fingerprint(near_copies.shingles(b"")) == []
