"""Near-duplicate groups against all pairs, with blocks so small that every path is taken."""

import random
import re

from palimpsest.llm import trie_join
from palimpsest.llm.trie_join import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").translate({65 + i: 97 + i for i in range(26)}))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets, least = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and sets[j]:
                least[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            groups.setdefault(find(i), []).append(k)
    return sorted(((k, len(sets[i]), min(groups.get(find(i), [None]), key=lambda x: (x is None, x))) for i, (k, _) in enumerate(rows)), key=repr)


def found(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame, **how).collect()], key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[rnd.choice(words) for _ in range(60)] for _ in range(3)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.5 and texts:
            base = rnd.choice(texts[:12]).split()
            for _ in range(rnd.randint(0, 4)):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            texts.append(" ".join(base))
        elif kind < 0.8:
            texts.append(" ".join(rnd.choice(passages) + [rnd.choice(words) for _ in range(rnd.randint(5, 25))]))
        else:
            texts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))))
    return [(i * 3 % n if n % 3 else i, t) for i, t in enumerate(texts)]


def test_against_all_pairs_with_tiny_blocks(spark, monkeypatch):
    rows = corpus(3, 160)
    expected = brute(rows)
    assert found(spark, rows) == expected
    assert found(spark, rows, block_sets=2, block_shingles=150) == expected
    monkeypatch.setattr(trie_join, "HOT_MARGIN", -40)
    assert found(spark, rows, block_sets=4, hot_level=0) == expected


def test_nulls_ties_long_texts_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (5, "one\ttwo"), (None, "one two"), (None, None), (9, long), (7, long + " end"), (6, "one")]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_components_of_a_line(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    labels = {r["node"]: r["label"] for r in trie_join.components(edges).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}
