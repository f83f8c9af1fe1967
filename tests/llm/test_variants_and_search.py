"""Spelling variants, top-k search and token alignment against plain Python, with nulls, ties, repeated rows, odd values and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pytest

from palimpsest.llm import approximation_file, spelling_variants, token_alignment
from palimpsest.llm.queries import QUERIES, vocabulary

BYTES, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


# Spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        around = [(x, m) for x, m in counts.items() if near(w, x)]
        best = min(around, key=lambda x: (-x[1], x[0]), default=None)
        leads = best is not None and best[1] >= 2 * n
        out[w] = (best[0] if leads else None, n, len(around), best[1] if leads else None)
    return sorted((w, f, root(out, w), n, k, m) for w, (f, n, k, m) in out.items())


def root(forms, word):
    while forms[word][0] is not None:
        word = forms[word][0]
    return word


def plain_counts(rows, every, least_chars=5, least=3):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least}


def found_variants(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_texts(spark):
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abcdeéÿÀ") for _ in range(rnd.randint(4, 8))) for _ in range(40)]

    def word():
        w = rnd.choice(stems)
        if rnd.random() < 0.4:
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abcé") + w[i:], w[:i] + rnd.choice("abcé") + w[i + 1 :]])
        return w.upper() if rnd.random() < 0.1 else w

    rows = [(None if i % 9 == 0 else i % 20, " ".join(word() for _ in range(40))) for i in range(80)] + [(1, None), (2, ""), (3, "x" * 40_000), (3, "x" * 40_000), (3, "x" * 40_000 + " " + "x" * 39_999)]
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    counts = plain_counts(rows, 7)
    vocabulary_ = spelling_variants.word_counts(frame, drop_every=7)
    assert {r["word"]: r["n"] for r in vocabulary_.collect()} == counts
    assert found_variants(spelling_variants.group_variants(vocabulary_)) == plain_variants(counts)


@pytest.mark.parametrize("symbols", [1, 3, 16])
def test_variants_over_any_alphabet(spark, symbols):
    rnd = random.Random(symbols)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))): rnd.choice([3, 6, 6, 12, 50]) for _ in range(250)} | {"": 7, "梦想": 3, "梦": 9, "a\U0001f600b": 4, "a\U0001f600": 8}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found_variants(spelling_variants.group_variants(frame, symbols=symbols)) == plain_variants(words)


def test_variants_lead_along_a_chain(spark):
    words = {"a" * 5 + "b" * i: 3 * 2**i for i in range(12)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling_variants.group_variants(frame).collect()
    assert {r["root"] for r in found} == {"a" * 5 + "b" * 11} and {r["word"]: r["form"] for r in found}["aaaaab"] == "aaaaabb"
    assert spelling_variants.group_variants(frame.limit(0)).count() == 0
    assert spelling_variants.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Top-k search


def plain_top(rows, k=5, every=50, factor=256):
    kept = []
    for place, (v, x) in enumerate(rows):
        if x is not None and all(c is not None and math.isfinite(c) and math.isfinite(factor * c) for c in x):
            kept.append((place, v, [math.floor(factor * c) for c in x]))
    out = []
    for place, q, x in kept:
        if q is None or q % every:
            continue
        scores = [(sum(a * b for a, b in zip(x, y)), v) for other, v, y in kept if other != place and len(x) == len(y)]
        scores = [(min(max(s, -(1 << 63)), (1 << 63) - 1), v) for s, v in scores]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(q, i + 1, v, s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def found_top(spark, rows, kind="double", **how):
    frame = spark.createDataFrame([(v, x, 1, 2) for v, x in rows], f"vec_id long, embedding array<{kind}>, score int, entry int")
    return sorted((tuple(r) for r in approximation_file.top_k(frame, "vec_id % 50 = 0", factor=256.0, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"block": 7, "queries": 3}, {"k": 1}, {"k": 400}])
def test_top_k_of_vectors(spark, how):
    rnd = random.Random(3)
    rows = [(i * 10, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(5 * i, rows[3][1]) for i in range(60)]  # a vector shared by many
    rows += [(i, [0.0] * 6) for i in range(0, 100, 25)] + [(i, [0.01 * (i % 3)] * 6) for i in range(300, 420, 10)]
    rnd.shuffle(rows)
    assert found_top(spark, rows, **how) == plain_top(rows, how.get("k", 5))


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (50, []), (100, []), (100, []), (7, []), (150, [1.0, None]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [1.0, 2.0]), (300, [1.0, 2.0]), (350, [-1.0, -0.001]), (None, [3.0, 1.0]), (None, [3.0, 1.0]), (400, [1e9, -3e8])]
    rows += [(450, [1e300, 1.0]), (500, [1e307, 1.0]), (1, [5e8, 1e8 + 0.5]), (550, [0.5]), (600, [1.0, 2.0, 3.0]), (2, [1.0, 2.0])]
    expected = plain_top(rows)
    assert found_top(spark, rows) == expected and found_top(spark, rows, block=2, queries=1) == expected
    assert found_top(spark, []) == [] and found_top(spark, [(50, [1.0])]) == []
    floats = [(v, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for v, x in rows if x is None or all(c is None or not math.isfinite(c) or abs(c) < 1e38 for c in x)]
    assert found_top(spark, floats, "float") == plain_top(floats)


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(4)
    vectors, queries = np.floor(rnd.normal(0, 40, (3000, 16))), np.floor(rnd.normal(0, 40, (20, 16)))
    found = approximation_file.Approximations.of(vectors)
    low, high = found.bounds(queries, *found.decoded())
    exact = queries @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    for i, _, places, _ in approximation_file.candidates(queries, found, 6):
        assert set(np.argsort(-exact[i])[:6].tolist()) <= set(places.tolist()) and len(places) < 60


# Token alignment

TEXTS = [
    None, "", " ", "\n", "one", " lead", "trail ", "trail\n", "a  b", "a \nb", "a\n b\n\nc", "tab\there", "cr\r\nx {\r y", "don't they're I'll 'S",
    "naïve façade ÿ œuvre Straße", "x y  z", " em space", "梦想 成真。 中文", "emoji 😀 👩‍👩‍👧 é à ", "nul\x00 in\x1c side \x85 nel", "word▁piece ▁ x", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "▁", "http://a.b/c?d=1&e=2 ,.;!? ((x)) --- ___", "1234567 8,900.12 3rd", "ab " * 400, "kein Umbruch" * 900, "x" * 3000, "\n\n\n  \n", "Ünï çödé Ωmega кириллица текст",
]


@lru_cache(maxsize=1)
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def whole(text):
    """Groups of a text by encoding it whole, or None if it has no tokens."""
    a, b = models()
    if not text:
        return None
    table = {**{chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    for i, x in enumerate(x for x in range(256) if chr(x) not in table):
        table[chr(256 + i)] = x
    left = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in b.encode(text)]
    if not b"".join(x for _, x in left) == (" " + text).encode() == b"".join(x for _, x in right):
        return None
    groups, i, j, x, y, own = [], 0, 0, 0, 0, ([], [])
    while i < len(left) or j < len(right):
        if x <= y and i < len(left):
            own[0].append(left[i][0])
            x += len(left[i][1])
            i += 1
        else:
            own[1].append(right[j][0])
            y += len(right[j][1])
            j += 1
        if x == y:
            groups.append(own)
            own = ([], [])
    return groups


def plain_alignment(texts):
    found = [whole(t) for t in texts]
    pairs = [Counter((a, b) for g in f or [] for a in g[0] for b in g[1]) for f in found]
    counts = Counter(p for own in pairs for p in own)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, f in enumerate(found):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in f or [])
        sizes = sum(len(a) for a, _ in f or []), sum(len(b) for _, b in f or []), len(f or []), sum(pairs[i].values())
        out.append((i, *sizes, sum(n for p, n in pairs[i].items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in pairs[i].items()), hashlib.sha256(shown.encode()).hexdigest() if f else ""))
    return out


@pytest.mark.parametrize("how", [({}, {}), ({"size": 64, "fan": 2}, {"hot_pairs": 100}), ({"size": 7, "fan": 3}, {"hot_pairs": 0})])
def test_alignment_against_whole_texts(spark, how):
    texts = TEXTS + ["ab " * 400]
    frame = spark.createDataFrame([(i, t, 9, "clash", b"x") for i, t in enumerate(texts)], "doc_id long, text string, row int, key string, pairs binary")
    rows = token_alignment.with_counts(token_alignment.aligned(frame, BYTES, PIECES, **how[0]), **how[1])
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r[n] for n in names) for r in rows.collect()) == plain_alignment(texts)


def test_alignment_of_random_texts(spark):
    rnd = random.Random(8)
    parts = ["the ", "Übung", "don't", " ", "\n", "  ", "▁", "é", "é", "。", "梦", "\r", "{\r", "x\t", "100", "...", "'s", " ", "<s>", "ing"]
    texts = ["".join(rnd.choice(parts[:6] if i % 2 else parts) for _ in range(rnd.randint(1, 60))) for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_alignment.aligned(frame, BYTES, PIECES, size=40, fan=2).collect()
    assert sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows) == [(x[0], *x[1:5], x[7]) for x in plain_alignment(texts)]


def test_fragments_compose_associatively():
    both, rnd = token_alignment.aligner(BYTES, PIECES), random.Random(1)
    text = " " + " ".join(rnd.choice(["unbelievable", "Donaudampfschiff", "ça", "x", "don't"]) for _ in range(60))
    cuts = sorted(rnd.sample(range(1, len(text.encode())), 25))
    ranges = [both.range(text, a, b) for a, b in zip([0, *cuts], [*cuts, len(text.encode())])]
    left = token_alignment.closed(reduce(token_alignment.compose, ranges))
    right = token_alignment.closed(reduce(lambda x, y: token_alignment.compose(y, x), reversed(ranges)))
    expected = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in whole(text[1:]))
    for x in (left, right):
        assert ";".join(x.groups) == expected and not x.prefix[0] and not x.suffix[0] and x.sizes[2] == len(expected.split(";"))


def test_one_python_worker_a_task_finishes_long_texts(spark):
    frame = spark.createDataFrame([(b"k", "some words " * 50)], "key binary, text string")
    plan = token_alignment._long(frame, BYTES, PIECES, 40, 2)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "")


def test_alignment_sends_workers_short_batches(spark, monkeypatch):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    met, before, durable = [], [spark.conf.get(k) for k in keys], token_alignment.durable
    monkeypatch.setattr(token_alignment, "durable", lambda df: met.append([int(spark.conf.get(k)) for k in keys]) or durable(df))
    frame = spark.createDataFrame([(i, "some words here " * 9) for i in range(3)], "doc_id long, text string")
    found = token_alignment.with_counts(token_alignment.aligned(frame, BYTES, PIECES, size=50), hot_pairs=1)
    assert len(met) == 4 and all(rows <= 200 and size <= 8 << 20 for rows, size in met)
    assert "InArrow" not in found._jdf.queryExecution().executedPlan().toString()  # nothing is left for a worker
    assert [spark.conf.get(k) for k in keys] == before


def test_pair_sums_in_parts():
    rnd, sums, sent = random.Random(3), token_alignment.PairSums(held=40, fresh=10), []
    lists = [np.array(rnd.sample(range(90), rnd.randint(0, 30)), dtype=np.int64) for _ in range(50)]
    for own in lists:
        if sums.add(own):
            sent += sums.sent()
    sent += sums.sent()
    counts = Counter()
    for batch in sent:
        pairs = batch.column("pair").to_pylist()
        assert len(set(pairs)) == len(pairs)
        counts.update(dict(zip(pairs, batch.column("n").to_pylist())))
    assert counts == Counter(x for own in lists for x in own.tolist()) and len(sent) > 2 and not list(sums.sent())


def test_alignment_of_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "same words here"), (None, "same words here"), (1, None), (1, None), (2, "same words here"), (2, "w" * 200), (2, "w" * 200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_alignment.with_counts(token_alignment.aligned(frame, BYTES, PIECES, size=50)).collect()
    assert Counter((r["doc_id"], r["n_groups"]) for r in found) == Counter((d, len(whole(t) or [])) for d, t in rows)
    assert token_alignment.with_counts(token_alignment.aligned(frame.limit(0), BYTES, PIECES)).count() == 0
    assert set(QUERIES) >= {"op11_spelling_variants", "op12_approximation_file", "op13_token_alignment"}
