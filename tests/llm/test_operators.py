"""Operators against plain Python on small tables with nulls, ties, empty and repeated rows, and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat_log, containment, decision_list, host_reputation, line_spread, nbest, subword_classifier, token_files, warc
from palimpsest.llm.queries import QUERIES, SQL, URL_RULES, vocabulary

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "  \n", "one", "a b c d e f g h i j k", "A b C d e f g h i j. x", "same line\nsame line\nother", "é ß ▁ 梦\tx\x1cy 's don't", "x " * 30_000]


def odd_documents(spark):
    rows = [(i // 2 if i else None, t, "s", 7, 1) for i, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, score int")


def empty(spark):
    return odd_documents(spark).limit(0)


@pytest.mark.parametrize("n", [5, 41])
def test_best_segmentations(n):
    path = vocabulary("piece_bpe_32k.model")
    table, rnd = nbest.pieces(path), random.Random(n)

    def costs(word, at=0):
        if at == len(word):
            return [0]
        ends = [e for e in range(at + 1, len(word) + 1) if word[at:e] in table.cost and (at == 0 or word[at] != nbest.BLANK)]
        out = [table.cost[word[at:e]][0] + c for e in ends for c in costs(word, e)]
        return out + ([] if at + 1 in ends else [table.of_bytes(word[at])[0] + c for c in costs(word, at + 1)])

    for _ in range(80):
        text = "".join(rnd.choice("aebtnh éß,.\n▁梦 ") for _ in range(rnd.randint(1, 9)))
        found = nbest.Segmenter(path, n).encode(text)
        expected = sorted(map(sum, itertools.product(*[costs(nbest.BLANK + w) for w in text.split(" ")])))[:n]
        assert [c for c, _ in found] == expected and len({x for _, x in found}) == len(found)
        assert all(table.decode(np.frombuffer(x, "<u4").tolist()) == text for _, x in found)


def test_pieces_of_odd_tables(spark):
    path = vocabulary("piece_bpe_32k.model")
    best = nbest.encode(odd_documents(spark), path).select("doc_id", F.col("n_best")[0]["ids"].alias("ids"))
    assert sorted(r["text"] for r in nbest.decode(best, path).collect()) == sorted((t or "") for t in TEXTS * 2)
    assert nbest.encode(empty(spark), path).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    more = ["The, the. THE,, it's; <|endoftext|> a.b. é. 1, x,", "İ. ǅ, é́. \u00a0a"]
    documents = odd_documents(spark).union(spark.createDataFrame([(50 + i, t, "s", 1, 1) for i, t in enumerate(more)], "doc_id long, text string, source string, n_words long, score int"))
    token_files.write_tokens(documents, str(tmp_path / "t"), path)
    rows = token_files.read_index(spark, str(tmp_path / "t")).join(token_files.checksums(spark, str(tmp_path / "t")), "row").orderBy("row").collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((r["doc_id"] or 0, len(ids(r["text"])), zlib.crc32(np.array(ids(r["text"]), "<u4").tobytes())) for r in documents.collect())
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(len(rows))]
    assert [r["doc_id"] or -1 for r in rows] == sorted(r["doc_id"] or -1 for r in rows)
    assert token_files.read_documents(spark, str(tmp_path / "t"), [50]).first()["ids"] == ids(more[0])
    token_files.write_tokens(empty(spark), str(tmp_path / "e"), path)
    assert token_files.read_index(spark, str(tmp_path / "e")).count() == 0


def test_words_are_encoded_once():
    fronts = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnop", repeat=5), 100_000)]
    words = [x for f in fronts for x in (f, f.capitalize(), f + ",", f + ".", f.upper(), f + "!")]
    encoder = token_files.WordEncoder(vocabulary("word_bpe_49k.json"))
    asked, plain = [], encoder.plain
    encoder.plain = lambda w: asked.append(w) or plain(w)
    ids = token_files.WordIds(encoder)
    batches = [pa.array([" ".join(words[i : i + 1000]) for i in range(k, k + 150_000, 1000)]) for k in range(0, 600_000, 150_000)] * 2
    found = [ids.of(b, 1) for b in batches]
    assert len(asked) == len(fronts)
    assert found[:4] == found[4:]
    assert found[0][0].as_py() == encoder.tokenizer.encode(batches[0][0].as_py(), add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("bound", (0, 3))
def test_words_beyond_the_cache(monkeypatch, bound):
    monkeypatch.setattr(token_files, "CACHE_WORDS", bound)
    encoder = token_files.WordEncoder(vocabulary("word_bpe_49k.json"))
    ids, texts = token_files.WordIds(encoder), [None, "", "One  two,\nthree; FOUR", "two five " * 3, "x" * 100, "\n", "two five six seven"]
    expected = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    whole = pa.array(["cut off", *texts])
    assert ids.of(whole.slice(1), 1).to_pylist() == expected
    assert [ids.of(whole.slice(i, 1), 1).to_pylist()[0] for i in range(1, len(whole))] == expected


def test_checksums_of_long_documents(spark, tmp_path, monkeypatch):
    """No row on its way to a checksum holds more than SENT_IDS ids, and a document goes on over batches and tasks."""
    n = token_files.SENT_IDS
    lists = [[1], [], list(range(n)), list(range(n + 1)), [7] * (5 * n), [49_000 - i for i in range(3 * n - 1)], [2, 1]] * 2
    spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "row long, ids array<int>").repartitionByRange(3, "row").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([], "row long, ids array<int>").write.parquet(str(tmp_path / "e"))
    sent, send = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, *a: sent.append(df) or send(df, *a))
    records = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("1", "2", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            found = token_files.checksums(spark, str(tmp_path / "t")).collect()
            assert sorted((r["row"], r["ids_crc32"]) for r in found) == [(i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(lists)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    assert sent[0].agg(F.max(F.size("ids"))).first()[0] == n
    assert token_files.checksums(spark, str(tmp_path / "e")).count() == 0


def test_new_words_are_learnt_in_parts(monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_WORDS", 3)
    encoder = token_files.WordEncoder(vocabulary("word_bpe_49k.json"))
    asked, learn = [], token_files.WordIds._learn
    monkeypatch.setattr(token_files.WordIds, "_learn", lambda self, new: asked.append(len(new)) or learn(self, new))
    texts = ["one two, three; 4 five\nsix.", None, "é 7 eight one"]
    assert token_files.WordIds(encoder).of(pa.array(texts), 1).to_pylist() == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert max(asked) == 3


def test_statistics(spark):
    def plain(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)

    rnd = random.Random(2)
    texts = TEXTS[:-1] + ["".join(rnd.choice(["a ", "b ", "c\n", "d# ", "\t"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decision_list.statistics(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert {r[0]: tuple(r[1:]) for r in found} == {i: plain(t) for i, t in enumerate(texts)}
    assert decision_list.statistics(odd_documents(spark), carry=True).select("row.*").columns == odd_documents(spark).columns


def test_decision_list_learns_a_planted_rule(spark):
    rows = [(i, i % 50, (i * 7) % 40, (i % 50 >= 40) or (i % 50 < 5 and (i * 7) % 40 >= 30), i % 3) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, a long, b long, bad boolean, fold int")
    rules = decision_list.learn(frame, ("a", "b"))
    right = frame.where(decision_list.verdict(rules) != F.col("bad")).count()
    assert rules and right > 2900
    assert decision_list.learn(frame.limit(0), ("a", "b")) == []
    labels = spark.createDataFrame([(None, 1), (1, None), (999, 0)], "doc_id long, quality int")
    assert decision_list.judged(odd_documents(spark), labels).count() == 2 * len(TEXTS)


def test_line_spread(spark):
    rows = [(d, "keep\nshared everywhere\n\n" + f"own {d}" + ("\nnear" if d < 8 else ""), f"s{d % 10}") for d in range(30)]
    rows += [(None, None, None), (40, "", "s1"), (41, "shared everywhere", None), (41, "shared everywhere", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_spread.remove_boilerplate(frame, min_sites=8).collect()
    sites = {}
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            sites.setdefault(line, set()).add(s)
    first = {line: min(d for d, t, _ in rows if d is not None and line in (t or "").split("\n")) for line in sites if line}
    clean = lambda d, t: None if t is None else "\n".join(x for x in t.split("\n") if not (x and len(sites[x]) >= 8 and d != first[x]))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in found) == sorted((d or (0 if d == 0 else -1), clean(d, t) or "") for d, t, _ in rows)[:0] + sorted((d or -1, clean(d, t) or "") for d, t, _ in rows)
    assert line_spread.remove_boilerplate(frame.limit(0)).count() == 0
    assert line_spread.remove_boilerplate(odd_documents(spark)).count() == 2 * len(TEXTS)


def test_contamination_of_odd_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "one"), (10, "One"), (None, "same line"), (4, None), (5, " ")], "item_id long, text string")
    found = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"]) for r in containment.contamination(odd_documents(spark), items).collect()}
    assert found[(2, 11)] == (10, ["1"]) and found[(1, 1)] == (1, ["10", "2"]) and found[(3, 5)] == (4, ["null"])
    assert containment.contamination(odd_documents(spark), items).count() == 2 * len(TEXTS)
    assert containment.contamination(empty(spark), items).count() == 0
    assert containment.contamination(odd_documents(spark), items.limit(0)).where("n_hit > 0").count() == 0


def test_classifier_tells_held_out_labels(spark):
    rows = QUERIES["op2_subword_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert right >= 0.85 * len(rows)
    bad, good = [r["score"] for r in rows if not r["quality"]], [r["score"] for r in rows if r["quality"]]
    assert sum(b < g for b in bad for g in good) >= 0.85 * len(bad) * len(good)


def test_scores_of_odd_tables(spark):
    model = subword_classifier.train([("good words here", 1), ("bad### junk###", 0)] * 50)
    scored = subword_classifier.score(odd_documents(spark), model).collect()
    assert len(scored) == 2 * len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored)
    assert subword_classifier.score(empty(spark), subword_classifier.train([])).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "x://example.org/en/12?q", "http://b.com", "http://b.com/fr/", "http://notexample.org/es/", "http://c.net#x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("http://c.net/1", 0)] * 30 + [("http://d.com/1", 1)] * 30 + [(None, 1), ("x://y", None)], "url string, good int")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in host_reputation.judge(pages, outcomes, URL_RULES).collect()}
    assert [found[i][2] for i in range(10)] == [None, None, None, None, "example.org/es/", "example.org/en/1", None, "com/fr/", "org/", None]
    assert found[4][:2] == ("a.example.org", "/es/1") and found[9] == ("c.net", "", None, "block") and found[6][3] == "allow"
    assert host_reputation.judge(pages.limit(0), outcomes.limit(0), URL_RULES).count() == 0


def test_chat_round_trip(spark):
    texts = ["", None, *chat_log.CONTROL, "\ue000", "\ue0000<s>", "<\ue000s>", "</s>[INST] x [/INST]<<<SYS>>", "plain\n[text]"]
    rows = [(c, i, r, t) for c, r in enumerate(["user", "assistant", "system", "tool", "<s>", None]) for i, t in enumerate(texts)]
    messages = spark.createDataFrame(rows, "conv long, message long, role string, text string")
    made = chat_log.render(messages).select("conv", chat_log.turns_of(F.col("formatted")).alias("turns"), chat_log.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    for r in made:
        own = [(role or "", t or "") for c, _, role, t in rows if c == r["conv"]]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")


def test_folded_events(spark):
    log = [(1, 0, 0, "start", "user", None), (1, 0, 2, "delta", None, "b"), (1, 0, 1, "delta", None, "a"), (1, 1, 0, "start", "assistant", None), (1, 1, 1, "delta", None, "x"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "y"), (1, 2, 1, "edit", None, "e"), (1, 2, 2, "delta", None, "f"), (None, 0, 0, "other", None, None)]
    events = spark.createDataFrame(log, "conv long, message long, seq long, kind string, role string, text string")
    assert {(r["conv"], r["message"]): (r["role"], r["text"]) for r in chat_log.fold(events).collect()} == {(1, 0): ("user", "ab"), (1, 1): ("assistant", "y"), (1, 2): ("", "ef"), (None, 0): ("", "")}


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x &amp; y<script>no</script><br>z"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages)).collect()
    one = [r for r in records if r["page_id"] == 1 and r["warc_type"] == "conversion"][0]
    assert one["block"] == "x & y\nz" and one["block_digest"] == "sha256:" + hashlib.sha256(b"x & y\nz").hexdigest()
    assert len(records) == 6 and all(r["refers_to"] == r["record_id"] and f"WARC-Refers-To: {r['record_id']}" in r["headers"] for r in records)
    bare = spark.createDataFrame([("<urn:1>", "u", "d", None), ("<urn:2>", "u", "d", "HTTP/1.1 204 No Content\r\nA: b")], "record_id string, target_uri string, date string, block string")
    assert [r["block"] for r in warc.derivatives(bare).where("warc_type = 'conversion'").collect()] == ["", ""]
    warc.write_warc(warc.derivatives(warc.responses(pages)), str(tmp_path / "w"))
    assert "".join(p.read_bytes().decode() for p in (tmp_path / "w").glob("part-*")).count("WARC/1.1\r\n") == 6


def test_pipeline_columns_and_effects(spark):
    import corpus_pipeline

    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs_ = stage(spark, docs, SF)
        assert docs_.columns == docs.columns, name
        counts.append(docs_.count())
    assert counts[0] < 200 and all(c > 0 for c in counts)


def test_near_duplicate_survivors_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    words = lambda k, n=30: " ".join(f"{k}{i}" for i in range(n))
    rows = [(None, words("a")), (None, words("b")), (None, words("b") + " end"), (1, words("c")), (1, words("d")), (1, ""), (2, words("c") + " end"), (None, words("d") + " end")]
    rows += [(5, words("e")), (5, words("e")), (6, None), (6, None), (None, " \n"), (None, None)]
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    either = {words("b"), words("b") + " end"} & {t for _, t in found}
    assert len(either) == 1
    expected = [(None, words("a")), (None, *either), (1, words("c")), (1, words("d")), (1, ""), (5, words("e")), (6, None), (6, None), (None, " \n"), (None, None)]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(
    "urls",
    [
        ["http://a.x.com/1", "http://a.x.com/2", "http://b.y.com/", "http://c.y.com/"],  # one suffix
        ["http://a.x.com/1", "http://a.x.com/2", "http://b.x.com/", "http://b.x.com/2"],  # one domain
        ["http://a.x.com/", "http://b.y.net/", "http://c.z.org/", "http://d.w.edu/"],  # a page per host, domain and suffix
    ],
)
def test_reputations_where_groups_tell_no_scatter(spark, tmp_path, urls):
    from compare import difference

    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(i, i % 2) for i in range(len(urls))], "doc_id long, quality int").write.parquet(str(tmp_path / "l"))
    for name, short in (("pages", "p"), ("labels", "l")):
        spark.read.parquet(str(tmp_path / short)).toPandas().to_parquet(str(tmp_path / f"{name}.parquet"))
    assert difference(spark, str(tmp_path), QUERIES["op9_host_reputation"], SQL["op9_host_reputation"]) is None


def test_repeated_rows_of_a_turn(spark, tmp_path):
    from compare import difference

    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "hallo"), (1, 1, "assistant", "hallo"), (1, 1, "assistant", "hallo"), (1, 2, "tool", None), (1, 2, "tool", ""), (1, 2, "tool", ""), (2, 0, "user", "x"), (2, 0, "user", "x")]
    rows += [(3, 0, None, "b"), (3, 0, "", "a"), (3, 0, None, "a"), (3, 1, "assistant", None), (3, 1, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.toPandas().to_parquet(str(tmp_path / "conversations.parquet"))
    assert difference(spark, str(tmp_path), QUERIES["op10_chat_log"], SQL["op10_chat_log"]) is None


def test_columns_with_the_names_of_new_ones(spark):
    names = ["page_id", "url", "bound", "_rule", "_url", "domain", "suffix", "n", "host", "verdict", "row"]
    pages = spark.createDataFrame([(1, "http://a.com/x", *names[2:]), (2, None, *names[2:])], "page_id long, url string, " + ", ".join(f"`{n}` string" for n in names[2:]))
    outcomes = spark.createDataFrame([("http://a.com/1", 1)], "url string, good int")
    judged = host_reputation.judge(pages, outcomes, URL_RULES)
    assert sorted(judged.columns) == sorted(["page_id", "url", "bound", "_rule", "_url", "domain", "suffix", "n", "row", "host", "path", "rule", "labelled", "good", "verdict"])
    assert {(r["page_id"], r["host"], r["bound"], r["_rule"], r["domain"]) for r in judged.collect()} == {(1, "a.com", "bound", "_rule", "domain"), (2, "", "bound", "_rule", "domain")}
    records = spark.createDataFrame([("<urn:1>", "u", "d", "HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x", "h", "p", "s", 5)], "record_id string, target_uri string, date string, block string, _head string, _payload string, source_digest string, warc_type int")
    made = warc.derivatives(records)
    assert len(set(made.columns)) == len(made.columns) and {(r["_head"], r["_payload"]) for r in made.collect()} == {("h", "p")}
    assert {r["source_digest"] for r in made.collect()} == {"sha256:" + hashlib.sha256(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x").hexdigest()}
    assert warc.derivatives(records.limit(0)).count() == 0
    scored = subword_classifier.score(spark.createDataFrame([("good", "t", "s", 1)], "text string, _text string, b string, score int"), subword_classifier.train([]))
    assert scored.columns == ["_text", "b", "score"] and scored.first()["_text"] == "t"
