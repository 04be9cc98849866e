"""Operators on single texts: encoding, stores, shards, licenses, urls, search, toxicity."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from wagelens.llm import bpe, compression, licenses, search, sharding, token_store, tokenize, toxicity, urls
from wagelens.llm.queries import vocabulary_path
from wagelens.llm.tables import free_name

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, text_ string"
ODD = [
    None, "", " \n\t", "a\x1cb c", "İstanbul ΣΑΣ σς", "don't I'M we'll 's", "<|endoftext|>x <|startoftext|>", "é ́a b́",
    "½ ² ª µ ſ ﬁ", "a\x00b \x00", "Āā ĀĀ", "…--—!!! ,.;x", "１２３ 12a3", "　x y\x85z\xa0w", "👩‍👧 ok", "क़ ॐ", "A<B",
]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, 0.5, "x") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    letters = "aAéÉ .,'<|>\n\t\x1c0 9ßİΣς́Ā½ﬁ한😀-_\x00"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("kind", [bpe.LibraryEncoder, bpe.BoundaryEncoder])
def test_encoders_equal_the_library(library, kind):
    texts = ODD + random_texts(800) + ["the quick brown fox " * 3000]
    encoder = kind(bpe.vocabulary(vocabulary_path()))
    for text, got in zip(texts, encoder.encode(texts)):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == wanted, text
        assert bpe.decode(encoder.known, got).decode() == library.decode(wanted, skip_special_tokens=False)


def test_encoder_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    monkeypatch.setattr(bpe.LibraryEncoder, "memory", 5)
    monkeypatch.setattr(bpe.BoundaryEncoder, "memory", 5)
    monkeypatch.setattr(bpe, "_WORDS_AT_ONCE", 3)
    texts = random_texts(100, 8)
    for kind in (bpe.LibraryEncoder, bpe.BoundaryEncoder):
        got = list(kind(bpe.vocabulary(vocabulary_path())).encode(texts))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
            library.encode(t, add_special_tokens=False).ids for t in texts
        ]


def test_no_merge_crosses_a_forced_boundary():
    known = bpe.vocabulary(vocabulary_path())
    encoder = bpe.BoundaryEncoder(known)
    fragments = encoder.fragments("qzxjvk")
    assert len(fragments) > 1 and "".join(fragments) == "qzxjvk"


def test_digests_and_round_trip(spark, library):
    docs = frame(spark, ODD)
    got = {r.doc_id: r for r in tokenize.digests(docs, vocabulary_path()).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert tokenize.encoded(docs, vocabulary_path()).where("doc_id = 0").first().ids == []


def test_planes_give_the_ids_back():
    rnd = np.random.default_rng(3)
    for n in (1, 7, 1000, token_store.BLOCK):
        for top in (2, 255, 49408, 2**32):
            ids = rnd.integers(0, top, n, dtype=np.uint64).astype("<u4")
            layout, planes = token_store.to_planes(ids)
            assert (token_store.from_planes(layout, planes, n) == ids).all()


def test_store_of_odd_texts(spark, library, monkeypatch):
    texts = ODD + ["hello world " * 40_000] + random_texts(30)
    ids = [*range(len(texts) - 1), 3]  # one id twice
    docs = frame(spark, texts, ids)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.stored_documents(docs, vocabulary_path()).collect())
    at, wanted = 0, []
    for i, text in sorted(zip(ids, texts), key=lambda x: (x[0], x[1] or "")):
        own = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((at, i, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    assert got == wanted
    assert token_store.stored_documents(docs.limit(0), vocabulary_path()).count() == 0


def test_schedule_is_longest_first():
    assert schedule_loads([("a", 7), ("b", 6), ("c", 5), ("d", 4), ("e", 3)], 2) == [11, 14]
    assert sharding.schedule([], 3) == {}


def schedule_loads(sizes, shards):
    loads = Counter()
    for name, shard in sharding.schedule(sizes, shards).items():
        loads[shard] += dict(sizes)[name]
    return sorted(loads.values())


def test_shards(spark):
    rnd = random.Random(2)
    texts = [None, "", "x" * 5000, *["copy" * 20] * 300, *["w" * rnd.randint(0, 900) for _ in range(800)]]
    rows = sharding.sharded_documents(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    loads, places, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text.encode()))
        loads[r.shard] += r.size
        places[text].add(r.shard)
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(16)) and all(len(p) == 1 for p in places.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    group = 300 * 81
    assert max(loads.values()) - min(loads.values()) <= max(1000, group - sum(loads.values()) / 16 + 1000)
    assert sharding.sharded_documents(frame(spark, [])).count() == 0


def test_licenses(spark):
    texts = [
        "Under the MIT-License! x under THE mit license", "licensd under the Apache License, Version 2.0", None, "",
        "This work is licenced under the GNU General Public Lisense, version 3.", "é" * 3 + " cc by nc" * 3, "mit license under the",
    ]
    got = {r.doc_id: r for r in licenses.license_documents(frame(spark, texts)).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word) == (9, 2, 0, 5)
    assert got[1].base_labels == "apache-2" and got[1].labels == "apache-2"
    assert got[2].n_words == got[3].n_words == 0 and got[2].labels == "" and got[2].score == 0
    assert (got[4].base_labels, got[4].labels, got[4].n_base, got[4].first_word) == ("", "gpl-3", 0, None)
    assert 0 < got[4].score < 1 and got[0].score == 1
    assert (got[5].n_base, got[5].last_word) == (3, 7) and got[6].labels == ""


def test_pieces_hold_every_near_match():
    rnd = random.Random(4)
    for notice, _, edits in licenses.NOTICES:
        for _ in range(30):
            changed = list(notice)
            for _ in range(edits):
                changed[rnd.randrange(len(changed))] = "q"
            assert any(piece in "".join(changed) for _, piece in licenses.pieces(notice, edits))


def test_urls(spark):
    listed = [
        (1, "https://A.Example.ORG/es/x?q"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2"), (4, "http://x.com/fr/"),
        (5, "x.com/de/"), (6, None), (7, "http://badorg/"), (8, "http://example.org"), (None, ""), (9, "ftp://h#frag/?"), (9, "ftp://h#frag/?"),
        *[(100 + i, f"http://good{i}.com/fr/{i}") for i in range(30)], *[(200 + i, f"http://spam{i}.com/de/{i}") for i in range(30)],
        (300, "http://spam77.net/de/3"), (301, "http://good77.net/fr/3"),
    ]
    pages = spark.createDataFrame(listed, "page_id bigint, url string")
    rows = urls.judged_pages(pages).collect()
    assert len(rows) == len(listed)
    got = {r.page_id: r for r in rows}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert [got[i].rule for i in (2, 3, 4, 5, 7, 8)] == ["example.org/en/1", "org/", "com/fr/", None, None, None]
    assert (got[6].host, got[6].path) == ("", "") and (got[9].host, got[9].path) == ("h", "")
    assert got[300].verdict == "block" and got[301].verdict == "allow"
    assert got[301].score == pytest.approx(brute_score(listed, "http://good77.net/fr/3"), abs=1e-8)
    assert urls.judged_pages(pages.limit(0)).count() == 0


def brute_score(listed, url):
    """The same smoothing, letter by letter from nested counts."""
    counts = {"allow": Counter(), "block": Counter()}
    rules = {"/fr/": "allow", "/de/": "block"}
    for _, text in listed:
        text = text or ""
        host, _, path = text.partition("://")[2].partition("/")
        path = "/" + path.split("?")[0]
        host = host.lower()
        verdict = None
        if host.endswith(".com") and path[:4] in rules:
            verdict = rules[path[:4]]
        elif host.endswith("example.org") and "/" in text.partition("://")[2]:
            verdict = "block" if path.startswith(("/es/", "/en/1")) else "allow"
        if verdict and zlib.crc32(text.encode()) % 5 != 0:
            letters = "\2" * 4 + text + "\3"
            for i in range(len(letters) - 4):
                for size in range(1, 6):
                    counts[verdict][letters[i + 5 - size : i + 5]] += 1

    def chance(verdict, gram):
        if not gram:
            return 1 / 256
        below = chance(verdict, gram[1:])
        after = [n for g, n in counts[verdict].items() if len(g) == len(gram) and g[:-1] == gram[:-1]]
        total, kinds = sum(after), len(after)
        return (counts[verdict][gram] + kinds * below) / (total + kinds) if total else below

    letters = "\2" * 4 + url + "\3"
    grams = [letters[i : i + 5] for i in range(len(letters) - 4)]
    return sum(math.log(chance("allow", g) / chance("block", g)) for g in grams) / len(grams)


def test_search_equals_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", *[" ".join(rnd.choices(vocabulary, range(1, 61), k=rnd.randint(1, 80))) for _ in range(300)]]
    texts[40] = texts[41] = texts[60]
    rows = search.similar_documents(frame(spark, texts), k=7).collect()
    words = [t.split() if t else [] for t in texts]
    n, average = len(words), sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.rank):
        got[r.query_id].append((r.doc_id, r.score))
    for q in range(0, len(texts), 20):
        scores = []
        for i, ws in enumerate(words):
            tf = Counter(ws)
            s = sum(
                math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average))
                for w in set(words[q]) if w in tf
            )
            if s > 0:
                scores.append((round(s, 6), i))
        wanted = sorted(scores, key=lambda x: (-x[0], x[1]))[:7]
        assert got[q] == [(i, pytest.approx(s, abs=2e-6)) for s, i in wanted]


def test_shard_prunes_but_loses_nothing():
    rnd = np.random.default_rng(1)
    texts = [" ".join(f"t{j}" for j in rnd.zipf(1.4, 40) if j < 500) for _ in range(1500)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], names=["doc_id", "text"])
    shard = search.Shard(next(search._shard_rows([batch])).to_pylist()[0], 30.0)
    terms, _, _ = search.term_counts("t1 t7 t400 t90")
    weights = np.array([1.0, 2.0, 3.0, 4.0])
    ids, scores = shard.top(terms, weights, 5)
    monkey, search._FIRST_BLOCKS = search._FIRST_BLOCKS, 10_000
    try:
        all_ids, all_scores = shard.top(terms, weights, 5)
    finally:
        search._FIRST_BLOCKS = monkey
    assert ids.tolist() == all_ids.tolist() and scores.tolist() == pytest.approx(all_scores.tolist())


def one_shard(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    return next(search._shard_rows([batch])).to_pylist()[0]


def block_of(texts, weight):
    import pyarrow as pa

    terms = [search.term_counts(t)[0] for t in texts]
    together = np.concatenate(terms)
    weights = np.array([weight[t] for t in together.tolist()])
    return search.Queries(pa.array(range(len(texts))), np.array([len(t) for t in terms]), together, weights)


def test_search_scores_few_documents_where_a_score_is_known(monkeypatch):
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"t{j}" for j in rnd.zipf(1.3, rnd.integers(5, 90)) if j < 5000) for _ in range(2500)]
    row, k = one_shard(texts), 5
    average = row["words"] / row["n"]
    weight = {t: 1 + (t % 97) / 10 for t in np.frombuffer(row["terms"], "<u8").tolist()}
    queries, shard = block_of(texts[:60], weight), search.Shard(row, average)
    asked = []
    scores = search.Shard._scores
    monkeypatch.setattr(search.Shard, "_scores", lambda self, terms, docs: asked.append(len(docs)) or scores(self, terms, docs))
    shard.weigh(queries)
    free = {i: (ids.tolist(), found.tolist()) for i, ids, found in shard.answers(0, 60, k)}
    for i, (ids, found) in free.items():
        queries.least[i], queries.last[i] = found[-1], ids[-1]
    asked.clear()
    again = {i: (ids.tolist(), found.tolist()) for i, ids, found in shard.answers(0, 60, k)}
    assert again == free and len(free) == 60
    assert sum(asked) <= 60 * 2 * k  # of 60 * 2,500
    words = [Counter(t.split()) for t in texts]
    for q in range(0, 60, 7):
        every = []
        for d, tf in enumerate(words):
            norm = 1.2 * (0.25 + 0.75 * tf.total() / average)
            s = sum(
                weight[int(search.term_counts(w)[0][0])] * tf[w] * 2.2 / (tf[w] + norm) for w in set(words[q]) if w in tf
            )
            every.append((-round(s, 9), d))
        assert [d for _, d in sorted(every)[:k]] == free[q][0]


def test_search_of_a_word_that_stands_seventy_thousand_times():
    shard = search.Shard(one_shard(["a " * 70_000 + "b", "a b", "c"]), 10.0)
    terms = search.term_counts("a")[0]
    ids, scores = shard.top(terms, np.ones(1), 3)
    norms = [1.2 * (0.25 + 0.75 * n / 10) for n in (70_001, 2)]
    wanted = [70_000 * 2.2 / (70_000 + norms[0]), 2.2 / (1 + norms[1])]
    assert dict(zip(ids.tolist(), scores.tolist())) == {0: pytest.approx(wanted[0]), 1: pytest.approx(wanted[1])}


def test_search_in_turns_and_blocks_keeps_ties_and_queries_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(search, "_LEAST_DOCUMENTS", 30)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rnd = random.Random(8)
    kinds = [" ".join(rnd.choices([f"w{i}" for i in range(30)], k=rnd.randint(3, 20))) for _ in range(6)]
    texts = [rnd.choice(kinds) for _ in range(240)]
    index = search.build_index(frame(spark, texts))
    assert {r.turn for r in index.select("turn").collect()} == {0, 1, 2}
    asked = [*[(i, t) for i, t in enumerate(kinds)], (None, kinds[0]), (None, kinds[1]), (99, None)]
    rows = search.top_k(index, spark.createDataFrame(asked, "query_id bigint, text string"), k=8).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.rank):
        got[r.query_id].append(r.doc_id)
    words = [Counter(t.split()) for t in texts]
    average, df = sum(w.total() for w in words) / 240, Counter(x for w in words for x in w)
    for i, text in [*enumerate(kinds), (None, kinds[0] + " " + kinds[1])]:
        every = []
        for d, tf in enumerate(words):
            norm, both = 1.2 * (0.25 + 0.75 * tf.total() / average), set(text.split()) & set(tf)
            s = sum(math.log1p((240.5 - df[w]) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + norm) for w in sorted(both))
            every.append((-round(s, 9), d))
        assert got[i] == [d for s, d in sorted(every)[:8] if s < 0]
    assert 99 not in got


def labelled(n=400, seed=9):
    rnd = random.Random(seed)
    plain = ["th" + "".join(rnd.choices("aeinorst", k=rnd.randint(1, 6))) for _ in range(400)]
    rude = ["blockhead", "nincompoop", "scoundrel"]
    rows = []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(30, 200))
        toxic = i % 5 == 0
        for _ in range(5 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(rude))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    docs = frame(spark, [*(t for _, t, _ in rows), None, "", "the " * 100_000])
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (None, 1), (5000, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.scored_documents(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 40 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[400].score == got[401].score and got[400].predicted == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got.values())


def test_toxicity_without_labels_rejects_nothing(spark):
    docs = frame(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.without_toxic(docs, labels).count() == 2
    assert compression.fit([]).weights[0] < 0


def test_free_name():
    assert free_name(["A", "a_"], "a") == "a__"
