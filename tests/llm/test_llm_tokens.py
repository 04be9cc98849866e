"""Token counts and alignment against the libraries themselves and against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from wagelens.llm import alignment, token_counts
from wagelens.llm.queries import BYTE_LEVEL, PIECES, VOCABULARY, vocabulary_path

SCHEMA = "doc_id bigint, text string, lang string, n_tokens int, n bigint, code string, chunk int, docs string"
LETTERS = list("aAéÉ .,'<|>\n\t\x1c0 9ßİΣς́Ā½ﬁ한😀-_\x00▁数据ال(;пр\r　") + ["<|endoftext|>", "<s>", "<0x41>", "  "]
ODD = [
    None, "", " ", "   ", "\n", "a ", " a", "a  b", "▁", "a▁b", "<s>a</s><unk><0x0A>", "x<|endoftext|>", "\n\n a\n",
    "a\x00b", "１２３ 12a3", "👩‍👧 ok", "क़ ॐ", "don't I'M", "word " * 3000, "q" * 40_000, "é" * 3000,
]


def texts_of(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 1, 2, "c", 3, "d") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def pieces():
    return SentencePieceProcessor(model_file=vocabulary_path(PIECES))


def library_counts(name):
    if name.endswith(".model"):
        model = SentencePieceProcessor(model_file=vocabulary_path(name))
        return lambda text: len(model.encode(text))
    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", [PIECES, BYTE_LEVEL, VOCABULARY])
def test_counts_equal_the_library(name):
    cut = token_counts.splitter(vocabulary_path(name))
    texts = ODD + texts_of(1500, 3)
    frequent = token_counts.frequent_counts(texts[:200], vocabulary_path(name), 300)
    assert len(frequent) <= 300
    count = library_counts(name)
    wanted = [count(t or "") for t in texts]
    assert list(token_counts.Counts(cut, frequent).of(texts)) == wanted
    assert list(token_counts.Counts(cut, {}, memory=5).of(texts)) == wanted


def test_forced_boundaries_are_found():
    cut = token_counts.splitter(vocabulary_path(PIECES))
    assert cut.split("one, two\n3 ") == [" one", ",", " two", "\n", "3", " "]


def test_a_text_is_one_part_where_no_cut_is_sure(pieces, monkeypatch):
    cut = token_counts.Pieces(vocabulary_path(PIECES))
    monkeypatch.setattr(cut, "_pattern", None)
    texts = texts_of(50, 9)
    assert list(token_counts.Counts(cut, {}).of(texts)) == [len(pieces.encode(t)) for t in texts]


def test_counted_documents(spark, pieces):
    texts = ODD + texts_of(60, 4) + ["same", "same", "null id"]
    ids = [*range(len(texts) - 3), 500, 500, None]
    got = token_counts.counted_documents(frame(spark, texts, ids).repartition(5), vocabulary_path(PIECES), limit=50)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    counts = [len(pieces.encode(t or "")) for t in texts]
    wanted = [(i, len((t or "").encode()), n, n > 50) for i, t, n in zip(ids, texts, counts)]
    key = repr
    assert sorted(map(tuple, got.collect()), key=key) == sorted(wanted, key=key)


def test_empty_table_has_no_counts_and_no_alignment(spark):
    empty = frame(spark, [])
    assert token_counts.counted_documents(empty, vocabulary_path(PIECES)).collect() == []
    assert alignment.aligned_documents(empty, vocabulary_path(BYTE_LEVEL), vocabulary_path(PIECES)).collect() == []


# ---- alignment -----------------------------------------------------------------


def byte_spans(tokens):
    spans, at = [], 0
    for i, b in tokens:
        spans.append((i, at, at + len(b)))
        at += len(b)
    return spans


def brute_alignment(texts, pieces):
    """Every token against every other, from the libraries' own spellings."""
    tokenizer = Tokenizer.from_file(vocabulary_path(BYTE_LEVEL))
    tokenizer.encode_special_tokens = True
    codes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelled = {chr(c): c for c in codes} | {
        chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in codes)
    }
    docs, pairs = [], Counter()
    for text in texts:
        raw = b" " + (text or "").encode()
        a_ids = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        a = byte_spans([(i, bytes(spelled[c] for c in tokenizer.id_to_token(i))) for i in a_ids])
        b = byte_spans([
            (i, bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i)
             else pieces.id_to_piece(i).replace("▁", " ").encode())
            for i in pieces.encode(text or "")
        ])
        given_back = b"".join(
            bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i, _, _ in b
        )
        if not text or given_back != raw:
            docs.append((0, 0, [], ""))
            continue
        links = [(x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)]
        pairs.update(links)
        ends = sorted({e for _, _, e in a} & {f for _, _, f in b})
        groups, before = [], 0
        for end in ends:
            left = ",".join(str(i) for i, s, e in a if before < e <= end)
            right = ",".join(str(i) for i, s, e in b if before < e <= end)
            groups.append(f"{left}|{right}")
            before = end
        docs.append((len(a), len(b), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return [
        (
            n_a, n_b, groups.count(";") + 1 if groups else 0, len(links),
            sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, links, groups in docs
    ]


@pytest.mark.parametrize("chunk_chars", [40, 4_000_000])
def test_alignment_equals_brute_force(spark, pieces, chunk_chars, monkeypatch):
    short = [t if t is None or len(t) < 2000 else t[:400] for t in ODD]
    texts = short + texts_of(80, 6) + ["the cat", "the cat", "null id"]
    ids = [*range(len(texts) - 3), 900, 900, None]
    docs = frame(spark, texts, ids).repartition(3)
    got = alignment.aligned_documents(docs, vocabulary_path(BYTE_LEVEL), vocabulary_path(PIECES), chunk_chars)
    wanted = [(i, *row) for i, row in zip(ids, brute_alignment(texts, pieces))]
    assert got.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_worker_forgets_parts_and_long_words_align(monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 3)
    known = alignment.Aligner(vocabulary_path(BYTE_LEVEL), vocabulary_path(PIECES))
    assert known.cuts
    for text in texts_of(30, 11) + ["x" * 20_000]:
        (parts,) = known.align([text]) if text else [None]
        if parts is None:
            continue
        ends = [set(), set()]
        for side, ids in zip(ends, ([], [])):
            at = 0
            for part in known.parts(text):
                ids = known.a.encode([part])[0] if side is ends[0] else known.b.encode([part], True)[0]
                spelled = known.a.bytes if side is ends[0] else known.b.bytes
                for i in ids:
                    at += len(spelled[i])
                    side.add(at)
        # Each stretch between neighbouring ends of either side is the overlap of one pair.
        assert sum(len(p.codes) // 8 for p in parts) == len(ends[0] | ends[1])


def test_parts_are_cut_where_both_tokenizers_cut():
    known = alignment.Aligner(vocabulary_path(BYTE_LEVEL), vocabulary_path(PIECES))
    assert known.parts("a b,\nc  d\t e▁ f ") == [
        " a", " b", ",", "\nc", "  d\t e▁ f", " ",
    ]


def test_whole_texts_align_where_no_cut_is_sure(monkeypatch):
    known = alignment.Aligner(vocabulary_path(BYTE_LEVEL), vocabulary_path(PIECES))
    texts = [t for t in texts_of(300, 21) + ODD[:-3] if t]
    cut = known.align(texts)
    monkeypatch.setattr(known, "cuts", False)
    known._known.clear()
    for text, one, many in zip(texts, known.align(texts), cut):
        assert (one is None) == (many is None), text
        if one:
            assert one[0].groups == ";".join(p.groups for p in many)
            assert one[0].codes == b"".join(p.codes for p in many)


def test_pair_counts_name_the_best(spark):
    docs = frame(spark, ["the cat sat", "the cat", "a dog"])
    chunks = alignment.aligned_chunks(docs, vocabulary_path(BYTE_LEVEL), vocabulary_path(PIECES))
    rows = alignment.pair_counts(chunks).collect()
    assert all(r.code == r.a << 32 | r.b for r in rows)
    most = defaultdict(int)
    for r in rows:
        most[r.b] = max(most[r.b], r.n)
    assert all(r.best == (r.n == most[r.b]) for r in rows)


@pytest.mark.parametrize("task, kind", [("digest", "BoundaryEncoder"), ("chunks", "LibraryEncoder")])
def test_a_worker_remembers_no_words_after_a_task(task, kind, monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    from wagelens.llm import bpe, token_store, tokenize

    path = vocabulary_path(VOCABULARY)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["the cat sat", "on the Mat."])], ["doc_id", "text"])
    if task == "digest":
        rows = list(tokenize._digest(iter([batch]), path))
    else:
        monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
        rows = list(token_store._chunk_rows(iter([batch]), path))
    assert rows
    encoder = bpe.encoder(getattr(bpe, kind), path)
    assert encoder._memory.recent == {} and encoder._memory._older == {}
    assert all(not held for held in getattr(encoder, "_fragments", {}).values())
    assert getattr(encoder, "_pieces", bpe.Memory()).recent == {}
