"""Operators across documents against brute force, and the pipeline."""

import hashlib
import random
from collections import defaultdict

import pytest

import corpus_pipeline
from wagelens.llm import components, decontaminate, line_dedup, near_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, spans int, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2) for i, t in rows], SCHEMA)


def words(rnd, n, pool=3000):
    return [f"w{rnd.randrange(pool)}" for _ in range(n)]


def grouped(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    links += [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    rnd.shuffle(links)
    edges = spark.createDataFrame([*links, links[0], (None, 3)], "u bigint, v bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    linked = [(a, b) for a, b in links if a != b]
    assert got == grouped(linked, {n for e in linked for n in e})


def brute_near(rows, width):
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(set(near_dedup.shingles(t, width).tolist()))
    links = [
        (i, j) for i in sets for j in sets if j < i
        if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j])
    ]
    return grouped(links, sets)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rnd = random.Random(width)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  b"), (8, "x " * 50_000), (9, "É a"), (10, "é a")]
    for group in range(12):
        base = words(rnd, 100)
        for _ in range(8):
            copy = list(base)
            for _ in range(rnd.randrange(0, 9)):
                copy[rnd.randrange(100)] = "new" + str(rnd.random())
            rows.append((100 + len(rows) * 3, " ".join(copy)))
    rows.append((rows[-1][0], "quite another text"))  # an id with two texts
    got = near_dedup.near_duplicates(frame(spark, [*rows, (None, "One")]), width).collect()
    assert len(got) == len(rows) + 1
    wanted = brute_near(rows, width)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert {r.n_shingles for r in got if r.doc_id in (1, 2, 3)} == {0}


def brute_lines(rows, run_words):
    runs, gone, first = [], defaultdict(set), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        numbers, counts, hashes = line_dedup._lines(text or "")
        for a in range(len(counts)):
            for b in range(a, len(counts)):
                if sum(counts[a : b + 1]) >= run_words:
                    run = tuple(hashes[a : b + 1])
                    runs.append((i, a, b, run, numbers))
                    first.setdefault(run, (i, a, b))
    for i, a, b, run, numbers in runs:
        if first[run][0] != i or a > first[run][2]:
            gone[i].update(range(numbers[a], numbers[b] + 1))
    out = {}
    for i, text in rows:
        kept, before = [], False
        for number, line in enumerate((text or "").split("\n")):
            before = number in gone[i] or (before and not line.strip())
            if not before:
                kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("run_words", [1, 8])
def test_repeated_runs_of_lines(spark, run_words):
    rnd = random.Random(run_words)
    lines = [" ".join(words(rnd, rnd.randrange(1, 7))) for _ in range(25)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choices(lines, k=rnd.randrange(0, 18)))) for i in range(60)]
    rows += [(60, None), (61, rows[3][1]), (62, "z z z\n" * 40)]
    docs = frame(spark, rows)
    cut = line_dedup.without_repeated_lines(docs, run_words)
    got = cut.collect()
    wanted = brute_lines(rows, run_words)
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in got} == wanted
    assert all(r.n_chars == len(r.text or "") for r in got)
    left = {r.doc_id for r in line_dedup.unrepeated_documents(docs, run_words).collect()}
    assert left == {i for i, t in rows if not (t or "").strip() or (wanted[i] or "").strip()}
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0


def brute_leaks(rows, items):
    """Windows at an item's first shingles; exact copies and similarity, without fingerprints."""
    import re

    def shingles(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    found = set()
    kept = {j: shingles(t) for j, t in items}
    for i, text in rows:
        own = shingles(text)
        starts = defaultdict(set)
        for item in kept.values():
            for q, s in enumerate(item[: len(item) // 9 + 1]):
                starts[s].add((q, len(item)))
        for at, s in enumerate(own):
            for q, m in starts.get(s, ()):
                if at < q:
                    continue
                window = own[at - q : at - q + m]
                for j, item in kept.items():
                    if len(item) != m:
                        continue
                    both = sum(min(window.count(x), item.count(x)) for x in set(item))
                    if both / (len(window) + len(item) - both) >= 0.8:
                        found.add((i, j))
    return found


def test_contaminations(spark):
    rnd = random.Random(3)
    items = [(j, " ".join(words(rnd, rnd.randrange(20, 60)))) for j in range(15)] + [(15, "too short"), (16, None), (17, "")]
    items.append((18, items[2][1]))
    rows = [(1, None), (2, ""), (3, "one two"), (4, items[0][1].upper()), (5, items[15][1])]
    for i in range(10, 60):
        text, item = words(rnd, rnd.randrange(5, 200)), items[rnd.randrange(15)][1].split()
        for _ in range(rnd.randrange(0, 4)):
            item[rnd.randrange(len(item))] = "changed"
        at = rnd.randrange(len(text))
        rows.append((i, " ".join(text[:at] + item + text[at:]) if i % 2 else " ".join(text)))
    rows.append(rows[-1])
    docs = frame(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    wanted = brute_leaks(rows, items)
    assert got == wanted and (4, 0) in got and len(got) > 5
    left = decontaminate.without_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert left.count() == sum(i not in {d for d, _ in got} for i, _ in rows)
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_decontamination_runs_no_python(spark):
    docs = frame(spark, [(1, "a b c d e f")])
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    plan = decontaminate.leaks(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(7)
    passage = " ".join(words(rnd, 60))
    item = " ".join(words(rnd, 40))
    texts = [" ".join(words(rnd, 120)) for _ in range(40)]
    texts[10] = texts[3]  # an exact copy
    texts[11] = texts[4] + " tail"  # a near copy
    texts[12] += "\n" + passage
    texts[13] += "\n" + passage
    texts[14] += " " + item
    texts += ["", None]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), columns)
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == set(range(42)) - {10, 11, 14}
    assert passage in left[12] and passage not in left[13]
    final = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == set(left) and final[40] == 0


def brute_passages(rows, width):
    """Words left of every text when each window that stands earlier goes."""
    first, out = {}, {}
    for i, text in sorted(rows):
        own = text.split()
        gone = set()
        for a in range(len(own) - width + 1):
            place = first.setdefault(tuple(own[a : a + width]), (i, a))
            if place[0] != i or a >= place[1] + width:
                gone.update(range(a, a + width))
        out[i] = [w for n, w in enumerate(own) if n not in gone]
    return out


@pytest.mark.parametrize("width", [1, 8, 50])
def test_repeated_passages_inside_lines(spark, width):
    rnd = random.Random(width)
    passages = [words(rnd, width + rnd.randrange(-1, 2 * width + 2)) for _ in range(6)]
    rows = []
    for i in range(50):
        own = []
        for _ in range(rnd.randrange(0, 4)):
            own += words(rnd, rnd.randrange(0, 30), 10**9)
            passage = rnd.choice(passages)
            own += passage[rnd.randrange(0, 3) : len(passage) - rnd.randrange(0, 3)]
        rows.append((i, "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", "\n"]) for w in own)))
    rows += [(60, "z " * 3 * width), (61, rows[5][1].replace("\n", " ")), (62, "")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs, width, width).collect()}
    wanted = brute_passages(rows, width)
    assert {i: r.text.split() for i, r in got.items()} == wanted
    assert any(0 < len(wanted[i]) < len(t.split()) for i, t in rows)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_a_passage_that_starts_and_ends_inside_lines(spark):
    rnd = random.Random(11)
    passage = words(rnd, 61)
    rows = [
        (1, "  one two " + " ".join(passage[:30]) + "\n" + " ".join(passage[30:]) + " three \n\nfour"),
        (2, "  five\tsix " + " ".join(passage[:20]) + "\n" + " ".join(passage[20:]) + " seven  \n\neight"),
        (3, "nine " + " ".join(passage) + "  ten\n" + " ".join(passage)),
        (4, " ".join(passage[:49])),
    ]
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "  five\tsix\nseven  \n\neight", 3: "nine ten", 4: rows[3][1]}


def brute_windows(rows, items):
    """Every start of an item-sized window with a similarity of 0.8, without seeds."""
    def shingles(text):
        w = text.lower().split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    found = defaultdict(int)
    for i, text in rows:
        own = shingles(text)
        for j, item in ((j, shingles(t)) for j, t in items):
            for at in range(len(own)):
                window = own[at : at + len(item)]
                both = sum(min(window.count(x), item.count(x)) for x in set(item) & set(window))
                found[i, j] += both / (len(window) + len(item) - both) >= 0.8
    return {pair: n for pair, n in found.items() if n}


def test_windows_at_every_start(spark):
    rnd = random.Random(13)
    items = [(j, " ".join(words(rnd, n))) for j, n in enumerate([54, 60, 104])]
    own = [t.split() for _, t in items]
    rows = [(1, " ".join(own[0][1:] + words(rnd, 20))), (2, " ".join(own[0][3:])), (3, " ".join(words(rnd, 9) + own[1][2:]))]
    # Four words missing among the first, four more in the middle; the item's halves exchanged.
    rows.append((4, " ".join(words(rnd, 30) + own[2][:1] + own[2][5:60] + words(rnd, 4) + own[2][60:] + words(rnd, 30))))
    rows.append((5, " ".join(words(rnd, 30) + own[2][50:] + own[2][:50] + words(rnd, 30))))
    docs = frame(spark, [*rows, rows[0]])
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == brute_windows(rows, items)
    assert {d for d, _ in got} == {1, 2, 3, 4, 5}


def test_repeated_rows_and_rows_without_an_id_stay_once(spark):
    rnd = random.Random(23)
    text, other = " ".join(words(rnd, 40)), " ".join(words(rnd, 40))
    rows = [(1, text), (1, text), (2, text), (3, other), (None, other), (None, other), (None, None), (4, ""), (4, ""), (5, "")]
    left = near_dedup.without_near_duplicates(frame(spark, rows)).collect()
    wanted = [(1, text), (3, other), (None, other), (None, None), (4, ""), (5, "")]
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted(wanted, key=repr)
    assert near_dedup.without_near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_deduplicated_lines_counts_what_is_left(spark):
    rnd = random.Random(29)
    passage = words(rnd, 55)
    first = "\n".join([" ".join(passage[:30]), " ".join(passage[30:]), "end"])
    second = "new\n" + first
    rows = [(1, first), (2, second), (3, first), (None, None), (4, ""), (1, first)]
    got = {(r.doc_id, r.n_lines, r.n_removed, r.text_md5) for r in line_dedup.deduplicated_lines(frame(spark, rows)).collect()}

    def md5(t):
        return hashlib.md5(t.encode()).hexdigest()

    assert got == {
        (1, 3, 0, md5(first)), (2, 4, 3, md5("new")), (3, 3, 3, md5("")), (None, 1, 0, md5("")), (4, 1, 0, md5("")),
    }


@pytest.mark.parametrize("seed", range(4))
def test_units_settle_what_windows_would(spark, seed):
    """Long repeated stretches, copies with edits and copies of copies, at the usual width."""
    rnd = random.Random(seed)
    base = [words(rnd, 400, 10**9) for _ in range(3)]
    rows = []
    for i in range(40):
        own = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 4)):
            at = rnd.randrange(len(own))
            own[at : at + rnd.randrange(0, 30)] = words(rnd, rnd.randrange(0, 30), 10**9)
        if rnd.random() < 0.3:
            own = own[rnd.randrange(60) :] + rnd.choice(base)[: rnd.randrange(40, 200)]
        rows.append((rnd.randrange(30) if rnd.random() < 0.2 else 100 - i, "\n".join(" ".join(own[j : j + 9]) for j in range(0, len(own), 9))))
    rows = list(dict(rows).items())
    docs = frame(spark, rows)
    got = {r.doc_id: r.text.split() for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == brute_passages(rows, 50)
