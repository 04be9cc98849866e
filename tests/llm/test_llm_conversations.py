"""Conversation repair against exhaustive search and against a plain walk over all rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from wagelens.llm import conversations as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, again boolean, part int"
PATTERN = re.compile("(s?(ua)+)?")


def exhaustive(rows):
    """Every edit of every row, with up to two insertions at every place."""
    best = None
    choices = [["D" * r] if isinstance(r, int) else ["D", "K", "Ru", "Ra"] for r in rows]
    inserts = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            if sum(map(len, put)) > 3:
                continue
            cost, audit, roles = 5 * len(put[0]), "I" * len(put[0]), put[0]
            for row, edit, more in zip(rows, edits, put[1:]):
                if edit[0] == "D":
                    cost += 2 * len(edit)
                else:
                    roles += row[0][:1] if edit == "K" else edit[1]
                    cost += (edit != "K") + 5 * row[2]
                audit += edit[0] * (len(edit) if edit[0] == "D" else 1) + "I" * len(more)
                roles += more
                cost += 5 * len(more)
            if PATTERN.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def walked(rows):
    """The cheapest repair by relaxing a table from the left, states by their role initials."""
    states = {"": (0, "", ())}

    def put(table, role, value):
        if role not in table or value < table[role]:
            table[role] = value

    def follow(state, initial):
        if initial == "s":
            return "s" if state == "" else None
        if initial == "u":
            return "u" if state != "u" else None
        return "a" if initial == "a" and state == "u" else None

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, kept) in list(table.items()):
                name = "assistant" if state == "u" else "user"
                put(table, name[0], (cost + 5, audit + "I", (*kept, f"{name}:")))
        return table

    for role, text, must_go, truncated in rows:
        new = {}
        for state, (cost, audit, kept) in inserted(states).items():
            put(new, state, (cost + 2, audit + "D", kept))
            if must_go:
                continue
            more = 5 * truncated
            then = follow(state, role[:1])
            if then:
                put(new, then, (cost + more, audit + "K", (*kept, f"{role}:{text}")))
            name = "assistant" if state == "u" else "user"
            put(new, name[0], (cost + more + 1, audit + "R", (*kept, f"{name}:{text}")))
        states = new
    inserted(states)
    return min(states[s] for s in ("", "a") if s in states)


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def expected(rows, damaged=True):
    found = defaultdict(list)
    for row in damage(rows) if damaged else rows:
        found[row[0]].append(row[1:])
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(found[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        blank = duplicate = truncated = illegal = 0
        seen, kept = set(), []
        for i, (turn, role, text) in enumerate(mine):
            if i and mine[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults = not bare, (role, text) in seen, bool(bare) and bare[-1] not in ".!?"
            seen.add((role, text))
            blank += faults[0]
            duplicate += faults[1] and not faults[0]
            truncated += faults[2] and not any(faults[:2])
            kept.append((role, text, any(faults[:2]), faults[2]))
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = walked(kept)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, True, 1) for r in rows], SCHEMA)


def random_rows(seed, convs, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", " ", "", None, "Really?  ", "é.", "a\nb.", "So what", "\x1c", "ok. \t"]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "User", "speaker"]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rnd.randint(1, most)):
            place = rnd.choice([turn, turn, turn, turn, turn + 3, None, -turn])
            rows.append((conv, place, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"t{turn}."))
    rows += rnd.sample(rows, len(rows) // 6)
    rnd.shuffle(rows)
    return rows


def test_the_agenda_equals_exhaustive_search():
    rnd = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    for _ in range(250):
        rows = [
            rnd.randint(1, 2) if rnd.random() < 0.2 else (rnd.choice(roles), "x", rnd.random() < 0.3)
            for _ in range(rnd.randint(0, 3))
        ]
        assert c.cheapest(rows) == exhaustive(rows), rows


def test_segments_join_to_the_same_repair():
    rnd = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    for _ in range(150):
        rows = [
            rnd.randint(1, 3) if rnd.random() < 0.2 else (rnd.choice(roles), f"{i}", rnd.random() < 0.3)
            for i in range(rnd.randint(1, 30))
        ]
        stream, start, segments = c._Stream(1), 0, []
        while start < len(rows):
            size = rnd.randint(1, 6)
            segments.append(rows[start : start + size])
            start += size
        blank = dict.fromkeys(c._COUNTS, 0) | {"first_role": None, "low": None}
        for number, segment in enumerate(segments):
            stream.add(blank | {"part": 0, "number": number, "paths": c.segment_paths(segment)})
        ways = list(stream.rows())
        assert (ways[-1]["cost"], ways[-1]["audit"]) == c.cheapest(rows)
        in_parts = [t for w, s in zip(ways, segments) for t in c.applied(s, w["edits"], w["start"])]
        assert in_parts == c.applied(rows, ways[-1]["audit"])


@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 5), (3, 4), (4, 40)])
def test_damaged_and_repaired_equals_a_plain_walk(spark, seed, partitions):
    rows = random_rows(seed, 25, 14) + [(77, t, "user" if t % 2 == 0 else "assistant", f"row {t}.") for t in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = c.damaged_and_repaired(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_one_conversation_with_most_rows_and_equal_rows(spark):
    rows = [(5, t, "user", "Same.") for t in range(700)] + [(5, None, "assistant", "Null.")] * 300
    rows += [(i, 0, "user", "Hi.") for i in range(6, 60)]
    got = c.damaged_and_repaired(frame(spark, rows).repartition(6)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_undamaged_rows_repaired_turns_and_reports(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Go?"), (2, 0, "user", " ")]
    fixed = c.repaired(frame(spark, rows))
    reports = {r.conv_id: r for r in fixed.reports().collect()}
    assert (reports[1].cost, reports[1].audit) == (1 + 1, "KRR")
    assert (reports[2].cost, reports[2].audit, reports[2].blank) == (2, "D", 1)
    turns = fixed.turns().orderBy("conv_id", "part", "number", "place").collect()
    assert [(t.conv_id, t.role, t.text) for t in turns] == [
        (1, "system", "Be kind."), (1, "user", "Hi."), (1, "assistant", "Go?"),
    ]


def test_dropped_conversations_stay_and_an_empty_table_is_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = c.damaged_and_repaired(frame(spark, [(dropped, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert c.damaged_and_repaired(frame(spark, [])).collect() == []


def test_a_very_long_text_is_a_segment_of_its_own(spark):
    rows = [(1, 0, "user", "x" * 5_000_000 + "."), (1, 1, "assistant", "Yes."), (2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    got = c.repaired(frame(spark, rows)).digests().collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, damaged=False)


@pytest.mark.parametrize("seed", [5, 6])
def test_the_sql_counterpart_equals_a_plain_walk(seed):
    import duckdb

    from wagelens.llm.queries import CONVERSATIONS_SQL

    rows = random_rows(seed, 20, 9)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(db.execute(CONVERSATIONS_SQL).fetchall(), key=repr) == expected(rows)
