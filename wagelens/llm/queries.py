"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from wagelens.llm import (
    alignment, conversations, decontaminate, licenses, line_dedup, near_dedup, search, sharding, token_counts, token_store,
    tokenize, toxicity, urls,
)
from wagelens.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "word_bpe_49k.json"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(operator: Callable[..., DataFrame], **settings) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), **settings)


def all_queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda spark, sf_dir: toxicity.scored_documents(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        ),
        "op2_search": _documents(search.similar_documents),
        "op3_line_dedup": _documents(line_dedup.deduplicated_lines),
        "op4_near_dedup": _documents(near_dedup.near_duplicates, width=2),
        "op5_licenses": _documents(licenses.license_documents),
        "op6_urls": lambda spark, sf_dir: urls.judged_pages(table(spark, sf_dir, "pages")),
        "op7_token_store": lambda spark, sf_dir: token_store.stored_documents(
            table(spark, sf_dir, "documents"), vocabulary_path()
        ),
        "op8_shards": _documents(sharding.sharded_documents),
        "op9_decontaminate": lambda spark, sf_dir: decontaminate.leaks(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        ),
        "op10_bpe": lambda spark, sf_dir: tokenize.digests(table(spark, sf_dir, "documents"), vocabulary_path()),
        "op11_conversations": lambda spark, sf_dir: conversations.damaged_and_repaired(
            table(spark, sf_dir, "conversations")
        ),
        "op12_alignment": lambda spark, sf_dir: alignment.aligned_documents(
            table(spark, sf_dir, "documents"), vocabulary_path(BYTE_LEVEL), vocabulary_path(PIECES)
        ),
        "op13_token_counts": lambda spark, sf_dir: token_counts.counted_documents(
            table(spark, sf_dir, "documents"), vocabulary_path(PIECES)
        ),
        "pipeline": corpus_pipeline.run,
    }


def all_oracles() -> dict[str, str]:
    found = {"op4_near_dedup": NEAR_DEDUP_SQL, "op11_conversations": CONVERSATIONS_SQL}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


# Every document against every other of a similar size that shares a shingle.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(
      CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words
), sets AS (
  SELECT doc_id, coalesce(len(s), 0) AS n, s FROM shingled
), parts AS (
  SELECT doc_id, n, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS common
  FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT u, v FROM shared WHERE 100 * common >= 80 * (nu + nv - common)
), arcs AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT arcs.v, reach.seen FROM reach JOIN arcs ON arcs.u = reach.node
), lowest AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT sets.doc_id, sets.n AS n_shingles, lowest.component_id, sets.doc_id = lowest.component_id AS kept
FROM sets JOIN lowest ON lowest.node = sets.doc_id
"""

# A table of four states by their last role (0 nothing, 1 system, 2 user, 3 assistant), relaxed
# row by row; a state is its cheapest (cost, audit) and the lines kept so far.
_FAR = "{'c': 1000000000, 'a': '', 't': CAST([] AS VARCHAR[])}"
_INSERTED = "{{'c': {0}.c + 5, 'a': {0}.a || 'I', 't': list_append({0}.t, '{1}:')}}"


def _with_insertions(states: str) -> str:
    """The states after at most one insertion."""
    users = ", ".join([f"{states}[3]", *[_INSERTED.format(f"{states}[{i}]", "user") for i in (1, 2, 4)]])
    assistant = _INSERTED.format(f"{states}[3]", "assistant")
    return f"[{states}[1], {states}[2], list_min([{users}]), list_min([{states}[4], {assistant}])]"


def _edited(before: str, cost: str, initial: str, line: str) -> str:
    return f"{{'c': {before}.c + {cost}, 'a': {before}.a || '{initial}', 't': list_append({before}.t, {line})}}"


def _after_row() -> str:
    """The states after one row ``x``, from the states ``q`` before it."""
    gone = [f"{{'c': q[{i}].c + 2, 'a': q[{i}].a || 'D', 't': q[{i}].t}}" for i in (1, 2, 3, 4)]
    stays = "CASE WHEN x.cut THEN 5 ELSE 0 END"

    def into(state: int, initial: str, name: str, sources: tuple[int, ...]) -> str:
        kept = [
            f"CASE WHEN NOT x.gone AND x.role[1] = '{initial}' THEN "
            + _edited(f"q[{i}]", stays, "K", "x.role || ':' || x.text") + " END" for i in sources
        ]
        moved = [] if name == "system" else [
            "CASE WHEN NOT x.gone THEN " + _edited(f"q[{i}]", f"1 + {stays}", "R", f"'{name}:' || x.text") + " END"
            for i in sources
        ]
        return f"list_min([{', '.join([gone[state - 1], *kept, *moved])}])"

    users, assistants = into(3, "u", "user", (1, 2, 4)), into(4, "a", "assistant", (3,))
    return f"[{gone[0]}, {into(2, 's', 'system', (1,))}, {users}, {assistants}]"


CONVERSATIONS_SQL = rf"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), '') AS letters
  FROM conversations
), checked AS (
  SELECT *, xor(list_reduce(list_transform(letters, lambda l: CAST(unicode(l) AS BIGINT)), lambda crc, b:
    list_reduce(CAST(range(8) AS BIGINT[]), lambda v, i:
      CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, b)), CAST(4294967295 AS BIGINT)),
    4294967295) % 20 AS kind
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM checked)
), placed AS (
  SELECT *, row_number() OVER line AS place, lag(role[1]) OVER line AS before,
    NOT regexp_matches(text, '[^ 	-
]') AS blank,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') AS unended
  FROM damaged WINDOW line AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, blank OR again AS gone, unended AND NOT (blank OR again) AS cut FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again FROM placed)
), found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE place > 1 AND concat(before, role[1]) NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'s': [{_FAR}], 'role': role, 'text': text, 'gone': gone, 'cut': cut}} ORDER BY place) AS rows
  FROM judged GROUP BY conv_id
), relaxed AS (
  SELECT * EXCLUDE (rows), list_reduce(rows, lambda so_far, x:
    {{'s': list_transform([so_far.s], lambda s: list_transform([{_with_insertions('s')}], lambda q: {_after_row()})[1])[1],
      'role': '', 'text': '', 'gone': false, 'cut': false}},
    {{'s': [{{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}}, {_FAR}, {_FAR}, {_FAR}],
      'role': '', 'text': '', 'gone': false, 'cut': false}}).s AS s FROM found
), ended AS (
  SELECT * EXCLUDE (s), list_transform([{_with_insertions('s')}],
    lambda q: list_transform([{_with_insertions('q')}], lambda z: list_min([z[1], z[4]]))[1])[1] AS best FROM relaxed
)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(best.c AS BIGINT), 0) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM every.conv_id
"""
