"""One fact and five lookups from the cleaned filings.

Lookup ids are dense, start at 0 and follow first appearance in case-number order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens import fixed
from wagelens.functions import wages
from wagelens.functions.cases import case_day, case_number, case_order, case_prefix, case_serial
from wagelens.operators.checks import duplicate_keys, null_counts, orphan_report, schema_differences
from wagelens.operators.constraints import REFERENCE, UNIQUE, Constraint, broken_constraints, not_null
from wagelens.operators.joins import frequent_values, key_text, spread_join
from wagelens.operators.positions import bucketed_positions
from wagelens.operators.summaries import unpivot_counts
from wagelens.sources.sinks import verify_rows
from wagelens.sources.versions import current_version, replace_table

# ---- fixed values: per lookup its table, its id, the columns that make a row its own, and the
# column of which each row keeps the first value seen
LOOKUPS = [
    ("employers", "employer_id", ["employer_name"], "raw_name_sample"),
    ("occupations", "soc_id", ["soc_code"], "soc_title"),
    ("titles", "title_id", ["job_title"], None),
    ("locations", "location_id", ["worksite_city", "worksite_state"], None),
    ("visa_classes", "visa_class_id", ["visa_class"], None),
]

# Column names and types of the six tables, as schema text.
SCHEMAS = {
    "employers": "employer_id bigint, employer_name string, raw_name_sample string",
    "occupations": "soc_id bigint, soc_code string, soc_title string",
    "titles": "title_id bigint, job_title string",
    "locations": "location_id bigint, worksite_city string, worksite_state string",
    "visa_classes": "visa_class_id bigint, visa_class string",
    "filings": (
        "case_serial bigint, case_prefix int, employer_id bigint, soc_id bigint, title_id bigint,"
        " location_id bigint, visa_class_id bigint, annual_wage bigint, annual_from bigint, annual_to bigint,"
        " prevailing_wage bigint, fiscal_year int, full_time boolean, withdrawn boolean,"
        " is_outlier boolean, pw_outlier boolean, unit_repaired boolean, pw_repaired boolean"
    ),
}

# What the stored fact holds besides: a key per text that questions ask for, and the folder.
KEY_COLUMNS = {"title_key": "job_title", "city_key": "worksite_city", "state_key": "worksite_state"}
BLOCK = "title_block"
_STORED_FACT = SCHEMAS["filings"] + "".join(f", {key} binary" for key in KEY_COLUMNS) + f", {BLOCK} int"

# Titles as a search offers them: folded, its least spelling, how many filings it has.
SEARCH_SCHEMA = "folded string, job_title string, n bigint"
_SEARCH = "title_counts"

# Ends a run's name, before the bits of its folders of titles.
_BITS_MARK = "-b"

# A folder of one year holds about so many filings, but there are at most 2^12 folders a year.
BLOCK_ROWS = 16_000_000
_MOST_BITS, _KEY_BITS = 12, 16

TABLES = [name for name, *_ in LOOKUPS] + ["filings"]
COLUMNS = {name: [field.split()[0] for field in text.split(",")] for name, text in SCHEMAS.items()}
FACT_COLUMNS = COLUMNS["filings"]

# What is carried beside a key may be null, but for these.
REQUIRED_PAYLOADS = ("soc_title",)

# Columns that may not be null: every id and flag, the key, and the year.
REQUIRED = [
    c for c in FACT_COLUMNS if c not in ("annual_wage", "annual_from", "annual_to", "prevailing_wage")
]


@dataclass(frozen=True)
class Star:
    """The six tables, and what a stored star has besides to answer questions sooner.

    ``keyed`` is the fact with the keys of ``KEY_COLUMNS`` and its folder, ``search`` the titles
    with their counts, ``block_bits`` how many bits of a title's key name its folder. Without them
    questions join the lookups.
    """

    filings: DataFrame
    employers: DataFrame
    occupations: DataFrame
    titles: DataFrame
    locations: DataFrame
    visa_classes: DataFrame
    keyed: DataFrame | None = None
    search: DataFrame | None = None
    block_bits: int = 0

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def register(self) -> None:
        """Expose the tables and the joined view to SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        joined_view(self).createOrReplaceTempView("v_filings")


# ---- lookups -------------------------------------------------------------------


def star_source(cleaned: DataFrame) -> DataFrame:
    """Cleaned filings as the star sees them: empty text for a missing place."""
    return cleaned.withColumns(
        {
            "raw_name_sample": F.col("employer_raw"),
            "worksite_city": F.coalesce("worksite_city", F.lit("")),
            "worksite_state": F.coalesce("worksite_state", F.lit("")),
            "_order": case_order(F.col("case_number")),
        }
    )


def numbered_lookup(
    source: DataFrame, id_column: str, keys: Sequence[str], payload: str | None
) -> DataFrame:
    """One lookup with its ids, and the payload of the first filing that names the key.

    The large step keeps one long per group, which aggregates by hash and combines on
    the map side; only its distinct (keys, payload) rows reach the step that picks a
    payload. Ids count up by day of the first case number: at most a million per day.
    """
    first = F.min("_order").alias("_first")
    seen = source.groupBy(*keys, *([payload] if payload else [])).agg(first)
    if payload:
        seen = seen.groupBy(*keys).agg(
            F.min_by(payload, "_first").alias(payload), F.min("_first").alias("_first")
        )
    ranked = bucketed_positions(
        seen.withColumn("_day", case_day(F.col("_first"))), "_day", [F.col("_first")], "_id"
    )
    return ranked.select(
        F.col("_id").cast("bigint").alias(id_column), *keys, *([payload] if payload else [])
    )


# ---- fact ----------------------------------------------------------------------


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text in any case. For a given text it is a constant of the plan,
    so a question about it is a literal filter that prunes folders, row groups and pages."""
    return F.unhex(F.md5(F.lower(text)))


def title_block(key: Column, bits: int) -> Column:
    """The folder of a title: the leading bits of its key."""
    leading = F.conv(F.substring(F.hex(key), 1, _KEY_BITS // 4), 16, 10).cast("int")
    return F.shiftright(leading, _KEY_BITS - bits)


def block_bits(n_rows: int) -> int:
    """Bits for folders of about ``BLOCK_ROWS`` filings."""
    return min(_MOST_BITS, (max(0, n_rows - 1) // BLOCK_ROWS).bit_length())


def frequent_keys(source: DataFrame, tasks: int) -> dict[str, list]:
    """Per lookup the keys that hold more than half a task's share of the filings."""
    columns = {name: key_text([F.col(k) for k in keys]) for name, _, keys, _ in LOOKUPS}
    return frequent_values(source, columns, 1 / (2 * tasks))


def fact_of(
    source: DataFrame, lookups: dict[str, DataFrame], frequent: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """The fact and its keys. Text is replaced by ids one lookup at a time; null keys match null keys.

    Catalyst broadcasts a lookup by its stored size and shuffles it beyond the threshold. The
    rows of ``frequent`` keys are then dealt over all tasks.
    """
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = sorted({k for _, _, ks, _ in LOOKUPS for k in ks})
    number = F.col("case_number")
    facts = source.select(
        case_serial(number).alias("case_serial"),
        case_prefix(number).alias("case_prefix"),
        *keys,
        *[text_key(F.col(text)).alias(key) for key, text in KEY_COLUMNS.items()],
        *[
            wages.whole_dollars(F.col(c)).alias(c)
            for c in ("annual_wage", "annual_from", "annual_to", "prevailing_wage")
        ],
        "fiscal_year",
        "full_time",
        F.coalesce(F.col("case_status") == fixed.WITHDRAWN_STATUS, F.lit(False)).alias("withdrawn"),
        "is_outlier",
        "pw_outlier",
        "unit_repaired",
        "pw_repaired",
    )
    for name, id_column, lookup_keys, _ in LOOKUPS:
        ids = lookups[name].select(id_column, *lookup_keys)
        hot = (frequent or {}).get(name, ())
        facts = spread_join(facts, ids, lookup_keys, hot, F.col("case_serial"), parts).drop(*lookup_keys)
    return facts.select(*FACT_COLUMNS, *KEY_COLUMNS)


def title_counts(facts: DataFrame, titles: DataFrame) -> DataFrame:
    """Per folded title its least spelling and its filings, for ``title_search``.

    Spellings that differ in case are one entry. Filings are counted by id before the text
    is joined.
    """
    filed = facts.groupBy("title_id").agg(F.count(F.lit(1)).alias("_filed"))
    return (
        filed.join(titles, "title_id")
        .groupBy(F.lower("job_title").alias("folded"))
        .agg(F.min("job_title").alias("job_title"), F.sum("_filed").alias("n"))
    )


# ---- build and open ------------------------------------------------------------


class BrokenStar(ValueError):
    """The built tables break a key or a not-null rule."""


def build_star(cleaned: DataFrame, root: str) -> Star:
    """Write the six tables under a new run, check them, then make the run current.

    Readers see the previous run until the new one is complete. A run that fails is removed.
    """
    spark, n_rows = cleaned.sparkSession, cleaned.count()
    name = f"run-{uuid.uuid4().hex[:12]}{_BITS_MARK}{block_bits(n_rows)}"
    replace_table(spark, root, partial(_write_run, cleaned, n_rows), name)
    return open_star(spark, root)


def _write_run(cleaned: DataFrame, n_rows: int, folder: str) -> None:
    spark, bits = cleaned.sparkSession, block_bits(n_rows)
    source = star_source(cleaned)
    _together(
        [
            partial(
                numbered_lookup(source, id_column, keys, payload).write.parquet, f"{folder}/{name}"
            )
            for name, id_column, keys, payload in LOOKUPS
        ]
    )
    lookups = {
        name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}") for name, *_ in LOOKUPS
    }

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = fact_of(source, lookups, frequent_keys(source, tasks))
    write_fact(facts, f"{folder}/filings", bits)
    star = _open_run(spark, folder, bits)
    # Sorted, so that a prefix is a range of row groups.
    search = title_counts(star.filings, star.titles).orderBy("folded")
    _together([
        partial(_check, star),
        lambda: verify_rows(spark, f"{folder}/filings", n_rows),
        partial(search.write.parquet, f"{folder}/{_SEARCH}"),
    ])
    wrong = stored_types(spark, folder)
    if wrong:
        raise BrokenStar(f"stored tables differ from their layout: {wrong}")


def write_fact(facts: DataFrame, path: str, bits: int) -> None:
    """The fact in folders per year and block of titles, sorted by title and place in each file.

    A question about a title reads one folder a year and skips nearly every row group there.
    Rows meet by finer blocks of neighbouring keys. The rebalance hint lets adaptive execution
    cut a block that holds many rows into several files, and, unlike a range partitioning, it
    does not run the joins a first time just to sample them.
    """
    tasks = 4 * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    finer = min(_KEY_BITS, max(bits, (tasks - 1).bit_length()))
    order = ["fiscal_year", BLOCK, "title_key", "location_id", "case_serial"]
    (
        facts.withColumn(BLOCK, title_block(F.col("title_key"), bits))
        .withColumn("_part", title_block(F.col("title_key"), finer))
        .hint("rebalance", "fiscal_year", "_part")
        .sortWithinPartitions(*order)
        .drop("_part")
        .write.partitionBy("fiscal_year", BLOCK)
        .parquet(path)
    )


def _together(steps: Sequence[Callable[[], object]]) -> None:
    """Run independent jobs side by side; the first failure is raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        for done in [pool.submit(step) for step in steps]:
            done.result()


def _open_run(spark: SparkSession, folder: str, bits: int) -> Star:
    """The tables of a run. Stated schemas save the job that would infer each of them."""
    tables = {
        name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}").select(*COLUMNS[name])
        for name, *_ in LOOKUPS
    }
    keyed = spark.read.schema(_STORED_FACT).parquet(f"{folder}/filings")
    return Star(filings=keyed.select(*FACT_COLUMNS), keyed=keyed, block_bits=bits, **tables)


def open_star(spark: SparkSession, root: str) -> Star:
    """The current run's tables."""
    run = current_version(spark, root)
    folder, bits = f"{root}/{run}", int(run.rpartition(_BITS_MARK)[2])
    search = spark.read.schema(SEARCH_SCHEMA).parquet(f"{folder}/{_SEARCH}")
    return replace(_open_run(spark, folder, bits), search=search)


# What must hold in a star: ids, keys and flags are there, keys are their rows' own, ids refer.
CONSTRAINTS = [
    *not_null("filings", REQUIRED),
    *[
        rule
        for name, id_column, keys, payload in LOOKUPS
        for rule in not_null(name, [id_column, *keys, *([payload] if payload in REQUIRED_PAYLOADS else [])])
    ],
    Constraint(UNIQUE, "filings", ("case_serial",)),
    *[Constraint(UNIQUE, name, tuple(keys)) for name, _, keys, _ in LOOKUPS],
    *[Constraint(UNIQUE, name, (id_column,)) for name, id_column, _, _ in LOOKUPS],
    *[Constraint(REFERENCE, "filings", (id_column,), name) for name, id_column, _, _ in LOOKUPS],
]


def broken_rules(star: Star) -> DataFrame:
    """(rule, table, columns, n_keys, n_rows) for every constraint; zeros in a sound star."""
    return broken_constraints({name: star.table(name) for name in TABLES}, CONSTRAINTS)


def stored_types(spark: SparkSession, folder: str) -> list[str]:
    """Columns of a run's files that are missing, unexpected or of another type than stated."""
    stated = {**SCHEMAS, "filings": _STORED_FACT, _SEARCH: SEARCH_SCHEMA}
    with ThreadPoolExecutor(len(stated)) as pool:
        stored = dict(zip(stated, pool.map(lambda name: spark.read.parquet(f"{folder}/{name}").schema, stated)))
    return [
        f"{name}: {difference}"
        for name, text in stated.items()
        for difference in schema_differences(stored[name], T.StructType.fromDDL(text))
    ]


def foreign_keys(star: Star) -> DataFrame:
    """Orphans per lookup; all zero in a sound star."""
    parents = {name: (id_column, star.table(name)) for name, id_column, _, _ in LOOKUPS}
    return orphan_report(star.filings, parents)


def missing_values(star: Star) -> DataFrame:
    """Nulls in the columns that may hold none."""
    return null_counts(star.filings, REQUIRED)


def missing_lookup_values(star: Star) -> DataFrame:
    """(lookup, column, n_rows): nulls in ids, keys and occupation titles; all zero in a sound star."""
    parts = []
    for name, id_column, keys, payload in LOOKUPS:
        columns = [id_column, *keys, *([payload] if payload in REQUIRED_PAYLOADS else [])]
        counts = unpivot_counts(null_counts(star.table(name), columns), "column", "n_rows")
        parts.append(counts.select(F.lit(name).alias("lookup"), "column", "n_rows"))
    return reduce(DataFrame.unionByName, parts)


def repeated_serials(star: Star) -> DataFrame:
    return duplicate_keys(star.filings, ["case_serial"])


def repeated_lookup_keys(star: Star) -> DataFrame:
    """(lookup, repeated keys) for every lookup; all zero in a sound star."""
    parts = [
        duplicate_keys(star.table(name), keys).agg(
            F.lit(name).alias("lookup"), F.count(F.lit(1)).alias("n_repeated")
        )
        for name, _, keys, _ in LOOKUPS
    ]
    return reduce(DataFrame.unionByName, parts)


def _check(star: Star) -> None:
    """Not-null and key rules. An id without a lookup row is a null here: ids come from a
    left join with the lookups, so references need no second pass."""
    nulls = {c: n for c, n in missing_values(star).first().asDict().items() if n}
    nulls |= {f"{r.lookup}.{r.column}": r.n_rows for r in missing_lookup_values(star).collect() if r.n_rows}
    if nulls:
        raise BrokenStar(f"nulls in required columns: {nulls}")
    shared = repeated_serials(star).count()
    if shared:
        raise BrokenStar(f"{shared:,} case serials occur more than once; the serial is the key")


# ---- catalog and view ----------------------------------------------------------


def catalog(star: Star) -> DataFrame:
    """(table, n_rows) of the six tables."""
    counts = [
        star.table(name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"))
        for name in sorted(TABLES)
    ]
    return reduce(DataFrame.unionByName, counts)


def status_of(withdrawn: Column) -> Column:
    return F.when(withdrawn, F.lit(fixed.WITHDRAWN_STATUS)).otherwise(F.lit(fixed.CERTIFIED_STATUS))


def joined_view(star: Star) -> DataFrame:
    """Everything joined, with the case number and the status text rebuilt.

    The columns and their order are fixed values.
    """
    joined = (
        star.filings.join(star.employers, "employer_id")
        .join(star.occupations, "soc_id")
        .join(star.titles, "title_id")
        .join(star.visa_classes, "visa_class_id")
        .join(star.locations, "location_id", "left")
    )
    return joined.select(
        case_number(F.col("case_prefix"), F.col("case_serial")).alias("case_number"),
        "employer_name",
        F.col("raw_name_sample").alias("employer_as_filed"),
        "job_title",
        "soc_code",
        "soc_title",
        "worksite_city",
        "worksite_state",
        "visa_class",
        "annual_wage",
        "annual_from",
        "annual_to",
        "prevailing_wage",
        "fiscal_year",
        "full_time",
        status_of(F.col("withdrawn")).alias("case_status"),
        "is_outlier",
        "pw_outlier",
        "unit_repaired",
        "pw_repaired",
    )
