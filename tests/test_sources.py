import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from wagelens import fixed
from wagelens.plans import clean as cleaning
from wagelens.plans import questions
from wagelens.plans import build as build_module
from wagelens.plans.build import build
from wagelens.plans.star import open_star
from wagelens.sources import filings as sources
from wagelens.sources import quoted, sinks, versions


@pytest.fixture
def quarters(filings, tmp_path):
    """Two quarters that disagree about columns, types and one case."""
    first = filings(
        {"CASE_STATUS": "Certified - Withdrawn", "DECISION_DATE": dt.date(2025, 4, 2)},
        {"CASE_NUMBER": "I-200-25001-000002"}, {"CASE_NUMBER": None},
    )
    second = filings(
        {"DECISION_DATE": dt.date(2025, 3, 30)},
        {"CASE_NUMBER": "I-200-25091-000003", "WAGE_RATE_OF_PAY_FROM": "120000"},
        types={"WAGE_RATE_OF_PAY_FROM": "string"},
    ).withColumn("LAWFIRM_BUSINESS_FEIN", F.lit("x")).drop("FULL_TIME_POSITION")
    second = second.withColumn("DECISION_DATE", F.col("DECISION_DATE").cast("string"))
    sinks.write_cache(first, str(tmp_path / "LCA_a.parquet"))
    sinks.write_cache(second, str(tmp_path / "LCA_b.parquet"))
    sinks.write_cache(filings(), str(tmp_path / "probe.parquet"))
    return str(tmp_path)


def names(paths):
    return [p.rsplit("/", 1)[-1] for p in paths]


def test_sources_are_found_in_order_and_strays_ignored(spark, quarters):
    assert names(sources.find_sources(spark, quarters)) == ["LCA_a.parquet", "LCA_b.parquet"]


def test_no_source_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.find_sources(spark, str(tmp_path))


def test_quarters_unite_and_the_later_decision_wins(spark, quarters):
    raw = sources.load_filings(spark, quarters)
    assert raw.count() == 4
    rows = {r.case_number: r for r in cleaning.clean(raw).collect()}
    assert len(rows) == 3
    assert rows["I-200-25001-000001"].case_status == "Certified - Withdrawn"
    assert rows["I-200-25091-000003"].annual_wage == 120_000.0
    assert rows["I-200-25091-000003"].full_time is False
    cleaning.require_valid(raw)


def test_ties_go_to_the_later_source_and_row(spark, filings, tmp_path):
    case = {"CASE_NUMBER": "I-200-25001-000001"}
    sinks.write_cache(filings({**case, "CASE_STATUS": "Denied"}).coalesce(1), str(tmp_path / "LCA_1.parquet"))
    later = filings({**case, "JOB_TITLE": "one"}, {**case, "JOB_TITLE": "two"})
    sinks.write_cache(later.coalesce(1), str(tmp_path / "LCA_2.parquet"))
    kept = cleaning.latest_filings(sources.load_filings(spark, str(tmp_path))).collect()
    assert [r.JOB_TITLE for r in kept] == ["two"]


def test_ties_inside_a_source_go_to_the_later_part(spark, filings, tmp_path):
    case = {"CASE_NUMBER": "I-200-25001-000001"}
    titles = [f"t{i:02d}" for i in range(12)]
    rows = filings(*[{**case, "JOB_TITLE": t} for t in titles])
    rows.repartitionByRange(12, "JOB_TITLE").write.parquet(str(tmp_path / "LCA_1.parquet"))
    kept = cleaning.latest_filings(sources.load_filings(spark, str(tmp_path))).collect()
    assert [r.JOB_TITLE for r in kept] == ["t11"]


def test_only_the_needed_columns_are_read(spark, quarters):
    df = sources.load_filings(spark, quarters, columns=["EMPLOYER_NAME"])
    assert set(df.columns) == {"CASE_NUMBER", "DECISION_DATE", "EMPLOYER_NAME", "_position"}
    assert "JOB_TITLE" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_column_no_source_has_is_an_error(spark, quarters):
    with pytest.raises(ValueError, match="NOPE"):
        sources.load_filings(spark, quarters, columns=["NOPE"])


def test_a_source_without_the_key_is_refused(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "LCA_x.parquet"))
    with pytest.raises(ValueError, match="CASE_NUMBER"):
        sources.load_filings(spark, str(tmp_path))


def test_csv_source(spark, tmp_path):
    header = ",".join(fixed.SOURCE_COLUMNS)
    row = 'I-200-25001-000001,Certified,H-1B,{},2024-11-01,ACME INC,"=""Analyst (""FP&A"")""",' \
        "15-1252.00,Software Developers,austin,tx,100000,,Year,95000,Year,Y"
    body = [row.format("2025-01-15"), row.format("2025-01-16"), "," * 16]
    (tmp_path / "LCA_1.csv").write_text("\n".join([header, *body]) + "\n")
    raw = sources.load_filings(spark, str(tmp_path), "LCA_*.csv")
    rows = cleaning.clean(raw).collect()
    assert len(rows) == 1
    assert rows[0].decision_date == dt.date(2025, 1, 16)
    assert rows[0].job_title == 'Analyst ("FP&A")'


def test_inventory_reports_drift(spark, quarters):
    paths = sources.find_sources(spark, quarters)
    got = [tuple(r) for r in sources.source_inventory(spark, paths).collect()]
    assert got == [
        ("LCA_a.parquet", 2, 17, "", ""),
        ("LCA_b.parquet", 2, 17, "LAWFIRM_BUSINESS_FEIN", "FULL_TIME_POSITION"),
    ]


def test_curated_table_is_pruned_by_year(spark, filings, tmp_path):
    raw = filings({}, {"DECISION_DATE": dt.date(2024, 1, 1)})
    path = sinks.write_curated(cleaning.clean(raw), str(tmp_path / "curated"))
    df = spark.read.parquet(path).filter("fiscal_year = 2024")
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fiscal_year" in plan


def test_published_runs_are_switched_whole(spark, tmp_path):
    root = str(tmp_path)
    sinks.publish(spark, root, "run-a")
    sinks.publish(spark, root, "run-b")
    assert sinks.current_run(spark, root) == "run-b"


def test_build_from_quarters_to_answers(spark, quarters, tmp_path):
    root = str(tmp_path / "star")
    star, stages = build(spark, quarters, root)
    assert stages == {
        "rows read": 4, "duplicate cases": 1, "unique filings": 3, "not certified": 0, "not tech": 0, "rows out": 3,
    }
    answer = questions.salary_percentiles(open_star(spark, root), "software engineer").first()
    assert (answer.p50, answer.n_filings) == (100_000.0, 3)
    assert star.filings.count() == 3


def test_a_broken_rule_publishes_nothing(spark, filings, tmp_path):
    sinks.write_cache(filings({"WAGE_UNIT_OF_PAY": "Fortnight"}), str(tmp_path / "LCA_1.parquet"))
    root = tmp_path / "star"
    with pytest.raises(cleaning.BadFilings):
        build(spark, str(tmp_path), str(root))
    assert not list(root.glob("run-*")) and not (root / "_published").exists()


def test_database_load_empties_children_first_and_fills_parents_first(monkeypatch):
    calls = []

    class Table:
        sparkSession = None

        def __init__(self, name):
            self.name = name

        @property
        def write(self):
            return self

        def jdbc(self, url, table, mode, properties):
            assert table == self.name
            calls.append((mode, table, properties["batchsize"], properties["user"]))

    monkeypatch.setattr(
        sinks, "clear_tables", lambda spark, url, names, login: calls.extend(("clear", n) for n in names)
    )
    order = ["titles", "filings"]
    sinks.write_database({n: Table(n) for n in order}, "jdbc:none", order, {"user": "u"})
    assert calls == [
        ("clear", "filings"), ("clear", "titles"),
        ("append", "titles", "10000", "u"), ("append", "filings", "10000", "u"),
    ]


# ---- replacing -------------------------------------------------------------------


def failing(spark):
    """Rows of which one cannot be made, so that a task of the write fails."""
    return spark.range(20).selectExpr("if(id = 13, raise_error('lost'), id) AS id")


@pytest.mark.parametrize("write", [sinks.write_cache, lambda df, path: sinks.write_curated(df.withColumn("fiscal_year", F.lit(2025)), path)])
def test_an_overwrite_that_fails_leaves_the_old_rows(spark, tmp_path, write):
    path = str(tmp_path / "t")
    write(spark.range(5), path)
    with pytest.raises(Exception, match="lost"):
        write(failing(spark), path)
    assert versions.read_table(spark, path).count() == 5
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1
    write(spark.range(7), path)
    assert versions.read_table(spark, path).count() == 7


@pytest.mark.parametrize("step", ["publish", "retire"])
def test_a_stop_between_two_steps_leaves_whole_rows(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    sinks.write_cache(spark.range(5), path)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(versions, step, stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_cache(spark.range(9), path)
    assert versions.read_table(spark, path).count() == (5 if step == "publish" else 9)


def test_old_versions_go_and_open_readers_keep_theirs(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_cache(spark.range(1), path)
    opened = versions.read_table(spark, path)
    sinks.write_cache(spark.range(2), path)
    assert opened.count() == 1
    for n in (3, 4):
        sinks.write_cache(spark.range(n), path)
    assert versions.read_table(spark, path).count() == 4
    assert len(list((tmp_path / "t").glob("v-*"))) == versions.KEEP == len(versions.published(spark, path))


def test_folders_of_killed_writers_go_by_age(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_cache(spark.range(3), path)
    for name in ("v-dead", "other", "_kept"):
        (tmp_path / "t" / name).mkdir()
    assert versions.retire(spark, path) == []
    assert versions.retire(spark, path, orphan_hours=-1) == ["v-dead"]
    assert (tmp_path / "t" / "other").exists() and versions.read_table(spark, path).count() == 3


def test_a_plain_folder_comes_back_after_a_stop(spark, tmp_path, monkeypatch):
    path, fresh = str(tmp_path / "t"), str(tmp_path / "fresh")
    spark.range(5).write.parquet(path)
    with pytest.raises(OSError):
        sinks.replace(spark, fresh, path)
    assert spark.read.parquet(path).count() == 5
    # As a driver leaves it that dies between the two moves.
    (tmp_path / "t").rename(tmp_path / f".t{sinks._ASIDE}00000000000000000001")
    assert sinks.recover(spark, path) and not sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == 5
    spark.range(8).write.parquet(fresh)
    sinks.replace(spark, fresh, path)
    assert spark.read.parquet(path).count() == 8
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_table_without_a_version_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.current_version(spark, str(tmp_path))
    assert versions.current_path(spark, str(tmp_path)) == str(tmp_path)


# ---- many sources ----------------------------------------------------------------


def scans(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return len(re.findall(r"\n\(\d+\) Scan parquet", df._jdf.queryExecution().explainString(mode)))


def test_sources_of_one_schema_are_one_scan(spark, filings, tmp_path):
    plain = filings({"DECISION_DATE": dt.date(2025, 1, 1)})
    kinds = [
        plain,
        plain.withColumn("LAWFIRM_BUSINESS_FEIN", F.lit("x")),
        plain.withColumn("PREVAILING_WAGE", F.col("PREVAILING_WAGE").cast("string")),
    ]
    for i in range(24):
        rows = kinds[i % 3].withColumn("JOB_TITLE", F.lit(f"t{i:02d}")).coalesce(1)
        # Versioned folders, plain folders with odd names, and single files.
        if i % 2:
            sinks.write_cache(rows, str(tmp_path / f"LCA_{i:02d}.parquet"))
        else:
            rows.write.parquet(str(tmp_path / f"LCA_{i:02d} é+%41.parquet"))
    raw = sources.load_filings(spark, str(tmp_path), columns=["JOB_TITLE", "PREVAILING_WAGE"])
    assert scans(raw) <= 3 and raw.count() == 24
    order = [r.JOB_TITLE for r in raw.orderBy("_position").collect()]
    assert order == [f"t{i:02d}" for i in range(24)]
    assert [r.JOB_TITLE for r in cleaning.latest_filings(raw).collect()] == ["t23"]
    inventory = sources.source_inventory(spark, sources.find_sources(spark, str(tmp_path)))
    got = [(r.source[:6], r.n_rows, r.n_columns, r.added) for r in inventory.collect()]
    assert got == [(f"LCA_{i:02d}", 1, 18 if i % 3 == 1 else 17, "LAWFIRM_BUSINESS_FEIN" if i % 3 == 1 else "") for i in range(24)]


def test_single_files_are_told_apart(spark, filings, tmp_path):
    for i in range(3):
        filings({"JOB_TITLE": f"t{i}"}).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (part,) = (tmp_path / f"w{i}").glob("part-*.parquet")
        part.rename(tmp_path / f"LCA_{i}.parquet")
    raw = sources.load_filings(spark, str(tmp_path))
    assert scans(raw) == 1
    assert {(r.JOB_TITLE, r._position.source) for r in raw.collect()} == {("t0", 0), ("t1", 1), ("t2", 2)}


def test_part_files_of_a_source_may_drift(spark, filings, tmp_path):
    path = str(tmp_path / "LCA_1.parquet")
    filings({"JOB_TITLE": "old"}).drop("PW_UNIT_OF_PAY").write.parquet(path)
    filings({"JOB_TITLE": "new"}).write.mode("append").parquet(path)
    raw = sources.load_filings(spark, str(tmp_path))
    assert {(r.JOB_TITLE, r.PW_UNIT_OF_PAY) for r in raw.collect()} == {("old", None), ("new", "Year")}


def test_a_build_reads_and_deduplicates_its_sources_once(spark, quarters, tmp_path, monkeypatch):
    calls = []
    original = build_module.counted_latest
    monkeypatch.setattr(build_module, "counted_latest", lambda raw: calls.append(scans(raw)) or original(raw))
    monkeypatch.setattr(cleaning, "latest_filings", lambda *_: pytest.fail("deduplicated again"))
    root = str(tmp_path / "star")
    _, stages = build(spark, quarters, root)
    assert calls == [2] and (stages["rows read"], stages["duplicate cases"]) == (4, 1)
    assert versions.read_table(spark, f"{root}/cleaned").count() == 3


def test_counted_latest_is_the_latest(spark, filings):
    case = {"CASE_NUMBER": "I-200-25001-000009"}
    raw = filings(
        {**case, "DECISION_DATE": dt.date(2025, 1, 1), "JOB_TITLE": "a"}, {**case, "DECISION_DATE": None, "JOB_TITLE": "b"},
        {**case, "DECISION_DATE": dt.date(2026, 1, 1), "JOB_TITLE": "c"}, {"JOB_TITLE": "d"},
    ).withColumn("_position", F.monotonically_increasing_id())
    got = {(r.JOB_TITLE, r._filed) for r in cleaning.counted_latest(raw).collect()}
    assert got == {("b", 3), ("d", 1)}
    assert {r.JOB_TITLE for r in cleaning.latest_filings(raw).collect()} == {"b", "d"}


# ---- CSV -------------------------------------------------------------------------


def odd_csv(n, seed):
    """Records with quotes, line ends, commas and blanks in any field."""
    rnd = random.Random(seed)
    pieces = ['plain', 'a, b', 'two\nlines', '"said"', '', ' ', '\n\n', 'é ñ', '"', ',', 'x' * 200, '="15-1252.00"']
    rows = [[f"k{i}", *("".join(rnd.choices(pieces, k=rnd.randrange(0, 3))) for _ in range(3))] for i in range(n)]

    def field(text):
        quoted = any(c in text for c in '",\n\r') or rnd.random() < 0.3
        return '"' + text.replace('"', '""') + '"' if quoted else text

    lines = [",".join(map(field, row)) for row in rows]
    return "CASE_NUMBER,b,c,d\n" + "\n".join(lines) + "\n"


@pytest.mark.parametrize("split", ["512", "3k", "10m"])
def test_quoted_csv_is_split_and_reads_as_in_one_task(spark, tmp_path, split):
    path = str(tmp_path / "LCA_1.csv")
    (tmp_path / "LCA_1.csv").write_text(odd_csv(400, 7) + '\n"k400","a long\n' + "line\n" * 900 + '",x,y\n')
    wanted = [tuple(r) for r in spark.read.csv(path, header=True, escape='"', multiLine=True).collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = quoted.read_quoted_csv(spark, path)
        got = [tuple(r) for r in df.orderBy(quoted.ROW).drop(quoted.FILE, quoted.ROW).collect()]
        tasks = quoted._lines(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == wanted and len(got) == 401
    assert tasks > 3 or split != "512"
    assert df.select(quoted.ROW).distinct().count() == 401


def test_csv_with_an_unpaired_quote_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text('CASE_NUMBER,b\n1,"open\n2,x\n')
    with pytest.raises(ValueError, match="pair"):
        quoted.read_quoted_csv(spark, str(tmp_path / "x.csv"))


def test_csv_with_carriage_returns_and_no_last_line_end(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'CASE_NUMBER,b\r\n1,"x"\r\n\r\n2,y')
    rows = quoted.read_quoted_csv(spark, str(tmp_path / "x.csv")).collect()
    assert sorted((r.CASE_NUMBER, r.b) for r in rows) == [("1", "x"), ("2", "y")]
