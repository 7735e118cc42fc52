"""The whole job with the deterministic labeller, and the incremental one."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from faultline.catalog.views import CONFIG, view
from faultline.config import Limits
from faultline.catalog.labeller import keyword_labeller
from faultline.operators.ledger import read_ledger
from faultline.operators.metrics import ledger_metrics, run_totals
from faultline.plans.full import Run, finish, full_run, with_codes
from faultline.sources.scratch import delete_folder
from faultline.streaming.incremental import label_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    rows = view(spark, SF, "wo")
    repeated = rows.where("row_id IN (3, 4)")  # work-order numbers need not be unique
    return rows.unionByName(repeated).cache(), view(spark, SF, "components").cache()


def content(df):
    """All rows, in an order of their own."""
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def finished(spark, inputs, tmp_path_factory):
    run = Run(spark, str(tmp_path_factory.mktemp("run")), CONFIG, keyword_labeller)
    return run, full_run(run, *inputs)


def test_every_row_comes_back_labelled(inputs, finished):
    _, result = finished
    assert content(result.select("row_id", "descriptions")) == content(inputs[0].select("row_id", "descriptions"))
    assert {r.P4_Status for r in result.select("P4_Status").distinct().collect()} == {"ok", "skipped"}
    # what was merged is the old code or one that passed its gate
    wrong = result.where(F.col("System_Code_Corrected_Flag") & (F.coalesce("P1_Confidence", "P2_Relabel_Confidence") != "High"))
    assert wrong.isEmpty()
    assert result.where("QA_Status IS NULL").isEmpty()


def test_second_run_asks_nothing_and_one_partition_gives_the_same(spark, inputs, finished, tmp_path):
    run, result = finished
    before, calls = content(result), read_ledger(spark, run.ledger).count()
    again = full_run(Run(spark, run.folder, CONFIG, keyword_labeller), *inputs)
    assert read_ledger(spark, run.ledger).count() == calls
    assert content(again) == before
    # small batches split the bigger groups; their merged dictionaries allow the same answers
    small = replace(CONFIG, limits=Limits(batch_chars=20_000))
    single = full_run(Run(spark, str(tmp_path), small, keyword_labeller, partitions=1),
                      inputs[0].coalesce(1).orderBy(F.desc("row_id")), inputs[1])
    assert content(single) == before
    pieces = read_ledger(spark, f"{tmp_path}/ledger", "P3").count()
    assert pieces > read_ledger(spark, run.ledger, "P3").count()


def test_second_pass_over_a_result_keeps_legacy_copies_and_asks_nothing(spark, inputs, finished):
    run, result = finished
    calls = read_ledger(spark, run.ledger).count()
    again = full_run(Run(spark, run.folder, CONFIG, keyword_labeller), result, inputs[1])
    assert read_ledger(spark, run.ledger).count() == calls
    columns = ["row_id", "Legacy_System_Code", "Legacy_Maintenance_Type", "Merged_System_Code", "QA_Status", "P2_Status", "P2_Relabel_Status"]
    assert content(again.select(columns)) == content(result.select(columns))


def test_no_rows_give_no_rows(spark, inputs, tmp_path):
    empty = full_run(Run(spark, str(tmp_path), CONFIG, keyword_labeller), inputs[0].limit(0), inputs[1])
    assert empty.isEmpty() and "QA_Status" in empty.columns


def test_each_phase_asks_in_as_many_tasks_as_set(spark, inputs, finished):
    """Also where texts are joined by a key that all rows share: calls are dealt after the join."""
    run, result = finished
    asked = read_ledger(spark, run.ledger).groupBy("phase").count().collect()
    assert {r.phase for r in asked} >= {"P1", "P2", "P3", "P4_OPERATIONAL"}
    assert result.where("P2_Requires_Relabel AND P2_Relabel_Status NOT IN ('ok', 'config_error', 'error', 'invalid')").isEmpty()


def test_ledger_reports(spark, finished):
    run, _ = finished
    totals = run_totals(ledger_metrics(read_ledger(spark, run.ledger), CONFIG.pricing)).first()
    assert totals.rows_processed == read_ledger(spark, run.ledger).count()
    assert totals.cost_usd > 0


def test_stream_labels_new_files_only(spark, inputs, finished, tmp_path):
    done, result = finished
    rows, taxonomy = inputs
    dictionary = spark.read.parquet(done.path("dictionary"))
    source = str(tmp_path / "in")
    rows.where("row_id % 2 = 0").write.parquet(source)
    run = Run(spark, str(tmp_path / "out"), CONFIG, keyword_labeller)

    def drain():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        query = label_stream(run, stream, taxonomy, dictionary)
        assert query.awaitTermination(300)
        return spark.read.parquet(f"{run.folder}/labelled")

    assert drain().count() == rows.where("row_id % 2 = 0").count()
    rows.where("row_id % 2 = 1").write.mode("append").parquet(source)
    labelled = drain()
    assert labelled.select("batch").distinct().count() == 2
    columns = ["row_id", "Merged_System_Code", "P4_Maintenance_Type", "P4_Failure_Mode", "QA_Status"]
    assert content(labelled.select(columns)) == content(result.select(columns))

    # a batch handed over again after it was written: its folder is left as it is, nothing is asked
    files = sorted(p.name for p in (tmp_path / "out/labelled/batch=1").iterdir())
    calls = read_ledger(spark, run.ledger).count()
    delete_folder(spark, f"{run.folder}/stream/commits/1")
    drain()
    assert sorted(p.name for p in (tmp_path / "out/labelled/batch=1").iterdir()) == files
    assert read_ledger(spark, run.ledger).count() == calls
    # texts of one taxonomy are kept in one place, each branch once
    (version,) = (tmp_path / "out/branches").iterdir()
    kept = spark.read.parquet(*map(str, version.iterdir()))
    assert kept.count() == kept.select("branch").distinct().count() > 0


def test_run_report_counts_every_call_and_its_rows(spark, finished):
    run, result = finished
    report = spark.read.parquet(run.path("report"))
    ledger = read_ledger(spark, run.ledger).where(F.col("batch_id").isin(run.batches))
    assert {r.batch_id for r in report.where("level = 'batch'").collect()} == set(run.batches)
    phases = {r.phase: r for r in report.where("level = 'phase'").collect()}
    assert {p: r.calls for p, r in phases.items()} == {r.phase: r["count"] for r in ledger.groupBy("phase").count().collect()}
    whole = report.where("level = 'run'").first()
    for c in ("rows", "calls", "input_tokens", "output_tokens"):
        assert whole[c] == sum(r[c] for r in phases.values())
    assert all(r.rows >= r.calls for p, r in phases.items()) and whole.cost_usd > 0


def test_codes_and_labels_are_not_broadcast(spark, finished):
    """columns that hardly vary make a table of all rows look small, but it meets the texts by a shuffle."""
    from types import SimpleNamespace

    run, result = finished
    read = lambda name: spark.read.parquet(run.path(name))
    rows = read("work_orders").drop("route", "P1_call", "P2_call", "P2_RELABEL_call")
    coded = with_codes(SimpleNamespace(config=CONFIG, table=lambda name, df: df), rows, read("codes"))
    whole = finish(rows, read("codes"), read("labels"), CONFIG)
    for df in (coded, whole):
        assert df.collect() and df.count() == result.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
