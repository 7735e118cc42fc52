"""Sources, key merges, dictionaries and label merges."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.config import ColumnMap, Config, Gate, Limits, Pricing, Rules
from faultline.errors import DataError
from faultline.operators import dictionary as D
from faultline.operators import merge, metrics, prompts
from faultline.operators.joins import merge_tables
from faultline.plans import extraction
from faultline.sources import dictionary_json as J
from faultline.sources import tables


# ---- sources

def test_csv_edges(spark, tmp_path):
    path = tmp_path / "wo.csv"
    path.write_text('WO_ID,Descriptions,System_Code\n001,"two\nlines, ""quoted""",NA\n2,null,=G1\n3, x ,n/a\n')
    df = tables.load_work_orders(spark, str(path), ["WO_ID", "Descriptions"])
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == [
        ("001", 'two\nlines, "quoted"', None), ("2", None, "=G1"), ("3", " x ", None)]
    with pytest.raises(DataError, match="2 required columns: A, B"):
        tables.load_work_orders(spark, str(path), ["A", "WO_ID", "B"])
    mapped = tables.map_columns(df, ColumnMap())
    assert mapped.columns[:3] == ["row_id", "wo_id", "system_code"]
    extra = tables.map_columns(df.withColumn("Site", F.lit("north")), ColumnMap(pitch_type="P"))
    assert extra.columns[-1] == "Site"
    assert tables.user_columns(extra, ColumnMap(pitch_type="P")).columns[:2] == ["WO_ID", "System_Code"]
    assert mapped.where("pitch_type is not null").isEmpty()
    with pytest.raises(DataError, match="Descriptions"):
        tables.map_columns(df.drop("Descriptions"), ColumnMap())
    assert ColumnMap().specification() == [
        "Manufacturer", "Turbine_Model", "Drive_Type", "Generator_Type", "Pitch_Type", "Yaw_Brake_Type"]


def test_folders_are_known_by_their_files(spark, tmp_path):
    spark.createDataFrame([("1", "x")], "WO_ID string, Descriptions string").write.parquet(str(tmp_path / "orders"))
    assert [r.WO_ID for r in tables.load_work_orders(spark, str(tmp_path / "orders")).collect()] == ["1"]
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.csv").write_text("WO_ID,Descriptions\n007,y\n")
    assert [r.WO_ID for r in tables.load_work_orders(spark, str(tmp_path / "odd")).collect()] == ["007"]
    assert tables.load_work_orders(spark, str(tmp_path / "odd"), fmt="csv").count() == 1


def test_taxonomy_order_follows_files_and_rows(spark, tmp_path):
    folder = tmp_path / "tax"
    folder.mkdir()
    (folder / "part-0.csv").write_text("Code,Name\n=A,first\n")
    (folder / "part-1.csv").write_text("Code,Name\n" + "".join(f"=B{i},n{i}\n" for i in range(500)))
    got = [r.code for r in tables.load_taxonomy(spark, str(folder)).orderBy("ord").collect()]
    assert got == ["=A"] + [f"=B{i}" for i in range(500)]


def test_own_names_of_the_user_come_back(spark):
    df = spark.createDataFrame([("1", "text", "mine", 7, "b")], "WO_ID string, Long_Text string, descriptions string, row_id long, Branch string")
    columns = ColumnMap(descriptions="Long_Text")
    mapped = tables.map_columns(df, columns)
    assert mapped.first().descriptions == "text"
    back = tables.user_columns(mapped, columns).first()
    assert (back.Long_Text, back.descriptions, back.row_id, back.Branch) == ("text", "mine", 7, "b")


def test_csv_export_overwrites(spark, tmp_path):
    df = spark.createDataFrame([("1", "Pass")], "WO_ID string, QA_Status string")
    for _ in range(2):
        tables.export_final(df, str(tmp_path / "out"), fmt="csv")
    assert tables.load_work_orders(spark, str(tmp_path / "out")).count() == 1


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(DataError):
        tables.load_work_orders(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(DataError):
        tables.load_work_orders(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "tax.csv").write_text("Code,Name\n")
    with pytest.raises(DataError, match="no taxonomy rows"):
        tables.load_taxonomy(spark, str(tmp_path / "tax.csv"))
    (tmp_path / "tax2.csv").write_text("Code,Title\na,b\n")
    with pytest.raises(DataError, match="Name"):
        tables.load_taxonomy(spark, str(tmp_path / "tax2.csv"))


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\n c', "Pass"), ("2", " lead", "Low")], "WO_ID string, t string, QA_Status string")
    tables.export_final(df, str(tmp_path / "out"), "csv")
    assert sorted(tables.load_work_orders(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())
    tables.export_final(df, str(tmp_path / "parts"), by_status=True)
    assert spark.read.parquet(str(tmp_path / "parts")).where("QA_Status = 'Pass'").count() == 1


# ---- key merge

@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
def test_merge_like_a_data_frame(spark, how):
    left = pd.DataFrame({"k": ["a", "a", None, "b", "z"], "v": [1, 2, 3, 4, 5], "l": list("pqrst")})
    right = pd.DataFrame({"k": ["a", None, None, "c", "a"], "v": [6, 7, 8, 9, 10]})
    got = merge_tables(spark.createDataFrame(left), spark.createDataFrame(right), "k", how).toPandas()
    want = left.merge(right, on="k", how=how)
    assert list(got.columns) == list(want.columns)

    def rows(df):
        return sorted(repr(tuple(None if pd.isna(v) else str(v).removesuffix(".0") for v in r))
                      for r in df.itertuples(index=False))

    assert rows(got) == rows(want)


def test_merge_needs_the_key(spark):
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(DataError, match="secondary"):
        merge_tables(df, df.withColumnRenamed("k", "x"), "k")
    with pytest.raises(DataError, match="primary"):
        merge_tables(df.withColumnRenamed("k", "x"), df, "k")


# ---- dictionaries

DOC = {
    "A": {"Actions": ["x"], "Failure_Modes": ["Bare ", "", {"Failure_Mode": " M ", "Symptom_Effect": "e", "Cause": "c"}]},
    "B": {"t1": {"Actions": ["y", "y"], "Failure_Modes": [{"Failure_Mode": "F", "Mechanism": "m", "Cause": "c", "Symptom": "s", "Frequency_in_Logs": 3}]},
          "Standard Topology": {"Actions": []}},
    "C": {"only": {"Failure_Modes": []}},
    "D": "not a dictionary",
}


def test_read_dictionary_shapes(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(DOC, indent=4))
    got = {(r.code, r.topology): r for r in J.read_dictionary(spark, str(path)).collect()}
    assert set(got) == {("A", None), ("B", "t1"), ("B", "Standard Topology"), ("C", "only")}
    assert [tuple(m) for m in got["A", None].modes] == [
        ("Bare", "Not Enough Information", "Not Enough Information", "Not Enough Information", None),
        ("M", "", "c", "e", None)]
    assert got["B", "t1"].actions == ["y", "y"] and got["B", "t1"].modes[0].frequency == 3
    entries = J.read_dictionary(spark, str(path))
    J.write_dictionary(entries, str(tmp_path / "out"))
    again = J.read_dictionary(spark, str(tmp_path / "out"), per_line=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, entries.collect()))


def test_lookup_outcomes(spark, tmp_path):
    entries = spark.createDataFrame(
        [("A", None, [], []), ("B", "t1", [], []), ("B", "Standard Topology", [], []), ("C", "only", [], []),
         ("E", "p", [], []), ("E", "q", [], [])], D.ENTRY_SCHEMA)
    pairs = spark.createDataFrame(
        [("A", "t9"), ("B", "t1"), ("B", "t9"), ("C", "t9"), ("E", "t9"), ("Z", "t1")], "code string, topology string")
    got = {(r.code, r.topology): (r.found, r.entry_topology) for r in D.lookup_entries(pairs, entries).collect()}
    assert got == {("A", "t9"): (True, None), ("B", "t1"): (True, "t1"), ("B", "t9"): (True, "Standard Topology"),
                   ("C", "t9"): (True, "only"), ("E", "t9"): (False, None), ("Z", "t1"): (False, None)}


def lines(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("code"), F.lit("Standard Topology").alias("topology"),
        F.col("id").alias("row_id"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("system_name"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("- line "), F.col("id").cast("string"))).alias("line")
    ).withColumn("n_chars", D.line_chars(F.col("line")))


def test_group_text_is_whole_and_in_order(spark):
    got = {r.code: r for r in D.group_batches(lines(spark, 50), Limits()).collect()}
    for code, keep in (("hot", lambda i: i % 3 < 2), ("cold", lambda i: i % 3 == 2)):
        assert got[code].batch_text == "\n".join(f"- line {i}" for i in range(50) if keep(i) and i % 7)
    assert got["hot"].system_name == "name 0" and got["cold"].n_rows == 16


def test_hot_group_is_split_without_losing_a_line(spark):
    pieces = D.group_batches(lines(spark, 3000), Limits(batch_chars=2000)).where("code = 'hot'").collect()
    assert len(pieces) > 5 and max(len(p.batch_text) for p in pieces) < 4000
    found = [line for p in pieces for line in p.batch_text.split("\n")]
    assert sorted(found) == sorted(f"- line {i}" for i in range(3000) if i % 3 < 2 and i % 7)
    for p in pieces:
        numbers = [int(line.rsplit(" ", 1)[1]) for line in p.batch_text.split("\n")]
        assert numbers == sorted(numbers)


def answer(modes, actions):
    return json.dumps({"Empirical_Actions_Taken": actions, "Failure_Modes": [
        {"Failure_Mode": m, "Mechanism": "", "Cause": "c ", "Symptom_Effect": "s", "Frequency_in_Logs": n} for m, n in modes]})


def test_one_rule_merges_any_number_of_pieces(spark):
    df = spark.createDataFrame([
        ("one", "t", 0, answer([("A", 1), (" ", 9), ("A", 2)], ["x", "x"])),
        ("two", "t", 0, answer([("A", 1), ("B", 1)], ["x"])), ("two", "t", 1, answer([("C", 4), ("A", 5)], ["y", "x"])),
        ("none", "t", 0, answer([], []))], "code string, topology string, piece long, raw string")
    got = {r.code: r for r in D.build_dictionary(df.withColumn("answer", F.parse_json("raw"))).collect()}
    assert [(m.failure_mode, m.cause, m.frequency) for m in got["one"].modes] == [("A", "c", 3)]
    assert got["one"].actions == ["x"]
    assert [(m.failure_mode, m.frequency) for m in got["two"].modes] == [("A", 6), ("B", 1), ("C", 4)]
    assert got["two"].actions == ["x", "y"]
    assert got["none"].modes == [] and got["none"].actions == []


def test_a_failed_piece_withholds_the_group(spark):
    calls = spark.createDataFrame([("a", "t", 0, 2, "k0"), ("a", "t", 1, 2, "k1"), ("b", "t", 0, 1, "k2")],
                                  "code string, topology string, piece long, n_pieces long, call_id string")
    good = answer([("A", 1)], ["x"])
    answers = spark.createDataFrame([("k0", "ok", good), ("k1", "invalid", None), ("k2", "ok", good)],
                                    "call_id string, status string, raw string").withColumn("answer", F.try_parse_json("raw"))
    assert [r.code for r in extraction.dictionary_from_answers(calls, answers).collect()] == ["b"]


def test_copies_and_missing_numbers_are_spread(spark):
    alike = spark.range(1000).select(
        F.lit("c").alias("code"), F.lit("t").alias("topology"), F.lit(None).cast("string").alias("row_id"), F.lit("n").alias("system_name"),
        F.lit("- the same").alias("line")).withColumn("n_chars", D.line_chars(F.col("line")))
    other = alike.limit(1).drop("line").crossJoin(spark.range(1000).select(F.concat(F.lit("- x"), "id").alias("line"))).select(*alike.columns)
    pieces = D.group_batches(alike.unionByName(other), Limits(batch_chars=2000)).collect()
    assert sum(p.n_rows for p in pieces) == 2000 and len(pieces) == pieces[0].n_pieces
    assert max(p.n_rows for p in pieces) < 2 * 2000 / len(pieces) + 20
    assert sum(p.batch_text.split("\n").count("- the same") for p in pieces) == 1000


def test_repeated_entries_do_not_multiply_rows(spark):
    mode = [("A", "", "", "", 1)]
    entries = spark.createDataFrame([("c", "t", ["x"], mode), ("c", "t", ["x", "y"], mode), ("d", None, ["z"], [])], D.ENTRY_SCHEMA)
    rows = spark.createDataFrame([(1, "c", "t"), (2, "c", "t"), (3, "d", "t")], "row_id int, code string, topology string")
    assert D.attach_entry(rows, entries, ["actions"], Limits()).count() == 3
    once = {r.code: r for r in D.one_per_key(entries).collect()}
    assert once["c"].actions == ["x", "y"] and once["c"].modes[0].frequency == 2 and once["d"].topology is None


def test_options(spark):
    one = spark.createDataFrame([(1,)], "i int")

    def value(c):
        return one.select(c).first()[0]

    assert value(D.action_options(F.array(F.lit(" a"), F.lit("a"), F.lit("")), ["Other", "a"])) == ["a", "Other"]
    assert value(D.action_options(F.lit(None).cast("array<string>"), [])) == ["Other", "Not Enough Information"]
    modes = F.lit(None).cast(f"array<{D.MODE_TYPE}>")
    assert value(D.mode_list_text(D.mode_options(modes), D.escape_modes([]))) == "Other Novel Failure, Not Enough Information"


# ---- prompts

def test_render_is_one_pass(spark):
    row = spark.createDataFrame([("{b} {", None)], "a string, b string")
    text = prompts.render("{a}|{b}|{{x}}|{a}", {"a": F.col("a"), "b": F.col("b")})
    assert row.select(text).first()[0] == "{b} {||{x}|{b} {"
    with pytest.raises(ValueError, match="c"):
        prompts.render("{c}", {})


# ---- merges

def code_rows(spark, rows):
    return spark.createDataFrame(rows, (
        "system_code string, P1_Audit_Exempt boolean, P1_System_Code string, P1_Confidence string, P1_Review_Flag string, "
        "P2_Relabel_System_Code string, P2_Relabel_Confidence string, P2_Relabel_Review_Flag string"))


def test_code_merge_priority(spark):
    rows = code_rows(spark, [
        (" L ", True, "P1", "High", "false", "P2", "High", "false"),
        ("L", True, "P1", "Low", "false", "P2", "High", None),
        ("L", True, "P1", "High", "yes", "P2", "Medium", None),
        ("L", False, "P1", "High", None, None, None, None),
        ("L", True, "Keep Current", "High", None, None, None, None),
        (None, False, None, None, None, None, None, None),
        (None, True, "P1 ", "High", None, None, None, None)])
    got = merge.merge_codes(rows, Gate()).select("Merged_System_Code", "System_Code_Corrected_Flag").collect()
    assert [tuple(r) for r in got] == [
        ("P1", True), ("P2", True), ("L", False), ("P1", True), ("L", False), (None, False), ("P1", True)]


def label_rows(spark, rows):
    return spark.createDataFrame([(*r, "m", "x", "c", "s") for r in rows], (
        "maintenance_type string, action_type string, P4_Maintenance_Type string, P4_Action_Taken string, "
        "P4_Operational_Confidence string, P4_Operational_Review_Flag string, P4_Semantic_Confidence string, "
        "P4_Semantic_Review_Flag string, P4_Failure_Mode string, P4_Mechanism string, P4_Cause string, P4_Symptom string"))


def test_label_merge(spark):
    rows = label_rows(spark, [
        (" Reset ", None, "Reset", "Replace", "High", None, "High", None),
        ("Reset", "a", None, " ", "High", None, "Low", None),
        ("Reset", "a", "Other", "b", "Medium", None, None, None)])
    rules = Rules(action_gate=Gate("Medium"))
    got = merge.merge_labels(rows, rules).select(
        "Merged_Maintenance_Type", "Maintenance_Type_Corrected_Flag", "Merged_Action_Taken", "Action_Taken_Corrected_Flag").collect()
    assert [tuple(r) for r in got] == [
        ("Reset", False, "Replace", True), (None, False, " ", False), ("Reset", False, "b", True)]
    plain = merge.merge_failures(rows, rules).select("Merged_Failure_Mode").collect()
    assert [r[0] for r in plain] == ["m", "m", "m"]
    gated = merge.merge_failures(rows, Rules(enforce_mode_gate=True)).select("Merged_Cause").collect()
    assert [r[0] for r in gated] == ["c", None, None]


def test_label_merge_keeps_an_earlier_legacy_copy(spark):
    rows = label_rows(spark, [("now", "a", "x", "y", "Low", None, None, None)]).withColumns(
        {"Legacy_Maintenance_Type": F.lit("before"), "Legacy_Action_Taken": F.lit(None).cast("string")})
    got = merge.merge_labels(rows, Rules()).first()
    assert (got.Legacy_Maintenance_Type, got.Legacy_Action_Taken) == ("before", "a")


@pytest.mark.parametrize("gate, expected", [
    (Gate(), ["Pass", "Requires Human Review (Flagged by Model)", "Requires Human Review (Low Confidence)", "Requires Human Review (Low Confidence)"]),
    (Gate("Low", True), ["Pass", "Pass", "Pass", "Requires Human Review (Low Confidence)"]),
])
def test_qa_status(spark, gate, expected):
    rows = spark.createDataFrame([("High", "0"), ("High", "true"), ("Medium", "true"), (None, None)],
                                 "P4_Confidence string, P4_Review_Flag string")
    assert [r.QA_Status for r in merge.with_qa_status(rows, gate).collect()] == expected


def test_cost_and_totals(spark):
    calls = spark.createDataFrame([("P1", "b", 1, 1, 1, 0.004), ("P1", "b", 1, 2, 0, 0.004), ("P2", "c", 3, 10, 0, 60.0)],
                                  "phase string, batch_id string, rows_processed int, input_tokens long, output_tokens long, seconds double")
    got = metrics.call_metrics(calls, Pricing())
    first = got.where("phase = 'P1'").first()
    # 3 x 2.50 + 15.00 USD per million: an exact tie at six places, rounded half up
    assert (first.rows_processed, str(first.cost_usd), first.seconds) == (2, "0.000023", 0.01)
    totals = metrics.run_totals(got).first()
    assert (totals.rows_processed, totals.input_tokens, round(totals.minutes, 4)) == (5, 13, 1.0002)


def test_config_defaults():
    assert Config().rules.max_attempts == 2 and Config().taxonomy.pitch_keywords == ("pitch", "pich", "ptch")


def test_a_key_of_100_000_modes_is_checked_by_a_join(spark):
    """Nothing on the check side is a list, whatever a key holds; answers stay as many as they are."""
    from faultline.operators.dictionary import LONG_SCHEMA, allowed_values, long_lists
    from faultline.plans.labels import check_semantic, no_entry_key
    n = 100_000
    lists = spark.range(2).crossJoin(spark.range(n).select(F.col("id").alias("m"))).select(
        F.lit("MDA10").alias("code"), F.lit(None).cast("string").alias("topology"), F.col("id").alias("piece"),
        F.array(F.lit("Replaced")).alias("actions"), F.array(F.struct(
            F.concat(F.lit("mode "), "m").alias("failure_mode"), F.lit("m").alias("mechanism"), F.lit("c").alias("cause"),
            F.lit("s").alias("symptom"), F.lit(1).cast("bigint").alias("frequency"))).alias("modes"))
    long = long_lists(lists)
    assert long.schema.simpleString() == spark.createDataFrame([], LONG_SCHEMA).schema.simpleString()
    assert long.where("failure_mode IS NOT NULL").agg(F.count("*"), F.sum("frequency")).first()[:] == (n, 2 * n)
    keys = spark.createDataFrame([("MDA10", None, "k1")], "code string, topology string, options_key string")
    rules = Rules()
    options = allowed_values(long, keys, rules, no_entry_key(rules))
    assert all(t == "string" for _, t in options.dtypes)
    answer = ('{"System_Code": "MDA10", "Failure_Mode_Selection": {"Failure_Mode": "%s", "Mechanism": "m", "Cause": "c", "Symptom": "%s"}, '
              '"Reasoning": "r", "Confidence_Score": "High", "Review_Flag": false}')
    said = [("k1", answer % ("mode 99999", "s")), ("k1", answer % ("mode 99999", "other")), ("k1", answer % ("mode 100000", "s")),
            ("k2", answer % ("mode 1", "s")), ("k1", answer % ("Other Novel Failure", "s")), ("k1", answer % ("mode 7", "s"))]
    got = check_semantic(spark.createDataFrame(said, "options_key string, raw_response string").withColumn(
        "n", F.monotonically_increasing_id()), options, rules)
    assert [r.status for r in got.orderBy("n").collect()] == ["ok", "invalid", "invalid", "invalid", "ok", "ok"]


@pytest.mark.parametrize("split", [97, 400, 5000, 1 << 27])
def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, split):
    """Quoted line breaks, quotes, commas and long fields over many splits give what the one-task reader gives, in order."""
    import random

    from faultline.sources.csv_records import PLACE, read_csv
    rng = random.Random(1)
    values = ["plain", "a, b", 'say "x"', "two\nlines", "", '"', "\n", "end\n", "é日", " sp ", "x\n\n\ny" * 30]
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') or rng.random() < 0.3 else v
    lines = ['Id,Text,"K\nx"'] + [",".join(map(quoted, (str(i), rng.choice(values), rng.choice(["k", "", "z,\n"])))) for i in range(300)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "a.csv")
    want = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    keys = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        tasks = spark.read.text(path).select(F.spark_partition_id()).distinct().count()
        got = read_csv(spark, path)
        rows = [tuple(r)[3:] for r in sorted(got.collect(), key=lambda r: tuple(r)[:3])]
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert got.columns == [*PLACE, *want.columns] and rows == [tuple(r) for r in want.collect()]
    assert tasks > 1 or split > 5000


def test_csv_folders_with_windows_line_ends_and_names_in_paths(spark, tmp_path):
    for day, text in (("1", '\ufeffId,T\r\n1,"a\r\nb"\r\n\r\n2,c\r\n'), ("2", "Id,T\n3,d"), ("3", "Id,T\n")):
        (tmp_path / "x" / f"day={day}").mkdir(parents=True)
        (tmp_path / "x" / f"day={day}" / "f.csv").write_bytes(text.encode())
    got = tables.load_work_orders(spark, str(tmp_path / "x"))
    assert got.columns == ["Id", "T", "day"]
    rows = sorted((r.Id, r["T"].replace("\r\n", "\n"), str(r.day)) for r in got.collect())
    assert rows == [("1", "a\nb", "1"), ("2", "c", "1"), ("3", "d", "2")]


def test_group_texts_follow_the_order_of_files(spark, tmp_path):
    """Number 10 after 2: rows are numbered by file, split and row, in CSV and in Parquet."""
    for name, ids in (("a", range(1, 12)), ("b", range(12, 30))):
        (tmp_path / f"{name}.csv").write_text("WO,Text\n" + "".join(f'{i},"line\n{i}"\n' for i in ids))
    csv = tables.load_work_orders(spark, f"{tmp_path}/*.csv", numbered=True)
    assert [r.WO for r in csv.orderBy("row_id").collect()] == [str(i) for i in range(1, 30)]
    assert [r.row_id for r in csv.orderBy("row_id").collect()] == list(range(29))
    csv.orderBy("row_id").drop("row_id").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    parquet = tables.load_work_orders(spark, str(tmp_path / "p.parquet"), numbered=True)
    assert [r.WO for r in parquet.orderBy("row_id").collect()] == [str(i) for i in range(1, 30)]
    lines = parquet.select(F.lit("c").alias("code"), F.lit("t").alias("topology"), "row_id", F.lit("s").alias("system_name"),
                           F.concat(F.lit("- "), "WO").alias("line"), F.lit(5).cast("long").alias("n_chars"))
    assert D.group_batches(lines, Limits()).first().batch_text == "\n".join(f"- {i}" for i in range(1, 30))
    with pytest.raises(DataError, match="row_id"):
        (tmp_path / "own.csv").write_text("row_id,T\n1,x\n")
        tables.load_work_orders(spark, str(tmp_path / "own.csv"), numbered=True)
