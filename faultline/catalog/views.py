"""Test views over the given tables, written once for both engines.

Every view grows with the tables it reads. The few words the engines spell differently are
marked and filled in per dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.config import Config, TaxonomyRules, ColumnMap

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The settings all registered queries use.
CONFIG = Config(
    columns=ColumnMap(**{name: name for name in vars(ColumnMap())}),
    taxonomy=TaxonomyRules(
        pitch_prefixes=("MDA",), yaw_prefixes=("MDL",), converter_prefixes=("MKY",),
        generator_prefixes=("MKA",), drivetrain_prefixes=("MDX",)),
)

DIALECTS = {
    "spark": {"<EXPLODE_PHASES>": "explode(array('P1', 'P2_RELABEL'))",
              "<JOIN_SORTED>": "array_join(sort_array(collect_list(item)), ',')"},
    "duckdb": {"<EXPLODE_PHASES>": "unnest(['P1', 'P2_RELABEL'])",
               "<JOIN_SORTED>": "array_to_string(list_sort(list(item)), ',')"},
}

VIEWS = {
    # work orders with blanks, padded codes, missing codes and uninformative texts
    "wo": """
SELECT d.doc_id AS row_id,
  concat('WO', lpad(CAST(d.doc_id AS STRING), 8, '0')) AS wo_id,
  CASE WHEN d.doc_id % 23 = 0 THEN NULL
       WHEN d.doc_id % 23 = 1 THEN '  ok '
       WHEN d.doc_id % 5 = 0 THEN concat('Pitch motor replaced, call 0123-456. ', d.text)
       WHEN d.doc_id % 5 = 1 THEN concat('Yaw brake inspected. ', d.text)
       WHEN d.doc_id % 5 = 2 THEN concat('Converter reset. ', d.text)
       ELSE concat('Annual service. ', d.text) END AS descriptions,
  CASE d.doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' Unknown ' WHEN 2 THEN '=G001 MDA10 GP001'
       WHEN 3 THEN '=G001 MDX10' WHEN 4 THEN ' =G001 MDL10  BP001 ' WHEN 5 THEN '=G002 MKY10' ELSE '=G001 MKA10' END AS system_code,
  CASE d.doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Blade Pitch' WHEN 3 THEN 'Drivetrain'
       WHEN 4 THEN 'Yaw' WHEN 5 THEN 'Power Converter' ELSE 'Generator' END AS system_name,
  CASE d.doc_id % 4 WHEN 0 THEN 'Corrective' WHEN 1 THEN 'Preventive' WHEN 2 THEN ' Reset ' ELSE NULL END AS maintenance_type,
  CASE d.doc_id % 3 WHEN 0 THEN 'Replace' WHEN 1 THEN 'Inspect' ELSE NULL END AS action_type,
  d.lang AS manufacturer, d.source AS turbine_model,
  CASE d.doc_id % 2 WHEN 0 THEN 'Geared' ELSE 'Direct' END AS drive_type,
  CASE d.doc_id % 2 WHEN 0 THEN 'DFIG' ELSE 'PMSG' END AS generator_type,
  CASE d.doc_id % 3 WHEN 0 THEN 'Electric' WHEN 1 THEN ' Hydraulic ' ELSE NULL END AS pitch_type,
  CASE d.doc_id % 2 WHEN 0 THEN 'Active' ELSE ' ' END AS yaw_brake_type
FROM documents d""",
    # component codes: unnamed inner nodes, children before parents, repeated codes, padding
    "components": """
SELECT p_partkey AS ord,
  concat(CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE '' END, '=G', lpad(CAST(p_partkey % 3 + 1 AS STRING), 3, '0'),
    CASE WHEN p_partkey % 101 = 7 THEN ''
         ELSE concat(' ', CASE p_partkey % 6 WHEN 0 THEN 'MDA' WHEN 1 THEN 'MDX' WHEN 2 THEN 'MDL' WHEN 3 THEN 'MKY'
                WHEN 4 THEN 'MKA' ELSE upper(substr(p_type, 1, 3)) END, CAST(p_size % 5 * 10 + 10 AS STRING),
              CASE WHEN p_partkey % 37 = 5 THEN '' ELSE concat(' GP', lpad(CAST(p_partkey % 1009 AS STRING), 4, '0')) END,
              CASE WHEN p_partkey % 11 = 3 THEN concat(' ', substr(p_brand, 7)) ELSE '' END) END) AS code,
  p_name AS name
FROM part""",
    # classification answers with five kinds of defect
    "ledger": """
SELECT x.doc_id AS row_id, x.phase AS phase,
  CASE WHEN x.doc_id % 11 = 0 THEN 'not json'
       WHEN x.doc_id % 11 = 1 THEN '{"Suggested_Code":"=G001 MDA10","Reasoning":"r","Confidence_Score":"High","Review_Flag":"true"}'
       WHEN x.doc_id % 11 = 2 THEN '{"Suggested_Code":"=G001 MDA10","Reasoning":"r","Confidence_Score":"Certain","Review_Flag":true}'
       WHEN x.doc_id % 11 = 3 THEN '{"Suggested_Code":"=G001 MDA10","Reasoning":"r","Confidence_Score":"High"}'
       WHEN x.doc_id % 11 = 4 THEN concat('```json', chr(10), '{"Suggested_Code":"Keep Current","Reasoning":"r","Confidence_Score":"High","Review_Flag":false}', chr(10), '```')
       WHEN x.doc_id % 11 = 5 THEN '{"Suggested_Code":"=G001 MDA10","Reasoning":"r","Confidence_Score":"High","Review_Flag":false,"Note":1}'
       WHEN x.doc_id % 11 = 6 THEN '[1, 2]'
       ELSE concat('{"Suggested_Code":"', CASE x.doc_id % 3 WHEN 0 THEN '=G001 MDA10 GP001' WHEN 1 THEN 'Keep Current' ELSE 'Not Enough Information' END,
            '","Reasoning":"r', CAST(x.doc_id AS STRING), '","Confidence_Score":"',
            CASE WHEN l.quality = 1 THEN 'High' WHEN l.quality = 0 THEN 'Low' ELSE 'Medium' END,
            '","Review_Flag":', CASE WHEN l.toxic = 1 THEN 'true' ELSE 'false' END, '}') END AS raw_response
FROM (SELECT doc_id, <EXPLODE_PHASES> AS phase FROM documents) x LEFT JOIN labels l ON x.doc_id = l.doc_id""",
    "audit_ledger": """
SELECT d.doc_id AS row_id,
  CASE WHEN d.doc_id % 17 = 0 THEN 'null'
       WHEN d.doc_id % 17 = 1 THEN '{"Reasoning":7,"Confidence_Score":"Low","Review_Flag":true}'
       ELSE concat('{"Reasoning":"a', CAST(d.doc_id AS STRING), '","Confidence_Score":"',
            CASE WHEN l.quality = 1 THEN 'High' ELSE 'Low' END, '","Review_Flag":',
            CASE WHEN d.doc_id % 4 = 3 THEN 'true' ELSE 'false' END, '}') END AS raw_response
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # failure modes per code and variant: flat, exact, standard-only, single-variant and absent codes
    "dict_long": """
SELECT code, topology, failure_mode, mechanism, cause, symptom, count(*) AS frequency, min(doc_id) AS pos FROM (
  SELECT d.doc_id,
    CASE d.doc_id % 6 WHEN 0 THEN '=G001 MDA10 GP001' WHEN 1 THEN '=G002 MKY10' WHEN 2 THEN '=G001 MDL10  BP001'
         WHEN 3 THEN '=G001 MKA10' WHEN 4 THEN 'Unknown' ELSE '=G001 MDA10 GP001' END AS code,
    CASE d.doc_id % 6 WHEN 0 THEN 'pitch_type: Electric' WHEN 1 THEN 'generator_type: DFIG'
         WHEN 2 THEN CASE WHEN d.doc_id % 4 = 0 THEN 'yaw_brake_type: Active' ELSE 'yaw_brake_type: Passive' END
         WHEN 3 THEN NULL ELSE 'Standard Topology' END AS topology,
    CASE WHEN d.doc_id % 31 = 0 THEN ' ' ELSE concat(' Fault ', d.source, ' ') END AS failure_mode,
    concat('Mechanism ', d.lang) AS mechanism,
    CASE WHEN d.doc_id % 2 = 0 THEN 'Overload' ELSE 'Ageing "slow"' END AS cause,
    CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'Trip' END AS symptom
  FROM documents d) t
GROUP BY code, topology, failure_mode, mechanism, cause, symptom""",
    "dict_actions": """
SELECT code, topology, action, min(doc_id) AS pos FROM (
  SELECT d.doc_id,
    CASE d.doc_id % 6 WHEN 0 THEN '=G001 MDA10 GP001' WHEN 1 THEN '=G002 MKY10' WHEN 2 THEN '=G001 MDL10  BP001'
         WHEN 3 THEN '=G001 MKA10' WHEN 4 THEN 'Unknown' ELSE '=G001 MDA10 GP001' END AS code,
    CASE d.doc_id % 6 WHEN 0 THEN 'pitch_type: Electric' WHEN 1 THEN 'generator_type: DFIG'
         WHEN 2 THEN CASE WHEN d.doc_id % 4 = 0 THEN 'yaw_brake_type: Active' ELSE 'yaw_brake_type: Passive' END
         WHEN 3 THEN NULL ELSE 'Standard Topology' END AS topology,
    CASE WHEN d.doc_id % 29 = 0 THEN ' Other ' ELSE concat('Replace ', d.source, CASE WHEN d.lang = 'de' THEN ' ' ELSE '' END) END AS action
  FROM documents d) t
GROUP BY code, topology, action""",
    # answers of the first P4 call, with an action or a type that is not allowed, bad JSON, a missing key
    "op_ledger": """
SELECT d.doc_id AS row_id,
  CASE WHEN d.doc_id % 13 = 0 THEN 'not json'
       WHEN d.doc_id % 13 = 3 THEN '{"System_Code":"=G001 MDX10","Maintenance_Type":"Reset","Action_Taken":"Other","Reasoning":"r","Confidence_Score":"High"}'
       ELSE concat('{"System_Code":"', CASE d.doc_id % 7 WHEN 3 THEN '=G001 MDX10' WHEN 5 THEN ' =G002 MKY10 ' ELSE '=G001 MKA10' END,
         '","Maintenance_Type":"', CASE WHEN d.doc_id % 13 = 2 THEN 'Weekly' ELSE CASE d.doc_id % 4 WHEN 0 THEN 'Corrective' WHEN 1 THEN 'Preventive' WHEN 2 THEN 'Reset' ELSE 'Retrofit' END END,
         '","Action_Taken":"', CASE WHEN d.doc_id % 13 = 1 THEN 'Polish' ELSE CASE d.doc_id % 3 WHEN 0 THEN 'Other' WHEN 1 THEN 'Not Enough Information' ELSE concat('Replace ', d.source) END END,
         '","Reasoning":"o', CAST(d.doc_id AS STRING), '","Confidence_Score":"',
         CASE WHEN l.quality = 1 THEN 'High' WHEN l.quality = 0 THEN 'Low' ELSE 'Medium' END,
         '","Review_Flag":', CASE WHEN l.toxic = 1 THEN 'true' ELSE 'false' END, '}') END AS raw_response
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # answers of the second P4 call: listed modes, changed ones, escapes, extra or mistyped members
    "sem_ledger": """
SELECT d.doc_id AS row_id,
  concat('{"System_Code":"=G001 MKA10","Failure_Mode_Selection":', CASE d.doc_id % 6
    WHEN 0 THEN '{"Failure_Mode":"Other Novel Failure","Mechanism":"m","Cause":"c","Symptom":"s"}'
    WHEN 1 THEN '{"Failure_Mode":"Not Enough Information","Mechanism":"","Cause":"","Symptom":"","More":1}'
    WHEN 2 THEN '{"Failure_Mode":"Other Novel Failure","Mechanism":"m","Cause":5,"Symptom":"s"}'
    WHEN 3 THEN '"Other Novel Failure"'
    ELSE concat('{"Failure_Mode":"Fault ', d.source, '","Mechanism":"Mechanism ', d.lang, '","Cause":"',
      CASE WHEN d.doc_id % 3 = 0 THEN 'Overload' ELSE 'Ageing \\"slow\\"' END, '","Symptom":"Trip"}') END,
    ',"Reasoning":"s', CAST(d.doc_id AS STRING), '","Confidence_Score":"', CASE d.doc_id % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END,
    '","Review_Flag":', CASE WHEN d.doc_id % 9 = 0 THEN 'true' ELSE 'false' END, '}') AS raw_response
FROM documents d""",
    # extraction answers per group (three pieces for one code), made from the rows of the group
    "batch_ledger": """
SELECT code, topology, piece,
  CASE WHEN code = '=G001 MDX10' THEN concat('{"System_Code":"', code, '","Failure_Modes":[]}')
       WHEN sum(n) % 5 = 0 THEN 'not json'
       ELSE concat('{"System_Code":"', code, '","System_Name":"","Topology":', CASE WHEN topology = 'Standard Topology' THEN 'null' ELSE concat('"', topology, '"') END,
         ',"Total_Logs_Analyzed":', CAST(sum(n) AS STRING), ',"Unclassified_Logs_Count":', CASE WHEN sum(n) % 2 = 0 THEN '0' ELSE '1.5' END,
         ',"Empirical_Actions_Taken":["Inspect","Replace","Inspect"],"Failure_Modes":[', <JOIN_SORTED>,
         '],"Reasoning":"b","Confidence_Score":"High","Review_Flag":false}') END AS raw_response
FROM (
  SELECT code, topology, piece, count(*) AS n,
    concat('{"Failure_Mode":"', CASE WHEN lang = 'de' THEN ' ' ELSE concat(' Fault ', lang) END, '","Mechanism":"Wear","Cause":" ', kind,
           '","Symptom_Effect":"Noise","Frequency_in_Logs":', CAST(count(*) AS STRING), '}') AS item
  FROM (SELECT g.code, g.topology, g.manufacturer AS lang, CAST(CASE WHEN g.code = 'Unknown' THEN g.row_id % 3 ELSE 0 END AS BIGINT) AS piece,
          CASE WHEN g.row_id % 2 = 0 THEN 'Load' ELSE 'Age' END AS kind FROM grouped g) r
  GROUP BY code, topology, piece, lang, kind) i
GROUP BY code, topology, piece""",
    "perf": """
SELECT concat('Phase ', CAST(l_linenumber % 4 + 1 AS STRING)) AS phase, l_orderkey AS batch_id, l_linenumber AS rows_processed,
  CAST(floor(l_quantity * 100) AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice / 100) AS BIGINT) AS output_tokens,
  CAST(floor(l_tax * 100) AS BIGINT) AS seconds FROM lineitem""",
    "attempts": """
SELECT user_id AS call_id, event_id AS attempt, ts, event_type AS error,
  CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'error' END AS status FROM events""",
}


def view_sql(name: str, dialect: str) -> str:
    text = VIEWS[name].strip()
    for word, replacement in DIALECTS[dialect].items():
        text = text.replace(word, replacement)
    # a backslash starts an escape in one engine's string literals only
    return text.replace("\\", "\\\\") if dialect == "spark" else text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **frames: DataFrame) -> DataFrame:
    """A test view; `frames` are other inputs it names besides the given tables."""
    text = VIEWS[name]
    for base in TABLES:
        if f"FROM {base}" in text or f"JOIN {base}" in text:
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    for frame, df in frames.items():
        df.createOrReplaceTempView(frame)
    return spark.sql(view_sql(name, "spark"))
