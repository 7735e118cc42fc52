"""Groups, dictionaries, lookup and options."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from faultline.catalog import sql as S
from faultline.catalog.registry import query
from faultline.catalog.row_queries import wo
from faultline.catalog.views import CONFIG, view
from faultline.config import Limits
from faultline.functions.contract import EXTRACTION, check_response
from faultline.operators import dictionary as D
from faultline.operators import prompts
from faultline.plans import extraction, labels
from faultline.sources import dictionary_json as J
from faultline.sources.scratch import new_folder

c = F.col
SMALL = replace(CONFIG, limits=Limits(batch_chars=100_000))
MODE = "struct<failure_mode:string,mechanism:string,cause:string,symptom:string>"


def grouped(spark, d):
    return labels.with_group(wo(spark, d), CONFIG)


def entries(spark, d):
    """Dictionary entries of the long views, lists in order of first appearance."""
    modes = view(spark, d, "dict_long").select(
        "code", "topology", F.struct("pos", F.struct(*D.TEXT_FIELDS, "frequency").alias("m")).alias("mode"),
        F.lit(None).cast("struct<pos:bigint,a:string>").alias("act"))
    actions = view(spark, d, "dict_actions").select(
        "code", "topology", F.lit(None).cast(modes.schema["mode"].dataType).alias("mode"),
        F.struct("pos", c("action").alias("a")).alias("act"))
    both = modes.unionByName(actions).groupBy("code", "topology").agg(
        F.sort_array(F.collect_list("act")).alias("acts"), F.sort_array(F.collect_list("mode")).alias("ms"))
    return both.select("code", "topology", F.transform("acts", lambda x: x["a"]).alias("actions"),
                       F.transform("ms", lambda x: x["m"]).alias("modes"))


def lines(spark, d):
    return extraction.batch_lines(grouped(spark, d), CONFIG)


_lines = f"(SELECT code, topology, row_id, system_name, '- ' || {S.norm('descriptions')} AS line FROM grouped)"
_sizes = f"""SELECT code, topology, count(*) AS n_rows, CAST(coalesce(sum(length(line) + 1), 0) AS BIGINT) AS n_chars,
  arg_min(system_name, row_id) FILTER (true) AS system_name, greatest(CAST(ceil(coalesce(sum(length(line) + 1), 0) / 100000.0) AS BIGINT), 1) AS n_pieces
  FROM {_lines} GROUP BY code, topology"""
query("group_batches", f"SELECT code, topology, n_rows, n_chars, n_pieces FROM ({_sizes})")(
    lambda s, d: D.group_sizes(lines(s, d), SMALL.limits).select("code", "topology", "n_rows", "n_chars", "n_pieces"))
query("group_head", f"""SELECT code, topology, (SELECT first(x.system_name ORDER BY x.row_id) FROM grouped x WHERE x.code = g.code AND x.topology = g.topology) AS system_name
  FROM (SELECT DISTINCT code, topology FROM grouped) g""")(
    lambda s, d: D.group_sizes(lines(s, d), CONFIG.limits).select("code", "topology", "system_name"))
_pieces = f"""SELECT l.code, l.topology, piece, count(*) AS n_rows, coalesce(string_agg(line, chr(10) ORDER BY row_id), '') AS batch_text
  FROM (SELECT l.*, CASE WHEN n_pieces > 1 THEN CAST('0x' || substr(md5(concat_ws(chr(31), CAST(row_id AS VARCHAR), line)), 1, 8) AS BIGINT) % n_pieces ELSE 0 END AS piece
        FROM {_lines} l JOIN ({_sizes}) s ON l.code = s.code AND l.topology = s.topology) l GROUP BY l.code, l.topology, piece"""
query("batch_text", f"SELECT code, topology, piece, n_rows, md5(batch_text) AS text_md5 FROM ({_pieces})")(
    lambda s, d: D.group_batches(lines(s, d), SMALL.limits).select(
        "code", "topology", "piece", "n_rows", F.md5("batch_text").alias("text_md5")))
_head = "(SELECT code, topology, system_name FROM grouped QUALIFY row_number() OVER (PARTITION BY code, topology ORDER BY row_id) = 1)"
query("prompt_batch", f"""SELECT p.code, p.topology, piece, md5({S.render(prompts.EXTRACT, {
    'system_name': S.unknown('h.system_name'), 'system_code': 'p.code', 'topology_context_block': S.key_block('p.topology'), 'log_batch_text': 'batch_text'})}) AS prompt_md5
  FROM ({_pieces}) p JOIN {_head} h ON p.code = h.code AND p.topology = h.topology""")(
    lambda s, d: extraction.extraction_calls(grouped(s, d), SMALL).select(
        "code", "topology", "piece", F.md5(extraction.extraction_prompt(SMALL)).alias("prompt_md5")))


# ---- extraction results

def built(spark, d):
    answers = check_response(view(spark, d, "batch_ledger", grouped=grouped(spark, d)), EXTRACTION)
    return D.build_dictionary(answers.where("status = 'ok'").select("code", "topology", "piece", "answer"))


def mode_rows(df):
    return df.select("code", "topology", F.posexplode("modes").alias("pos", "m")).select(
        "code", "topology", c("pos").cast("bigint").alias("pos"), "m.*")


_BATCH = S.checked("batch_ledger", S.EXTRACTION, "code, topology, piece")
_ITEMS = f"""SELECT code, topology, piece, n, pos, {S.strip("json_extract_string(x, '$.Failure_Mode')")} AS failure_mode, {S.strip("json_extract_string(x, '$.Mechanism')")} AS mechanism,
   {S.strip("json_extract_string(x, '$.Cause')")} AS cause, {S.strip("json_extract_string(x, '$.Symptom_Effect')")} AS symptom, CAST(json_extract(x, '$.Frequency_in_Logs') AS BIGINT) AS frequency
  FROM (SELECT code, topology, piece, count(*) OVER (PARTITION BY code, topology) AS n, unnest(range(len(json_extract(j, '$.Failure_Modes[*]')))) AS pos, unnest(json_extract(j, '$.Failure_Modes[*]')) AS x
        FROM ({_BATCH}) WHERE status = 'ok')"""
_BUILT = f"""SELECT code, topology, row_number() OVER (PARTITION BY code, topology ORDER BY place) - 1 AS pos, failure_mode, mechanism, cause, symptom, frequency FROM (
  SELECT code, topology, min([piece, pos]) AS place, failure_mode, mechanism, cause, symptom, CAST(sum(frequency) AS BIGINT) AS frequency FROM ({_ITEMS})
  WHERE failure_mode <> '' GROUP BY code, topology, failure_mode, mechanism, cause, symptom)"""
query("build_dictionary", _BUILT)(lambda s, d: mode_rows(built(s, d)))
query("long_dictionary", f"""SELECT code, topology, place[1] AS piece, failure_mode, mechanism, cause, symptom, frequency FROM (
  SELECT code, topology, min([piece, pos]) AS place, failure_mode, mechanism, cause, symptom, CAST(sum(frequency) AS BIGINT) AS frequency FROM ({_ITEMS})
  WHERE failure_mode <> '' GROUP BY code, topology, failure_mode, mechanism, cause, symptom)""")(
    lambda s, d: D.long_dictionary(check_response(view(s, d, "batch_ledger", grouped=grouped(s, d)), EXTRACTION).where("status = 'ok'").select(
        "code", "topology", "piece", "answer")).where("failure_mode IS NOT NULL").select(
        "code", "topology", "piece", *D.TEXT_FIELDS, "frequency"))
query("phase3", f"""SELECT code, topology, (SELECT string_agg(x, '|' ORDER BY place) FROM (SELECT x, min([piece, pos]) AS place FROM (SELECT a.piece, unnest(range(len(json_extract_string(a.j, '$.Empirical_Actions_Taken[*]')))) AS pos, unnest(json_extract_string(a.j, '$.Empirical_Actions_Taken[*]')) AS x FROM (SELECT * FROM ({_BATCH}) WHERE status = 'ok') a WHERE a.code = t.code AND a.topology = t.topology) GROUP BY x)) AS actions,
  (SELECT count(*) FROM ({_BUILT}) b WHERE b.code = t.code AND b.topology = t.topology) AS n_modes,
  (SELECT CAST(sum(frequency) AS BIGINT) FROM ({_BUILT}) b WHERE b.code = t.code AND b.topology = t.topology) AS n_logs
  FROM ({_BATCH}) t WHERE status = 'ok' GROUP BY code, topology""")(
    lambda s, d: built(s, d).select(
        "code", "topology", F.array_join("actions", "|").alias("actions"), F.size("modes").cast("bigint").alias("n_modes"),
        F.aggregate("modes", F.lit(None).cast("bigint"), lambda a, m: F.coalesce(a, F.lit(0)) + m["frequency"]).alias("n_logs")))
query("mode_frequency", "SELECT code, topology, failure_mode, CAST(sum(frequency) AS BIGINT) AS frequency FROM dict_long GROUP BY code, topology, failure_mode")(
    lambda s, d: D.mode_frequency(entries(s, d)))


# ---- JSON form, through files

def written(spark, d):
    folder = new_folder(spark, "dictionary")
    J.write_dictionary(entries(spark, d), folder)
    return folder


_LONG = f"""SELECT code, topology, row_number() OVER (PARTITION BY code, topology ORDER BY pos) - 1 AS pos, {S.strip('failure_mode')} AS failure_mode, {S.strip('mechanism')} AS mechanism,
  {S.strip('cause')} AS cause, {S.strip('symptom')} AS symptom, frequency FROM dict_long WHERE {S.norm('failure_mode')} IS NOT NULL"""
query("read_dictionary", _LONG)(
    lambda s, d: mode_rows(J.read_dictionary(s, written(s, d), per_line=True)))
_JSON_ENTRY = """CAST(to_json({'Actions': coalesce(acts, []), 'Failure_Modes': ms}) AS VARCHAR)"""
query("write_dictionary", f"""SELECT code, '{{' || CAST(to_json(code) AS VARCHAR) || ':' || CASE WHEN bool_or(topology IS NULL) THEN any_value(entry)
    ELSE '{{' || string_agg(CAST(to_json(topology) AS VARCHAR) || ':' || entry, ',' ORDER BY topology) || '}}' END || '}}' AS json FROM (
  SELECT m.code, m.topology, {_JSON_ENTRY} AS entry FROM (SELECT code, topology, list({{'Failure_Mode': failure_mode, 'Mechanism': mechanism, 'Cause': cause, 'Symptom': symptom, 'Frequency_in_Logs': frequency}} ORDER BY pos) AS ms
    FROM dict_long GROUP BY code, topology) m JOIN (SELECT code, topology, list(action ORDER BY pos) AS acts FROM dict_actions GROUP BY code, topology) a
    ON a.code = m.code AND a.topology IS NOT DISTINCT FROM m.topology) GROUP BY code""")(
    lambda s, d: s.read.text(written(s, d)).select(F.get(F.map_keys(F.try_variant_get(
        F.parse_json("value"), "$", "map<string,variant>")), F.lit(0)).alias("code"), c("value").alias("json")))
query("clean_modes", _LONG)(
    lambda s, d: mode_rows(entries(s, d).withColumn("modes", F.filter(
        F.transform("modes", lambda m: F.struct(*[F.get(D.clean_modes(F.array(m)), F.lit(0))[f].alias(f) for f in D.TEXT_FIELDS], m["frequency"].alias("frequency"))),
        lambda m: m["failure_mode"].isNotNull()))))
query("action_options", "SELECT code, topology, array_to_string(actions, '|') AS options FROM actions_of")(
    lambda s, d: entries(s, d).select("code", "topology", F.array_join(
        D.action_options(c("actions"), CONFIG.rules.action_escapes), "|").alias("options")))
query("mode_options", "SELECT code, topology, row_number() OVER (PARTITION BY code, topology ORDER BY pos) - 1 AS pos, m.Failure_Mode AS failure_mode, m.Mechanism AS mechanism, m.Cause AS cause, m.Symptom AS symptom FROM ("
      "SELECT code, topology, unnest(range(len(modes))) AS pos, unnest(modes) AS m FROM modes_of)")(
    lambda s, d: mode_rows(entries(s, d).withColumn("modes", D.mode_options(c("modes")))))


# ---- lookup

query("dictionary_lookup", "SELECT g.row_id, l.found, l.entry_topology FROM grouped g JOIN lookup l ON g.code = l.code AND g.topology = l.topology")(
    lambda s, d: grouped(s, d).join(
        D.lookup_entries(grouped(s, d).select("code", "topology").distinct(), entries(s, d)), ["code", "topology"]).select(
        "row_id", "found", "entry_topology"))
