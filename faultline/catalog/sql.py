"""The registered queries' reference results in DuckDB SQL: shared fragments and CTEs."""

from __future__ import annotations

import re

from faultline.catalog.views import VIEWS, view_sql
from faultline.functions.text import WHITESPACE

_WS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(WHITESPACE)})"


def norm(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def unknown(x: str) -> str:
    return f"coalesce({norm(x)}, 'Unknown')"


def active(merged: str, legacy: str) -> str:
    return f"coalesce({norm(merged)}, {norm(legacy)})"


def tokens(x: str) -> str:
    return f"regexp_split_to_array({norm(x)}, '[{_WS}]+')"


def prefix(x: str) -> str:
    return f"coalesce({tokens(x)}[2], {tokens(x)}[1])"


def starts(x: str, prefixes) -> str:
    return "coalesce(" + (" OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) or "false") + ", false)"


def prefix_match(code: str, prefixes) -> str:
    return f"({starts(prefix(code), prefixes)} OR {starts(norm(code), prefixes)})"


def contains(x: str, words) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({x}), {q(w)})" for w in words) + ", false)"


def mentions(x: str, words=("pitch", "pich", "ptch")) -> str:
    pattern = r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + ")"
    return f"coalesce(regexp_matches({x}, {q(pattern)}, 'i'), false)"


def missing_code(x: str) -> str:
    return f"({x} IS NULL OR lower({strip(x)}) IN ('', 'nan', 'none', 'unknown'))"


def unusable(x: str) -> str:
    return f"({norm(x)} IS NULL OR lower({strip(x)}) IN ('not enough information', 'keep current'))"


def flag(x: str) -> str:
    return (f"coalesce(lower({strip(f'CAST({x} AS VARCHAR)')}) NOT IN "
            "('false', '0', 'no', 'n', '', 'nan', 'none'), false)")


def score(x: str) -> str:
    return f"CASE {x} WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"


def gate(conf: str, review: str, required: int = 3, allow: bool = False) -> str:
    ok = f"({score(conf)}) >= {required}"
    return f"({ok})" if allow else f"({ok} AND NOT {flag(review)})"


_FAMILIES = (
    (("MDA",), ("pitch",), "pitch_type"), (("MDL",), ("yaw brake", "yaw"), "yaw_brake_type"),
    (("MKY",), ("converter", "inverter"), "generator_type"), (("MKA",), ("generator",), "generator_type"),
    (("MDX",), ("drive train", "drivetrain", "drive-train"), "drive_type"),
)


def topo_column(code: str, name: str, description: str | None = None) -> str:
    cases = []
    for prefixes, words, column in _FAMILIES:
        tests = [prefix_match(code, prefixes), contains(name, words)]
        if description:
            tests.append(contains(description, words))
        cases.append(f"WHEN {' OR '.join(tests)} THEN {q(column)}")
    return "CASE " + " ".join(cases) + " END"


def topo_value(spec: str) -> str:
    columns = ("pitch_type", "yaw_brake_type", "generator_type", "drive_type")
    return f"CASE {spec} " + " ".join(f"WHEN {q(c)} THEN {norm(c)}" for c in columns) + " END"


def topo_context(spec: str) -> str:
    return f"{spec} || ': ' || {topo_value(spec)}"


def block(context: str) -> str:
    return f"coalesce('Topology Context: ' || ({context}) || chr(10), '')"


def key_block(key: str) -> str:
    return f"CASE WHEN {key} <> 'Standard Topology' THEN 'Topology Context: ' || {key} || chr(10) ELSE '' END"


def unfence(x: str) -> str:
    inner = strip(f"trim({strip(x)}, '`')")
    return (f"CASE WHEN starts_with({strip(x)}, '```') THEN CASE WHEN starts_with({inner}, 'json') "
            f"THEN {strip(f'substr({inner}, 5)')} ELSE {inner} END ELSE {strip(x)} END")


def uninformative(x: str) -> str:
    return f"length({strip(f"coalesce({x}, '')")}) < 5"


def render(template: str, fields: dict[str, str]) -> str:
    """The template as a chain of literals and values."""
    out, last = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if template[last:m.start()]:
            out.append(q(template[last:m.start()]))
        out.append(f"coalesce({fields[m.group(1)]}, '')")
        last = m.end()
    if template[last:]:
        out.append(q(template[last:]))
    return " || ".join(out)


QA_KEYS = (("Reasoning", "string", ()), ("Confidence_Score", "string", ("High", "Medium", "Low")),
           ("Review_Flag", "boolean", ()))


def _problem(key: str, kind: str, allowed, j: str) -> list[str]:
    t = f"json_type({j}, '$.{key}')"
    good = {
        "string": f"{t} = 'VARCHAR'", "boolean": f"{t} = 'BOOLEAN'", "string or null": f"{t} IN ('VARCHAR', 'NULL')",
        "integer": f"({t} IN ('BIGINT', 'UBIGINT', 'HUGEINT') OR ({t} = 'DOUBLE' AND CAST(json_extract({j}, '$.{key}') AS DOUBLE) = floor(CAST(json_extract({j}, '$.{key}') AS DOUBLE))))",
        "array of strings": f"({t} = 'ARRAY' AND len(list_filter(json_extract({j}, '$.{key}[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0)",
    }
    if kind not in good:
        return [kind.replace("<T>", t).replace("<J>", j)]
    cases = [f"WHEN {t} IS NOT NULL AND NOT ({good[kind]}) THEN '{key}: expected {kind}'"]
    if allowed:
        values = ", ".join(map(q, allowed))
        cases.append(f"WHEN {t} IS NOT NULL AND json_extract_string({j}, '$.{key}') NOT IN ({values}) THEN '{key}: not an allowed value'")
    return cases


def _key_cases(keys: str, names, path: str) -> list[str]:
    listed = "[" + ", ".join(map(q, names)) + "]"
    missing = f"list_filter({listed}, lambda n: NOT list_contains({keys}, n))"
    extra = f"list_sort(list_filter({keys}, lambda n: NOT list_contains({listed}, n)))"
    return [f"WHEN len({missing}) > 0 THEN '{path}: missing ' || array_to_string({missing}, ', ')",
            f"WHEN len({extra}) > 0 THEN '{path}: unexpected ' || array_to_string({extra}, ', ')"]


def checked(source: str, fields, keep: str = "row_id") -> str:
    """Rows of `source` with j (JSON or NULL), status and reason against a contract."""
    names = [f[0] for f in fields]
    cases = ["WHEN raw_response IS NULL THEN '<root>: empty response'", "WHEN j IS NULL THEN '<root>: not valid JSON'",
             "WHEN json_type(j) <> 'OBJECT' THEN '<root>: expected object'"]
    for f in fields:
        cases += _problem(f[0], f[1], f[2], "j")
    cases += _key_cases("json_keys(j)", names, "<root>")
    return f"""SELECT *, CASE WHEN reason IS NULL THEN 'ok' ELSE 'invalid' END AS status FROM (
  SELECT *, CASE {' '.join(cases)} END AS reason FROM (
    SELECT {keep}, raw_response, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j
    FROM (SELECT *, {unfence('raw_response')} AS body FROM {source})))"""


MODE_KEYS = ("Failure_Mode", "Mechanism", "Cause", "Symptom")
CLASSIFY = (("Suggested_Code", "string", ()), *QA_KEYS)
AUDIT = QA_KEYS
_SELECTION = " ".join([
    "WHEN <T> IS NOT NULL AND <T> <> 'OBJECT' THEN 'Failure_Mode_Selection: expected object'",
    *[f"WHEN json_type(<J>, '$.Failure_Mode_Selection.{m}') IS NOT NULL AND json_type(<J>, '$.Failure_Mode_Selection.{m}') <> 'VARCHAR' "
      f"THEN 'Failure_Mode_Selection.{m}: expected string'" for m in MODE_KEYS],
    *[c.replace("WHEN ", "WHEN <T> = 'OBJECT' AND ") for c in
      _key_cases("json_keys(<J>, '$.Failure_Mode_Selection')", MODE_KEYS, "Failure_Mode_Selection")]])
_ITEM_BAD = " OR ".join(
    ["json_type(x) <> 'OBJECT'", "len(json_keys(x)) <> 5"]
    + [f"coalesce(json_type(x, '$.{m}'), '') <> 'VARCHAR'" for m in ("Failure_Mode", "Mechanism", "Cause", "Symptom_Effect")]
    + ["coalesce(json_type(x, '$.Frequency_in_Logs'), '') NOT IN ('BIGINT', 'UBIGINT')"])
_MODES = (f"WHEN <T> IS NOT NULL AND <T> <> 'ARRAY' THEN 'Failure_Modes: expected array of objects' "
          f"WHEN <T> = 'ARRAY' AND list_position(list_transform(json_extract(<J>, '$.Failure_Modes[*]'), lambda x: {_ITEM_BAD}), true) > 0 "
          f"THEN 'Failure_Modes.' || CAST(list_position(list_transform(json_extract(<J>, '$.Failure_Modes[*]'), lambda x: {_ITEM_BAD}), true) - 1 AS VARCHAR) || ': not a valid item'")
EXTRACTION = (
    ("System_Code", "string", ()), ("System_Name", "string", ()), ("Topology", "string or null", ()),
    ("Total_Logs_Analyzed", "integer", ()), ("Unclassified_Logs_Count", "integer", ()),
    ("Empirical_Actions_Taken", "array of strings", ()), ("Failure_Modes", _MODES, ()), *QA_KEYS)
TYPES = ("Corrective", "Reset", "Preventive", "Predictive", "Inspection", "Retrofit", "Other", "Not Enough Information")
OPERATIONAL = (("System_Code", "string", ()), ("Maintenance_Type", "string", TYPES), ("Action_Taken", "string", ()), *QA_KEYS)
SEMANTIC = (("System_Code", "string", ()), ("Failure_Mode_Selection", _SELECTION, ()), *QA_KEYS)
NOVEL = (("Action_Taken", "string", ()), *[(m, "string", ()) for m in MODE_KEYS], *QA_KEYS)
CLUSTERING = (("Standardized_New_Actions", "array of strings", ()), *QA_KEYS)


def s_(key: str, j: str = "j") -> str:
    return f"json_extract_string({j}, '$.{key}')"


def b_(key: str, j: str = "j") -> str:
    return f"CAST(json_extract({j}, '$.{key}') AS BOOLEAN)"


_SPEC = "spec"
CTES = {name: view_sql(name, "duckdb") for name in VIEWS}
CTES |= {
    "routed": f"""SELECT *, CASE WHEN {mentions('descriptions')} THEN 'Pitch Correction'
  WHEN {missing_code('system_code')} THEN 'Missing Code Recovery' ELSE 'Bypassed' END AS route FROM wo""",
    "checked_p1": checked("(SELECT * FROM ledger WHERE phase = 'P1')", CLASSIFY),
    "checked_p2b": checked("(SELECT * FROM ledger WHERE phase = 'P2_RELABEL')", CLASSIFY),
    "checked_p2": checked("audit_ledger", AUDIT),
    "p1": f"""SELECT w.*, route <> 'Bypassed' AS exempt,
  CASE WHEN route = 'Bypassed' THEN 'bypassed' ELSE coalesce(a.status, 'pending') END AS p1_status,
  route = 'Bypassed' OR a.status = 'ok' AS p1_done,
  CASE WHEN a.status = 'ok' THEN {s_('Suggested_Code')} END AS p1_suggested,
  CASE WHEN a.status = 'ok' THEN {s_('Reasoning')} END AS p1_reasoning,
  CASE WHEN a.status = 'ok' THEN {s_('Confidence_Score')} END AS p1_confidence,
  CASE WHEN a.status = 'ok' THEN {b_('Review_Flag')} END AS p1_flag
FROM routed w LEFT JOIN checked_p1 a ON w.row_id = a.row_id AND w.route <> 'Bypassed'""",
    "p1x": f"""SELECT *, CASE WHEN lower({strip('p1_suggested')}) = 'keep current'
  THEN nullif({norm('system_code')}, 'Unknown') ELSE p1_suggested END AS p1_code FROM p1""",
    "p2": f"""SELECT p.*,
  CASE WHEN exempt OR a.status = 'ok' THEN true END AS p2_complete,
  CASE WHEN exempt THEN 'High' WHEN a.status = 'ok' THEN {s_('Confidence_Score')} END AS p2_confidence,
  CASE WHEN exempt THEN 'Skipped because the row was handled by Phase 1 targeted pitch or missing-code correction.'
       WHEN a.status = 'ok' THEN {s_('Reasoning')} END AS p2_reasoning,
  CASE WHEN exempt THEN false WHEN a.status = 'ok' THEN {b_('Review_Flag')} END AS p2_relabel
FROM p1x p LEFT JOIN checked_p2 a ON p.row_id = a.row_id AND NOT p.exempt""",
    "p2b": f"""SELECT p.*, coalesce(p2_relabel, false) AND NOT exempt AS to_relabel, CASE WHEN a.status = 'ok' THEN true END AS p2b_complete,
  CASE WHEN a.status = 'ok' THEN {s_('Suggested_Code')} END AS p2b_suggested,
  CASE WHEN a.status = 'ok' THEN {s_('Reasoning')} END AS p2b_reasoning,
  CASE WHEN a.status = 'ok' THEN {s_('Confidence_Score')} END AS p2b_confidence,
  CASE WHEN a.status = 'ok' THEN {b_('Review_Flag')} END AS p2b_flag
FROM p2 p LEFT JOIN checked_p2b a ON p.row_id = a.row_id AND coalesce(p2_relabel, false) AND NOT exempt""",
    "p2bx": f"""SELECT *, CASE WHEN lower({strip('p2b_suggested')}) = 'keep current'
  THEN {strip('system_code')} ELSE p2b_suggested END AS p2b_code FROM p2b""",
    "merged": f"""SELECT *, coalesce(CASE
   WHEN exempt AND NOT {unusable('p1_code')} AND {gate('p1_confidence', 'p1_flag')} THEN {norm('p1_code')}
   WHEN NOT {unusable('p2b_code')} AND {gate('p2b_confidence', 'p2b_flag')} THEN {norm('p2b_code')}
   WHEN NOT {unusable('p1_code')} AND {gate('p1_confidence', 'p1_flag')} THEN {norm('p1_code')}
   END, {norm('system_code')}) AS merged_code FROM p2bx""",
    "grouped": f"""SELECT *, coalesce({topo_context('spec')}, 'Standard Topology') AS topology FROM (
  SELECT *, {topo_column('code', 'system_name')} AS spec FROM (
    SELECT *, coalesce({norm('system_code')}, 'Unknown') AS code FROM wo))""",
    # taxonomy: nodes, their depth-first position, membership in branches
    "tax_rows": f"SELECT ord, string_split({strip('code')}, ' ') AS parts, {strip('code')} AS code, coalesce({strip('name')}, '') AS name FROM components",
    "nodes": """SELECT path, len(path) AS depth, array_to_string(path, ' ') AS full_code,
  coalesce(arg_max(own, ord) FILTER (own IS NOT NULL), '') AS name, min(ord) AS ord
  FROM (SELECT ord, parts[1:k] AS path, CASE WHEN k = len(parts) THEN name END AS own
        FROM (SELECT ord, parts, name, unnest(range(1, len(parts) + 1)) AS k FROM tax_rows)) GROUP BY path""",
    "places": """SELECT n.path, n.depth, n.full_code, n.name, n.ord, list(a.ord ORDER BY s.k) AS place
  FROM nodes n, (SELECT path, unnest(range(1, depth + 1)) AS k FROM nodes) s JOIN nodes a ON a.path = s.path[1:s.k]
  WHERE n.path = s.path GROUP BY n.path, n.depth, n.full_code, n.name, n.ord""",
    "flagged": """SELECT *, path[1] AS f, path[2] AS s, starts_with(path[2], 'MDA') AS pitch,
  bool_or(len(path) = 2 AND starts_with(path[2], 'MDA')) OVER (PARTITION BY path[1]) AS has_pitch,
  bool_or(len(path) = 2 AND NOT starts_with(path[2], 'MDA')) OVER (PARTITION BY path[1]) AS has_rest FROM places""",
    "members": """SELECT branch, place, CASE WHEN name = '' THEN '' ELSE repeat('  ', CAST(depth - root AS BIGINT)) || '- ' || full_code || ': ' || name || chr(10) END AS line
  FROM (SELECT 'all' AS branch, 1 AS root, * FROM flagged
  UNION ALL SELECT 'all|' || f, 2, * FROM flagged WHERE depth > 1
  UNION ALL SELECT 'all|' || f || '|' || s, 2, * FROM flagged WHERE depth > 1
  UNION ALL SELECT 'pitch', 1, * FROM flagged WHERE CASE WHEN depth > 1 THEN pitch ELSE has_pitch END
  UNION ALL SELECT 'pitch|' || f, 2, * FROM flagged WHERE depth > 1 AND pitch
  UNION ALL SELECT 'rest', 1, * FROM flagged WHERE CASE WHEN depth > 1 THEN NOT pitch ELSE has_rest END
  UNION ALL SELECT 'rest|' || f, 2, * FROM flagged WHERE depth > 1 AND NOT pitch
  UNION ALL SELECT 'rest|' || f || '|' || s, 2, * FROM flagged WHERE depth > 1 AND NOT pitch)""",
    "branches": "SELECT branch, string_agg(line, '' ORDER BY place) AS text FROM members GROUP BY branch",
    "row_branches": f"""SELECT row_id, CASE WHEN {mentions('descriptions')} THEN 'pitch' || CASE WHEN len(t) >= 2 THEN '|' || t[1] ELSE '' END
   ELSE 'rest' || CASE WHEN len(t) >= 2 THEN '|' || t[1] || '|' || t[2] ELSE '' END END AS branch
   FROM (SELECT *, {tokens('system_code')} AS t FROM wo)""",
    # dictionary lookup
    "entry_keys": "SELECT DISTINCT code, topology FROM dict_long UNION SELECT DISTINCT code, topology FROM dict_actions",
    "per_code": """SELECT code, bool_or(topology IS NULL) AS flat, bool_or(topology = 'Standard Topology') AS standard,
   count(topology) AS n, min(topology) AS only_one FROM entry_keys GROUP BY code""",
    "lookup": """SELECT g.code, g.topology, CASE WHEN p.flat THEN NULL WHEN e.code IS NOT NULL THEN g.topology
    WHEN p.standard THEN 'Standard Topology' WHEN p.n = 1 THEN p.only_one END AS entry_topology,
    coalesce(p.flat, false) OR e.code IS NOT NULL OR coalesce(p.standard, false) OR coalesce(p.n = 1, false) AS found
    FROM (SELECT DISTINCT code, topology FROM grouped) g LEFT JOIN entry_keys e ON e.code = g.code AND e.topology = g.topology
    LEFT JOIN per_code p ON p.code = g.code""",
    "modes_of": f"""SELECT code, topology, list(m ORDER BY pos) AS modes FROM (
      SELECT code, topology, min(pos) AS pos, {{'Failure_Mode': {strip('failure_mode')}, 'Mechanism': {strip('mechanism')}, 'Cause': {strip('cause')}, 'Symptom': {strip('symptom')}}} AS m
      FROM dict_long WHERE {norm('failure_mode')} IS NOT NULL GROUP BY code, topology, m) GROUP BY code, topology""",
    "actions_of": f"""SELECT code, topology, list(a ORDER BY pos) AS actions FROM (
      SELECT code, topology, a, min(pos) AS pos FROM (
        SELECT code, topology, pos, {norm('action')} AS a FROM dict_actions
        UNION ALL SELECT code, topology, 9000000000000000001, 'Other' FROM entry_keys
        UNION ALL SELECT code, topology, 9000000000000000002, 'Not Enough Information' FROM entry_keys)
      GROUP BY code, topology, a) GROUP BY code, topology""",
    "row_options": """SELECT g.*, l.found, coalesce(a.actions, ['Other', 'Not Enough Information']) AS action_choices, coalesce(m.modes, []) AS mode_choices
      FROM grouped g JOIN lookup l ON g.code = l.code AND g.topology = l.topology
      LEFT JOIN actions_of a ON l.found AND a.code = l.code AND a.topology IS NOT DISTINCT FROM l.entry_topology
      LEFT JOIN modes_of m ON l.found AND m.code = l.code AND m.topology IS NOT DISTINCT FROM l.entry_topology""",
    "checked_op": checked("(SELECT o.*, r.action_choices FROM op_ledger o JOIN row_options r ON o.row_id = r.row_id)", OPERATIONAL, "row_id, action_choices"),
    "op_ok": f"""SELECT row_id, j, CASE WHEN status <> 'ok' THEN reason WHEN list_contains(action_choices, {s_('Action_Taken')}) THEN NULL
      ELSE 'Action_Taken: not an allowed value' END AS reason FROM checked_op""",
    "checked_sem": checked("(SELECT o.*, r.mode_choices FROM sem_ledger o JOIN row_options r ON o.row_id = r.row_id)", SEMANTIC, "row_id, mode_choices"),
    "sem_ok": f"""SELECT row_id, j, CASE WHEN status <> 'ok' THEN reason
      WHEN (len(list_filter(mode_choices, lambda m: m.Failure_Mode = {s_('Failure_Mode_Selection.Failure_Mode')} AND m.Mechanism = {s_('Failure_Mode_Selection.Mechanism')}
        AND m.Cause = {s_('Failure_Mode_Selection.Cause')} AND m.Symptom = {s_('Failure_Mode_Selection.Symptom')})) > 0)
        <> ({s_('Failure_Mode_Selection.Failure_Mode')} IN ('Other Novel Failure', 'Not Enough Information')) THEN NULL
      ELSE 'Failure_Mode_Selection: not exactly one option' END AS reason FROM checked_sem""",
    "op_rows": f"""SELECT w.*, {uninformative('w.descriptions')} AS skip, a.j AS oj, a.row_id IS NOT NULL AND a.reason IS NULL AS op_good
      FROM row_options w LEFT JOIN op_ok a ON a.row_id = w.row_id""",
    "op_half": f"""SELECT *, op_good AND NOT skip AS op_done,
      CASE WHEN skip THEN 'Not Enough Information' WHEN op_good THEN {strip(s_('Maintenance_Type', 'oj'))} END AS m_type,
      CASE WHEN skip THEN 'Not Enough Information' WHEN op_good THEN {s_('Action_Taken', 'oj')} END AS action,
      CASE WHEN skip THEN 'High' WHEN op_good THEN {s_('Confidence_Score', 'oj')} END AS op_conf,
      CASE WHEN skip THEN false WHEN op_good THEN {b_('Review_Flag', 'oj')} END AS op_flag FROM op_rows""",
    "p4_all": f"""SELECT h.*, op_done AND m_type IN ('Preventive', 'Retrofit') AS healthy, s.j AS sj,
      s.row_id IS NOT NULL AND s.reason IS NULL AND op_done AND m_type NOT IN ('Preventive', 'Retrofit') AS sem_good
      FROM op_half h LEFT JOIN sem_ok s ON s.row_id = h.row_id""",
    "p4": f"""SELECT *, skip OR healthy OR sem_good AS done,
      {', '.join(f"CASE WHEN skip THEN 'Not Enough Information' WHEN healthy THEN 'Not Applicable' WHEN sem_good THEN {s_('Failure_Mode_Selection.' + m, 'sj')} END AS {m.lower()}" for m in MODE_KEYS)},
      CASE WHEN skip OR healthy THEN 'High' WHEN sem_good THEN {s_('Confidence_Score', 'sj')} END AS sem_conf,
      CASE WHEN skip OR healthy THEN false WHEN sem_good THEN {b_('Review_Flag', 'sj')} END AS sem_flag,
      CASE WHEN skip THEN 'Deterministically skipped due to missing or uninformative description.'
        WHEN healthy THEN 'Operational: ' || {s_('Reasoning', 'oj')} || ' | FMEA: Skipped deterministically as maintenance type is ' || m_type || '.'
        WHEN sem_good THEN 'Operational: ' || {s_('Reasoning', 'oj')} || ' | FMEA: ' || {s_('Reasoning', 'sj')} END AS reasoning FROM p4_all""",
    "p4x": f"""SELECT *, CASE WHEN skip OR healthy THEN op_conf WHEN sem_good THEN
        CASE WHEN ({score('op_conf')}) < ({score('sem_conf')}) THEN op_conf ELSE sem_conf END END AS conf,
      CASE WHEN skip OR healthy THEN op_flag WHEN sem_good THEN op_flag OR sem_flag END AS review FROM p4""",
}


def with_ctes(select: str) -> str:
    """The select behind the CTEs it needs, directly or through others, in dependency order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b(FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                need(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    need(select)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + select
