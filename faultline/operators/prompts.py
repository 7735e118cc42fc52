"""Prompt rendering and the default templates."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.errors import ConfigError

ENGINEER = "You label wind turbine maintenance records. Answer with one JSON object only."
AUDITOR = "You audit wind turbine maintenance records. Answer with one JSON object only."

CLASSIFY = """Choose the component code that fits this work order best.

Work order: {log_description}
Recorded component: {legacy_system_name}, code {legacy_system_code}
{topology_context_block}
Candidate codes:
{taxonomy_text}
Answer "Keep Current" when the recorded code is right, and "Not Enough Information" when the text
does not say what was worked on. Give one sentence of reasoning, your confidence, and whether a
person should look at it.
"""

AUDIT = """Does this work order contradict the component it was booked on?

Work order: {log_description}
Recorded component: {legacy_system_name}, code {legacy_system_code}
{topology_context_block}
Set the review flag only for a clear contradiction; vague texts pass. Give one sentence of
reasoning and your confidence.
"""

EXTRACT = """Below are all work orders of one component, {system_name} (code {system_code}).
{topology_context_block}
List every distinct action taken, each starting with a verb, and every failure mode with its
mechanism, cause, symptom and the number of work orders showing it. Keep different causes of one
failure mode apart. Leave nothing out; count texts that say nothing as unclassified.

{log_batch_text}
"""

OPERATIONAL = """Name the action and the kind of maintenance in this work order.

Work order: {log_description}
Component: {system_name}, code {system_code}
{topology_context_block}
Allowed actions: {valid_actions_list}
Kinds: Corrective, Reset, Preventive, Predictive, Inspection, Retrofit, Other, Not Enough Information.
Use an allowed action word for word. Give one sentence of reasoning, your confidence, and whether
a person should look at it.
"""

SEMANTIC = """Pick the failure mode behind this work order.

Work order: {log_description}
Component: {system_name}, code {system_code}
{topology_context_block}
Maintenance: {maintenance_type}; action: {action_taken}
Allowed failure modes:
{valid_failure_modes_list}
Copy all four fields of one mode word for word. Give one sentence of reasoning, your confidence,
and whether a person should look at it.
"""


@dataclass(frozen=True)
class Templates:
    """Wording of all prompts; replace any of them. A template need not use every field."""

    engineer: str = ENGINEER
    auditor: str = AUDITOR
    classify: str = CLASSIFY
    audit: str = AUDIT
    extract: str = EXTRACT
    operational: str = OPERATIONAL
    semantic: str = SEMANTIC


def template_fields(template: str) -> list[str]:
    return [name for _, name, _, _ in string.Formatter().parse(template) if name is not None]


def _filled(template: str, fields: dict[str, Column], shared: str | None = None) -> list[Column]:
    missing = sorted(set(template_fields(template)) - set(fields) - {shared})
    if missing:
        raise ConfigError(f"template needs {', '.join(missing)}")
    runs: list[list[Column]] = [[]]
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            runs[-1].append(F.lit(literal))
        if name is not None and name == shared:
            runs.append([])
        elif name is not None:
            runs[-1].append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return [F.concat(*run) if run else F.lit("") for run in runs]


def render(template: str, fields: dict[str, Column]) -> Column:
    """Template with its {fields} filled in one pass, so braces inside values mean nothing."""
    return _filled(template, fields)[0]


def render_around(template: str, fields: dict[str, Column], shared: str) -> Column:
    """Array of what stands before, between and after the places of the field `shared`; joined by its text it is the prompt."""
    return F.array(*_filled(template, fields, shared))
