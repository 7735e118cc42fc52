"""Run settings. All of them become literals in the plan; none is read inside a task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from faultline.operators.prompts import Templates

# Labels, levels and default options of the data contract.
STANDARD_TOPOLOGY = "Standard Topology"
UNKNOWN = "Unknown"
NOT_ENOUGH = "Not Enough Information"
NOT_APPLICABLE = "Not Applicable"
KEEP_CURRENT = "Keep Current"
ROUTE_PITCH = "Pitch Correction"
ROUTE_MISSING = "Missing Code Recovery"
ROUTE_BYPASSED = "Bypassed"
AUDIT_SKIPPED_REASON = (
    "Skipped because the row was handled by Phase 1 targeted pitch or missing-code correction."
)
LABEL_SKIPPED_REASON = "Deterministically skipped due to missing or uninformative description."
SEMANTIC_SKIPPED_REASON = " | FMEA: Skipped deterministically as maintenance type is "
QA_PASS = "Pass"
QA_LOW = "Requires Human Review (Low Confidence)"
QA_FLAGGED = "Requires Human Review (Flagged by Model)"
CONFIDENCE_SCORES = {"High": 3, "Medium": 2, "Low": 1}
MAINTENANCE_TYPES = (
    "Corrective", "Reset", "Preventive", "Predictive",
    "Inspection", "Retrofit", "Other", "Not Enough Information",
)
DEFAULT_ACTION_ESCAPES = ("Other", "Not Enough Information")
DEFAULT_MODE_ESCAPES = ("Other Novel Failure", "Not Enough Information")


@dataclass(frozen=True)
class ColumnMap:
    """User column name for each canonical column."""

    wo_id: str = "WO_ID"
    system_code: str = "System_Code"
    system_name: str = "System_Name"
    descriptions: str = "Descriptions"
    maintenance_type: str = "Maintenance_Type"
    action_type: str = "Action_Type"
    manufacturer: str = "Manufacturer"
    turbine_model: str = "Turbine_Model"
    drive_type: str = "Drive_Type"
    generator_type: str = "Generator_Type"
    pitch_type: str = "Pitch_Type"
    yaw_brake_type: str = "Yaw_Brake_Type"

    def pairs(self) -> list[tuple[str, str]]:
        """(canonical, user) names in declaration order."""
        return list(vars(self).items())

    def specification(self) -> list[str]:
        """User names of the hardware columns."""
        return [vars(self)[name] for name in SPECIFICATION]


REQUIRED = ("wo_id", "descriptions")
SPECIFICATION = (
    "manufacturer", "turbine_model", "drive_type", "generator_type", "pitch_type", "yaw_brake_type",
)


@dataclass(frozen=True)
class Gate:
    """What a confidence / review-flag pair must reach to be merged."""

    required: str | None = "High"
    allow_flags: bool = False


@dataclass(frozen=True)
class Rules:
    qa: Gate = Gate()
    code_gate: Gate = Gate()
    type_gate: Gate = Gate()
    action_gate: Gate = Gate()
    mode_gate: Gate = Gate()
    enforce_mode_gate: bool = False
    max_attempts: int = 2
    skip_uninformative: bool = True
    skip_non_failure: bool = True
    uninformative_label: str = NOT_ENOUGH
    healthy_label: str = NOT_APPLICABLE
    action_escapes: tuple[str, ...] = DEFAULT_ACTION_ESCAPES
    mode_escapes: tuple[str, ...] = DEFAULT_MODE_ESCAPES
    non_failure_types: tuple[str, ...] = ("Preventive", "Retrofit")


@dataclass(frozen=True)
class TaxonomyRules:
    facility: str | None = None
    system: str | None = None
    pitch_keywords: tuple[str, ...] = ("pitch", "pich", "ptch")
    pitch_prefixes: tuple[str, ...] = ()
    yaw_prefixes: tuple[str, ...] = ()
    generator_prefixes: tuple[str, ...] = ()
    converter_prefixes: tuple[str, ...] = ()
    drivetrain_prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Redaction:
    enabled: bool = False
    patterns: tuple[str, ...] = ()
    replacement: str = "[REDACTED]"
    custom: Callable[[str], str] | None = None


@dataclass(frozen=True)
class Pricing:
    """USD per one million tokens."""

    input: Decimal = Decimal("2.50")
    output: Decimal = Decimal("15.00")


@dataclass(frozen=True)
class Limits:
    """Size bounds of single cells and of what may be broadcast."""

    batch_chars: int = 4_000_000
    page_lines: int = 10_000
    broadcast_bytes: int = 64 << 20


@dataclass(frozen=True)
class Config:
    columns: ColumnMap = field(default_factory=ColumnMap)
    rules: Rules = field(default_factory=Rules)
    taxonomy: TaxonomyRules = field(default_factory=TaxonomyRules)
    redaction: Redaction = field(default_factory=Redaction)
    pricing: Pricing = field(default_factory=Pricing)
    limits: Limits = field(default_factory=Limits)
    prompts: Templates = field(default_factory=Templates)
