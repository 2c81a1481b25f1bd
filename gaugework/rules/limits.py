"""Plausibility ranges, ratio ceilings, priorities and metric directions.

Fixed values.
"""

from __future__ import annotations

# Report type -> priority (lower wins); any other type comes last
TYPE_PRIORITY: dict[str, int] = {"Integrated": 0, "BRSR": 1, "ESG": 2}
OTHER_PRIORITY = 99

USABLE_STATUS: tuple[str, ...] = ("downloaded", "parsed", "extracted")
RETRY_STATUS: tuple[str, ...] = ("discovered", "failed")
# Report types that are looked for
REPORT_KINDS: tuple[str, ...] = ("BRSR", "ESG", "Integrated")
# Status of a report: how far it is, and what may follow; an upload begins as downloaded
STATUS_ORDER: tuple[str, ...] = ("discovered", "downloading", "failed", "downloaded", "parsed")
NO_STATUS = "none"
STATUS_CHANGES: dict[str, tuple[str, ...]] = {
    "none": ("discovered", "downloaded"),
    "discovered": ("downloading", "failed"),
    "downloading": ("downloaded", "failed"),
    "failed": ("downloading", "failed"),
    "downloaded": ("parsed", "failed"),
    "parsed": ("parsed",),
}

ACCEPT_PATTERN_CONFIDENCE = 0.88
READ_CONFIDENCE = 0.40
VALID_CONFIDENCE = 0.85
DEFAULT_CONFIDENCE = 0.50
REVENUE_CONFIDENCE = 0.70
CACHED_REVENUE_CONFIDENCE = 0.99

# Profile -> metric -> (lowest, highest), in canonical units
PLAUSIBLE: dict[str, dict[str, tuple[float, float]]] = {
    "store": {
        "scope_1_emissions": (1.0, 5e6),
        "scope_2_emissions": (1.0, 5e6),
        "total_ghg_emissions": (1.0, 1e7),
        "energy_consumption": (1e3, 5e8),
        "water_consumption": (100.0, 1e8),
        "waste_generated": (0.1, 5e5),
        "employee_count": (1.0, 5e6),
        "renewable_energy_percentage": (0.0, 100.0),
        "women_in_workforce_percentage": (0.0, 100.0),
    },
    "run": {
        "energy_consumption": (1e3, 5e8),
        "scope_1_emissions": (1.0, 5e6),
        "scope_2_emissions": (1.0, 5e6),
        "total_ghg_emissions": (1.0, 1e7),
        "water_consumption": (100.0, 1e8),
        "waste_generated": (0.1, 5e5),
    },
    "dashboard": {
        "scope_1_emissions": (1.0, 5e6),
        "scope_2_emissions": (1.0, 5e6),
        "scope_3_emissions": (1.0, 1e7),
        "energy_consumption": (100.0, 5e8),
        "water_consumption": (100.0, 1e8),
        "waste_generated": (0.1, 5e5),
        "renewable_energy_percentage": (0.0, 100.0),
        "employee_count": (1.0, 5e6),
        "women_in_workforce_percentage": (0.0, 100.0),
        "complaints_filed": (0.0, 1e6),
        "complaints_pending": (0.0, 1e5),
    },
}

# Profile -> metric -> highest ratio
CEILINGS: dict[str, dict[str, float]] = {
    "compare": {
        "scope_1_emissions": 10.0,
        "scope_2_emissions": 10.0,
        "scope_3_emissions": 50.0,
        "energy_consumption": 1000.0,
        "waste_generated": 5.0,
        "water_consumption": 500.0,
        "employee_count": 5000.0,
        "women_in_workforce_percentage": 100.0,
        "complaints_filed": 1e6,
        "complaints_pending": 1e5,
    },
    "run": {
        "energy_consumption": 1000.0,
        "scope_1_emissions": 10.0,
        "scope_2_emissions": 10.0,
        "total_ghg_emissions": 20.0,
        "water_consumption": 500.0,
        "waste_generated": 5.0,
    },
    "dashboard": {
        "scope_1_emissions": 10.0,
        "scope_2_emissions": 10.0,
        "scope_3_emissions": 50.0,
        "energy_consumption": 1000.0,
        "water_consumption": 500.0,
        "waste_generated": 5.0,
        "renewable_energy_percentage": 100.0,
        "employee_count": 5000.0,
        "women_in_workforce_percentage": 100.0,
        "complaints_filed": 1e6,
        "complaints_pending": 1e5,
    },
}

# Compared metrics, in order:
# metric, display name, short label, group, canonical unit, ratio unit,
# divide by revenue, lower is better
COMPARED: tuple[tuple[str, str, str, str, str, str, bool, bool], ...] = (
    ("scope_1_emissions", "Scope 1 GHG Emissions", "Scope 1 GHG", "environmental", "tCO2e", "tCO2e / INR_Crore", True, True),
    ("scope_2_emissions", "Scope 2 GHG Emissions", "Scope 2 GHG", "environmental", "tCO2e", "tCO2e / INR_Crore", True, True),
    ("scope_3_emissions", "Scope 3 GHG Emissions", "Scope 3 GHG", "environmental", "tCO2e", "tCO2e / INR_Crore", True, True),
    ("energy_consumption", "Total Energy Consumption", "Energy Intensity", "environmental", "GJ", "GJ / INR_Crore", True, True),
    ("waste_generated", "Total Waste Generated", "Waste Intensity", "environmental", "MT", "MT / INR_Crore", True, True),
    ("water_consumption", "Total Water Consumption", "Water Intensity", "environmental", "KL", "KL / INR_Crore", True, True),
    ("employee_count", "Total Employees", "Workforce", "social", "count", "count / INR_Crore", True, True),
    ("women_in_workforce_percentage", "Women in Workforce (%)", "Women in Workforce", "social", "%", "%", False, False),
    ("complaints_filed", "Complaints Filed", "Complaints Filed", "governance", "count", "count", False, True),
    ("complaints_pending", "Complaints Pending", "Complaints Pending", "governance", "count", "count", False, True),
)
COMPARED_NAMES: tuple[str, ...] = tuple(row[0] for row in COMPARED)

# Metrics a comparison run extracts, in order
RUN_TARGETS: tuple[str, ...] = (
    "scope_1_emissions", "scope_2_emissions", "total_ghg_emissions", "waste_generated",
)
# The total is derived, never searched for
RUN_EXTRACTED: tuple[str, ...] = (
    "scope_1_emissions", "scope_2_emissions", "waste_generated",
)

# Dashboard groups: metric, label, group
DASHBOARD_GROUPS: tuple[tuple[str, str, str], ...] = (
    ("scope_1_emissions", "Scope 1 GHG", "Environmental"),
    ("scope_2_emissions", "Scope 2 GHG", "Environmental"),
    ("scope_3_emissions", "Scope 3 GHG", "Environmental"),
    ("energy_consumption", "Energy Intensity", "Environmental"),
    ("water_consumption", "Water Intensity", "Environmental"),
    ("waste_generated", "Waste Intensity", "Environmental"),
    ("renewable_energy_percentage", "Renewable Energy", "Environmental"),
    ("employee_count", "Workforce", "Social"),
    ("women_in_workforce_percentage", "Women in Workforce", "Social"),
    ("complaints_filed", "Complaints Filed", "Governance"),
    ("complaints_pending", "Complaints Pending", "Governance"),
)

# Metric -> wording of a ratio that the report itself states
RATIO_LABELS: dict[str, tuple[str, ...]] = {
    "energy_consumption": ("energy intensity per rupee of turnover",),
    "water_consumption": ("water intensity per rupee of turnover", "water intensity per rupee"),
    "waste_generated": ("waste intensity per rupee of turnover", "waste intensity per rupee"),
}
RATIO_SEARCH_CHARS = 400
RATIO_VALUE = r"\b(0\.0{6,}\d+)\b"
RUPEES_PER_CRORE = 1e7

# Revenue of one company-year that is believable, in crore
REVENUE_MIN = 1e3
REVENUE_MAX = 9e6
DEFAULT_REVENUE = {"extract": 258315.0, "dashboard": 315322.0}

PAGE_TEXT_CHARS = 4000
CONTEXT_CHARS = 6000
MAX_FILE_BYTES = 50 * 1024 * 1024
PDF_MAGIC = "%PDF-"
MILLION_SCALE_METRICS: tuple[str, ...] = (
    "scope_1_emissions", "scope_2_emissions", "total_ghg_emissions",
)
