"""Ordered text patterns for value extraction and revenue.

Fixed values: patterns are tried in the order given; the first group is the
value and, where there is one, the second group is the unit.
"""

from __future__ import annotations

# A number with two- or three-digit comma groups: 1,80,737 or 55,881
GROUPED = r"[\d]{1,3}(?:,\d{2,3})+"

# Wording that marks a change, a target or an intensity instead of a total
DELTA_WORDING = (
    r"\b("
    r"reduc(?:ed|es?|tion|ing)|"
    r"declin(?:ed|e|ing)|"
    r"decreas(?:ed|es?|e|ing)|"
    r"avoid(?:ed|ance|ing|s?)|"
    r"offset(?:ting|s)?|"
    r"sequester(?:ed|ing)?|"
    r"sav(?:ed|ing|ings)|"
    r"target(?:ed|ing|s?)?\s+(?:of|to|at)|"
    r"goal\s+(?:of|to)|"
    r"aim(?:s|ing)?\s+(?:to|for)|"
    r"commit(?:ted|ment)\s+(?:to|of)|"
    r"plan(?:ned|s|ning)?\s+(?:to|for)|"
    r"by\s+(?:fy|20)\d{2}|"
    r"per\s+(?:employee|fte|unit|sqm|sq\.?\s*m|revenue|capita|tonne|kwh)|"
    r"intensit(?:y|ies)|"
    r"baseline\s+(?:of|year|value)|"
    r"compared\s+to\s+(?:fy|20)\d{2}|"
    r"vs\.?\s+(?:fy|20)\d{2}|"
    r"from\s+(?:fy|20)\d{2}\s+(?:to|level)|"
    r"improvement\s+(?:of|in)|"
    r"increase[sd]?\s+by|"
    r"net\s+(?:zero|neutral)|"
    r"emission\s+factor"
    r")\b"
)
DELTA_WINDOW = 150
DELTA_MIN_PIECE = 5

# Metrics whose matches are accepted inside such wording
DELTA_EXEMPT: tuple[str, ...] = (
    "complaints_filed", "complaints_pending", "renewable_energy_percentage",
)
COMPLAINT_METRICS: tuple[str, ...] = ("complaints_filed", "complaints_pending")

# --------------------------------------------------------------------------
# Block patterns per metric (label line, then value)
# --------------------------------------------------------------------------
BLOCK: dict[str, tuple[str, ...]] = {
    "energy_consumption": (
        r"total\s+energy\s+consumed\s*\(A[^)]*D[^)]*F\)[^\n]*\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+energy\s+consumed\s*\((?:A[^)]*)\)[^\n]*\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+energy\s+consumption[^\n]{0,80}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+energy\s+consumed[^\n]{0,80}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
    ),
    "water_consumption": (
        r"total\s+volume\s+of\s+water\s+consumption[^\n]*\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+water\s+consumption[^\n]*\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+water\s+withdrawn[^\n]{0,80}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+water\s+(?:intake|sourced|used)[^\n]{0,80}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
    ),
    "waste_generated": (
        r"^total\s*\([a-h\s\+]+\)\s*\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+\(A\s*\+\s*B[^\n]*\)\s*\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
    ),
    "scope_1_emissions": (
        r"total\s+scope\s*1\s+emissions.{0,200}?metric\s+tonnes\s+of\s+([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+scope\s*1\s+emissions[\s\S]{0,300}?equivalent\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
    ),
    "scope_2_emissions": (
        r"total\s+scope\s*2\s+emissions.{0,200}?metric\s+tonnes\s+of\s+([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+scope\s*2\s+emissions[\s\S]{0,300}?equivalent\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
    ),
    "scope_3_emissions": (
        r"total\s+scope\s*3\s+emissions.{0,200}?metric\s+tonnes\s+of\s+([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+scope\s*3\s+emissions[\s\S]{0,300}?equivalent\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"scope\s*3\s+(?:ghg\s+)?emissions[^\n]{0,80}\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+value\s+chain\s+emissions[^\n]{0,80}\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"other\s+indirect\s+\(scope\s*3\)[^\n]{0,80}\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
        r"total\s+scope\s*3\s+emissions[^\n]*\n\s*(" + GROUPED + r"(?:\.\d+)?)",
        r"scope\s*3\s+(?:ghg\s+)?emissions[^\n]*\n\s*(" + GROUPED + r"(?:\.\d+)?)",
        r"other\s+indirect\s+\(?scope\s*3\)?[^\n]*\n\s*(" + GROUPED + r"(?:\.\d+)?)",
        r"scope\s*3\s+(?:ghg\s+)?emissions[^\n]{0,100}?(" + GROUPED + r"(?:\.\d+)?)\s*(?:tco2e?|metric\s*tonn\w*)",
        r"total\s+scope\s*3\s+emissions[\s\S]{0,400}?equivalent[^\n]*\n\s*(" + GROUPED + r"(?:\.\d+)?)",
    ),
    "renewable_energy_percentage": (
        r"renewable\s+energy[\s\S]{0,80}?([\d]+(?:\.\d+)?)\s*%",
        r"([\d]+(?:\.\d+)?)\s*%[\s\S]{0,40}?(?:from\s+)?renewable",
        r"renewable[\s\S]{0,40}?([\d]+(?:\.\d+)?)\s*percent",
        r"([\d]+(?:\.\d+)?)\s*%[^\n]*\n[^\n]*(?:renew\w*|met\s+through)",
        r"share\s+of\s+renew\w*[^\n]{0,80}?([\d]+(?:\.\d+)?)\s*%",
        r"([\d]+(?:\.\d+)?)\s*%\s+of\s+(?:\w+\s+){0,5}electricity[^\n]{0,150}renew\w*",
        r"([\d]+(?:\.\d+)?)\s*%[\s\S]{0,200}?from\s+renew\w+",
        r"renew(?:able\s+sources?|ables?|able\s+energy)\b[^\n]{0,120}([\d]{2,}(?:\.\d+)?)\s*%",
        r"(?:solar|wind|hydro|geotherm\w+)\s+energy[^\n]{0,80}?([\d]+(?:\.\d+)?)\s*%",
    ),
    "complaints_filed": (
        r"employees?\s+and\s+workers?[^\n]{0,250}?(\b\d{2,}\b)\s+\d+",
        r"filed\s+during\s+(?:the\s+)?year[^\n]{0,60}?[:\s]+(\d[\d,]*)",
        r"(\d[\d,]+)\s+complaints?\s+(?:were\s+)?filed",
        r"complaints?\s+received[^\n]{0,60}?[:\s]+(\d[\d,]+)",
        r"complaints?\s+filed[^\n]{0,60}?[:\s]+(\d[\d,]+)",
        r"number\s+of\s+complaints?\s+filed[^\n]{0,100}?(\d[\d,]+)",
        r"total\s+complaints?\s+(?:filed|received)[^\n]{0,80}?(\d[\d,]+)",
        r"(\d[\d,]+)\s+complaints?\s+(?:were\s+)?(?:lodged|raised|reported|submitted)",
        r"(?:working\s+conditions?|health\s+and\s+safety)[^\n]{0,80}?(\d+)\s+\d+",
        r"grievances?\s+(?:filed|received)[^\n]{0,80}?[:\s]+(\d[\d,]+)",
    ),
    "complaints_pending": (
        r"employees?\s+and\s+workers?[^\n]{0,250}?\d[\d,]+\s+(\b\d+\b)",
        r"pending\s+resolution\s+at\s+(?:close|end)[^\n]{0,100}?(\d[\d,]*)",
        r"(\d[\d,]*)\s+(?:complaints?\s+)?(?:are\s+)?pending\b",
        r"complaints?\s+pending\s+(?:resolution\s+)?[^\n]{0,60}?[:\s]+(\d[\d,]*)",
        r"(?:pending|outstanding)[^\n]{0,40}?[:\s]+(\d+)",
        r"close\s+of\s+the\s+year[^\n]{0,20}\n\s*(\d+)",
        r"complaints?\s+pending[^\n]{0,80}?[:\s]+(\d+)",
        r"total\s+(?:complaints?\s+)?pending[^\n]{0,80}?(\d+)",
        r"(\d[\d,]*)\s+(?:complaints?\s+)?(?:were\s+)?pending\s+at\s+(?:year|the\s+(?:end|close))",
        r"grievances?\s+pending[^\n]{0,80}?[:\s]+(\d+)",
    ),
}

# Confidence of a block match: in a table, in other text
BLOCK_CONFIDENCE = (0.93, 0.88)
BLOCK_CONFIDENCE_RENEWABLE = (0.90, 0.88)
BLOCK_CONFIDENCE_COMPLAINT = (0.88, 0.85)
GHG_ROW_CONFIDENCE = (0.91, 0.87)
SPECIFIC_CONFIDENCE = (0.92, 0.80)
BROAD_CONFIDENCE = (0.65, 0.55)
BLOCK_MIN_VALUE = 0.1
GHG_ROW_MIN_VALUE = 10.0
RENEWABLE_MAX_VALUE = 100.0
COMPLAINT_MAX_VALUE = 10_000_000.0

# --------------------------------------------------------------------------
# Emission table rows
# --------------------------------------------------------------------------
GHG_MARKERS: tuple[str, ...] = ("ghg into co", "break-up of the ghg")
GHG_ROW: tuple[str, ...] = (
    r"ghg\s+into\s+co.{0,80}\s2\s+([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
    r"break-?up\s+of\s+the\s+ghg[^\n]*\n\s*(" + GROUPED + r"(?:\.\d+)?)",
)
# Header wording -> scope that the rows after it belong to (0: none)
GHG_HEADERS: tuple[tuple[str, int], ...] = (
    ("total scope 1 emissions", 1),
    ("total scope 2 emissions", 2),
    ("total scope 3 emissions", 3),
    ("scope 3 ghg", 3),
    ("total scope 4", 0),
)
GHG_SCOPE: dict[str, int] = {
    "scope_1_emissions": 1, "scope_2_emissions": 2, "scope_3_emissions": 3,
}

# --------------------------------------------------------------------------
# Broad patterns, any metric
# --------------------------------------------------------------------------
_VALUE = r"([\d,]+(?:\.\d+)?)(?:\(\d+\))?"
_UNIT = (
    r"(tco2e?|t\s*co2e?|mt\s*co2e?|kt\s*co2e?|tonnes?\s*co2e?|"
    r"mwh|gwh|gj|tj|kl|kilolitr\w*|m3|mt|metric\s*tonn?\w*|"
    r"%|percent|crore|lakh|number|nos|headcount)"
)
BROAD: tuple[str, ...] = (
    r"(?:was|is|were|of|:)\s*" + _VALUE + r"\s*" + _UNIT,
    _VALUE + r"\s*" + _UNIT + r"\s*(?:in|for|during|fy|fiscal)",
    r"\|\s*" + _VALUE + r"\s*\|\s*" + _UNIT,
)

# --------------------------------------------------------------------------
# revenue
# --------------------------------------------------------------------------
_REVENUE = r"(?:\d{1,3}(?:,\d{2,3})+|\d{1,3},\d{3}|\d{5,7})(?:\.\d+)?"
# name, pattern, value group, base confidence
REVENUE: tuple[tuple[str, str, int, float], ...] = (
    ("total_block", r"total\s+revenue\s*\n\s*(" + _REVENUE + r")", 1, 0.96),
    ("block", r"revenue\s*\n\s*(" + _REVENUE + r")", 1, 0.93),
    ("block_note_next_line", r"revenue\s*\n\s*\d{1,3}\s*\n\s*(" + _REVENUE + r")", 1, 0.91),
    ("block_decimal_ref_next_line", r"revenue\s*\n\s*\d{1,2}\.\d{1,3}\s*\n\s*(" + _REVENUE + r")", 1, 0.92),
    ("inline_note_same_line", r"revenue\s+\d{1,3}\s+(" + _REVENUE + r")", 1, 0.92),
    ("inline_decimal_ref", r"revenue\s+\d{1,2}\.\d{1,3}\s+(" + _REVENUE + r")", 1, 0.92),
    (
        "consolidated_col3",
        r"revenue\s+(?:from\s+operations\s+)?(" + _REVENUE + r")\s+" + _REVENUE + r"\s+(" + _REVENUE + r")",
        2, 0.89,
    ),
    ("inline_broad", r"revenue[\s\n]+(" + _REVENUE + r")", 1, 0.75),
)
FINANCIAL_PAGE_BONUS = 0.04
REVENUE_MAX_CONFIDENCE = 0.99

SKIP_WORDING: tuple[str, ...] = (
    "csr details", "section 135", "business responsibility and sustainability",
    "brsr", "material topics", "esg vision", "sustainability report",
)
FORCE_WORDING: tuple[str, ...] = ("intensity per rupee", "intensity per rupee of turnover")
FINANCIAL_WORDING: tuple[str, ...] = (
    "statement of profit", "income statement", "profit and loss",
    "consolidated statement", "standalone statement", "financial highlights",
    "revenue from operations",
)

INTENSITY = (
    r"intensity\s+per\s+rupee\s+(?:of\s+)?(?:turnover|operations)?"
    r"[^\n]{0,250}\n?\s*(0\.\d+|[1-9]\d*\.?\d*(?:[eE][+-]?\d+)?)\b"
)
_TOTAL = r"\d{1,3}(?:,\d{2,3})+"
# kind, pattern for the total near an intensity, confidence; in search order
TOTALS: tuple[tuple[str, str, float], ...] = (
    ("energy", r"total\s+energy\s+consum(?:ed|ption)[^\n]{0,120}\n?\s*(" + _TOTAL + r"(?:\.\d+)?)", 0.91),
    ("water", r"total\s+(?:volume\s+of\s+water\s+consumption|water\s+consumption)[^\n]{0,120}\n?\s*(" + _TOTAL + r"(?:\.\d+)?)", 0.85),
    ("ghg", r"total\s+scope\s*1\s+and\s+scope\s*2\s+emissions[^\n]{0,80}([\d,]+(?:\.\d+)?)", 0.82),
    ("waste", r"(?:^|\n)\s*total\s*\([a-h\s+]+\)[^\n]{0,180}\n?\s*(" + _TOTAL + r"(?:\.\d+)?)", 0.78),
)
TOTAL_WINDOW = 1500
CONSENSUS_SPREAD = 0.03
CONSENSUS_STEP = 0.03
CONSENSUS_MAX = 0.97
CROSS_CHECK_SPREAD = 0.02
CROSS_CHECK_BONUS = 0.02
REGEX_TRUSTED = 0.90
