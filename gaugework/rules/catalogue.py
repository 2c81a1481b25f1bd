"""Metric catalogue: what is looked for in a report, and how.

Fixed values.  The names, units, bounds, keywords, aliases and patterns below
are data that results depend on; they are stated as they must be matched.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Metric:
    """One row of the metric catalogue."""

    name: str
    display_name: str
    category: str
    subcategory: str
    expected_unit: str
    valid_min: float | None
    valid_max: float | None
    keywords: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    is_active: bool = True

    def first_words(self) -> list[str]:
        return [k.lower().split()[0] for k in self.keywords]

    def single_words(self) -> list[str]:
        """Every word of the keywords and aliases, lower case, once."""
        words = (w.lower() for phrase in self.keywords + self.aliases for w in phrase.split())
        return list(dict.fromkeys(words))

    def query_phrases(self) -> list[str]:
        """Phrases used to query a vector index for this metric."""
        return [
            self.display_name,
            f"{self.display_name} {self.expected_unit}",
            *self.keywords[:3],
            *self.aliases[:3],
        ]


# --------------------------------------------------------------------------
# Default metrics
# --------------------------------------------------------------------------
METRICS: tuple[Metric, ...] = (
    Metric(
        "scope_1_emissions", "Scope 1 GHG Emissions", "Environmental", "Emissions",
        "tCO2e", 0.0, 1e8,
        keywords=(
            "scope 1", "direct emissions", "direct ghg", "tCO2e",
            "metric tonnes CO2", "GHG emissions scope 1",
            "greenhouse gas emission", "total scope",
        ),
        patterns=(
            r"total\s+scope\s*1\s+emissions[\s\S]{0,150}?equivalent\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"scope[\s\-]*1[\s\S]{0,80}?([\d,]+(?:\.\d+)?)(?:\(\d+\))?\s*(tco2e?|t\s*co2e?|metric\s*tonnes?\s*(?:of\s*)?co2)",
            r"scope\s*1\s+emissions?\s+(?:were|was|of|:)\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?\s*(tco2e?|t\s*co2)",
        ),
        aliases=(
            "scope 1", "direct emissions", "direct ghg", "fuel combustion",
            "stationary combustion", "owned vehicles", "fugitive emissions",
        ),
    ),
    Metric(
        "scope_2_emissions", "Scope 2 GHG Emissions", "Environmental", "Emissions",
        "tCO2e", 0.0, 1e8,
        keywords=(
            "scope 2", "indirect emissions", "purchased electricity", "tCO2e",
            "market-based", "location-based", "GHG emissions scope 2",
            "greenhouse gas emission", "total scope",
        ),
        patterns=(
            r"total\s+scope\s*2\s+emissions[\s\S]{0,150}?equivalent\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"scope[\s\-]*2[\s\S]{0,80}?([\d,]+(?:\.\d+)?)(?:\(\d+\))?\s*(tco2e?|t\s*co2e?|metric\s*tonnes?\s*(?:of\s*)?co2)",
            r"scope\s*2\s+emissions?\s+(?:were|was|of|:)\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?\s*(tco2e?|t\s*co2)",
        ),
        aliases=(
            "scope 2", "indirect emissions", "purchased electricity",
            "electricity consumption ghg", "market-based", "location-based",
        ),
    ),
    Metric(
        "total_ghg_emissions", "Total GHG Emissions (Scope 1+2)", "Environmental", "Emissions",
        "tCO2e", 0.0, 1e9,
        keywords=(
            "total GHG", "scope 1 and scope 2", "total scope 1 and 2",
            "carbon neutral", "greenhouse gas", "tCO2e total",
        ),
        patterns=(
            r"total\s+(?:ghg|greenhouse\s+gas)\s+emissions[\s\S]{0,80}?([\d,]+(?:\.\d+)?)\s*(tco2e?|t\s*co2e?|mt\s*co2e?)",
            r"scope\s*1\s+and\s+scope\s*2[\s\S]{0,80}?([\d,]+(?:\.\d+)?)\s*(tco2e?|t\s*co2e?)",
            r"(?:carbon|ghg)\s+footprint[\s\S]{0,60}?([\d,]+(?:\.\d+)?)\s*(tco2e?|t\s*co2e?)",
        ),
        aliases=(
            "total emissions", "total ghg", "scope 1 and 2", "scope 1+2",
            "combined emissions", "carbon footprint", "co2 equivalent",
            "greenhouse gas", "ghg inventory", "carbon neutral",
        ),
    ),
    Metric(
        "energy_consumption", "Total Energy Consumption", "Environmental", "Energy",
        "GJ", 100.0, 1e13,
        keywords=(
            "total energy consumed", "energy consumption", "GJ", "gigajoules",
            "energy intensity", "A + B + C + D + E + F",
            "total energy consumption", "energy used", "electricity consumed",
            "fuel consumed", "MWh", "GWh", "energy use",
        ),
        patterns=(
            r"total\s+energy\s+consumed\s*\([A-Za-z+\s]+\)[\s\S]{0,10}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"total\s+energy\s+consumed[^\n]{0,50}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"total\s+energy\s+(?:consumption|consumed)[^\n]{0,60}?([\d,]+(?:\.\d+)?)\s*(gj|gwh|mwh|tj|kwh|mj)",
            r"energy\s+consumption\s+(?:was|of|:)\s*([\d,]+(?:\.\d+)?)\s*(gj|gwh|mwh|tj|kwh|mj)",
            r"total\s+energy\s+used[^\n]{0,60}?([\d,]+(?:\.\d+)?)\s*(gj|gwh|mwh|tj|kwh|mj)",
            r"electricity\s+consumed[^\n]{0,60}?([\d,]+(?:\.\d+)?)\s*(mwh|gwh|kwh|gj)",
        ),
        aliases=(
            "total energy", "energy consumed", "energy use", "energy usage",
            "electricity consumed", "fuel consumed", "energy intensity",
            "gigajoules", "megawatt hours", "energy consumption",
            "total energy consumed", "total energy consumption",
            "energy used", "electricity consumption", "fuel consumption",
            "power consumption", "thermal energy", "renewable energy consumed",
            "non-renewable energy", "energy from grid",
        ),
    ),
    Metric(
        "renewable_energy_percentage", "Renewable Energy Percentage", "Environmental", "Energy",
        "%", 50.0, 100.0,
        keywords=(
            "renewable energy", "solar energy", "wind energy", "clean energy",
            "green energy", "renewable electricity", "non-fossil", "re share",
            "percent renewable", "% renewable",
            "share of renewables", "renewables", "met through renewables",
            "from renewable sources", "electricity from renewable",
            "renewable sources electricity", "solar pv", "green power",
            "electricity from renewables", "renewables in our operations",
        ),
        patterns=(
            r"renewable\s+energy[\s\S]{0,80}?([\d]+(?:\.\d+)?)\s*%",
            r"([\d]+(?:\.\d+)?)\s*%[\s\S]{0,40}?(?:from\s+)?renewable",
            r"renewable[\s\S]{0,40}?([\d]+(?:\.\d+)?)\s*percent",
            r"([\d]+(?:\.\d+)?)\s*%\s+of\s+(?:our\s+)?(?:\w+\s+){0,5}electricity[^\n]{0,150}renew\w*",
            r"([\d]+(?:\.\d+)?)\s*%[^\n]{0,150}?(?:electricity|power)[^\n]{0,150}?from\s+renewable\s+sources?",
            r"share\s+of\s+renew\w*[^\n]{0,80}?([\d]+(?:\.\d+)?)\s*%",
            r"([\d]+(?:\.\d+)?)\s*%[^\n]{0,120}met\s+through\s+renew\w*",
            r"([\d]+(?:\.\d+)?)\s*%[\s\S]{0,250}?from\s+renewable\s+sources?",
            r"([\d]+(?:\.\d+)?)\s*%[\s\S]{0,200}comes?\s+from\s+renew\w*",
            r"renew(?:able\s+sources?|ables?|able\s+energy)\b[^\n]{0,120}([\d]{2,}(?:\.\d+)?)\s*%",
            r"(?:solar|wind|hydro|geotherm\w+)\s+energy[^\n]{0,80}?([\d]+(?:\.\d+)?)\s*%",
        ),
        aliases=(
            "renewable energy", "solar energy", "wind energy", "clean energy",
            "green energy", "renewable electricity", "non-fossil", "re share",
            "percent renewable", "% renewable",
            "share of renewables", "renewables", "met through renewables",
            "from renewable", "electricity from renewable",
            "renewable sources", "solar pv", "green power",
        ),
    ),
    Metric(
        "water_consumption", "Total Water Consumption", "Environmental", "Water",
        "KL", 0.0, 1e12,
        keywords=(
            "water consumption", "total volume of water consumption",
            "water withdrawal", "KL", "kilolitres", "kl",
            "total water", "water intake", "water used",
            "water withdrawn", "freshwater", "ground water",
            "surface water", "municipal water", "water sourced",
        ),
        patterns=(
            r"total\s+volume\s+of\s+water\s+consumption[^\n]{0,60}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"total\s+water\s+consumption[^\n]{0,60}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"total\s+water\s+withdrawn[^\n]{0,60}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"total\s+water\s+(?:intake|sourced|used)[^\n]{0,60}\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"water\s+consumption[^\n]{0,60}?([\d,]+(?:\.\d+)?)\s*(kl|kilolitr\w*|m3)",
            r"([\d,]+(?:\.\d+)?)\s*(kl|kilolitr\w*)\s*[\s\S]{0,30}?water\s+consumption",
            r"net\s+water\s+consumption[^\n]{0,60}?([\d,]+(?:\.\d+)?)\s*(kl|kilolitr\w*|m3)",
        ),
        aliases=(
            "water consumed", "water usage", "water use", "water withdrawal",
            "freshwater", "water recycled", "water intensity", "kilolitres",
            "water consumption", "total water", "water intake",
            "water used", "total water intake", "water withdrawn",
            "water abstraction", "water sourced", "ground water",
            "surface water", "municipal water", "third party water",
            "total freshwater consumption", "water discharge",
            "net water consumption", "water footprint",
        ),
    ),
    Metric(
        "waste_generated", "Total Waste Generated", "Environmental", "Waste",
        "MT", 0.0, 1e9,
        keywords=(
            "total waste generated", "waste generated", "A + B + C + D + E + F + G + H",
            "metric tonnes", "MT", "hazardous waste", "non-hazardous",
        ),
        patterns=(
            r"total\s*\(A\s*\+\s*B[\s+A-Za-z]*\)\s*\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"^total\s*\([a-h\s\+]+\)\s*\n([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"total\s+waste\s+generated[^\n]{0,60}\n[^\n]{0,60}\n([\d,]+(?:\.\d+)?)",
            r"total\s+waste\s+(?:generated|produced)[^\n]{0,60}?([\d,]+(?:\.\d+)?)\s*(mt|metric\s*tonn?\w*|tonne\w*)",
            r"([\d,]+(?:\.\d+)?)\s*(mt|metric\s*tonn?\w*)\s*[\s\S]{0,40}?waste",
        ),
        aliases=(
            "waste generated", "total waste", "solid waste", "hazardous waste",
            "non-hazardous waste", "waste disposed", "waste diverted",
        ),
    ),
    Metric(
        "employee_count", "Total Employees", "Social", "Workforce",
        "headcount", 1.0, 5e6,
        keywords=(
            "total employees", "workforce", "headcount", "FTE",
            "permanent employees", "employee strength",
        ),
        patterns=(
            r"total\s+(?:number\s+of\s+)?employees[\s\S]{0,40}?([\d,]+)\s*(?:nos|number|headcount|employees|$|\n)",
            r"workforce\s+(?:size|strength|count|of)[\s\S]{0,40}?([\d,]+)",
            r"([\d,]+)\s+(?:permanent\s+)?employees\s+(?:as\s+of|globally|worldwide|in\s+india)",
            r"total\s+headcount[\s\S]{0,40}?([\d,]+)",
        ),
        aliases=(
            "total employees", "total workforce", "number of employees",
            "headcount", "fte", "full time", "permanent employees",
            "workforce strength", "employee base",
        ),
    ),
    Metric(
        "women_in_workforce_percentage", "Women in Workforce (%)", "Social", "Diversity",
        "%", 0.0, 100.0,
        keywords=(
            "women", "female", "gender diversity", "gender ratio",
            "women employees", "female workforce",
        ),
        patterns=(
            r"women[\s\S]{0,60}?([\d]+(?:\.\d+)?)\s*%",
            r"female[\s\S]{0,60}?([\d]+(?:\.\d+)?)\s*%",
            r"([\d]+(?:\.\d+)?)\s*%[\s\S]{0,30}?(?:women|female)",
        ),
        aliases=(
            "women", "female", "gender diversity", "women employees",
            "female employees", "gender ratio", "women in workforce",
        ),
    ),
    Metric(
        "scope_3_emissions", "Scope 3 GHG Emissions", "Environmental", "Emissions",
        "tCO2e", 0.0, 1e10,
        keywords=(
            "scope 3", "scope-3", "scope iii",
            "value chain emissions", "upstream emissions", "downstream emissions",
            "supply chain emissions", "indirect value chain",
            "total scope 3", "scope 3 ghg", "scope 3 tco2e",
            "purchased goods and services", "business travel emissions",
            "employee commute", "use of sold products",
            "end-of-life treatment", "capital goods",
            "transportation and distribution",
            "other indirect emissions",
        ),
        patterns=(
            r"total\s+scope\s*3\s+emissions.{0,200}?metric\s+tonnes\s+of\s+([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"total\s+scope\s*3\s+emissions[\s\S]{0,300}?equivalent\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"scope\s*3\s+(?:ghg\s+)?emissions[^\n]{0,80}\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"total\s+value\s+chain\s+emissions[^\n]{0,80}\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"other\s+indirect\s+\(scope\s*3\)[^\n]{0,80}\n\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?",
            r"scope[\s\-]*3[\s\S]{0,100}?([\d,]+(?:\.\d+)?)(?:\(\d+\))?\s*(tco2e?|t\s*co2e?|metric\s*tonnes?\s*(?:of\s*)?co2)",
            r"scope\s*3\s+emissions?\s+(?:were|was|of|:|amount\w*\s+to)\s*([\d,]+(?:\.\d+)?)(?:\(\d+\))?\s*(tco2e?|t\s*co2)",
            r"total\s+scope\s*3\s+emissions[^\n]*\n[^\n]*equivalent[^\n]*\n\s*([\d,]+(?:\.\d+)?)(?:\s*\(\d+\))?",
            r"total\s+scope\s*3\s+emissions[^\n]{0,400}?\b([\d]{1,3}(?:,\d{2,3})+(?:\.\d+)?)\b",
            r"scope\s*3\s+(?:ghg\s+)?emissions[^\n]{0,100}?([\d]{1,3}(?:,\d{2,3})+(?:\.\d+)?)\s*(?:tco2e?|metric\s*tonn\w*)",
        ),
        aliases=(
            "scope 3", "scope-3",
            "indirect value chain ghg", "supply chain emissions",
            "scope 3 category", "business travel emissions",
            "purchased goods and services", "use of sold products",
            "capital goods emissions", "transportation and distribution",
            "processing of sold products", "franchises",
            "upstream scope 3", "downstream scope 3",
            "total scope 3", "scope 3 tco2e",
            "other indirect emissions", "indirect ghg scope 3",
            "scope 3 carbon", "scope 3 footprint",
        ),
    ),
    Metric(
        "complaints_filed", "Total Complaints Filed", "Social", "Governance",
        "count", 0.0, 1_000_000.0,
        keywords=(
            "complaints filed", "complaints received",
            "number of complaints filed", "number of complaints received",
            "complaints filed during the year", "grievances filed",
            "grievances received", "complaints lodged",
            "filed during the year", "sexual harassment complaints",
            "BRSR complaints", "stakeholder complaints",
            "working conditions complaints", "health and safety complaints",
            "NGRBC complaints", "complaints grievances",
        ),
        patterns=(
            r"filed\s+during\s+(?:the\s+)?year[^\n]{0,60}?[:\s]+(\d[\d,]*)",
            r"number\s+of\s+complaints?\s+filed[^\n]{0,100}?(\d[\d,]+)",
            r"(\d[\d,]+)\s+complaints?\s+(?:were\s+)?filed",
            r"complaints?\s+received[^\n]{0,60}?[:\s]+(\d[\d,]+)",
            r"(?:employees?\s+and\s+workers?|customers?|shareholders?)[^\n]{0,150}?(\d[\d,]+)\s+\d+",
            r"complaints?\s+filed[^\n]{0,80}?[:\s]+(\d[\d,]+)",
            r"total\s+complaints?\s+(?:filed|received)[^\n]{0,80}?(\d[\d,]+)",
            r"(\d[\d,]+)\s+complaints?\s+(?:lodged|raised|reported|submitted)",
            r"(?:working\s+conditions?|health\s+and\s+safety)[^\n]{0,60}?(\d+)\s+\d+",
            r"grievances?\s+(?:filed|received)[^\n]{0,80}?[:\s]+(\d[\d,]+)",
        ),
        aliases=(
            "complaints filed", "complaints received",
            "number of complaints filed", "complaints filed during the year",
            "grievances filed", "grievances received", "complaints lodged",
            "filed during the year", "sexual harassment complaints",
            "stakeholder complaints", "working conditions complaints",
            "ngrbc complaints",
            "employees and workers", "shareholders", "customers",
            "filed during", "pending resolution",
        ),
    ),
    Metric(
        "complaints_pending", "Total Complaints Pending", "Social", "Governance",
        "count", 0.0, 100_000.0,
        keywords=(
            "complaints pending", "pending complaints",
            "pending resolution", "complaints pending resolution",
            "pending at close of year", "pending at end of year",
            "unresolved complaints", "grievances pending",
            "complaints not resolved", "complaints outstanding",
            "pending resolution at close", "complaints pending at year end",
            "number of complaints pending", "pending grievances",
            "NGRBC complaints pending",
        ),
        patterns=(
            r"pending\s+resolution\s+at\s+(?:close|end)[^\n]{0,100}?(\d[\d,]*)",
            r"complaints?\s+pending\s+(?:resolution\s+)?[^\n]{0,60}?[:\s]+(\d[\d,]*)",
            r"(\d[\d,]*)\s+(?:complaints?\s+)?(?:are\s+)?pending\b",
            r"(?:employees?\s+and\s+workers?|customers?|shareholders?)[^\n]{0,150}?\d[\d,]+\s+(\d+)",
            r"(\d[\d,]*)\s+(?:complaints?\s+)?(?:were\s+)?pending\s+at\s+(?:year|the\s+(?:end|close))",
            r"(?:pending|outstanding)[^\n]{0,40}?[:\s]+(\d+)",
            r"complaints?\s+pending[^\n]{0,80}?[:\s]+(\d+)",
            r"total\s+(?:complaints?\s+)?pending[^\n]{0,80}?(\d+)",
            r"close\s+of\s+the\s+year[^\n]{0,20}\n\s*(\d+)",
            r"grievances?\s+pending[^\n]{0,80}?[:\s]+(\d+)",
        ),
        aliases=(
            "complaints pending", "pending complaints",
            "pending resolution", "complaints pending resolution",
            "pending at close of year", "pending at end of year",
            "unresolved complaints", "grievances pending",
            "pending resolution at close",
            "employees and workers", "shareholders", "customers",
            "filed during", "close of the year",
        ),
    ),
)

METRIC_NAMES: tuple[str, ...] = tuple(m.name for m in METRICS)
BY_NAME: dict[str, Metric] = {m.name: m for m in METRICS}
