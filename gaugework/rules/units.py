"""Unit tables: extraction synonyms and conversion factors per category.

Fixed values.
"""

from __future__ import annotations

# Category -> canonical unit
CANONICAL: dict[str, str] = {
    "energy": "GJ",
    "ghg": "tCO2e",
    "water": "KL",
    "waste": "MT",
    "revenue": "INR_Crore",
    "count": "count",
    "percentage": "%",
}

# Units as written in reports -> unit used by the extractor
SYNONYMS: dict[str, str] = {
    "tco2e": "tCO2e", "tco2": "tCO2e", "t co2e": "tCO2e",
    "mtco2e": "tCO2e", "mt co2e": "tCO2e",
    "ktco2e": "tCO2e", "kt co2e": "tCO2e",
    "tonnes co2e": "tCO2e", "tons co2e": "tCO2e",
    "mwh": "MWh", "gwh": "GWh", "twh": "TWh",
    "gj": "GJ", "tj": "TJ", "pj": "PJ",
    "kwh": "kWh", "mj": "MJ",
    "kl": "KL", "kilolitre": "KL", "kiloliter": "KL", "kilo litre": "KL",
    "m3": "m³", "cubic meter": "m³", "cubic metre": "m³",
    "mt": "MT", "metric ton": "MT", "metric tonne": "MT",
    "kg": "kg", "tonne": "MT",
    "%": "%", "percent": "%", "per cent": "%",
    "inr crore": "INR Crore", "crore": "INR Crore", "cr": "INR Crore",
    "inr lakh": "INR Lakh", "lakh": "INR Lakh",
    "number": "count", "nos": "count", "headcount": "count",
}

# Category -> unit -> factor to the canonical unit
FACTORS: dict[str, dict[str, float]] = {
    "energy": {
        "j": 1e-9, "kj": 1e-6, "mj": 1e-3, "gj": 1.0, "tj": 1e3, "pj": 1e6,
        "wh": 3.6e-6, "kwh": 3.6e-3, "mwh": 3.6, "gwh": 3600.0, "twh": 3600000.0,
        "megajoule": 1e-3, "megajoules": 1e-3,
        "gigajoule": 1.0, "gigajoules": 1.0,
        "terajoule": 1e3, "terajoules": 1e3,
        "megawatt hour": 3.6, "megawatt hours": 3.6,
        "gigawatt hour": 3600.0, "gigawatt hours": 3600.0,
        "kilowatt hour": 3.6e-3, "kilowatt hours": 3.6e-3,
        "btu": 1.0551e-6, "mmbtu": 1.0551,
    },
    "ghg": {
        "tco2e": 1.0, "tco2": 1.0, "t co2e": 1.0, "t co2": 1.0,
        "tonne co2e": 1.0, "tonnes co2e": 1.0, "ton co2e": 1.0, "tons co2e": 1.0,
        "metric tonne co2e": 1.0, "metric tonnes co2e": 1.0,
        "metric ton co2e": 1.0, "metric tons co2e": 1.0,
        "tons of co equivalent": 1.0,
        "metric tonnes of co2 equivalent": 1.0,
        "metric tonnes of co2equivalent": 1.0,
        "metric tonnes co2 equivalent": 1.0,
        "tonnes of co2 equivalent": 1.0, "tonnes co2 equivalent": 1.0,
        "tonne of co2 equivalent": 1.0,
        "co2 equivalent": 1.0, "co2e": 1.0,
        "ktco2e": 1e3, "kt co2e": 1e3, "ktco2": 1e3, "kt co2": 1e3,
        "kilo tonne co2e": 1e3, "kilotonne co2e": 1e3, "kilotonnes co2e": 1e3,
        "thousand tonnes co2e": 1e3, "thousand metric tonnes co2e": 1e3,
        "million tonnes co2e": 1e6, "million tonne co2e": 1e6,
        "million metric tonnes co2e": 1e6, "million metric tonne co2e": 1e6,
        "million tonnes of co2e": 1e6,
        "million tonnes of co2 equivalent": 1e6, "million tonne co2 equivalent": 1e6,
        "million tons co2e": 1e6, "million ton co2e": 1e6,
        "mtco2e": 1e6, "mt co2e": 1e6, "mtco2": 1e6, "mt co2": 1e6,
        "million tonnes coe": 1e6, "million co2e": 1e6,
        "ghg": 1.0, "t ghg": 1.0,
    },
    "water": {
        "kl": 1.0, "kilolitre": 1.0, "kilolitres": 1.0, "kiloliter": 1.0, "kiloliters": 1.0,
        "kilo litre": 1.0, "kilo litres": 1.0,
        "m3": 1.0, "m³": 1.0,
        "cubic meter": 1.0, "cubic meters": 1.0, "cubic metre": 1.0, "cubic metres": 1.0,
        "ml": 0.001, "millilitre": 0.001,
        "litre": 0.001, "litres": 0.001, "liter": 0.001, "liters": 0.001, "l": 0.001,
        "ml3": 1e3, "megalitres": 1e3, "megaliters": 1e3,
        "million litre": 1e3, "million litres": 1e3,
        "million liter": 1e3, "million liters": 1e3,
    },
    "waste": {
        "mt": 1.0, "metric tonne": 1.0, "metric tonnes": 1.0, "metric ton": 1.0,
        "metric tons": 1.0, "tonne": 1.0, "tonnes": 1.0, "ton": 1.0, "tons": 1.0, "t": 1.0,
        "kg": 0.001, "kilogram": 0.001, "kilograms": 0.001,
        "kt": 1e3, "kilotonne": 1e3, "kilotonnes": 1e3,
        "thousand tonnes": 1e3, "lakh tonnes": 1e5,
    },
    "revenue": {
        "inr crore": 1.0, "crore": 1.0, "crores": 1.0, "cr": 1.0,
        "rs crore": 1.0, "rs. crore": 1.0,
        "inr lakh": 0.01, "lakh": 0.01, "lakhs": 0.01,
        "inr": 1e-7, "rupee": 1e-7, "rupees": 1e-7,
        "usd million": 83.0, "million usd": 83.0, "$ million": 83.0,
        "usd billion": 83000.0, "billion usd": 83000.0,
    },
    "count": {
        "count": 1.0, "headcount": 1.0, "number": 1.0, "nos": 1.0,
        "employees": 1.0, "persons": 1.0, "people": 1.0, "workers": 1.0,
        "complaints": 1.0, "grievances": 1.0, "cases": 1.0,
    },
    "percentage": {"%": 1.0, "percent": 1.0, "per cent": 1.0, "percentage": 1.0},
}

# Words dropped from the front / end of a unit when the whole unit is unknown
UNIT_PREFIXES: tuple[str, ...] = ("metric ", "total ", "absolute ")
UNIT_SUFFIXES: tuple[str, ...] = (" equivalent", " emissions", " emission")

# Metric name -> category, exact
CATEGORY_EXACT: dict[str, str] = {
    "energy_consumption": "energy", "total_energy_consumption": "energy",
    "scope_1_emissions": "ghg", "scope_2_emissions": "ghg", "scope_3_emissions": "ghg",
    "total_ghg_emissions": "ghg", "ghg_emissions": "ghg",
    "water_consumption": "water", "total_water_consumption": "water",
    "waste_generated": "waste", "total_waste_generated": "waste",
    "revenue": "revenue", "revenue_from_operations": "revenue",
    "employee_count": "count", "complaints_filed": "count", "complaints_pending": "count",
    "women_in_workforce_percentage": "percentage", "renewable_energy_percentage": "percentage",
}

# Part of a metric name -> category, first that fits
CATEGORY_PARTS: tuple[tuple[str, str], ...] = (
    ("scope_1", "ghg"), ("scope_2", "ghg"), ("scope_3", "ghg"),
    ("scope 1", "ghg"), ("scope 2", "ghg"), ("scope 3", "ghg"),
    ("ghg", "ghg"), ("emission", "ghg"), ("co2", "ghg"),
    ("energy", "energy"),
    ("water", "water"),
    ("waste", "waste"),
    ("revenue", "revenue"), ("turnover", "revenue"),
    ("employee", "count"), ("headcount", "count"),
    ("complaint", "count"), ("grievance", "count"),
    ("women", "percentage"), ("female", "percentage"),
    ("renewable", "percentage"), ("percent", "percentage"),
)
