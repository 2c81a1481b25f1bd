"""Rules for judging search results.

Fixed values.
"""

from __future__ import annotations

# Types that can be returned, best first
TYPE_ORDER: tuple[str, ...] = ("Integrated", "ESG")

# Query templates per type
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("BRSR", "{company} BRSR {past_year}-{year_short} filetype:pdf"),
    ("ESG", "{company} sustainability report {past_year}-{year_short} filetype:pdf"),
    ("Integrated", "{company} annual report {past_year}-{year_short} filetype:pdf"),
)

# Words in a company name that do not identify it
NAME_STOP_WORDS: tuple[str, ...] = (
    "the", "and", "of", "for", "from", "limited", "ltd", "inc",
    "corp", "corporation", "private", "pvt", "services", "solutions",
    "technologies", "technology", "india", "group", "holdings",
    "international", "global", "company", "enterprises", "industries",
)
NAME_WORD_MIN = 5
NAME_PHRASE_MIN = 6

# Slug of a name -> other wording it is known by
NAME_ALIASES: dict[str, tuple[str, ...]] = {
    "tcs": ("tata consultancy", "tcs.com"),
    "infosys": ("infosys",),
    "wipro": ("wipro",),
    "hcl": ("hcltech", "hcl technologies"),
    "bpcl": ("bharat petroleum",),
    "hpcl": ("hindustan petroleum",),
    "iocl": ("indianoil", "indian oil"),
    "ongc": ("ongcindia",),
    "ntpc": ("ntpclimited",),
    "sail": ("steelauthority",),
    "gail": ("gailonline",),
    "sbi": ("statebankofin",),
    "itc": ("itcportal",),
    "ltim": ("ltimindtree",),
    "kennametal": ("kennametal",),
}

# Report type wording, first type that fits
TYPE_WORDING: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("ESG", (
        "esg report", "esg-report",
        "sustainability report", "sustainability-report",
        "csr report", "csr-report",
        "environmental report", "environmental-report",
        "responsible business report",
        "corporate responsibility report",
        "corporate sustainability report",
    )),
    ("Integrated", (
        "annual report", "annual-report", "annualreport",
        "integrated report", "integrated-report",
        "integrated annual",
    )),
)
# Optional rule, tried before the others when switched on
BRSR_WORDING: tuple[str, ...] = ("brsr", "business responsibility")
