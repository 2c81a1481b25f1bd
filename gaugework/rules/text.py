"""Rules for cleaning, tokenising and chunking text.

Fixed values.
"""

from __future__ import annotations

STOP_WORDS: tuple[str, ...] = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "has", "have", "had", "will", "would", "could", "should", "may", "might",
    "that", "this", "these", "those", "it", "its", "as", "not", "no", "our",
    "we", "their", "they", "he", "she", "his", "her", "which", "who", "also",
)
# Short words that are kept all the same
SHORT_TERMS: tuple[str, ...] = (
    "ghg", "co2", "nox", "sox", "esg", "kl", "mwh", "gwh", "gj", "tj",
    "fte", "csr", "epi", "re", "pv",
)
# Wording of a label whose value may stand in the next chunk
LABEL_WORDING: tuple[str, ...] = (
    "scope 1", "scope 2", "scope 3", "total scope",
    "total energy", "energy consumed", "energy consumption",
    "water consumption", "water consumed",
    "waste generated", "total waste",
    "ghg emission", "greenhouse gas", "carbon",
    "tco2e", "tco2", "co2e",
    "employee", "headcount", "workforce",
    "csr expenditure", "csr spend",
)

NUMBER = r"\b\d[\d,\.]*\b"
DATA_NUMBER = r"\b\d[\d,]*\d{2,}\b|\b\d{3,}\b"
# Two repeats decide it; more cannot change the answer
ADJACENT_NUMBERS = r"(\b[\d,]+(?:\.\d+)?\b[\s|,]{0,10}){2}"
UNIT_WORD = r"\b(tco2e?|t\s*co2e?|mwh|gwh|gj|tj|kl|mt|metric\s*tonn?\w*|%|crore|lakh)\b"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
FOOTNOTE_START = r"^[\d\*†‡§¹²³]"

WORDS_PER_TOKEN = 0.75
MAX_TOKENS = 500
MIN_TOKENS = 200
MERGED_FACTOR = 1.5
OVERLAP_SENTENCES = 1
MIN_BLOCK_CHARS = 30
MIN_SPATIAL_CHARS = 20
MIN_TABLE_CELLS = 4
FOOTNOTE_TOP = 0.85
FOOTNOTE_MAX_CHARS = 200
TABLE_NUMERIC_SHARE = 0.30
