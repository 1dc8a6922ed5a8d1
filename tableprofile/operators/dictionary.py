"""Keyword dictionaries: categories of terms to look for in text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

# Short examples of our own; callers pass their lists. Country names come from the caller's
# geo dimension.
COMPLIANCE = ["GDPR", "HIPAA", "SOX", "PCI DSS", "SOC 2", "NIST 800-53", "ISO 9001", "ISO 27001"]
REGIONS = ["APAC", "EMEA", "LATAM", "Global"]
BUSINESS_UNITS = ["HR", "IT", "Finance", "Legal", "Marketing", "Sales", "Training", "Payroll", "Procurement",
                  "Human Resources", "Quality Assurance", "Client Services", "Business Development"]


def parse_keywords(text: str) -> list[str]:
    """Comma-separated keywords, stripped, empties dropped."""
    return [part.strip() for part in text.split(",") if part.strip()]


def unique_keywords(keywords: list[str]) -> list[str]:
    """One entry per spelling ignoring case; the last spelling wins."""
    last: dict[str, str] = {}
    for word in keywords:
        if word.strip():
            last[word.strip().lower()] = word.strip()
    return list(last.values())


class Dictionary:
    """Category name -> keywords. Changes return a new dictionary."""

    def __init__(self, categories: dict[str, list[str]] | None = None):
        self.categories = {c: unique_keywords(k) for c, k in (categories or {}).items()}

    def add(self, category: str, keywords: list[str]) -> "Dictionary":
        if not category or not unique_keywords(keywords):
            raise ValueError("a category needs a name and at least one keyword")
        if category in self.categories:
            raise ValueError(f"category {category!r} already exists")
        return Dictionary({**self.categories, category: keywords})

    def replace(self, category: str, keywords: list[str]) -> "Dictionary":
        if category not in self.categories:
            raise KeyError(category)
        return Dictionary({**self.categories, category: keywords})

    def remove(self, category: str) -> "Dictionary":
        if category not in self.categories:
            raise KeyError(category)
        return Dictionary({c: k for c, k in self.categories.items() if c != category})

    def entries(self, match_joined: bool = False) -> list["Entry"]:
        out = []
        for category, words in self.categories.items():
            for word in words:
                out.append(Entry(category, word, word.lower()))
                if match_joined and " " in word:
                    out.append(Entry(category, word, word.lower().replace(" ", "")))
        return out


def built_in(countries: list[str], regions: list[str] | None = None, compliance: list[str] | None = None,
             business_units: list[str] | None = None) -> Dictionary:
    """The four standard categories."""
    return Dictionary({
        "Countries": countries,
        "Regions": REGIONS if regions is None else regions,
        "Compliance": COMPLIANCE if compliance is None else compliance,
        "Business Units": BUSINESS_UNITS if business_units is None else business_units,
    })


# What cannot stand next to a keyword: letters, and number signs that are no digits.
NO_BOUNDARY = r"\p{L}\p{Nl}\p{No}"


@dataclass(frozen=True)
class Entry:
    """One searched form of a keyword, in lower case."""

    category: str
    keyword: str
    form: str

    @property
    def anchor(self) -> str | None:
        """The longest letter run: inside a bounded match it is a whole letter run of the text."""
        runs = ["".join(run) for letters, run in groupby(self.form, str.isalpha) if letters]
        return max(runs, key=len) if runs else None

    @property
    def pattern(self) -> str:
        literal = re.sub(r"([^\w\s])", r"\\\1", self.form)
        return f"(^|[^{NO_BOUNDARY}]){literal}([^{NO_BOUNDARY}]|$)"
