"""Registry of the core queries and of their SQL oracles."""

from __future__ import annotations

from fitloom.plans import corpus, matching, texts, whole

#: Queries of ``whole`` whose operators ``corpus`` runs over the same documents and more.
COVERED = {f"whole_{n}" for n in ("clean_heading", "strip_bullet", "date_ranges", "years_requirement", "education_detect", "seniority_detect", "rounding")}
QUERIES = matching.QUERIES | texts.QUERIES | {n: f for n, f in whole.QUERIES.items() if n not in COVERED} | corpus.QUERIES
ORACLES = matching.ORACLES | texts.ORACLES | whole.ORACLES | corpus.ORACLES
