"""Statuses of ledger entries and of listed resources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ledger statuses with (settled, gate).
STATUSES = {
    "done": (True, False),
    "absent": (True, False),
    "skipped": (True, False),
    "not-applicable": (True, False),
    "reference-cleared": (True, True),
    "reference-absent": (True, True),
    "errored": (False, False),
    "forbidden": (False, False),
    "pending": (False, True),
}
# Final statuses by kind of resource; any other is not final.
TERMINAL = {
    "run": ["applied", "canceled", "discarded", "errored", "planned_and_finished", "policy_soft_failed", "force_canceled"],
    "state_version": ["finalized", "discarded", ""],
    "stack_configuration": ["completed", "failed"],
    "deployment_run": ["succeeded", "failed", "abandoned"],
}


def status_settled(status: Column) -> Column:
    """A re-run leaves it alone."""
    return F.coalesce(status.isin([s for s, (settled, _) in STATUSES.items() if settled]), F.lit(False))


def status_gate(status: Column) -> Column:
    """It marks a reference of a run, not an object."""
    return F.coalesce(status.isin([s for s, (_, gate) in STATUSES.items() if gate]), F.lit(False))


def status_valid(status: Column) -> Column:
    """It is one of the nine."""
    return F.coalesce(status.isin(list(STATUSES)), F.lit(False))


def is_terminal(kind: Column, status: Column) -> Column:
    """The resource won't change any more; unknown kinds and statuses are not final."""
    known = F.lit(False)
    for k, finals in TERMINAL.items():
        known = known | ((kind == k) & status.isin(finals))
    return F.coalesce(known, F.lit(False))


def classify_error(http_status: Column, message: Column, cause: Column) -> Column:
    """transient, terminal, forbidden or unknown, of a failed attempt; causes are not_found, canceled, timeout, reset, rate_limited."""
    text = F.coalesce(message, F.lit(""))
    raw = F.regexp_extract(text, r"\Aerror HTTP response:\s+([0-9]+)(?:\s|\z)", 1)
    # A whole line says so: a path or a detail that merely holds the word doesn't.
    refused = F.exists(F.split(F.lower(text), "\n"), lambda x: F.trim(x, F.lit(" \t\r")).isin("forbidden", "403 forbidden"))
    return (
        F.when((http_status == 404) | (cause == "not_found"), "terminal")
        .when(cause.isin("canceled", "timeout", "reset", "rate_limited") | (http_status == 429), "transient")
        .when((http_status == 403) | refused, "forbidden")
        .when(raw == "404", "terminal")
        .when(raw == "403", "forbidden")
        .otherwise("unknown")
    )
