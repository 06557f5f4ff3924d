"""Fleet telemetry analytics as Spark jobs.

Raw scrape payloads become one long table of metric samples; rates, deltas,
label sums, quantiles, health events and encoded points are derived from it
with DataFrame operators.
"""

from tidemark.session import build_session, configure

__all__ = ["build_session", "configure"]
