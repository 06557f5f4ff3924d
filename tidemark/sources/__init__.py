"""Extraction jobs: raw scrape payloads to sample rows.

Every job keeps the scrape's columns (all but `payload`), adds `name`, `seq`,
`tags`, `value_raw`, `value` and `value_kind`, and uses column expressions only.
A payload is expanded in place, so no job shuffles.
"""
