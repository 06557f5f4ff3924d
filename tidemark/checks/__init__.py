"""Checks: one extraction job and one recipe list per kind of monitored service."""

from tidemark.checks import bean_services, document_services, exposition_services, text_services
from tidemark.checks.registry import (
    Check,
    Recipe,
    enabled_recipes,
    extract_all,
    recipe_table,
    register,
    registered,
    run_checks,
    run_with_events,
)

__all__ = [
    "Check", "Recipe", "enabled_recipes", "extract_all", "recipe_table", "register", "registered", "run_checks", "run_with_events",
    "bean_services", "document_services", "exposition_services", "text_services",
]
