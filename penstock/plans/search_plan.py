"""A typed search plan: validated, lowered to filters, executed; the one call to a language model is injected."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lists import fact_filter
from ..operators.search import search_facts

VERSION = "0.1"
FIELDS = ("vendor", "fact_type", "currency", "country", "date_from", "date_to", "amount_min", "amount_max", "category")
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def validate(plan: dict, context: dict[str, set]) -> dict:
    """The plan with a list of ungrounded values; a structural fault raises."""
    if not isinstance(plan, dict) or plan.get("version", VERSION) != VERSION:
        raise ValueError("not a plan of this version")
    filters = plan.get("filters") or {}
    unknown = set(filters) - set(FIELDS)
    if unknown or not isinstance(plan.get("query_text", ""), str):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    for k in ("date_from", "date_to"):
        if filters.get(k) and not _DATE.match(str(filters[k])):
            raise ValueError(f"{k} is not an ISO date")
    flags = [f"{k}={v}" for k, v in filters.items() if k in context and v and v not in context[k]]
    return {**plan, "filters": filters, "ungrounded": flags}


def lower(plan: dict) -> dict:
    """Plain parameters; the limit is clamped to 1..200."""
    f = {k: v for k, v in (plan.get("filters") or {}).items() if v not in (None, "")}
    return {"filters": {k: v for k, v in f.items() if k != "category"}, "category": f.get("category"), "query_text": plan.get("query_text") or "", "limit": max(1, min(200, int(plan.get("limit") or 20)))}


def execute(plan: dict, facts: DataFrame, items: DataFrame) -> DataFrame:
    """Filters win over the text. A category filters a pool of min(200, 4 * limit) newest facts, so it may return fewer than there are."""
    p = lower(plan)
    rows = facts.where(fact_filter(p["filters"])) if p["filters"] or p["category"] or not p["query_text"] else search_facts(facts, items, p["query_text"])
    order = [F.desc("event_date"), F.col("id")]
    if p["category"]:
        pool = rows.orderBy(*order).limit(min(200, 4 * p["limit"]))
        rows = pool.join(items.where(F.col("category") == p["category"]).select(F.col("fact_id").alias("id")), "id", "left_semi")
    return rows.orderBy(*order).limit(p["limit"])


def compile_and_search(text: str, facts: DataFrame, items: DataFrame, context: dict[str, set], llm: Callable[[str], dict]) -> tuple[dict, DataFrame]:
    plan = validate(llm(text), context)
    return plan, execute(plan, facts, items)
