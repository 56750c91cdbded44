"""Rule scores of pages: a validated configuration becomes one expression tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_score(target: Column, points: Mapping[str, Any] | None) -> Column:
    """Each keyword at most once, as a substring without regard to case."""
    lowered, total = F.lower(F.coalesce(target, F.lit(""))), F.lit(0)
    for word, value in (points or {}).items():
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            total = total + F.when((lowered != "") & lowered.contains(str(word).lower()), int(value)).otherwise(0)
    return total


def threshold_score(value: Column, rules: Sequence[Mapping[str, Any]] | Mapping[str, Any] | None) -> Column:
    """The sum of the rules whose bounds (`lt`, `gte`, both optional) hold."""
    rules = [rules] if isinstance(rules, Mapping) else list(rules or [])
    total = F.lit(0)
    for rule in rules:
        holds = F.lit(True)
        if rule.get("lt") is not None:
            holds = holds & (value < float(rule["lt"]))
        if rule.get("gte") is not None:
            holds = holds & (value >= float(rule["gte"]))
        total = total + F.when(holds, int(rule.get("score", 0))).otherwise(0)
    return total


def matches(score: Column, bounds: Mapping[str, Any] | None) -> Column:
    """Whether a decision's bounds hold; a decision without bounds holds always."""
    bounds, holds = bounds or {}, F.lit(True)
    if bounds.get("gte") is not None:
        holds = holds & (score >= int(bounds["gte"]))
    if bounds.get("lt") is not None:
        holds = holds & (score < int(bounds["lt"]))
    return holds


def short_line_ratio(text: Column, most: int = 20) -> Column:
    """The share of lines (cut at full stops and line ends) of at most `most` characters, to four places."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[。\n\r]+"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.round(F.size(F.filter(lines, lambda x: F.length(x) <= most)) / F.size(lines), 4)).otherwise(F.lit(0.0))


def judge(config: Mapping[str, Any], *, url: Column, title: Column, text: Column, features: Mapping[str, Column]) -> dict[str, Column]:
    """score, decision and is_usable of a page.

    The rules named text_density and sentence_ratio are given the text length and the short-line ratio, as the service
    that this library replaces does.
    """
    rules, limits, structure = (config.get(k) or {} for k in ("rules", "thresholds", "structure_rules"))
    words = keyword_score(title, rules.get("title_keywords")) + keyword_score(text, rules.get("body_keywords")) + keyword_score(url, rules.get("url_keywords"))
    cap = int(config.get("keyword_cap") or 0)
    score = F.lit(int(config.get("base_score") or 0)) + (F.least(words, F.lit(cap)) if cap > 0 else words)
    length, short = features["text_length"].cast("double"), features["short_line_ratio"]
    density = F.when(length > 0, F.round(features["link_count"] / F.greatest(length, F.lit(1.0)), 4)).otherwise(F.lit(0.0))
    for value, found in ((length, limits.get("min_text_length")), (length, limits.get("text_length_bonus")), (density, limits.get("link_density")), (short, limits.get("short_line_ratio"))):
        score = score + threshold_score(value, found)
    fed = {"paragraph_count": features["paragraph_count"], "heading_count": features["heading_count"], "text_density": length, "sentence_ratio": short}
    fed |= {k: features[k] for k in ("link_only_block_ratio", "nav_like_block_ratio")}
    for name, value in fed.items():
        score = score + threshold_score(value.cast("double"), structure.get(name))
    score = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
    decisions, decision = config.get("decisions") or {}, F.lit(config.get("default_decision") or "reject")
    for name in ("reject", "review", "pass"):
        decision = F.when(matches(score, decisions.get(name)), name).otherwise(decision)
    usable = ["pass"] if config.get("filter_mode") == "active_filter" else ["pass", "review"]
    return {"score": score, "decision": decision, "is_usable": decision.isin(*usable).cast("int")}
