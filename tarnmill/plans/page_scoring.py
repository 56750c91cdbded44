"""Checks of crawl and page-scoring configurations before they become expressions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def _whole(value: Any, name: str, least: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or (least is not None and value < least):
        raise ValueError(f"{name}: a whole number" + (f" of {least} or more" if least is not None else ""))
    return value


def _bounds(value: Any, name: str) -> None:
    if not isinstance(value, Mapping):
        raise ValueError(f"{name}: an object")
    for k in ("lt", "gte"):
        if value.get(k) is not None and (isinstance(value[k], bool) or not isinstance(value[k], (int, float))):
            raise ValueError(f"{name}.{k}: a number")


def checked_scoring(config: Mapping[str, Any]) -> dict[str, Any]:
    """The configuration, or ValueError naming the first thing wrong with it."""
    out = dict(config)
    _whole(out.get("base_score", 0), "base_score")
    _whole(out.get("keyword_cap", 0), "keyword_cap", 0)
    for group in ("title_keywords", "body_keywords", "url_keywords"):
        for word, points in (out.get("rules") or {}).get(group, {}).items():
            _whole(points, f"rules.{group}.{word}")
    for section in ("thresholds", "structure_rules"):
        for name, rules in (out.get(section) or {}).items():
            for rule in [rules] if isinstance(rules, Mapping) else rules:
                _bounds(rule, f"{section}.{name}")
                _whole(rule.get("score", 0), f"{section}.{name}.score")
    for name, rule in (out.get("decisions") or {}).items():
        if name not in ("pass", "review", "reject"):
            raise ValueError(f"decisions.{name}: pass, review or reject")
        _bounds(rule, f"decisions.{name}")
    if out.get("filter_mode", "score_only") not in ("score_only", "active_filter"):
        raise ValueError("filter_mode: score_only or active_filter")
    return out


def checked_crawl(config: Mapping[str, Any]) -> dict[str, Any]:
    """A crawl rule with its lists lower-cased, or ValueError."""
    out = dict(config)
    for name in ("same_domain_only", "include_root_page"):
        if not isinstance(out.get(name, True), bool):
            raise ValueError(f"{name}: true or false")
    _whole(out.get("max_depth"), "max_depth", 1)
    _whole(out.get("max_pages"), "max_pages", 1)
    for name in ("priority_keywords", "deprioritize_keywords"):
        words = out.get(name) or []
        if not all(isinstance(w, str) for w in words):
            raise ValueError(f"{name}: texts")
        out[name] = [w.strip().lower() for w in words if w.strip()]
    return out
