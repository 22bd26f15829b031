"""The confidence model; the rule-dependent part is a constant of each rule, computed once on the driver."""

from __future__ import annotations

#: Confidence where neither a method nor its category is configured.
DEFAULT = 0.5


def for_regex(base: float, pattern: str | None = None, has_context: bool = False) -> float:
    """A long pattern (over 80 characters) adds 0.15, a short one (under 30) takes 0.1 but leaves 0.1; context adds 0.1."""
    out = base
    if pattern is not None:
        share = len(pattern) / 100
        out = min(out + 0.15, 1.0) if share > 0.8 else max(out - 0.1, 0.1) if share < 0.3 else out
    return min(out + 0.1, 1.0) if has_context else out


def for_matcher(base: float, accuracy: float | None = None, structured: bool = False) -> float:
    out = base if accuracy is None else (base + accuracy) / 2
    return min(out + 0.1, 1.0) if structured else out


def for_morphology(base: float, tags: int = 0, capital: bool = False) -> float:
    out = min(base + 0.1, 1.0) if tags > 1 else base
    return min(out + 0.05, 1.0) if capital else out


def for_phrase(words: int, partial: bool = False) -> float:
    """A phrase of more words is surer, up to 0.99; a partial one by 0.1 less."""
    return min(0.99, 0.95 + min(0.04, 0.01 * words) - (0.1 if partial else 0.0))
