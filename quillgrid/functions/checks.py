"""Argument checks: every operator raises ValueError before it builds a plan."""

import math


def positive(name: str, value: float) -> float:
    if isinstance(value, bool) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be a finite number above 0, got {value!r}")
    return float(value)


def whole(name: str, value: int, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}, got {value!r}")
    return value


def share(name: str, value: float) -> float:
    if isinstance(value, bool) or not 0 < value < 1:
        raise ValueError(f"{name} must lie strictly between 0 and 1, got {value!r}")
    return float(value)


def one_of(name: str, value: str, choices: tuple[str, ...]) -> str:
    if value not in choices:
        raise ValueError(f"{name} must be one of {choices}, got {value!r}")
    return value
