"""Guards and choices over column names, made before any job runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Parts of names that must never enter a morphology model.
FORBIDDEN = (
    "oct4", "oct_4", "oct-4", "af488", "yap", "experimental_group",
    "ha_exposure", "ha_concentration", "seeding_density", "culture_day",
    "treatment", "time", "dose", "replicate", "sample",
)


def refuse_leakage(columns: list[str], forbidden: tuple[str, ...] = FORBIDDEN) -> None:
    """Raises if a feature's name holds a forbidden part."""
    bad = sorted(c for c in columns if any(f in c.lower() for f in forbidden))
    if bad:
        raise ValueError(f"features that would leak: {bad}")


def switched(features: list[str], switches: dict[str, bool], least: int = 2) -> list[str]:
    """The features that are on; unknown names, values that aren't booleans, and too few features are errors."""
    if unknown := sorted(set(switches) - set(features)):
        raise KeyError(f"unknown features: {unknown}")
    if odd := sorted(k for k, v in switches.items() if not isinstance(v, bool)):
        raise TypeError(f"switches must be true or false: {odd}")
    on = [f for f in features if switches.get(f, True)]
    if len(on) < least:
        raise ValueError(f"at least {least} features are needed")
    return on


def resolved(columns: list[str], specs: list[dict]) -> list[dict]:
    """Each spec (name, candidates, required, log1p, weight) with the first of its candidates that exists."""
    out, missing = [], []
    for s in specs:
        column = next((c for c in s["candidates"] if c in columns), None)
        if column is not None:
            out.append({"log1p": False, "weight": 1.0} | s | {"column": column})
        elif s.get("required", False):
            missing.append(s["name"])
    if missing:
        raise KeyError(f"no column for: {sorted(missing)}")
    return out


def common_numeric(a: DataFrame, b: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN) -> list[str]:
    """Numeric columns of both tables, without forbidden ones, sorted."""
    numeric = lambda df: {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return sorted(c for c in numeric(a) & numeric(b) if not any(f in c.lower() for f in forbidden))


def prefer_physical(columns: list[str]) -> list[str]:
    """Without the pixel columns whose twin in micrometres exists."""
    twin = lambda c: {re.sub(r"_px(2?)$", r"_um\1", c)} if re.search(r"_px2?$", c) else {f"{c}_um", f"{c}_um2"}
    return [c for c in columns if not twin(c) & (set(columns) - {c})]


def canonical(column: str) -> str:
    """A name without unit and filler, by which columns of the same meaning are found."""
    name = re.sub(r"[^a-z0-9]+", "_", column.lower()).strip("_")
    return re.sub(r"_(px|um)2?$", "", re.sub(r"^(nucleus|nuclear|cell)_", "", name))


def same_meaning(columns: list[str]) -> dict[str, list[str]]:
    """Canonical names that several columns share."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(canonical(c), []).append(c)
    return {k: v for k, v in groups.items() if len(v) > 1}


def split_intensity(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Shape columns and intensity columns as two tables that share the keys."""
    light = [c for c in df.columns if c not in keys and ("intensity" in c.lower() or c.lower().startswith("is_bright"))]
    return df.drop(*light), df.select(*keys, *light)


def picked(columns: list[str], exact: list[str], keywords: list[str]) -> str | None:
    """The first exact name that exists, else the name with the best keywords (earlier ones count more), shortest first."""
    for e in exact:
        for c in columns:
            if c.lower() == e.lower():
                return c
    scored = [(-sum(100 - i for i, k in enumerate(keywords) if k in c.lower()), len(c), c) for c in columns]
    scored = [s for s in scored if s[0] < 0]
    return min(scored)[2] if scored else None


def abbreviated(columns: list[str], tokens: dict[str, str]) -> dict[str, str]:
    """Short names by token, made unique by a number."""
    out, seen = {}, {}
    for c in columns:
        short = "_".join(tokens.get(t, t) for t in c.split("_"))
        seen[short] = seen.get(short, 0) + 1
        out[c] = short if seen[short] == 1 else f"{short}_{seen[short]}"
    return out
