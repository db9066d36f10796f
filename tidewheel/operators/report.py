"""Markdown over small collected tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def table(rows: DataFrame | Sequence[Sequence], columns: Sequence[str] | None = None, places: int = 2) -> str:
    """A Markdown table; doubles to `places`, nulls as a dash. A DataFrame should be a handful of rows."""
    if isinstance(rows, DataFrame):
        columns, rows = rows.columns, rows.collect()
    cell = lambda v: "-" if v is None else f"{v:,.{places}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [columns, ["---"] * len(columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def sections(title: str, parts: dict[str, DataFrame | str]) -> str:
    """A report of named parts, tables or text."""
    return "\n\n".join([f"# {title}", *(f"## {n}\n\n{p if isinstance(p, str) else table(p)}" for n, p in parts.items())]) + "\n"


def duration(seconds: float) -> str:
    """Hours and minutes, or minutes and seconds under an hour."""
    minutes, s = divmod(int(max(0, seconds)), 60)
    return f"{minutes // 60}h{minutes % 60:02d}m" if minutes >= 60 else f"{minutes}m{s:02d}s"


def recommendations(facts: dict[str, float]) -> list[str]:
    """What the figures of an analysis advise; facts that are missing advise nothing."""
    f = facts.get
    out = []
    if f("random_siblings", 0) > 0.05:
        out.append("Split by date: a random split leaves most test rows a sibling of the same day in training.")
    if f("effective_series", 99) < 0.5 * f("entities", 0):
        out.append("Count days, not rows: the entities move as far fewer series.")
    if f("rare_levels", 0):
        out.append("Some levels have too few days or episodes to be scored alone; report their support.")
    if f("persistence_macro_f1") is not None:
        out.append(f"Beat persistence (macro-F1 {f('persistence_macro_f1'):.3f}) on the same folds before anything else.")
    if f("useful_lags", 1) == 0:
        out.append("Lags add nothing beyond today's value and the season; start without them.")
    if f("slope_per_100") is not None and abs(f("slope_per_100")) > 0.2:
        out.append("Elevation matters within cells; keep it as a feature.")
    if f("missing", 0) or f("gaps", 0):
        out.append("Mend missing values and gaps first; lags and targets skip over them.")
    if f("shared_vectors", 0) > 0.5:
        out.append("Many rows of a day are alike; weight days, or keep one city a cell.")
    if f("city_share") is not None and f("city_share") < 0.05:
        out.append("The city explains little; leave it out unless a model without it scores lower.")
    if f("lag1_adjusted", 0) > 0.3:
        out.append("Yesterday tells much beyond the season; leave days between training and test out.")
    if f("focus_days_in_test") is not None and f("focus_days_in_test") < 30:
        out.append("Too few days of the level that matters lie in the test span; start it earlier.")
    if f("skewed", 0):
        out.append("Some measures are skewed; take logarithms before scaling.")
    return out
