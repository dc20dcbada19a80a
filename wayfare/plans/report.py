"""HTML report of the marts: what was loaded, promise error by store beside the pooled average, breach rates
by day, and the verdicts of the last batch. What is collected is one row for each store, store and day, or gate."""

from __future__ import annotations

import math
import re
from html import escape

from pyspark.sql import functions as F

from wayfare.operators import marts
from wayfare.sources import lake
from wayfare.sources.warehouse import Warehouse

TEMPLATE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>
<p>{bronze} messages landed, {silver} rows kept, {collapsed} collapsed or rejected, {quarantined} quarantined, {trips} trips.</p>
<p>{measured} measured trips; mean error {pooled} minutes.</p>{line}
<table><tr><th>store<th>trips<th>mean error<th>absolute<th>p50<th>p90<th>late</tr>{rows}</table>
<p>Days that all stores report: {shared}. Breach rate by day, up to {top}:</p>{days}
<table><tr><th>state<th>trips</tr>{states}</table><table><tr><th>stage<th>check<th>verdict<th>observed<th>expected</tr>{gates}</table></body></html>"""
WIDTH, HEIGHT = 600, 120


def render(template: str, values: dict[str, str]) -> str:
    """Fill {lower_snake} places; a missing value raises KeyError."""
    return re.sub(r"\{([a-z_]+)\}", lambda m: values[m[1]], template)


def axis_top(value: float) -> float:
    """The least of 1, 2, 2.5 and 5 times a power of ten that isn't below value; 1 for none."""
    if value <= 0:
        return 1.0
    unit = 10.0 ** math.floor(math.log10(value))
    return next((f * unit for f in (1, 2, 2.5, 5, 10) if f * unit >= value * (1 - 1e-12)))


def number_line(marks: dict[str, float]) -> str:
    """The marks on one scale, which takes in 0."""
    low, high = min(0.0, *marks.values()), max(0.0, *marks.values())
    top = axis_top(max(high, -low))
    left = -top if low < 0 else 0.0

    def at(value: float) -> float:
        return round((value - left) / (top - left) * WIDTH, 1)

    shown = "".join(
        f'<circle cx="{at(v)}" cy="30" r="4"/><text x="{at(v)}" y="{16 if i % 2 else 52}" text-anchor="middle">{escape(k)} {v:+.2f}</text>' for i, (k, v) in enumerate(marks.items())
    )
    return f'<svg viewBox="0 0 {WIDTH} 60"><line x1="0" x2="{WIDTH}" y1="30" y2="30" stroke="black"/>{shown}</svg>'


def day_chart(rates: dict[str, list[float | None]], top: float) -> str:
    """A line for each series over the same days; days without a value are left out of its line."""
    out = []
    for i, (name, own) in enumerate(rates.items()):
        points = " ".join(f"{round((k + 0.5) / len(own) * WIDTH, 1)},{round(HEIGHT * (1 - v / top), 1)}" for k, v in enumerate(own) if v is not None)
        out.append(f'<polyline fill="none" stroke="black" stroke-dasharray="{4 * i},{2 * i}" points="{points}"><title>{escape(name)}</title></polyline>')
    return f'<svg viewBox="0 0 {WIDTH} {HEIGHT}">{"".join(out)}</svg>'


def build(warehouse: Warehouse, title: str = "Delivery promise", root: str | None = None) -> str:
    """Refuses missing marts, fewer than two stores, and a lake (root) without rows: a count that can't
    find its input gives no number."""
    for name in ("fct_trip", "mart_store_daily", "mart_promise_error"):
        if not warehouse.exists(name):
            raise FileNotFoundError(f"{name} has not been built")
    fact, spark = warehouse.table("fct_trip"), warehouse.spark
    stores = warehouse.table("mart_promise_error").orderBy(F.desc("mean_signed_error_minutes"), "store_id").collect()
    if len(stores) < 2:
        raise ValueError("a comparison takes two stores")
    root = root or warehouse.root.removesuffix("/warehouse")
    bronze, silver = (lake.read_days(spark, f"{root}/{layer}", "value string, dt string").count() for layer in ("bronze", "silver"))
    if not bronze or not silver:
        raise FileNotFoundError(f"no lake under {root}: {bronze} and {silver} rows")
    pooled = marts.pooled_error(marts.staging(fact)).first()
    daily = warehouse.table("mart_store_daily")
    shared = marts.shared_days(daily, len(stores)).count()
    rates = {(r.store_id, r.date_key): r.breach_rate for r in daily.where("breach_rate is not null").collect()}
    dates = sorted({d for _, d in rates})
    top = axis_top(max(rates.values(), default=0.0))
    states = fact.groupBy("completeness").count().orderBy("completeness").collect()
    gates = warehouse.latest_audit().collect() if warehouse.exists("run_audit") else []
    cells = lambda *x: "<tr>" + "".join(f"<td>{escape(str(c))}" for c in x) + "</tr>"
    marks = {"pooled": pooled.mean_signed_error_minutes} | {s.store_id: s.mean_signed_error_minutes for s in stores}
    return render(
        TEMPLATE,
        {
            "title": escape(title),
            "bronze": f"{bronze:,}",
            "silver": f"{silver:,}",
            "collapsed": f"{bronze - silver:,}",
            "quarantined": f"{warehouse.count('quarantine') if warehouse.exists('quarantine') else 0:,}",
            "trips": f"{fact.count():,}",
            "measured": f"{pooled.trips_measured:,}",
            "pooled": f"{pooled.mean_signed_error_minutes:+.2f}",
            "line": number_line(marks),
            "rows": "".join(cells(s.store_id, s.trips_measured, s.mean_signed_error_minutes, s.mean_absolute_error_minutes, s.p50_error_minutes, s.p90_error_minutes, s.breach_rate) for s in stores),
            "shared": str(shared),
            "top": f"{top:.0%}",
            "days": day_chart({s.store_id: [rates.get((s.store_id, d)) for d in dates] for s in stores}, top),
            "states": "".join(cells(*s) for s in states),
            "gates": "".join(cells(g.stage, g.check_name, "passed" if g.passed else f"failed ({g.severity})", g.observed, g.expected) for g in gates),
        },
    )
