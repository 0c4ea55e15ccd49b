"""Chart specifications as plain dictionaries, from aggregates; rendering is left to whoever shows them.

A chart of rows holds at most `most` of them, chosen by a hash, and says so;
limits and summaries are of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 2000


def layer(mark: str, rows: list[dict], **encoding) -> dict:
    return {"mark": mark, "data": rows, "encoding": encoding}


def chart(title: str, layers: list[dict], x: str, y: str, **more) -> dict:
    return {"title": title, "x": {"title": x}, "y": {"title": y}, "layers": layers, **more}


def points(df: DataFrame, columns: Sequence[str], most: int = MOST) -> tuple[list[dict], bool]:
    """Rows to be drawn, and whether some were left out."""
    rows = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(most + 1).collect()
    return [r.asDict() for r in rows[:most]], len(rows) > most


def scatter(df: DataFrame, x: str, y: str, title: str = "", most: int = MOST) -> dict:
    rows, more = points(df, [x, y], most)
    return chart(title, [layer("point", rows, x=x, y=y)], x, y, sampled=more)


def with_limits(spec: dict, **limits: float) -> dict:
    """Horizontal lines by name."""
    return {**spec, "layers": [*spec["layers"], *(layer("rule", [{"y": v}], y="y", name=k) for k, v in limits.items())]}


def control_chart(df: DataFrame, order: str, value: str, target: float, s: float, title: str = "") -> dict:
    return with_limits(scatter(df, order, value, title), target=target, lcl=target - 3 * s, ucl=target + 3 * s)


def bars(names: Sequence[str], values: Sequence[float], title: str = "", x: str = "", y: str = "") -> dict:
    return chart(title, [layer("bar", [{"name": n, "value": float(v)} for n, v in zip(names, values, strict=True)], x="name", y="value")], x, y)


def pareto(names: Sequence[str], values: Sequence[float], title: str = "Effects") -> dict:
    order = sorted(zip(names, values, strict=True), key=lambda t: -abs(t[1]))
    return bars([n for n, _ in order], [abs(v) for _, v in order], title, "effect", "size")


def boxes(stats: DataFrame, group: str, title: str = "") -> dict:
    """Boxes from box_statistics()."""
    return chart(title, [layer("box", [r.asDict() for r in stats.orderBy(group).collect()], x=group)], group, "value")


def score_plot(scores: DataFrame, a: str = "t1", b: str = "t2", ellipse=None, title: str = "Scores") -> dict:
    spec = scatter(scores, a, b, title)
    if ellipse is not None:
        spec["layers"].append(layer("line", [{a: float(p), b: float(q)} for p, q in ellipse], x=a, y=b))
    return spec


def to_plotly(spec: dict) -> dict:
    """The same as traces and a layout."""
    kinds = {"point": {"type": "scatter", "mode": "markers"}, "line": {"type": "scatter", "mode": "lines"}, "bar": {"type": "bar"}, "box": {"type": "box"}, "rule": {"type": "scatter", "mode": "lines"}}
    traces = [kinds[one["mark"]] | {"x": [r.get(one["encoding"].get("x")) for r in one["data"]], "y": [r.get(one["encoding"].get("y")) for r in one["data"]]} for one in spec["layers"]]
    return {"data": traces, "layout": {"title": {"text": spec["title"]}, "xaxis": spec["x"], "yaxis": spec["y"]}}


def to_echarts(spec: dict) -> dict:
    kinds = {"point": "scatter", "line": "line", "bar": "bar", "box": "boxplot", "rule": "line"}
    series = [{"type": kinds[one["mark"]], "data": [[r.get(one["encoding"].get("x")), r.get(one["encoding"].get("y"))] for r in one["data"]]} for one in spec["layers"]]
    return {"title": {"text": spec["title"]}, "xAxis": {"name": spec["x"]["title"]}, "yAxis": {"name": spec["y"]["title"]}, "series": series}
