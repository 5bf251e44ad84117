"""Figures as SVG text, from small collected tables: group means, a correlation matrix, a sweep."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

WIDTH, HEIGHT, LEFT, BOTTOM, TOP = 720, 420, 60, 60, 40
COLOURS = ["#4269d0", "#efb118", "#3ca951", "#ff725c", "#a463f2"]


def _svg(title: str, parts: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, f'<text x="{LEFT}" y="20" font-size="14">{escape(title)}</text>', *parts, "</svg>"])


def _text(x: float, y: float, text: str, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(text)}</text>'


def _line(x1: float, y1: float, x2: float, y2: float, colour: str = "#333") -> str:
    return f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="{colour}"/>'


def _up(value: float, low: float, high: float) -> float:
    return HEIGHT - BOTTOM - (value - low) / (high - low) * (HEIGHT - BOTTOM - TOP)


def _scale(low: float, high: float, steps: int = 4) -> list[str]:
    out = [_line(LEFT, TOP, LEFT, HEIGHT - BOTTOM), _line(LEFT, HEIGHT - BOTTOM, WIDTH - 20, HEIGHT - BOTTOM)]
    for k in range(steps + 1):
        value = low + (high - low) * k / steps
        out.append(_text(LEFT - 8, _up(value, low, high) + 4, f"{value:.2g}", "end"))
    return out


def _legend(names: list[str]) -> list[str]:
    out = []
    for k, name in enumerate(names):
        y = TOP + 14 * k
        out += [f'<rect x="{WIDTH - 150}" y="{y - 9}" width="10" height="10" fill="{COLOURS[k % len(COLOURS)]}"/>', _text(WIDTH - 135, y, name, "start")]
    return out


def group_bars(means: DataFrame, group: str = "discipline", low: float = 1.0, high: float = 5.0) -> str:
    """Bars of a group's mean in each dimension, with a standard error up and down. means: group, dimension, mean, sem."""
    rows = means.collect()  # a row for each group and dimension
    groups, dims = sorted({str(r[group]) for r in rows}), sorted({r.dimension for r in rows})
    room = (WIDTH - LEFT - 170) / max(1, len(dims))
    wide = room * 0.8 / max(1, len(groups))
    parts = _scale(low, high)
    for r in rows:
        x = LEFT + 10 + room * dims.index(r.dimension) + wide * groups.index(str(r[group]))
        y, colour = _up(r["mean"], low, high), COLOURS[groups.index(str(r[group])) % len(COLOURS)]
        parts.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{wide * 0.9:.1f}" height="{HEIGHT - BOTTOM - y:.1f}" fill="{colour}"/>')
        sem = r["sem"] or 0.0
        parts.append(_line(x + wide * 0.45, _up(r["mean"] - sem, low, high), x + wide * 0.45, _up(r["mean"] + sem, low, high)))
    parts += [_text(LEFT + 10 + room * (k + 0.4), HEIGHT - BOTTOM + 18, d[:14]) for k, d in enumerate(dims)]
    return _svg("Means by group", parts + _legend(groups))


def correlation_map(pairs: DataFrame) -> str:
    """Squares of a correlation matrix, darker for stronger. pairs: a, b, r."""
    rows = pairs.collect()  # a row for each pair of columns
    names = list(dict.fromkeys(x for r in rows for x in (r.a, r.b)))
    found = {(r.a, r.b): r.r for r in rows} | {(r.b, r.a): r.r for r in rows} | {(x, x): 1.0 for x in names}
    side = (HEIGHT - TOP - BOTTOM) / max(1, len(names))
    parts = []
    for i, a in enumerate(names):
        parts += [_text(LEFT + 110, TOP + side * (i + 0.6), a[:18], "end"), _text(LEFT + 120 + side * (i + 0.5), HEIGHT - BOTTOM + 16, a[:9])]
        for j, b in enumerate(names):
            r = found[a, b]
            shade = 255 - int(200 * min(1.0, abs(r or 0.0)))
            fill = f"rgb({shade},{shade},255)" if (r or 0.0) >= 0 else f"rgb(255,{shade},{shade})"
            x, y = LEFT + 120 + side * j, TOP + side * i
            parts += [f'<rect x="{x:.1f}" y="{y:.1f}" width="{side:.1f}" height="{side:.1f}" fill="{fill}"/>', _text(x + side / 2, y + side / 2 + 4, "" if r is None else f"{r:.2f}")]
    return _svg("Correlations", parts)


def sweep_curves(summary: DataFrame) -> str:
    """Median CFI and RMSEA by sample size, with the quartiles of CFI. summary: as `controls.fit_sweep_summary`."""
    rows = summary.orderBy("N").collect()  # a row for each size
    most = max((r.N for r in rows), default=1)
    at = lambda n: LEFT + 10 + (WIDTH - LEFT - 180) * n / most
    parts = [*_scale(0.0, 1.0), *_legend(["CFI", "RMSEA"])]
    for k, name in enumerate(("cfi_median", "rmsea_median")):
        points = [(at(r.N), _up(r[name], 0.0, 1.0)) for r in rows if r[name] is not None]
        parts.append(f'<polyline fill="none" stroke="{COLOURS[k]}" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in points)}"/>')
    parts += [_line(at(r.N), _up(r.cfi_q25, 0, 1), at(r.N), _up(r.cfi_q75, 0, 1), COLOURS[0]) for r in rows if r.cfi_q25 is not None]
    return _svg("Fit by sample size", parts + [_text(at(r.N), HEIGHT - BOTTOM + 18, str(r.N)) for r in rows])
