"""Plots as SVG text, without a plotting library: histories, sizes of clusters, heat maps, trees of merges.

All take small data that is on the driver. Marks carry a title, which viewers show when pointed at. Colours are light or
dark with the viewer's setting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape

# fixed values: colours of surface, text, grid, mark, second mark, and of negative, neutral and positive numbers
_LIGHT = {"surface": "#fcfcfb", "ink": "#0b0b0b", "soft": "#52514e", "grid": "#e1e0d9", "mark": "#2a78d6", "low": "#e34948", "mid": "#f0efec"}
_DARK = {"surface": "#1a1a19", "ink": "#ffffff", "soft": "#c3c2b7", "grid": "#383835", "mark": "#3987e5", "low": "#e66767", "mid": "#383835"}
LEFT, TOP, RIGHT, BOTTOM = 64, 40, 16, 40


def _page(width: float, height: float, title: str, body: list[str]) -> str:
    style = "".join(f".f-{k}{{fill:{v}}}.s-{k}{{stroke:{v};fill:none}}" for k, v in _LIGHT.items())
    dark = "".join(f".f-{k}{{fill:{v}}}.s-{k}{{stroke:{v}}}" for k, v in _DARK.items())
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}" width="{width:g}" height="{height:g}" role="img" aria-label="{escape(title, True)}" font-family="system-ui, sans-serif" font-size="12">'
    css = f"<style>{style}text{{fill:{_LIGHT['soft']}}}@media(prefers-color-scheme:dark){{{dark}text{{fill:{_DARK['soft']}}}}}</style>"
    return "\n".join([head, css, f'<rect class="f-surface" width="{width:g}" height="{height:g}"/>', f'<text class="f-ink" x="{LEFT}" y="22" font-size="14" font-weight="600">{escape(title)}</text>', *body, "</svg>\n"])


def _ticks(low: float, high: float, n: int = 5) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def _axis(low: float, high: float, y, width: float) -> list[str]:
    return [x for v in _ticks(low, high) for x in (f'<line class="s-grid" x1="{LEFT}" x2="{width - RIGHT}" y1="{y(v):.1f}" y2="{y(v):.1f}"/>', f'<text x="{LEFT - 8}" y="{y(v) + 4:.1f}" text-anchor="end">{v:.4g}</text>')]


def history(rows: Sequence[tuple[int, float, float]], title: str = "Loss by trial", width: int = 720, height: int = 320) -> str:
    """rows: trial, loss, best so far. Losses are dots, the best so far is a line, named at its end."""
    if not rows:
        return _page(width, height, title, [f'<text x="{LEFT}" y="{height / 2}">no completed trial</text>'])
    low, high = min(r[1] for r in rows), max(r[1] for r in rows)
    low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    first, last = rows[0][0], max(rows[-1][0], rows[0][0] + 1)
    x = lambda t: LEFT + (t - first) / (last - first) * (width - LEFT - RIGHT - 80)
    y = lambda v: TOP + (high - v) / (high - low) * (height - TOP - BOTTOM)
    line = " ".join(f"{x(t):.1f},{y(b):.1f}" for t, _, b in rows)
    dots = [f'<circle class="f-soft" cx="{x(t):.1f}" cy="{y(v):.1f}" r="4" opacity="0.55"><title>trial {t}: loss {v:.6g}, best {b:.6g}</title></circle>' for t, v, b in rows]
    ends = [f'<text class="f-ink" x="{x(rows[-1][0]) + 8:.1f}" y="{y(rows[-1][2]) + 4:.1f}">best {rows[-1][2]:.4g}</text>', f'<text x="{x(first):.1f}" y="{height - 14}">trial {first}</text>', f'<text x="{x(rows[-1][0]):.1f}" y="{height - 14}" text-anchor="end">{rows[-1][0]}</text>']
    return _page(width, height, title, [*_axis(low, high, y, width - 80), *dots, f'<polyline class="s-mark" stroke-width="2" points="{line}"/>', *ends])


def bars(values: Sequence[tuple[str, float]], title: str, width: int = 720, height: int = 320) -> str:
    """One bar for each name, in the order given."""
    high = max((v for _, v in values), default=0) or 1
    y = lambda v: TOP + (high - v) / high * (height - TOP - BOTTOM)
    step = (width - LEFT - RIGHT) / max(1, len(values))
    gap = 2 if step > 4 else 0
    out = []
    for i, (name, v) in enumerate(values):
        x = LEFT + i * step
        out.append(f'<rect class="f-mark" x="{x:.2f}" y="{y(v):.1f}" width="{max(0.5, step - gap):.2f}" height="{height - BOTTOM - y(v):.1f}"><title>{escape(str(name))}: {v:g}</title></rect>')
    names = [f'<text x="{LEFT + (i + 0.5) * step:.1f}" y="{height - 22}" text-anchor="middle">{escape(str(name))}</text>' for i, (name, _) in enumerate(values)] if step >= 40 else [f'<text x="{LEFT}" y="{height - 22}">{escape(str(values[0][0]))}</text>', f'<text x="{width - RIGHT}" y="{height - 22}" text-anchor="end">{escape(str(values[-1][0]))}</text>'] if values else []
    return _page(width, height, title, [*_axis(0, high, y, width), *out, *names])


def heat_map(cells: Mapping[tuple[str, str], float | None], names: Sequence[str], title: str = "Correlation of metrics", cell: int = 26) -> str:
    """Numbers from -1 to 1 by pair of names: strength is opacity over a neutral ground, sign the colour; missing ones are left blank."""
    side = max([60, *(7 * len(n) for n in names)])
    width, height = side + 24 + cell * len(names) + RIGHT, TOP + cell * len(names) + side + 20
    out = []
    for i, a in enumerate(names):
        y = TOP + i * cell
        out.append(f'<text x="{side + 16}" y="{y + cell / 2 + 4:.1f}" text-anchor="end">{escape(a)}</text>')
        out.append(f'<text transform="translate({side + 24 + (i + 0.5) * cell + 4:.1f},{TOP + cell * len(names) + 8}) rotate(-90)" text-anchor="end">{escape(a)}</text>')
        for j, b in enumerate(names):
            v = cells.get((a, b), cells.get((b, a)))
            x, size = side + 24 + j * cell, cell - 2
            if v is not None and v == v:
                out.append(f'<rect class="f-mid" x="{x}" y="{y}" width="{size}" height="{size}"/><rect class="{"f-mark" if v >= 0 else "f-low"}" x="{x}" y="{y}" width="{size}" height="{size}" fill-opacity="{min(1.0, abs(v)):.3f}"><title>{escape(a)}, {escape(b)}: {v:.3f}</title></rect>')
    return _page(max(width, 320), height, title, out)


def dendrogram(merges: Sequence[Sequence[float]], names: Sequence[str], order: Sequence[int], title: str = "Tree of metrics", row: int = 22) -> str:
    """merges: rows of (left, right, height, size) as ``operators.metrics.linkage`` gives; order: leaves from top to bottom."""
    side = max([60, *(7 * len(n) for n in names)])
    width, height = side + 24 + 480 + RIGHT, TOP + row * max(1, len(names)) + 30
    top = max((m[2] for m in merges), default=1.0) or 1.0
    x = lambda h: side + 24 + h / top * 480
    at = {leaf: (0.0, TOP + (k + 0.5) * row) for k, leaf in enumerate(order)}
    out = [f'<text x="{side + 16}" y="{at[i][1] + 4:.1f}" text-anchor="end">{escape(names[i])}</text>' for i in order]
    for k, (a, b, h, n) in enumerate(merges):
        (ha, ya), (hb, yb) = at[int(a)], at[int(b)]
        out.append(f'<path class="s-mark" stroke-width="2" d="M{x(ha):.1f},{ya:.1f}H{x(h):.1f}V{yb:.1f}H{x(hb):.1f}"><title>{int(n)} metrics at {h:.4g}</title></path>')
        at[len(names) + k] = (h, (ya + yb) / 2)
    return _page(width, height, title, [*out, f'<text x="{x(0):.1f}" y="{height - 10}">0</text>', f'<text x="{x(top):.1f}" y="{height - 10}" text-anchor="end">{top:.3g}</text>'])
