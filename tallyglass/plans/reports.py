"""Report tables as text: aligned, markdown and LaTeX. For results of a few hundred rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

MOST_ROWS = 5_000


def shown(value, digits: int = 3) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def p_value(p: float) -> str:
    return "-" if p is None or math.isnan(p) else "<.001" if p < 0.001 else f"{p:.3f}".lstrip("0")


def render(df: DataFrame, style: str = "text", title: str = "", digits: int = 3) -> str:
    """style: text, markdown or latex. Tables of over MOST_ROWS rows are refused."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows")
    cells = [list(df.columns), *[[shown(v, digits) for v in r] for r in rows]]
    if style == "latex":
        safe = lambda t: t.replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
        body = [" & ".join(map(safe, r)) + r" \\" for r in cells]
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", body[0], r"\hline", *body[1:], r"\end{tabular}"])
    if style == "markdown":
        lines = ["| " + " | ".join(c.replace("|", r"\|") for c in r) + " |" for r in cells]
        return "\n".join([*([f"## {title}", ""] if title else []), lines[0], "|" + "---|" * len(df.columns), *lines[1:]])
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([*([title] if title else []), lines[0], "-" * len(lines[0]), *lines[1:]])
