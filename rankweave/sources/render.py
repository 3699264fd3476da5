"""Report rows as text: markdown, fixed width, JSON files, and number formats. Small tables, on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def number(x: object, digits: int = 4) -> str:
    """A dash where nothing is defined."""
    return "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def size(n: float) -> str:
    for unit in ("B", "kB", "MB", "GB", "TB"):
        if n < 1000 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1000
    return ""


def duration(seconds: float) -> str:
    return f"{seconds * 1000:.1f} ms" if seconds < 1 else f"{seconds:.1f} s" if seconds < 120 else f"{seconds // 60:.0f} m {seconds % 60:02.0f} s"


def _cells(df: DataFrame, most: int) -> list[list[str]]:
    """Head and rows; a report with more rows than ``most`` is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is to be written as a table, or needs a larger bound")
    return [df.columns, *[[number(v) for v in r] for r in rows]]


def markdown(df: DataFrame, most: int = 1000) -> str:
    head, *rows = _cells(df, most)
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])


def fixed_width(df: DataFrame, most: int = 1000) -> str:
    rows = _cells(df, most)
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


def latex(df: DataFrame, most: int = 1000) -> str:
    escape = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in s)
    head, *rows = _cells(df, most)
    body = "\n".join(" & ".join(map(escape, r)) + r" \\" for r in [head, *rows])
    return f"\\begin{{tabular}}{{{'l' * len(head)}}}\n{body}\n\\end{{tabular}}"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
