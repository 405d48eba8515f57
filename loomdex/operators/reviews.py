"""Texts for people: the weekly review of a brain, and what an agent should know
when it begins to work in a folder. Both read pages, whose rows are bounded."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

BLANK = "_none_"


def label(text: str | None) -> str:
    """A text on one line that Markdown shows as it is."""
    return re.sub(r"([\\`*_\[\]<>#|])", r"\\\1", re.sub(r"\s+", " ", text or "").strip())


def code(text: str) -> str:
    """A code span around any text: its fence is longer than any run of ticks in it."""
    fence = "`" * (1 + max([len(x) for x in re.findall(r"`+", text)], default=0))
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def _lines(rows: DataFrame | None, most: int = 50) -> list[str]:
    held = [] if rows is None else rows.orderBy("rank").limit(most).collect()
    out = []
    for r in held:
        shown = label(getattr(r, "title", None)) or r.ref
        due = " (review)" if "review" in r and r.review else ""
        out.append(f"- {shown} — {code(r.ref)}{due}")
    return out or [BLANK]


def weekly_review(home: dict[str, DataFrame], week: dict[str, DataFrame], day: str) -> str:
    """Markdown of the home page and of the last seven days."""
    shares = [f"- {label(r.source)}: {r.records}" for r in week["sources"].orderBy("rank").limit(50).collect()] or [BLANK]
    total = week["total"].first().total
    parts = [
        (f"# Review {day}", [f"{total} items in seven days."]), ("## Projects", _lines(home["projects"])), ("## Upcoming", _lines(home["upcoming"])),
        ("## Changed notes", _lines(home["changed"])), ("## Changed elsewhere", _lines(week["changed"])), ("## Sources", shares),
    ]
    return "\n\n".join(f"{head}\n\n" + "\n".join(lines) for head, lines in parts) + "\n"


def session_context(title: str, backlinks: DataFrame, latest: DataFrame, most: int = 5) -> str:
    """A few lines: the note that owns a place, how it is linked, and the newest of
    the owner's items that link to it. latest: ref or item, external, rank."""
    counts = ", ".join(f"{r.relation or 'links'} {r.total}" for r in backlinks.orderBy("place").collect())
    own = latest.where("not external") if "external" in latest.columns else latest
    name = "ref" if "ref" in own.columns else "item"
    rows = own.orderBy("rank", name).limit(most).collect()
    return "\n".join([label(title), counts or BLANK, *[f"- {code(r[name])}" for r in rows]]) + "\n"
