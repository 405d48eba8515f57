"""Search and read over one or several brains.

A brain that fails is a problem beside the others' answers; alone, it raises. What
could not be read is told, and nothing is said to be absent because of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.identity import SCHEME, address, parse_address, split_ref
from loomdex.functions.markdown import sections
from loomdex.functions.temporal import IDENTITY, Scope, in_scope, scope
from loomdex.functions.text import excerpt, query_terms
from loomdex.operators import graph, pages, search
from loomdex.sources.brain import Brain, dated
from loomdex.sources.segments import Keyed

MAX_TEXT, MAX_LIMIT = 4096, 50


@dataclass(frozen=True)
class Query:
    """A validated question."""

    text: str
    limit: int = 10
    scope: Scope = field(default_factory=Scope)

    def __post_init__(self):
        if not self.text.strip() or len(self.text) > MAX_TEXT:
            raise ValueError(f"a query has 1 to {MAX_TEXT} characters")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit is 1 to {MAX_LIMIT}")
        s = self.scope
        if s.since and s.until and s.since >= s.until:
            raise ValueError("since comes before until")
        if s.target and not re.fullmatch(IDENTITY[1:-1], s.target):
            raise ValueError("target is an identity")


def ask(text: str, now: datetime, where: str = "", limit: int = 10, tz: str = "UTC") -> Query:
    return Query(text, limit, scope(where, now, tz) if where else Scope())


def is_identity(text: str) -> bool:
    return re.fullmatch(IDENTITY[1:-1], text) is not None


@dataclass
class Reply:
    items: DataFrame  # rank, brain, ref, score, ...
    problems: list[dict]
    identity: str = ""  # "unknown" where no brain names or links it
    coverage: list[dict] = field(default_factory=list)


def in_brain(brain: Brain, query: Query, names: list[str], targets: list[str], tz: str = "UTC") -> tuple[DataFrame, bool]:
    """(ref, fragment, title, status, ts, score, rank of one brain; whether the
    text is an identity the brain knows). An identity that it doesn't know is
    searched as words, by their stems, in the stored index where there is one."""
    items = dated(brain.items, tz)
    inside = _scoped(items, brain, query.scope, targets)
    if is_identity(query.text):
        if not graph.known(brain.graph, names).where("is_known").isEmpty():
            found = graph.identity_candidates(brain.graph, query.text, names).drop("time").join(inside, "ref")
            order = [F.desc("score"), F.desc("ts"), F.asc("ref")]
            top = found.orderBy(*order).limit(query.limit)
            return top.select("ref", F.lit("").alias("fragment"), "title", "status", "ts", "score", F.row_number().over(Window.orderBy(*order)).alias("rank")), True
    if brain.index is not None:
        scored = brain.index.find(query.text).select("ref", "fragment", "status", "score")
    else:
        scored = search.bm25(brain.passages, query.text, ["ref", "fragment", "weight", "status"], stemmed=True).select("ref", "fragment", "status", (F.col("score") * F.col("weight")).alias("score"))
    narrow = query.scope != Scope()
    if narrow:
        scored = scored.join(inside.select("ref"), "ref", "left_semi")
    # Passages know their status; only what is returned meets its item.
    top = search.ranked(search.best_passage(scored), query.limit, status="status").limit(query.limit)
    held = top.collect()
    top = top.sparkSession.createDataFrame(held, top.schema)
    about = dated(graph.wanted_rows(brain.graph.items, "ref", [r.ref for r in held]), tz).select("ref", "title", "ts")
    return top.join(F.broadcast(about), "ref").select("ref", "fragment", "title", "status", "ts", "score", "rank"), False


def _scoped(items: DataFrame, brain: Brain, s: Scope, targets: list[str]) -> DataFrame:
    out = items.where(in_scope(s, F.col("ts"), F.col("path")))
    if not s.target:
        return out
    linkers = graph.linking(brain.graph.links, targets).select(F.col("item").alias("ref")).distinct()
    return out.join(linkers, "ref", "left_semi")


def federated(brains: dict[str, Brain], query: Query, trust: dict[str, str] | None = None, broken: dict[str, str] | None = None, tz: str = "UTC", health: list[dict] | None = None) -> Reply:
    """Several brains: ranks of words alternate by brain, in the order given;
    identities are owners first, then the newest. `broken`: brains that cannot be
    opened and why."""
    problems = [{"brain": b, "error": e} for b, e in (broken or {}).items()]
    if not brains:
        raise LookupError("; ".join(e for e in (broken or {}).values()) or "no brain")
    every = {name: brain.graph for name, brain in brains.items()}
    expand = lambda x: graph.expanded(every, x) if x and is_identity(x) else ([x] if x else [], [])
    names, issues = expand(query.text)
    targets, more = expand(query.scope.target)
    problems += issues + more
    found, exact = None, False
    for place, (name, brain) in enumerate(brains.items()):
        local = [r.ref for r in graph.local_refs(brain.graph.names, targets).collect()] if targets else []
        rows, hit = in_brain(brain, query, names, local, tz)
        exact |= hit
        rows = pages.labelled(_decorated(rows, brain, query.text), name, "fragment").withColumns({"place": F.lit(place), "exact": F.lit(hit)})
        found = rows if found is None else found.unionByName(rows)
        if brain.problems is not None:
            problems += [{"brain": name, "file": r.file, "error": r.problem} for r in brain.problems.limit(200).collect()]
    if exact:
        # A brain that only matched words says nothing about the identity.
        order, found = [F.desc("score"), F.desc("ts"), F.asc("place"), F.asc("ref")], found.where("exact")
    else:
        order = [F.asc("rank"), F.asc("place")]
    top = found.orderBy(*order).limit(query.limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    identity = "unknown" if is_identity(query.text) and not exact else ""
    return Reply(pages.guarded(top, trust or {}, searched=True).drop("place", "exact"), problems, identity, health or [])


def _decorated(rows: DataFrame, brain: Brain, query: str) -> DataFrame:
    """At most MAX_LIMIT rows of a search with excerpt, kind and source. They are
    fetched once, and what belongs to them is looked up by their refs, so no text and
    no item but theirs is read or moved."""
    held = rows.limit(MAX_LIMIT).collect()
    top, refs = rows.sparkSession.createDataFrame(held, rows.schema), sorted({r.ref for r in held})
    texts = graph.wanted_rows(Keyed(brain.index.store, "passages", brain.index.at) if brain.stored else brain.passages, "ref", refs)
    wanted = brain.index.wanted(query, True) if brain.index else {t: [t] for t in query_terms(query)}
    texts = texts.select("ref", "fragment", excerpt(F.col("text"), wanted).alias("excerpt"))
    about = graph.wanted_rows(brain.graph.items, "ref", refs).select("ref", "kind", "source")
    return top.join(F.broadcast(texts), ["ref", "fragment"], "left").join(F.broadcast(about), "ref", "left")


def read_note(notes: DataFrame, ref: str) -> DataFrame:
    """path, text of a note (path, text), or of its section that `ref` names; none
    where either is missing."""
    path, fragment = ref, ""
    if "#" in ref and not re.fullmatch(r"(projects|concepts|actions)/.*\.md", ref):
        path, _, fragment = ref.rpartition("#")
    whole = notes.where(F.col("path") == path)
    if not fragment:
        return whole

    return sections(whole, fragment)


def read(brains: dict[str, Brain], ref: str, now: datetime, tz: str = "UTC") -> dict:
    """What a reference names, in this order: a page, a note, section or record
    (by reference, address or alias), an identity. {kind, brain, parts}; LookupError
    where nothing does, and where several brains have it."""
    wanted, only = ref, None
    spark = next(iter(brains.values())).items.sparkSession
    if ref.startswith(f"{SCHEME}:"):
        whole = ref.removeprefix(f"{SCHEME}://").rstrip("/")
        at = spark.range(1).select(parse_address(F.lit(ref)).alias("a")).first().a
        if at.valid:
            only, wanted = at.brain, at.path + (f"#{at.fragment}" if at.fragment else "")
        elif whole in brains:
            only, wanted = whole, ""
        else:
            raise ValueError(f"not an address: {ref}")
    chosen = {n: b for n, b in brains.items() if only in (None, n)}
    if not chosen:
        raise LookupError(f"no brain {only}")
    parts = {n: p for n, b in chosen.items() if (p := pages.page(dated(b.items, tz), b.links, wanted, now, tz)) is not None}
    if parts:
        return {"kind": "page", "page": wanted, "parts": parts}
    found = {}
    for name, brain in chosen.items():
        path, fragment = split_ref(F.lit(wanted))
        whole_path, part = spark.range(1).select(path.alias("p"), fragment.alias("f")).first()
        texts = Keyed(brain.index.store, "passages", brain.index.at) if brain.stored else brain.passages
        near = graph.wanted_rows(texts, "ref", sorted({whole_path, wanted}))
        exact = near.where(((F.col("ref") == whole_path) & (F.col("fragment") == part)) | ((F.col("ref") == wanted) & (F.col("fragment") == "")))
        if exact.isEmpty():
            owner = [r.item for r in graph.unique_owners(graph.wanted_rows(brain.graph.names, "name", [ref])).collect()]  # one name has one at most
            exact = graph.wanted_rows(texts, "ref", owner)
        if not exact.isEmpty():
            found[name] = exact
    if len(found) > 1:
        raise LookupError(f"{ref} is in several brains: {', '.join(sorted(found))}")
    if found:
        (name, rows), = found.items()
        reply = {"kind": "item", "brain": name, "parts": {"passages": rows}}
        if "#" not in wanted:
            item = rows.select("ref").first().ref
            whole_name = spark.range(1).select(address(name, F.lit(item)).alias("a")).first().a
            said, problems = graph.expanded({name: chosen[name].graph}, whole_name)
            reply["parts"] |= pages.context(chosen[name], item, sorted({*said, item}), item)
            reply["problems"] = problems
            if re.fullmatch(r"actions/[^/]+/ACTION\.md", item):
                reply["parts"] |= pages.action_context(chosen[name], item)
        return reply
    if is_identity(ref):
        pages_of = {n: p for n, b in chosen.items() if (p := pages.identity_page(b, ref)[0]) is not None}
        if pages_of:
            return {"kind": "identity", "page": ref, "parts": pages_of}
    if any(b.problems is not None and not b.problems.isEmpty() for b in chosen.values()):
        raise LookupError(f"{ref} may exist: something could not be read")
    raise LookupError(f"reference not found: {ref}")
