"""Addresses, references and strict JSON.

An address is `scheme://brain/path?rel=name#fragment`, where the query is optional
and the path is either a file's path or `source:record`. The grammar is one anchored
expression; decoded paths are then judged step by step. All of it runs on columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.temporal import IDENTITY

SCHEME = "brain"
NAME = r"[a-z0-9][a-z0-9-]*"
MAX_VALUE = 8192
#: Files that people write: notes below these folders.
AUTHORED = ("projects", "concepts", "actions")
_AUTHORED = rf"^({'|'.join(AUTHORED)})/.*\.md$"


def is_identity(value: Column) -> Column:
    return value.rlike(IDENTITY)


def identity_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def clean(value: Column) -> Column:
    """True for a nonempty text without C0 and C1 control characters."""
    return (F.trim(value) != "") & ~value.rlike(r"[\x00-\x1f\x7f-\x9f]")


def relative(path: Column) -> Column:
    """True for a normalised path inside a brain."""
    return clean(path) & ~path.startswith("/") & ~path.contains("\\") & ~path.rlike(r"(^|/)\.{0,2}(/|$)")


def is_authored(path: Column) -> Column:
    return path.rlike(_AUTHORED)


def _encoded(text: Column, keep: str) -> Column:
    """Percent-encoding of all but unreserved characters and `keep`."""
    out = F.url_encode(text)
    swaps = {"+": "%20", "*": "%2A", "%7E": "~"} | {f"%{ord(c):02X}": c for c in keep}
    for old, new in swaps.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def address(brain: Column | str, path: Column, fragment: Column | None = None, scheme: str = SCHEME) -> Column:
    brain = F.lit(brain) if isinstance(brain, str) else brain
    out = F.concat(F.lit(f"{scheme}://"), brain, F.lit("/"), _encoded(path, "/@:"))
    if fragment is None:
        return out
    return F.concat(out, F.when(F.coalesce(fragment, F.lit("")) != "", F.concat(F.lit("#"), _encoded(fragment, ""))).otherwise(F.lit("")))


def parse_address(value: Column, scheme: str = SCHEME) -> Column:
    """struct(brain, path, fragment, relation, valid); null for another scheme. Not
    valid: user info, ports, traversal, control characters and spaces, bad escapes,
    any query but `rel`, more than MAX_VALUE characters."""
    grammar = rf"^(?i:{scheme})://({NAME})/([^?#]+)(?:\?rel=({NAME}))?(?:#(.*))?$"
    group = lambda i: F.regexp_extract(value, grammar, i)
    decoded = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    path, fragment = decoded(group(2)), decoded(group(4))
    raw = value.rlike(grammar) & ~value.rlike(r"[\s\x00-\x1f\x7f-\x9f]|%(?![0-9a-fA-F]{2})") & (F.length(value) <= MAX_VALUE)
    held = ~F.concat(path, fragment).rlike(r"[\x00-\x1f\x7f-\x9f]")
    record = path.rlike(rf"^{NAME}:(?s:.+)$")
    fine = F.coalesce(raw & held & (record | relative(path)), F.lit(False))
    parts = F.struct(group(1).alias("brain"), path.alias("path"), fragment.alias("fragment"), group(3).alias("relation"), fine.alias("valid"))
    return F.when(F.lower(F.substring(value, 1, len(scheme) + 1)) == f"{scheme}:", parts)


def target_of(value: Column, scheme: str = SCHEME) -> Column:
    """The canonical target of a link: an address loses its relation."""
    at = parse_address(value, scheme)
    return F.when(at["valid"], address(at["brain"], at["path"], at["fragment"], scheme)).otherwise(value)


def split_ref(ref: Column) -> tuple[Column, Column]:
    """Path and fragment: the last # splits unless the whole is an authored path."""
    head, tail = F.regexp_extract(ref, r"^(.*)#([^#]*)$", 1), F.regexp_extract(ref, r"^(.*)#([^#]*)$", 2)
    whole = is_authored(ref) | (head == "")
    return F.when(whole, ref).otherwise(head), F.when(whole, F.lit("")).otherwise(tail)


def strict_json(text: Column) -> Column:
    """Null for duplicate keys, NaN and truncated JSON."""
    return F.try_parse_json(text)


def pointer(path: str) -> str:
    """A JSON Pointer as a JSON path for variant_get."""
    if path and not path.startswith("/"):
        raise ValueError("a pointer begins with /")
    out = "$"
    for step in path.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        out += f"[{step}]" if re.fullmatch(r"0|[1-9]\d*", step) else "['" + step.replace("'", "\\'") + "']"
    return out


def at_pointer(variant: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, pointer(path), kind)


def bad_traversal(variant: Column, path: str) -> Column:
    """True where a step of the pointer meets a scalar, or a name meets a list:
    there the pointer is wrong, while a missing member is only absent."""
    steps, wrong = path.split("/")[1:], F.lit(False)
    for n, step in enumerate(steps):
        kind = F.coalesce(F.schema_of_variant(F.try_variant_get(variant, pointer("/".join(["", *steps[:n]])), "variant")), F.lit("OBJECT"))
        number = re.fullmatch(r"0|[1-9]\d*", step) is not None
        wrong = wrong | ~(kind.startswith("OBJECT") | (kind.startswith("ARRAY") & F.lit(number)) | (kind == "VOID"))
    return wrong
