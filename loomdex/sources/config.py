"""Configuration of a brain: strict YAML, the schema, sensors, routines, related brains, trust."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

MAX_BYTES, MAX_DEPTH, MAX_EVENTS = 1 << 20, 32, 20_000
_NAME = re.compile(r"[a-z0-9][a-z0-9-]*")
#: Kinds of a declared field and the check of one value.
SCALARS = ("string", "integer", "number", "boolean", "timestamp", "identity")


class BadConfig(ValueError):
    pass


def yaml_object(text: str | bytes) -> dict:
    """A mapping without anchors, aliases, repeated keys, deep nesting or bulk. It is
    built from the parser's events as they come, so what is too much is not read on."""
    import yaml

    raw = text if isinstance(text, bytes) else text.encode()
    if len(raw) > MAX_BYTES:
        raise BadConfig("YAML above 1 MiB")
    builder = _Builder()
    try:
        for event in yaml.parse(raw.decode(), Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            builder.take(event)
    except (yaml.YAMLError, UnicodeDecodeError) as error:
        raise BadConfig(f"invalid YAML: {getattr(error, 'problem', None) or 'not UTF-8'}") from None
    if len(builder.documents) > 1:
        raise BadConfig("more than one YAML document")
    found = builder.documents[0] if builder.documents else None
    if found is None:
        return {}
    if not isinstance(found, dict) or not all(isinstance(k, str) for k in found):
        raise BadConfig("YAML must be a mapping of names")
    return found


class _Builder:
    """Values of YAML events. `open` has the containers that are not closed yet, each
    with the key that waits for its value."""

    WAITS = object()

    def __init__(self) -> None:
        import yaml

        self.documents: list = []
        self.open: list[list] = []
        self.events = 0
        self.resolver, self.constructor, self.scalar = yaml.resolver.Resolver(), yaml.constructor.SafeConstructor(), yaml.ScalarNode

    def take(self, event) -> None:
        self.events += 1
        if self.events > MAX_EVENTS:
            raise BadConfig("YAML has too many parts")
        if getattr(event, "anchor", None) is not None:
            raise BadConfig("YAML anchors and aliases are not read")
        kind = type(event).__name__.removesuffix("Event")
        if kind in ("MappingStart", "SequenceStart"):
            if event.tag and not event.tag.endswith((":map", ":seq")):
                raise BadConfig("YAML has an unknown tag")
            if len(self.open) == MAX_DEPTH:
                raise BadConfig("YAML is nested too deep")
            self.open.append([{} if kind == "MappingStart" else [], self.WAITS])
        elif kind in ("MappingEnd", "SequenceEnd"):
            self.put(self.open.pop()[0])
        elif kind == "Scalar":
            self.put(self.value(event))

    def value(self, event):
        tag = event.tag if event.tag not in (None, "!") else self.resolver.resolve(self.scalar, event.value, event.implicit)
        if tag.rpartition(":")[2] in ("str", "timestamp", "merge", "value"):
            return event.value  # dates stay text
        return self.constructor.construct_object(self.scalar(tag, event.value, event.start_mark, event.end_mark))

    def put(self, value) -> None:
        if not self.open:
            self.documents.append(value)
            return
        held, key = self.open[-1]
        if isinstance(held, list):
            held.append(value)
        elif key is self.WAITS:
            if not isinstance(value, str | int | float | bool | None) or value in held:
                raise BadConfig("repeated key" if isinstance(value, str) else "a key is one plain value")
            self.open[-1][1] = value
        else:
            held[key] = value
            self.open[-1][1] = self.WAITS


@dataclass(frozen=True)
class Field:
    """A declared meaning: a kind of scalar, one, optional or many of it."""

    type: str = "string"
    cardinality: str = "optional"
    relation: bool = False


@dataclass(frozen=True)
class Program:
    """What a sensor or a routine declares; a refresh of zero is manual."""

    enabled: bool = True
    refresh: int = 0
    lookback: int = 86_400
    overlap: int = 300
    mode: str = "window"
    trust: str = "external"
    fields: dict = field(default_factory=dict)  # field: {"path": pointer} or {"value": literal}


@dataclass(frozen=True)
class Config:
    name: str
    brains: dict = field(default_factory=dict)  # name: path
    schema: dict[str, Field] = field(default_factory=dict)
    sensors: dict[str, Program] = field(default_factory=dict)
    routines: dict[str, Program] = field(default_factory=dict)


def _typed(kind: type, values: dict, known: tuple[str, ...], where: str):
    if not isinstance(values, dict) or set(values) - set(known) - {"description", "examples", "command", "timeout", "max_bytes"}:
        raise BadConfig(f"{where}: unknown keys")
    return kind(**{k: v for k, v in values.items() if k in known})


def load(text: str | bytes) -> Config:
    """A brain's configuration; the same bytes are read once."""
    raw = text.encode() if isinstance(text, str) else text
    return _load(hashlib.sha256(raw).hexdigest(), raw)


@functools.lru_cache(maxsize=256)
def _load(digest: str, raw: bytes) -> Config:
    data = yaml_object(raw)
    if set(data) - {"version", "name", "brains", "schema", "sensors", "routines"}:
        raise BadConfig("unknown keys")
    names = [data.get("name", ""), *(k for part in ("brains", "schema", "sensors", "routines") for k in data.get(part) or {})]
    if not all(isinstance(n, str) and _NAME.fullmatch(n) for n in names):
        raise BadConfig("names are lower-case letters, digits and hyphens")
    schema = {k: _typed(Field, v, ("type", "cardinality", "relation"), k) for k, v in (data.get("schema") or {}).items()}
    for k, f in schema.items():
        if f.type not in SCALARS or f.cardinality not in ("one", "optional", "many") or (f.relation and f.type != "identity"):
            raise BadConfig(f"{k}: unknown kind, or a relation that is not an identity")
    keys = ("enabled", "refresh", "lookback", "overlap", "mode", "trust", "fields")
    sensors = {k: _typed(Program, v, keys, k) for k, v in (data.get("sensors") or {}).items()}
    routines = {k: _typed(Program, v, keys[:3], k) for k, v in (data.get("routines") or {}).items()}
    brains = {k: v["path"] for k, v in (data.get("brains") or {}).items()}
    if len(brains) > 32 or data["name"] in brains or set(sensors) & set(routines):
        raise BadConfig("more than 32 brains, a brain that names itself, or a name used twice")
    for k, s in sensors.items():
        for name, mapping in s.fields.items():
            if name not in schema or set(mapping) not in ({"path"}, {"value"}):
                raise BadConfig(f"{k}: a mapping is a path or a value of a declared field")
    return Config(data["name"], brains, schema, sensors, routines)


def signature(config: Config) -> str:
    """Changes whenever a projection made under the configuration must be made anew."""
    return hashlib.sha256(json.dumps([config.name, {k: vars(f) for k, f in config.schema.items()}], sort_keys=True).encode()).hexdigest()


# --- which brain, which others, and whose programs may run ---


def select(name: str = "", here: str = ".", env: dict | None = None, registry: dict[str, str] | None = None) -> str:
    """Folder of the brain that is named (a path or a registered name), else the one
    of the environment, else the one around `here`, else the only registered one."""
    registry, asked = registry or {}, name or (env or {}).get("LOOMDEX_BRAIN", "")
    if asked:
        found = registry.get(asked, asked)
        if not _is_brain(found):
            raise BadConfig(f"no brain at {asked}")
        return found
    for folder in (Path(here).resolve(), *Path(here).resolve().parents):
        if _is_brain(folder):
            return str(folder)
    if len(registry) == 1:
        return next(iter(registry.values()))
    raise BadConfig("name a brain")


def _is_brain(folder) -> bool:
    return os.path.isfile(os.path.join(folder, "brain.yaml"))


def open_brain(folder: str) -> Config:
    return load(Path(folder, "brain.yaml").read_bytes())


def related(folder: str) -> tuple[dict[str, str], list[dict]]:
    """(folders by name: the brain and those it names, one hop; problems). A brain
    under another name than its own, or two under one, are left out and reported."""
    own = open_brain(folder)
    found, problems = {own.name: folder}, []
    for name, path in sorted(own.brains.items()):
        at = os.path.normpath(os.path.join(folder, os.path.expanduser(path)))
        try:
            there = open_brain(at).name
        except (OSError, ValueError):
            problems.append({"brain": name, "error": "cannot be read"})
            continue
        if there != name or name in found:
            problems.append({"brain": name, "error": f"calls itself {there}" if there != name else "is named twice"})
        else:
            found[name] = at
    return found, problems


def register(registry: str, name: str, folder: str, collect: bool = False) -> dict:
    """Remember a brain and whether this machine may run its programs."""
    known = json.loads(Path(registry).read_text()) if os.path.exists(registry) else {}
    if known.get(name, {}).get("path", folder) != folder:
        raise BadConfig(f"{name} is another brain here")
    known[name] = {"path": folder, "collect": collect}
    scratch = f"{registry}.new"
    Path(scratch).write_text(json.dumps(known, sort_keys=True))
    os.replace(scratch, registry)
    return known


def may_collect(registry: str, name: str, folder: str) -> bool:
    if not os.path.exists(registry):
        return False
    held = json.loads(Path(registry).read_text()).get(name, {})
    return held.get("path") == folder and held.get("collect") is True
