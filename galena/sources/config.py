"""What a driver reads before any table: settings, cells of arms, pairs, plugins."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

_PLUGINS: dict[str, Callable] = {}


def settings(text: str, environment: Mapping[str, str]) -> dict[str, str]:
    """KEY=VALUE lines, of which none overrides the environment; blank lines and # are passed over."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#"):
            key, sign, value = line.partition("=")
            if not sign:
                raise ValueError(f"no setting: {line!r}")
            out[key.strip()] = value.strip().strip("'\"")
    return {**out, **environment}


def role_setting(known: Mapping[str, str], role: str, name: str, default: str | None = None) -> str | None:
    """The role's own value, else the shared one."""
    return known.get(f"{role.upper()}_{name}", known.get(name, default))


def cells(spark: SparkSession, spec: Mapping, section: str, base: str, paths: Sequence[str] = ("responses", "grades")) -> DataFrame:
    """arm, role, seed and file columns of a section's arms: a row a cell; relative paths are taken from ``base``."""
    rows = []
    for arm in spec[section]["arms"]:
        for cell in arm["cells"]:
            files = [os.path.join(base, cell[p]) if cell.get(p) and "://" not in cell[p] else cell.get(p) for p in paths]
            rows.append((arm["name"], arm.get("role", "table"), cell.get("seed"), *files))
    return spark.createDataFrame(rows, "arm string, role string, seed int, " + ", ".join(f"{p} string" for p in paths))


def named_path(text: str) -> tuple[str, str, str | None, int, float]:
    """NAME=PATH, with a mode, a number of draws and a temperature behind it if given."""
    name, sign, rest = text.partition("=")
    if not sign or not name or not rest:
        raise ValueError(f"not NAME=PATH: {text!r}")
    path, *more = rest.split(":") if "://" not in rest else [rest]
    mode, draws, heat = [*more, None, None, None][:3]
    return name, path, mode, int(draws or 1), float(heat or 0)


def point_path(text: str) -> tuple[str, str, int, str]:
    """ARM:SEED:STEP=PATH."""
    key, _, path = text.partition("=")
    arm, seed, step = key.split(":")
    return arm, seed, int(step), path


def pairs(text: str | None, arms: Sequence[str]) -> list[tuple[str, str]]:
    """x:y,x:y, or every pair of arms in their order; an unknown arm is an error."""
    if not text:
        return list(combinations(arms, 2))
    out = [tuple(p.split(":")) for p in text.split(",")]
    if any(len(p) != 2 or p[0] == p[1] or not set(p) <= set(arms) for p in out):
        raise ValueError(f"not pairs of {list(arms)}: {text!r}")
    return out


def plugin(name: str) -> Callable[[Callable], Callable]:
    """Registers a manager under a name; a second one under it is an error."""

    def add(f: Callable) -> Callable:
        if name in _PLUGINS:
            raise ValueError(f"{name} is taken")
        _PLUGINS[name] = f
        return f

    return add


def plugin_named(name: str) -> Callable:
    if name not in _PLUGINS:
        raise ValueError(f"no plugin {name!r}; there are {sorted(_PLUGINS)}")
    return _PLUGINS[name]


def write_whole(path: str, text: str) -> None:
    """A small file of the driver's, all of it or nothing: written aside and renamed."""
    handle, aside = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(aside, path)


def report(rows: Sequence[Mapping[str, object]], kind: str = "markdown", digits: int = 2) -> str:
    """A finished table, of a few rows, as markdown, LaTeX or JSON; numbers rounded, null as a dash."""
    if kind == "json":
        return json.dumps([dict(r) for r in rows], ensure_ascii=False, indent=1)
    show = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    names = list(rows[0]) if rows else []
    lines = [[show(r[n]) for n in names] for r in rows]
    if kind == "latex":
        return "\n".join(" & ".join(line).replace("_", r"\_").replace("%", r"\%") + r" \\" for line in lines)
    return "\n".join("| " + " | ".join(line) + " |" for line in [names, ["---"] * len(names), *lines])
