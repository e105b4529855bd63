"""Experiments: sweep grids, prediction fingerprints and configuration profiles. Small documents, handled on the driver."""

from __future__ import annotations

import copy
import hashlib
import json
import re
import time
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections of a configuration that change what is predicted.
PREDICTIVE = ("data", "features", "label", "model", "training", "windows", "universe")


def merged(base: dict, over: dict) -> dict:
    """Deep merge: mappings are merged, everything else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def with_path(document: dict, path: str, value) -> dict:
    """document with a value at a dotted path."""
    over = value
    for part in reversed(path.split(".")):
        over = {part: over}
    return merged(document, over)


def choices(value) -> list:
    """A sweep entry's values: a list, or text like {a,b} or [a,b]."""
    if isinstance(value, (list, tuple)):
        return list(value)
    m = re.fullmatch(r"\s*[{\[](.*)[}\]]\s*", value) if isinstance(value, str) else None
    if not m:
        return [value]

    def scalar(x: str):
        try:
            return json.loads(x)
        except ValueError:
            return x

    return [scalar(x.strip()) for x in m[1].split(",") if x.strip()]


def flat(sweep: dict, prefix: str = "") -> dict[str, list]:
    out: dict[str, list] = {}
    for k, v in sweep.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": choices(v)}
    return out


def grid(base: dict, sweep: dict | None = None, cases: list[dict] | None = None) -> list[dict]:
    """Configurations of a sweep: all combinations in key order, or the explicit cases."""
    if cases:
        return [merged(base, c) for c in cases]
    axes = flat(sweep or {})
    out = []
    for values in product(*axes.values()):
        document = base
        for path, v in zip(axes, values):
            document = with_path(document, path, v)
        out.append(document)
    return out


def fingerprint(document: dict) -> str:
    """Digest of what determines the predictions."""
    part = {k: document[k] for k in PREDICTIVE if k in document}
    return hashlib.sha256(json.dumps(part, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def deduplicated(documents: list[dict]) -> list[tuple[int, int]]:
    """(run, run whose predictions it uses): the first with the same fingerprint."""
    first: dict[str, int] = {}
    return [(i, first.setdefault(fingerprint(d), i)) for i, d in enumerate(documents)]


def fingerprints(runs: DataFrame, columns: list[str]) -> DataFrame:
    """The same for a table of runs: fingerprint of some columns, and the smallest run id that shares it."""
    from pyspark.sql import Window

    mark = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)
    return runs.withColumn("fingerprint", mark).withColumn("source_run", F.min("run").over(Window.partitionBy("fingerprint")))


def parameter_grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """A row for each combination of parameter values."""
    return spark.createDataFrame([dict(zip(axes, values)) for values in product(*axes.values())])


def resolved(profiles: dict[str, dict], name: str) -> dict:
    """A profile with what it extends, nearest last; features of every level accumulate."""
    chain, seen = [], set()
    while name:
        if name in seen:
            raise ValueError(f"profile {name} extends itself")
        if name not in profiles:
            raise ValueError(f"unknown profile {name}")
        seen.add(name)
        chain.append(profiles[name])
        name = profiles[name].get("extends")
    out: dict = {}
    for p in reversed(chain):
        out = merged(out, {k: v for k, v in p.items() if k not in ("extends", "add_columns", "drop_columns")})
    out["features"] = feature_list(chain[::-1])
    return out


def feature_list(levels: list[dict]) -> list[str]:
    """Selected features of profile levels, oldest first: each level's own list replaces, drops go, additions follow without repeats."""
    out: list[str] = []
    for p in levels:
        if p.get("columns") is not None:
            out = list(dict.fromkeys(p["columns"]))
        out = [f for f in out if f not in set(p.get("drop_columns", ()))]
        out += [f for f in dict.fromkeys(p.get("add_columns", ())) if f not in out]
    return out


def repeated(features: list[str], times: dict[str, int]) -> list[str]:
    """Features with aliases name__rep2, name__rep3 ... for those that count several times."""
    return [a for f in features for a in (f, *(f"{f}__rep{k}" for k in range(2, times.get(f, 1) + 1)))]


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def layered(profiles: dict[str, dict], name: str, load: Callable[[str], dict] = lambda path: {}) -> dict:
    """A profile's document from its layers, later ones over earlier: the profile that it extends, the file at its path, and what it says itself."""
    layers: list[dict] = []
    seen: list[str] = []
    while name is not None:
        if name in seen:
            raise ValueError(f"profiles extend each other: {' -> '.join([*seen, name])}")
        if name not in profiles:
            raise ValueError(f"unknown profile {name}")
        seen.append(name)
        own = profiles[name]
        layers += [{k: v for k, v in own.items() if k not in ("path", "extends")}, load(own["path"]) if own.get("path") else {}]
        name = own.get("extends")
    out: dict = {}
    for layer in reversed(layers):
        out = merged(out, layer)
    return out


def composed(*documents: dict, overrides: tuple[str, ...] = ()) -> dict:
    """Runtime, experiment and model documents, later ones over earlier, and then command-line overrides like a.b=3 (JSON values, else text)."""
    out: dict = {}
    for d in documents:
        out = merged(out, d)
    for text in overrides:
        path, equals, value = text.partition("=")
        if not equals:
            raise ValueError(f"an override is path=value, not {text}")
        out = with_path(out, path.strip(), choices(f"[{value}]")[0] if value.strip() and not value.strip().startswith(("[", "{")) else json.loads(value) if value.strip() else "")
    return out


def run_jobs(jobs: list[dict], run: Callable[[dict], object], done: set[str] = frozenset(), key: str = "matrix_id", shared: str | None = None, load: Callable[[object], object] | None = None) -> list[dict]:
    """Runs the jobs that aren't done one after the other (each is a distributed computation); a failed one is told of and the next begins.

    With `shared`, jobs of an equal value of that field stand together, and `load` makes what they share once. Per job, in the order
    given: key, status (success, skipped_done or failed), seconds and detail.
    """
    order = sorted(range(len(jobs)), key=lambda i: (str(jobs[i].get(shared)) if shared else "", i))
    told: dict[int, dict] = {}
    held: tuple = (None, None)
    for i in order:
        job, began = jobs[i], time.time()
        name = str(job[key])
        if name in done:
            told[i] = {key: name, "status": "skipped_done", "seconds": 0.0, "detail": ""}
            continue
        try:
            if load is not None and (held[1] is None or held[0] != job.get(shared)):
                held = job.get(shared), load(job.get(shared))
            run(job | {"shared": held[1]} if load is not None else job)
            status, detail = "success", ""
        except Exception as e:  # a batch outlives its jobs
            status, detail = "failed", f"{type(e).__name__}: {e}"
        told[i] = {key: name, "status": status, "seconds": round(time.time() - began, 3), "detail": detail}
    return [told[i] for i in range(len(jobs))]
