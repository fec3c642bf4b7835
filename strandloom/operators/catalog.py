"""The catalog of rules that can be evaluated: who they are, which parameters they take, and when a breach fails its construct.

A rule is registered by its id with a schema for each parameter (JSON-schema words: type, minimum, maximum, enum, items, minItems,
uniqueItems, default).  A rule set is data: ids, and parameters by name.  :func:`rule_set` checks it and binds it to the kernels, so one map
per construct evaluates all of them (:func:`breaches`).  Unknown rules, unknown parameters and values outside a schema are errors
before any row is read.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from . import evaluation, fragments, repeats, rules
from .evaluation import Breach, Construct, _codes

#: Of f5: window, hard band, preferred band, magnitudes.  Fixed values.
AT_WINDOW, AT_HARD, AT_SOFT, MAG_WARN, MAG_HARD, GC_POINTS = 100, (0.35, 0.65), (0.45, 0.60), 0.3, 1.0, 10.0
#: Of e7: the longest tract that passes.  Fixed value.
HARD_TRACT = 100


@dataclass(frozen=True)
class Rule:
    spec_id: str
    evaluate: Callable[..., Iterator[Breach]]
    parameters: Mapping[str, Mapping[str, Any]]
    #: Whether a breach makes the evaluation fail, over (kind, start, end, magnitude) as values or as columns.
    fails: Callable[..., Any]


CATALOG: dict[str, Rule] = {}
_TYPES = {"integer": int, "number": (int, float), "boolean": bool, "string": str, "array": (list, tuple)}


def check(name: str, schema: Mapping[str, Any], value: Any) -> None:
    """Raises unless ``value`` is what ``schema`` describes."""

    def need(ok: bool, why: str) -> None:
        if not ok:
            raise ValueError(f"{name}: {value!r} {why}")

    kind = schema["type"]
    need(isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool)), f"is not of type {kind}")
    if "minimum" in schema:
        need(value >= schema["minimum"], f"is below {schema['minimum']}")
    if "maximum" in schema:
        need(value <= schema["maximum"], f"is above {schema['maximum']}")
    if "enum" in schema:
        need(value in schema["enum"], f"is none of {schema['enum']}")
    if kind == "array":
        need(len(value) >= schema.get("minItems", 0), "has too few items")
        need(not schema.get("uniqueItems") or len(set(value)) == len(value), "repeats an item")
        for item in value:
            check(f"{name} item", schema["items"], item)


def register(spec_id: str, fails: Callable[..., Any], **parameters: Mapping[str, Any]) -> Callable[[Callable], Callable]:
    """Enters a kernel under a rule of the dimension; its contract is checked here, once."""

    def enter(evaluate: Callable[..., Iterator[Breach]]) -> Callable[..., Iterator[Breach]]:
        if spec_id not in {r[0] for r in rules.RULES}:
            raise ValueError(f"{spec_id} is no rule of the dimension")
        if spec_id in CATALOG:
            raise ValueError(f"{spec_id} is registered twice")
        takes = inspect.signature(evaluate).parameters
        for name, schema in parameters.items():
            if name not in takes or takes[name].default is inspect.Parameter.empty:
                raise ValueError(f"{spec_id} has no optional parameter {name}")
            check(f"{spec_id}.{name}", schema, takes[name].default)
        CATALOG[spec_id] = Rule(spec_id, evaluate, parameters, fails)
        return evaluate

    return enter


def rule_set(include: list[str] | None = None, overrides: Mapping[str, Mapping[str, Any]] | None = None, vendors: list[str] | None = None) -> dict[str, Callable[[Construct], Iterator[Breach]]]:
    """Kernels by rule id with their parameters bound; ``vendors`` goes to every rule that takes ``keys`` and has none of its own."""
    chosen = sorted(CATALOG) if include is None else include
    given = {k: dict(v) for k, v in (overrides or {}).items()}
    unknown = sorted((set(chosen) | set(given)) - set(CATALOG))
    if unknown:
        raise ValueError(f"unknown rules: {unknown}; the catalog has {sorted(CATALOG)}")
    out = {}
    for spec in chosen:
        rule, own = CATALOG[spec], given.get(spec, {})
        if vendors is not None and "keys" in rule.parameters:
            own.setdefault("keys", vendors)
        for name, value in own.items():
            if name not in rule.parameters:
                raise ValueError(f"{spec} has no parameter {name}; it takes {sorted(rule.parameters)}")
            check(f"{spec}.{name}", rule.parameters[name], value)
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in own.items()}
        out[spec] = functools.partial(rule.evaluate, **own) if own else rule.evaluate
    return out


def breaches(constructs: DataFrame, **chosen: Any) -> DataFrame:
    """Breaches of a rule set (:func:`rule_set`) on constructs with segments, with ``fails``."""
    return evaluation.breaches(constructs, rule_set(**chosen)).withColumn("fails", fails())


def fails() -> Column:
    """Whether a breach row fails its evaluation."""
    kind, start, end, magnitude = (F.col(c) for c in ("kind", "start", "end", "magnitude"))
    out = magnitude >= 1.0
    for spec, rule in sorted(CATALOG.items()):
        out = F.when(F.col("spec_id") == spec, rule.fails(kind, start, end, magnitude)).otherwise(out)
    return out


def evaluations(found: DataFrame) -> DataFrame:
    """``construct_id, spec_id, n, magnitude, passes`` of breach rows with ``fails``; counts are combined before the shuffle."""
    made = found.groupBy("construct_id", "spec_id").agg(F.count(F.lit(1)).alias("n"), F.sum("magnitude").alias("magnitude"), F.max(F.col("fails").cast("int")).alias("_f"))
    return made.select("construct_id", "spec_id", "n", "magnitude", (F.col("_f") == 0).alias("passes"))


def evaluated(constructs: DataFrame, **chosen: Any) -> DataFrame:
    """:func:`evaluations` of a rule set (:func:`rule_set`) on constructs with segments; breaches are summed where they are found."""
    kernels = rule_set(**chosen)
    names = ["construct_id", "spec_id", "n", "magnitude", "passes"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cid, seq, circular, segments in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                c = Construct(seq, circular, segments or [])
                for spec, kernel in kernels.items():
                    n, total, passes = 0, 0.0, True
                    for kind, start, end, _, magnitude, _ in kernel(c):
                        n, total = n + 1, total + magnitude
                        passes = passes and not CATALOG[spec].fails(kind, start, end, magnitude)
                    if n:
                        out.append((cid, spec, n, total, passes))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    found = constructs.select("construct_id", "seq", "circular", F.col("segments").cast(evaluation.SEGMENTS)).mapInArrow(run, "construct_id long, spec_id string, n long, magnitude double, passes boolean")
    return found.groupBy("construct_id", "spec_id").agg(F.sum("n").alias("n"), F.sum("magnitude").alias("magnitude"), F.min("passes").alias("passes"))


def at_windows(c: Construct, window: int = AT_WINDOW, hard_lo: float = AT_HARD[0], hard_hi: float = AT_HARD[1]) -> Iterator[Breach]:
    """f5: regions of windows outside the preferred band, each at its window furthest outside the hard one, with the bound that binds."""
    if hard_lo >= hard_hi:
        raise ValueError("the hard band is inverted")
    if not c.n:
        return
    width = min(window, c.n)
    share = window_shares(_codes(c.seq), c.circular, width)
    for start, kind, magnitude in at_regions(share, c.circular, np.arange(len(share)), hard_lo, hard_hi):
        yield kind, start, start + width, 1, magnitude, c.touches_cds(start, start + width)


def window_shares(codes: np.ndarray, circular: bool, width: int) -> np.ndarray:
    """GC of each window by its start."""
    strong = (codes == 71) | (codes == 67)
    total = np.concatenate(([0], np.cumsum(np.concatenate((strong, strong[: width - 1])) if circular else strong)))
    return (total[width:] - total[:-width]) / width


def at_regions(share: np.ndarray, circular: bool, starts: np.ndarray, lo: float, hi: float, band: tuple[float, float] = AT_SOFT) -> list[tuple[int, str, float]]:
    """(start, kind, magnitude) of each run of windows outside ``band`` among ``starts`` (neighbours in order).

    Where ``starts`` is a whole circle its last run joins its first.
    """
    value = share[starts]
    off = (value < band[0]) | (value > band[1])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], off.astype(np.int8), [0])))).reshape(-1, 2).tolist()
    groups = [starts[a:b] for a, b in edge]
    if circular and len(starts) == len(share) and len(groups) > 1 and off[0] and off[-1]:
        groups[0] = np.concatenate((groups.pop(), groups[0]))
    out = []
    for group in groups:
        room = np.minimum(share[group] - lo, hi - share[group])
        at = int(group[np.argmin(room)])
        gc = float(share[at])
        excess = max(lo - gc, gc - hi, 0.0)
        side = "lower" if gc < (lo + hi) / 2 else "upper"
        out.append((at, ("hard " if excess > 0 else "") + side, MAG_HARD + excess * 100.0 / GC_POINTS if excess > 0 else MAG_WARN))
    return out


_is = lambda *_: True if not any(isinstance(x, Column) for x in _) else F.lit(True)  # noqa: E731  any breach fails
_begins = lambda word: lambda kind, *_: kind.startswith(word)
_isnt = lambda word: lambda kind, *_: kind != word
_least = lambda least: lambda kind, start, end, magnitude: magnitude >= least
_KEYS = {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "enum": [v[0] for v in dims.VENDORS]}}

register("d1_restriction_sites", _is)(evaluation.restriction_sites)
register("d2_recombinase_sites", _least(1.0), partials={"type": "boolean"})(evaluation.recombinase_sites)
register("d3_splicing", _least(3.0), acceptors={"type": "boolean"}, table_id={"type": "integer", "enum": sorted(dims.DIFFERENCES)})(evaluation.splice_sites)
register("d4_internal_polya", _least(1.0))(evaluation.polya_signals)
register("d8_cpg_depletion", _least(1.0), criterion={"type": "string", "enum": sorted(evaluation.ISLANDS)})(evaluation.cpg_island)
register("e1_homopolymers", _is, max_at={"type": "integer", "minimum": 1}, max_gc={"type": "integer", "minimum": 1})(evaluation.homopolymer_runs)
register("e2_gc_band", _is, keys=_KEYS)(fragments.fragment_gc)
register("e4_gc_extent", _least(1.0), keys=_KEYS, warn_ratio={"type": "number", "minimum": 1.0})(fragments.gc_extent)
register("e5_synthesis_repeats", _isnt("warn"), keys=_KEYS, min_len={"type": "integer", "minimum": fragments.REPEAT_BP}, hard_len={"type": "integer", "minimum": fragments.REPEAT_BP}, anneal_c={"type": "number", "minimum": 30.0, "maximum": 80.0})(fragments.synthesis_repeats)
register("e6_repeat_density", _is, k={"type": "integer", "minimum": 4, "maximum": 31}, window={"type": "integer", "minimum": 20}, flag={"type": "number", "minimum": 0.0, "maximum": 1.0})(evaluation.repetitive_regions)
register("e7_short_tandem_repeats", lambda kind, start, end, magnitude: end - start > HARD_TRACT, max_unit={"type": "integer", "minimum": 2, "maximum": 12}, warn={"type": "integer", "minimum": 4})(evaluation.tandem_repeats)
register("f1_direct_repeats", _begins("hard"), min_len={"type": "integer", "minimum": 8, "maximum": 31}, hard_len={"type": "integer", "minimum": 8})(repeats.direct_repeats)
register("f3_inverted_repeats", _isnt("warn"), min_stem={"type": "integer", "minimum": 8, "maximum": 31}, max_loop={"type": "integer", "minimum": 0}, hard_stem={"type": "integer", "minimum": 8})(repeats.inverted_repeats)
register("f5_at_window", _begins("hard"), window={"type": "integer", "minimum": 20}, hard_lo={"type": "number", "minimum": 0.0, "maximum": 1.0}, hard_hi={"type": "number", "minimum": 0.0, "maximum": 1.0})(at_windows)
