"""Homopolymer runs and tandem tracts: one map per construct."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def homopolymers(df: DataFrame, least: int = 1) -> DataFrame:
    """``construct_id, base, start, run`` of maximal runs of at least ``least``; on a circle the last run joins the first of its base.

    One map per construct: its runs are the gaps between changes of base, and no base is a row.
    """
    names = ["construct_id", "base", "start", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for cid, seq, circular in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.frombuffer(seq.encode(), np.uint8)
                edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                size = np.diff(np.append(edge, len(codes)))
                if circular and len(edge) > 1 and codes[0] == codes[-1]:
                    size[-1] += size[0]
                    edge, size = edge[1:], size[1:]
                edge, size = edge[size >= least], size[size >= least]
                parts.append((np.full(len(edge), cid, np.int64), codes[edge], edge.astype(np.int32), size.astype(np.int32)))
            ids, letters, starts, sizes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, t) for t in (np.int64, np.uint8, np.int32, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(letters.view("S1").astype("U1")), pa.array(starts), pa.array(sizes)], names)

    return df.where("length > 0").select("construct_id", "seq", "circular").mapInArrow(run, "construct_id long, base string, start int, run int")


def tracts_of(seq: str, units: tuple[int, int], least: int) -> list[tuple[int, int, int]]:
    """(unit, start, tract) of one sequence on a line, at the least period of each."""
    codes, kept = np.frombuffer(seq.encode(), np.uint8), []
    for unit in range(1, units[1] + 1):
        if len(codes) <= unit:
            break
        same = np.concatenate(([False], codes[:-unit] == codes[unit:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in edge[edge[:, 1] - edge[:, 0] + unit >= max(least, 2 * unit)].tolist():
            if not any(u < unit and s <= a and b + unit <= s + t for u, s, t in kept):
                kept.append((unit, a, b + unit - a))
    return [x for x in kept if x[0] >= units[0]]


def tandem_tracts(df: DataFrame, units: tuple[int, int] = (2, 6), least: int = 20) -> DataFrame:
    """``construct_id, unit, start, tract`` of linear tracts s[i] = s[i + unit] of at least ``least`` bases.

    A tract inside one of a smaller unit is left out, so each keeps its minimal period.  One map: a construct's tracts are found
    by shifted equality of its bases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(c, *t) for c, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in tracts_of(seq, units, least)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64()] + [pa.int32()] * 3, strict=True)], ["construct_id", "unit", "start", "tract"])

    return df.where("length > 0").select("construct_id", "seq").mapInArrow(run, "construct_id long, unit int, start int, tract int")
