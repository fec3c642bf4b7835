"""Shared kernels: Arrow text columns as byte blocks, span hashing, chain decoding, durable cuts.

Python operators here work on blocks of a few megabytes taken from Arrow batches.  A block is one
``uint8`` array plus row offsets, so tokenising, hashing and scoring are NumPy passes over bytes and
no Python object is made per word.  UTF-8 keeps every non-ASCII character at bytes >= 0x80, hence
byte classes are enough for the ASCII-delimited tokens the operators use.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 2 << 20
SEGMENT_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over byte values; each range is inclusive."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: After lower-casing: digits, a-z and every non-ASCII byte.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Letters only.
ALPHA = byte_class((0x61, 0x7A), (0x80, 0xFF))
#: Everything but ASCII white space (tab, LF, VT, FF, CR, space).
SOLID = ~byte_class((0x09, 0x0D), (0x20, 0x20))
NOT_NEWLINE = ~byte_class((0x0A, 0x0A))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder and cut its lineage there."""
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(session))
    return df.checkpoint(eager=True)


_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="strandloom-"))
    return _OWN_DIR[0]


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and behind it what its task freed goes back to the machine: Python workers live on for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        # Arrays come from the C library, which keeps freed pages; only some libraries can be told to return them.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def text_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding at most ``limit`` text bytes, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_block(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
            to = min(max(to, row + 1), batch.num_rows)
            yield batch.slice(row, to - row)
            row = to
    pa.default_memory_pool().release_unused()


def shards(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in shards of about ``limit`` text bytes (one row at least): small batches join, large ones are cut.

    ``text`` is the column's index, so names may repeat.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_block(batch.column(text))
        row = 0
        while row < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[row] + limit - size, "right")) - 1
            to = min(max(to, row + (not held)), batch.num_rows)
            if to > row:
                held.append(batch.slice(row, to - row))
                size += int(offsets[to] - offsets[row])
                row = to
            if row < batch.num_rows or size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)
        held = []
    # Workers live on for other tasks: what this one freed goes back to the machine.
    pa.default_memory_pool().release_unused()


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes within each row, and per-row bounds into them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    starts = np.flatnonzero(inside & ~before)
    before[:-1] = inside[1:]
    before[-1] = False
    tails = offsets[1:] - 1
    before[tails[tails >= 0]] = False
    ends = np.flatnonzero(inside & ~before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, SEGMENT_BYTES + 65536)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result may be used."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *heads: int) -> list[np.ndarray]:
    """64-bit hashes of ``data[start:end]``; for each of ``heads`` also of at most that many first bytes.

    Spans are sorted and disjoint.  Memory is bounded by the segment or the longest span.
    """
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(heads))]
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + SEGMENT_BYTES, "right")), i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        for k, head in enumerate((None, *heads)):
            to = e if head is None else np.minimum(s + head, e)
            out[k][i:j] = mix((sums[to] - sums[s]) * down[s] + (to - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        i = j
    return out


def window_hashes(tokens: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive tokens in each row (a shorter row has one), and per-row bounds."""
    counts = np.diff(bounds)
    sizes = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    row = np.repeat(np.arange(len(counts)), sizes)
    first = bounds[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    last = bounds[1:][row]
    acc = np.zeros(len(first), np.uint64)
    for k in range(width):
        here = first + k
        ok = here < last
        token = tokens[np.minimum(here, max(len(tokens) - 1, 0))] if len(tokens) else acc
        acc = acc * np.uint64(0x9FB21C651E98DF25) + np.where(ok, token, np.uint64(0))
    return mix(acc), at


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte position 0..n, the number of characters that begin before it."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


CHUNK = 64


def chunked(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each row's tokens in (chunk, step) layout, and per-row bounds into the chunks."""
    counts = np.diff(bounds)
    per = -(-counts // CHUNK)
    at = np.concatenate(([0], np.cumsum(per)))
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(bounds[-1] - bounds[0]) - (bounds[:-1] - bounds[0])[row]
    return at[:-1][row] * CHUNK + inside, at


def _rounds(at: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: the rows that have a k-th chunk, longest rows first."""
    per = np.diff(at)
    order = np.argsort(-per, kind="stable")
    alive = np.searchsorted(-per[order], -np.arange(1, (per.max() if len(per) else 0) + 1), "right")
    return [order[:n] for n in alive]


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Best state per token of each row when every change of state costs ``penalty``.

    Exact: rows are cut in chunks, each chunk's (entry, exit) matrix is taken over max-plus for all
    chunks at once, the matrices are chained per row, and chunks are then decoded between known ends.
    """
    n, states = scores.shape
    if n == 0:
        return np.zeros(0, np.int8)
    where, at = chunked(bounds)
    chunks = int(at[-1])
    grid = np.zeros((chunks * CHUNK, states), np.float32)
    grid[where] = scores
    grid = grid.reshape(chunks, CHUNK, states).transpose(1, 0, 2).copy()
    stay = np.where(np.eye(states, dtype=bool), 0, -penalty).astype(np.float32)
    whole = stay[None] + grid[0][:, None, :]
    for t in range(1, CHUNK):
        whole = np.maximum(whole, whole.max(2, keepdims=True) - penalty) + grid[t][:, None, :]
    rounds = _rounds(at)
    rows = len(bounds) - 1
    level = np.zeros((rows, states), np.float32)
    entry = np.zeros((chunks, states), np.int8)
    for k, live in enumerate(rounds):
        through = level[live][:, :, None] + whole[at[:-1][live] + k]
        entry[at[:-1][live] + k] = through.argmax(1)
        best = through.max(1)
        level[live] = best - best.max(1, keepdims=True)
    last = level.argmax(1).astype(np.int8)
    enter, leave = np.zeros(chunks, np.int8), np.zeros(chunks, np.int8)
    for k in range(len(rounds) - 1, -1, -1):
        live = rounds[k]
        c = at[:-1][live] + k
        leave[c] = last[live]
        last[live] = enter[c] = entry[c, last[live]]
    back = np.zeros((CHUNK, chunks, states), np.int8)
    same = np.arange(states, dtype=np.int8)
    value = stay[enter] + grid[0]
    for t in range(1, CHUNK):
        top = value.argmax(1)
        jump = np.take_along_axis(value, top[:, None], 1) - penalty
        back[t] = np.where(value >= jump, same, top[:, None])
        value = np.maximum(value, jump) + grid[t]
    state = np.zeros((CHUNK, chunks), np.int8)
    state[-1] = leave
    each = np.arange(chunks)
    for t in range(CHUNK - 1, 0, -1):
        state[t - 1] = back[t, each, state[t]]
    return state.T.reshape(-1)[where]


def chain_marginals(emission: np.ndarray, bounds: np.ndarray, trans: np.ndarray, pairwise: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """P(state 1) per token of a two-state linear chain, by forward-backward over whole rows.

    With ``pairwise`` also the expected number of transitions between states, (2, 2): the sum of the pairwise marginals of
    neighbouring tokens, a row's first token counting as a transition from state 0.

    ``emission`` is the log-potential of state 1 against state 0 and ``trans`` the 2x2 log-potentials; a
    row begins as if state 0 stood before it.  Chunks are processed together as in :func:`viterbi`, in
    linear space with rescaling.
    """
    n = len(emission)
    if n == 0:
        return (np.zeros(0), np.zeros((2, 2))) if pairwise else np.zeros(0)
    where, at = chunked(bounds)
    chunks = int(at[-1])
    lift = np.ones((chunks * CHUNK, 2))
    lift[where, 1] = np.exp(np.clip(emission, -30, 30))
    used = np.zeros(chunks * CHUNK, bool)
    used[where] = True
    lift = lift.reshape(chunks, CHUNK, 2).transpose(1, 0, 2).copy()
    used = used.reshape(chunks, CHUNK).T
    a = np.exp(trans - trans.max())
    eye = np.eye(2)

    def step(m: np.ndarray, t: int) -> np.ndarray:
        moved = (m @ a) * lift[t][:, None, :]
        return np.where(used[t][:, None, None], moved / moved.sum((1, 2), keepdims=True), m)

    whole = np.broadcast_to(eye, (chunks, 2, 2))
    for t in range(CHUNK):
        whole = step(whole, t)
    rounds = _rounds(at)
    rows = len(bounds) - 1
    front = np.empty((chunks, 2))
    level = np.tile([1.0, 0.0], (rows, 1))
    for k, live in enumerate(rounds):
        c = at[:-1][live] + k
        front[c] = level[live]
        moved = np.einsum("ri,rij->rj", level[live], whole[c])
        level[live] = moved / moved.sum(1, keepdims=True)
    rear = np.empty((chunks, 2))
    level = np.ones((rows, 2))
    for k in range(len(rounds) - 1, -1, -1):
        live = rounds[k]
        c = at[:-1][live] + k
        rear[c] = level[live]
        moved = np.einsum("rij,rj->ri", whole[c], level[live])
        level[live] = moved / moved.sum(1, keepdims=True)
    ahead = np.empty((CHUNK, chunks, 2))
    value = front
    for t in range(CHUNK):
        moved = (value @ a) * lift[t]
        value = np.where(used[t][:, None], moved / moved.sum(1, keepdims=True), value)
        ahead[t] = value
    out = np.zeros((CHUNK, chunks))
    moves = np.zeros((2, 2))
    value = rear
    for t in range(CHUNK - 1, -1, -1):
        both = ahead[t] * value
        out[t] = both[:, 1] / both.sum(1)
        if pairwise:
            before = ahead[t - 1] if t else front
            pair = before[:, :, None] * a[None] * (lift[t] * value)[:, None, :]
            moves += (pair / pair.sum((1, 2), keepdims=True))[used[t]].sum(0)
        moved = (lift[t] * value) @ a.T
        value = np.where(used[t][:, None], moved / moved.sum(1, keepdims=True), value)
    return (out.T.reshape(-1)[where], moves) if pairwise else out.T.reshape(-1)[where]
