"""Shared kernels against plain versions."""

import itertools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import blocks

TEXTS = st.lists(st.one_of(st.none(), st.text("aB1 é\n.-\t😀", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_spans_match_regex(texts):
    data, offsets = blocks.text_block(pa.array(texts, pa.string()))
    data = blocks.LOWER[data]
    starts, ends, bounds = blocks.spans(data, offsets, blocks.ALNUM)
    hashes, head = blocks.span_hashes(data, starts, ends, 2)
    for k, text in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)
        got = [data[a:b].tobytes().decode() for a, b in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]], strict=True)]
        assert got == words
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len({*zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))
    assert len({w[:2] for w in words}) == len(set(head.tolist()))


def test_hash_of_a_long_span_is_that_of_its_bytes():
    long = np.frombuffer(b"ab" * (blocks.SEGMENT_BYTES), np.uint8)
    a = blocks.span_hashes(long, np.array([0]), np.array([len(long)]))[0]
    b = blocks.span_hashes(np.concatenate(([32], long)).astype(np.uint8), np.array([1]), np.array([len(long) + 1]))[0]
    assert a == b


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for n, states, penalty in [(1, 2, 1.0), (6, 3, 0.7), (5, 4, 2.0), (0, 2, 1.0)]:
        scores = rng.normal(size=(n, states)).astype(np.float32)
        got = blocks.viterbi(scores, np.array([0, n]), penalty)

        def value(path, scores=scores, penalty=penalty):
            return sum(scores[i, s] for i, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

        best = max((value(p) for p in itertools.product(range(states), repeat=n)), default=0)
        assert abs(value(got.tolist()) - best) < 1e-4


def test_viterbi_over_chunks_equals_plain():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 64, 65, 300, 2]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(size=(bounds[-1], 4)).astype(np.float32)
    got = blocks.viterbi(scores, bounds, 3.0)
    for a, b in zip(bounds, bounds[1:]):
        v = np.zeros(4)
        for i in range(a, b):
            v = np.maximum(v, v.max() - 3.0) + scores[i] if i > a else scores[i].astype(float)
        path = got[a:b]
        if b > a:
            mine = scores[np.arange(a, b), path].sum() - 3.0 * (path[1:] != path[:-1]).sum()
            assert abs(mine - v.max()) < 1e-3


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(2)
    sizes = [3, 0, 130, 64, 1]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    emission, trans = rng.normal(size=bounds[-1]) * 2, rng.normal(size=(2, 2))
    got = blocks.chain_marginals(emission, bounds, trans)
    for a, b in zip(bounds, bounds[1:]):
        n = b - a
        if not n:
            continue
        e = np.stack([np.zeros(n), emission[a:b]], 1)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = trans[0] + e[0]
        for t in range(1, n):
            alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, None] + trans, 0) + e[t]
        for t in range(n - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(trans + e[t + 1] + beta[t + 1], 1)
        p = alpha + beta
        want = np.exp(p[:, 1] - np.logaddexp(p[:, 0], p[:, 1]))
        assert np.abs(got[a:b] - want).max() < 1e-9
