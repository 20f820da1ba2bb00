"""Expected counts of words beyond the bound for batches."""

from __future__ import annotations

import numpy as np
import pytest

from terrasieve.llm import lattice


@pytest.fixture(scope="module")
def units():
    pieces, start = lattice.vocabulary()
    return lattice.Units(pieces, np.log(start))


WORDS = [
    b"https://example.org/some/long/path/with/many/words?and=values&more=" + b"abcdefghij" * 14,
    "これは空白のない長い文で、ひとつの語として数えられます。".encode() * 3,
    b"internationalisation" * 10,
]


def test_long_words_count_all_segmentations(units, monkeypatch):
    weights = np.array([1.0, 3.0, 2.0])
    got = lattice.expected_counts(WORDS, weights, units)
    monkeypatch.setattr(lattice, "_SHORT", 1000)
    want = lattice.expected_counts(WORDS, weights, units)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert got[256:].sum() > got[:256].sum()


def test_long_words_score_as_short_ones(units, monkeypatch):
    rng = np.random.default_rng(0)
    words = [*WORDS, *[bytes(rng.integers(33, 127, int(n)).astype(np.uint8)) for n in rng.integers(70, 3000, 90)], b"", b"a"]
    monkeypatch.setattr(lattice, "_SHORT", 10**6)
    want = lattice.word_log_probs(words, units)
    monkeypatch.undo()
    assert lattice.word_log_probs(words, units) == pytest.approx(want, rel=1e-12)
    weights = rng.random(len(words))
    assert np.allclose(sum(lattice.expected_counts([w], np.array([x]), units) for w, x in zip(words[:20], weights)), lattice.expected_counts(words[:20], weights[:20], units), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("block", [64, 100, 8192])
def test_blocks_join(units, block):
    word = lattice.WORD_MARK + WORDS[0]
    total = np.zeros(len(units.pieces))
    lattice._long_counts([word], np.ones(1), units, total, block=block)
    sizes = np.array([len(p) for p in units.pieces])
    assert (total * sizes).sum() == pytest.approx(len(word))
    edges = units.edges(np.frombuffer(word, dtype=np.uint8)[None, :])
    alpha, beta = lattice.forward(edges, 1, len(word)), lattice.backward(edges, 1, len(word))
    want = np.zeros(len(total))
    for size, unit, logp in edges:
        hit = unit[0] >= 0
        np.add.at(want, unit[0][hit], np.exp(alpha[: len(word) + 1 - size, 0] + logp[0] + beta[size:, 0] - alpha[-1, 0])[hit])
    assert np.allclose(total, want, rtol=1e-9, atol=1e-12)
