"""What a text's score may depend on, and where the threshold comes to lie."""

import numpy as np
import pytest

from scorelake.llm import toxicity


def test_a_words_inputs_do_not_depend_on_its_neighbours():
    words = ["a", "of", "the", "fine", "Zürich", "idiot", "世界", "x" * 40]
    m = toxicity.Model.new(1)
    alone = np.concatenate([toxicity.inputs(m, [w]) for w in words])
    for order in (range(8), range(7, -1, -1), [3, 1, 4, 0, 5, 2, 7, 6]):
        assert np.allclose(toxicity.inputs(m, [words[i] for i in order]), alone[list(order)], atol=1e-7)
    assert not np.allclose(alone[1, toxicity.WORD_DIM :], alone[2, toxicity.WORD_DIM :])


def test_a_texts_score_does_not_depend_on_the_other_texts():
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    rows = [(" ".join(word(20) + ["idiot"] * (i % 3 == 0) + word(20)), int(i % 3 == 0)) for i in range(90)]
    m = toxicity.train(rows)
    texts = [t for t, _ in rows]
    together = toxicity._score_texts(m, texts, "together")
    alone = [float(toxicity._score_texts(m, [t], f"alone {i}")[0]) for i, t in enumerate(texts)]
    assert np.allclose(together, alone, atol=1e-3)
    assert np.mean((together >= toxicity.THRESHOLD) == np.array([y for _, y in rows])) > 0.95


@pytest.mark.parametrize("same", [8.0, -8.0, 0.0])
def test_equally_strong_texts_are_not_all_rejected(same):
    """Nothing tells the texts apart: the offset is the regression's, about the share of toxic texts."""
    y = (np.arange(1000) % 3 == 0).astype(np.float32)
    w = toxicity._fit_top(np.full((1000, toxicity.TOP), same), y)
    got = toxicity._sigmoid(np.full(toxicity.TOP, same) @ w[:-1] + w[-1])
    assert abs(got - y.mean()) < 0.02


def test_texts_that_are_equally_strong_fall_on_one_side():
    """700 clean texts and all toxic ones are as strong as can be, 10 toxic ones of them come first: there is no place
    between them, so the threshold lies below or above all of them."""
    y = np.array([1.0] * 10 + [0.0] * 990, np.float32)
    f = np.full((1000, toxicity.TOP), 8.0)
    f[710:] = -8.0
    w = toxicity._fit_top(f, y)
    z = f @ w[:-1] + w[-1]
    at = np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
    assert np.abs(z - at).min() > 0.1 and np.isfinite(w).all()


def test_regression_settles_where_plain_steps_go_astray():
    """Nearly all texts are strong, so the first step of Newton's method overshoots."""
    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.3).astype(np.float32)
    f = np.clip(8 - np.abs(rng.normal(0, 0.3, (3000, toxicity.TOP))) - 0.2 * (1 - y[:, None]), -8, 8)
    f = -np.sort(-f, axis=1)
    a, w = toxicity._regression(f, y)
    p = toxicity._sigmoid(a @ w)
    assert np.linalg.norm(a.T @ (p - y) + 0.1 * w) < 1e-3 * len(y)
    got = toxicity._sigmoid(f @ (top := toxicity._fit_top(f, y))[:-1] + top[-1]) >= toxicity.THRESHOLD
    assert got[y == 1].mean() > got[y == 0].mean()
