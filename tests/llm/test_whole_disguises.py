"""op3_toxicity: disguises in long runs, joined tokens, doubled signs and spaced neighbours."""

import random

import numpy as np
import pytest

from sparlog.llm import toxicity

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="module")
def lm(spark):
    text = [" ".join(R.choice(WORDS) for _ in range(30)) + R.choice(["", " blatherskite", " zarkinoid"]) + " a b" for _ in range(300)]
    return toxicity.char_model(spark.createDataFrame([(t,) for t in text], "text string"))


def test_nothing_of_a_disguise_is_left_out(lm):
    words = lambda t: toxicity.words_of(t, lm)[0]
    plain = [w for w in WORDS if len(w) > 3][:12]
    assert "blatherskite" in words("a b l a t h e r s k i t e b")
    assert "blatherskite" in words(" ".join(" ".join(plain * 4)) + " b l a t h e r s k i t e")
    for sign in ",/-_":
        assert {"blatherskite", "zarkinoid"} <= words(sign.join([*plain, "blatherskite", "z4rk1n0id", *plain]))
    flat = np.log(np.full((64, 64, 64), 1 / 64, np.float32))
    assert "zarkinoidss" in toxicity.words_of("zarkinoid$$", flat)[0]
