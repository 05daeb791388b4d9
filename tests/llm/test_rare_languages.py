import random

import numpy as np

from sieveline.llm import language


def corpus(seed):
    """A draw of texts by language, each of its own words."""
    draw = random.Random(seed)
    letters = ["etaoinsh", "uxqvbjyw", "rdlcmfgp", "kzpwagoe"]
    words = {f"l{n}": ["".join(draw.choice(x) for _ in range(draw.randint(3, 8))) for _ in range(600)] for n, x in enumerate(letters)}
    return lambda name, n: " ".join(draw.choice(words[name]) for _ in range(n))


def right(samples, text, names):
    judge = language.Languages(language.cleaned(samples))
    return np.mean([judge.predict(text(k, 60))[0] == k for k in names for _ in range(40)])


def test_a_long_tail_leaves_common_languages_alone():
    text = corpus(1)
    samples = {k: [text(k, 300) for _ in range(60)] for k in ("l0", "l1", "l2")}
    samples |= {f"rare{n:02}": [f"zz{n} qq{n} kk{n} word{n}"] for n in range(30)}
    assert right(samples, text, ("l0", "l1", "l2")) >= 0.98


def test_a_rarer_language_is_still_told():
    text = corpus(2)
    samples = {k: [text(k, 300) for _ in range(60)] for k in ("l0", "l1", "l2")} | {"l3": [text("l3", 300) for _ in range(8)]}
    assert right(samples, text, ("l0", "l1", "l2", "l3")) >= 0.98


def test_one_single_text_leaves_cleaning_on():
    text = corpus(3)
    foreign = text("l1", 120)
    samples = {"l0": [*(text("l0", 300) for _ in range(10)), text("l0", 60) + " " + foreign], "l1": [text("l1", 300) for _ in range(10)], "l9": ["qq ww"]}
    kept = language.cleaned(samples)
    assert kept["l9"] == ["qq ww"]
    left = sum(len(set(foreign.split()) & set(t.split())) for t in kept["l0"])
    assert left < 30 < len(set(foreign.split()))
