"""Fingerprints of long texts made of repeated passages rest on all of their distinct phrases."""

import random

import pyarrow as pa

from tideline.llm import fingerprints


def test_repeated_passages_have_whole_sketches():
    rng = random.Random(4)
    passage = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x, y, long = passage(150), passage(150), passage(3000)
    (once, twice, other, both, many), _ = fingerprints.fingerprint(pa.array([x * 1000, x * 2000, y * 1000, x * 1000 + y * 1000, long * 1000]))
    assert once == twice and len(once) >= 8 * 20 and len(many) == 8 * fingerprints.SKETCH
    assert fingerprints.likeness(once, other) < 0.1
    assert 0.2 < fingerprints.likeness(once, both) < 0.8
