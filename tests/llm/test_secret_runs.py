"""Secret scans of very long runs, and harmless segments against the pattern that defines them."""

from __future__ import annotations

import random
import re
import string
import time

import pytest

from metricspark.llm import secrets

SCANNER = secrets.Scanner(secrets.SecretRules())
SEGMENTS = re.compile(f"(?i)[^/=_-]*(?:{secrets.ALLOWED_WORDS})[^/=_-]*")
WORDS = ["example", "placeholder", "your_", "your-", "YOUR", "yyour_", "dummyour-", "xxxxxx", "Sample", "dummy", "/", "=", "_", "-", "+", "a1", "Z9"]


def test_harmless_segments_equal_their_definition():
    rng = random.Random(1)
    for _ in range(20_000):
        run = "".join(rng.choice(WORDS) if rng.random() < 0.5 else rng.choice(string.ascii_letters) * rng.randint(1, 3) for _ in range(rng.randint(1, 12)))
        assert list(SCANNER.harmless(run)) == [m.span() for m in SEGMENTS.finditer(run)], run


@pytest.mark.parametrize("alphabet", ["0123456789abcdef", string.ascii_letters + string.digits + "+/", "a", "x", "ab-", string.ascii_lowercase + string.digits, "xX_"])
def test_long_runs_take_linear_time(alphabet):
    rng = random.Random(2)
    run = "".join(rng.choices(alphabet, k=1_000_000))
    began = time.process_time()
    SCANNER.spans(run, True)
    assert time.process_time() - began < 10


def test_many_spans_in_one_text():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=28)) for _ in range(20_000))
    began = time.process_time()
    found = SCANNER.spans(text, True)
    assert len(found) > 15_000 and time.process_time() - began < 10


def test_covers():
    rng = random.Random(4)
    for _ in range(300):
        spans = [(s, 0, s + rng.randint(1, 9)) for s in (rng.randint(0, 30) for _ in range(rng.randint(0, 6)))]
        cover = secrets._Cover(spans)
        for a in range(30):
            b = a + rng.randint(1, 6)
            assert cover.holds(a, b) == any(s <= a and b <= e for s, _, e in spans)
