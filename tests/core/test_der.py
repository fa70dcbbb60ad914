"""The error rate of speaker turns against a plain count of steps."""

import math
import random
from collections import Counter, defaultdict

import pytest

from talktide.operators import speakers

TURN = "media_id string, seq int, start double, end double, speaker string"


def brute(reference, hypothesis, collar=0.25, step=0.01):
    def ticks(rows):
        out = defaultdict(list)
        for m, _, a, b, s in rows:
            if b - a > step:
                for k in range(math.ceil(a / step), math.ceil(b / step)):
                    out[m, k].append((s, k * step - a < collar or b - k * step < collar))
        return out

    ref, hyp, common, found = ticks(reference), ticks(hypothesis), Counter(), defaultdict(list)
    low = lambda s: (s is not None, s or "")
    for (m, k), own in ref.items():
        if len(own) == 1 and not own[0][1]:
            said = min((s for s, _ in hyp.get((m, k), ()) if s is not None and m is not None), default=None)
            found[m].append((own[0][0], said))
            if said is not None:
                common[m, said, own[0][0]] += 1
    as_ref = {}
    for (m, said, told), n in common.items():
        as_ref[m, said] = max(as_ref.get((m, said), (0, (False, ""), None)), (n, low(told), told), key=lambda x: x[:2])
    return {m: (len(x), sum(told != (as_ref[m, said][2] if said is not None else None) for told, said in x)) for m, x in found.items()}


def test_random_turns(spark):
    draw = random.Random(3)
    sides = [[(draw.choice(["m", "n", "o", None]), i, a := draw.choice([draw.random() * 20, draw.randrange(20) / 4]), a + draw.choice([0.005, 0.01, 0.3, 0.5, 0.51, draw.random() * 4]), draw.choice(["a", "b", "ü", None])) for i in range(40)] for _ in range(2)]
    sides[0] += [("only", 0, 1.0, 3.0, "a")]
    sides[1] += [("other", 0, 1.0, 3.0, "a")]
    found = speakers.der(*(spark.createDataFrame(x, TURN) for x in sides)).collect()
    known = brute(*sides)
    assert {r.media_id: (round(r.scored * 100), round(r.errors * 100)) for r in found} == known
    assert len(known) == 5 and all(r.der == pytest.approx(r.errors / r.scored) for r in found)


def test_a_long_turn_is_one_row(spark):
    rows = spark.createDataFrame([("m", 0, 0.0, 3e7, "a")], TURN)
    late = spark.createDataFrame([("m", 0, 1e7, 4e7, "x")], TURN)
    one = speakers.der(rows, late).first()
    assert one.scored == pytest.approx(3e7 - 0.5, abs=0.05) and one.errors == pytest.approx(1e7 - 0.25, abs=0.05)
