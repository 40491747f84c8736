"""Line dedup whose threshold follows the length, against brute force over 1 to 40 characters."""

import itertools
import random
from collections import defaultdict

import pytest

from casebook.llm import line_dedup
from tests.llm.test_llm_native import edit_distance


def plain(rows, threshold, chars_per_edit):
    places = [((k, t, no), line, i, no) for i, (k, t) in enumerate(rows) for no, line in enumerate(t.split("\n")) if line.strip()]
    first = {}
    for at, line, _, _ in sorted(places):
        first.setdefault(line, at)
    late = set()
    for x, y in itertools.permutations(first, 2):
        allowed = min(threshold, min(len(x), len(y)) // chars_per_edit)
        if allowed and abs(len(x) - len(y)) <= allowed and first[y] < first[x] and edit_distance(x, y) <= allowed:
            late.add(x)
    out = defaultdict(set)
    for at, line, i, no in places:
        if line in late or at != first[line]:
            out[i].add(no)
    return out


@pytest.mark.parametrize("threshold,chars_per_edit,seed", [(2, 10, 1), (2, 10, 2), (3, 5, 3), (1, 8, 4)])
def test_threshold_follows_the_length(spark, threshold, chars_per_edit, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcé", k=n)) for n in range(1, 41)]

    def edited(s):
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(s))
            s = rnd.choice([s[:at] + "x" + s[at:], s[:at] + s[at + 1:], s[:at] + "y" + s[at + 1:]])
        return s

    rows = [(i, "\n".join(edited(rnd.choice(base)) for _ in range(rnd.randint(1, 6)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = plain(rows, threshold, chars_per_edit)
    got = {r.doc_id: set(r.removed_lines) for r in line_dedup.dedup_lines(docs, threshold, 1, chars_per_edit=chars_per_edit).collect()}
    assert got == {i: gone[i] for i in range(len(rows))} and any(gone.values())


def test_bands_cover_every_length_once():
    for threshold, per, near in [(2, 10, 2), (3, 5, 2), (2, 1, 2), (4, 3, 7), (1, 10, 20)]:
        bands = line_dedup.length_bands(threshold, near, per)
        for shorter in range(1, 60):
            allowed = min(threshold, shorter // per) if shorter >= near else 0
            for longer in range(shorter, shorter + allowed + 1):
                fits = [e for e, least, most in bands if least <= shorter and (most is None or longer <= most)
                        and (most is None or shorter < (e + 1) * per)]
                if allowed and shorter > allowed:
                    assert fits == [allowed]
