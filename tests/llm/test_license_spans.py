"""op3_license_scan finds poorer matches on both sides of the best one, and the best one itself."""

import random
import time

import pytest

from prefmill.llm import license_scan


@pytest.mark.parametrize("text, want", [
    ("all rights resrved x all rights reserved y all rights reservd", [(0, 18, 1), (21, 40, 0), (43, 61, 1)]),
    ("all rights resrved all rights reserved", [(0, 18, 1), (19, 38, 0)]),
])
def test_neighbouring_notices_keep_their_spans(text, want):
    r = license_scan.NoticeScanner().scan(text.encode())
    assert [(x["start"], x["end"], x["edits"]) for x in r["spans"]] == want and r["score"] == 1


def test_the_best_match_is_never_lost():
    # "first match, then fitted" (the flag e) has 3 edits here where 0 are possible
    r = license_scan.NoticeScanner().scan(b"mozilla public lec ense version 2 mozilla public license version 2 0 all")
    assert 0 in [x["edits"] for x in r["spans"] if x["label"] == "mpl-2.0"]
    r, scanner = random.Random(1), license_scan.NoticeScanner()
    for _ in range(400):
        text, _, k, pattern = r.choice(scanner.notices)
        parts = []
        for _ in range(r.randint(1, 4)):
            w = list(text)
            for _ in range(r.randint(0, k + 1)):
                w[r.randrange(len(w))] = r.choice(["", "a", "e", "b ", " "])
            parts += ["".join(w), r.choice(["", " ", "x", text[:4]])]
        joined = " " + " ".join("".join(parts).split()) + " "
        before = [m.span() for m in pattern.finditer(joined)]
        found = license_scan.NoticeScanner.matches(pattern, joined, 0, len(joined))
        assert set(before) <= {m.span() for m in found}
        assert all(a.end() <= b.start() for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("near", ["general publc license ", "all rights resrved ", "gnu generl public license and more "])
def test_time_is_in_proportion_to_dense_texts(near):
    scanner, took = license_scan.NoticeScanner(), []
    for size in (100_000, 200_000):
        text = near.encode() * (size // len(near))
        t = time.process_time()
        spans = scanner.scan(text)["spans"]
        took.append(time.process_time() - t)
        assert len({x["start"] for x in spans}) >= size // len(near)
    assert took[1] < 3 * took[0] + 0.5 and took[1] < 10
