"""Licence windows against comparing all windows, and notices in other text."""

from __future__ import annotations

import random
import re

import pytest

from tableloom.llm.licenses import TEMPLATES, VARIANTS, Templates, scan

KNOWN = Templates(TEMPLATES, 0.8)


def wrapped(text: str) -> str:
    """The notice among other words, over lines that begin with a mark."""
    words = text.split()
    return "Some words before it here.\n# " + "\n# ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\nAnd the file goes on after that."


@pytest.mark.parametrize(("name", "text"), TEMPLATES)
def test_each_template_is_found_as_itself(name, text):
    assert KNOWN.notices(text.encode()) == [(1.0, name)]
    assert [n for _, n in KNOWN.notices(wrapped(text).encode())] == [name]


@pytest.mark.parametrize(("text", "want"), [
    ("Copyright 2024 X. Released under the MIT License. See the other file for more.", ["mit"]),
    ("Copyright 2020 Jane Doe. All rights reserved.", ["all-rights-reserved"]),
    ("All\trights\treserved.", ["all-rights-reserved"]),
    ("All\nrights\nreserved.", ["all-rights-reserved"]),
    ("This work is licensed under the GNU General Public License, version 1.", []),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", []),
    ("Licensed under CC BY-NC 2.0.", []),
    ("All the rights that were reserved for them were sold.", []),
    ("Released under the MIT License. All rights reserved. Released under the MIT License.", ["mit", "all-rights-reserved", "mit"]),
])
def test_notices(text, want):
    assert [n for _, n in KNOWN.notices(text.encode())] == want


def brute(text: str, templates, least: float) -> list[tuple[float, str]]:
    """The same by comparing every window with every template."""

    def pairs(words):
        return {(a, b) for a, b in zip(words, words[1:])}

    def marks(words):
        return {w for w in words if w.isdigit() or w in VARIANTS}

    words, met = re.findall("[a-z0-9]+", text.lower()), []
    for name, t in templates:
        own = re.findall("[a-z0-9]+", t.lower())
        for a in range(len(words) - 1):
            for b in range(a, min(len(words) - 1, a + int((len(own) - 1) * (2 - least) / least + 1e-9))):
                window, wanted = words[a : b + 2], pairs(own)
                dice = 2 * len(pairs(window) & wanted) / (len(pairs(window)) + len(wanted))
                ends = {(words[a], words[a + 1]), (words[b], words[b + 1])}
                if dice >= least and ends <= wanted and marks(window) == marks(own):
                    met.append((a, b, -dice, name))
    out, end = [], -1
    for a, b, less, name in sorted(met):
        if a > end:
            out.append((less, name))
        else:
            out[-1] = min(out[-1], (less, name))
        end = max(end, b)
    return [(-less, name) for less, name in out]


def test_against_all_windows():
    rng = random.Random(8)
    short = [t for t in TEMPLATES if len(t[1]) < 130]
    for _ in range(150):
        words = []
        for _ in range(3):
            words += rng.choice(short)[1].split() + rng.choices("the of rights license under is reserved 4 sa work".split(), k=rng.randrange(4))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "2", "the", "license"])
        text = " ".join(words)
        assert Templates(tuple(short), 0.8).notices(text.encode()) == brute(text, short, 0.8), text


def test_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, "Licensed under CC BY 4.0. All rights reserved."), (3, "no licence at all"), (4, None), (5, "")]
    got = sorted(map(tuple, scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    # of equal coefficients the first name
    assert got == [(1, 1, "mit", 1.0, "mit")] * 2 + [(2, 2, "all-rights-reserved", 1.0, "all-rights-reserved,cc-by-4.0")] + [(k, 0, None, 0.0, "") for k in (3, 4, 5)]
