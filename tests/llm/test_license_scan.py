"""License notices inside ordinary text."""

import pytest

from wavelane.llm import license_scan as I

PROSE = "every house on the hill was painted again before the long winter came to this quiet valley and its people "
NOTICES = ["Apache-2.0", "MIT", "GPL-3.0", "CC-BY-4.0", "CC0-1.0"]


def names(text):
    return [f["license"] for f in I.Scanner(I.TEMPLATES).text(text)["found"]]


@pytest.mark.parametrize("name", NOTICES)
@pytest.mark.parametrize("times", [1, 6, 40])
def test_notice_inside_a_paragraph(name, times):
    text = f"{PROSE * times}{I.TEMPLATES[name]} {PROSE * times}"
    found = I.Scanner(I.TEMPLATES).text(text)["found"]
    assert [(f["license"], f["missing"], f["extra"]) for f in found] == [(name, [], [])]
    assert found[0]["reduction"] == I.Scanner(I.TEMPLATES).text(I.TEMPLATES[name])["found"][0]["reduction"] > 0.4


def test_every_license_of_a_line():
    assert names("Released under the MIT License. Licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert names(" ".join(I.TEMPLATES[n] for n in ("CC-BY-4.0", "GPL-2.0", "MIT", "CC-BY-SA-4.0", "MPL-2.0"))) == ["CC-BY-4.0", "GPL-2.0", "MIT", "CC-BY-SA-4.0", "MPL-2.0"]
    # A notice is no second license by words that the better match has; one said twice on a line is one.
    assert all(names(t) == [n] for n, t in I.TEMPLATES.items())
    assert names("Released under the MIT License. Released under the MIT License.") == ["MIT"]


def test_texts_and_the_notices_in_them():
    mit = I.TEMPLATES["MIT-text"]
    assert names("Copyright (c) 2020 Some Body\n\n" + mit) == ["MIT-text"]
    assert names(mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "NICE PEOPLE OF THE VILLAGE")) == ["MIT-text"]
    assert names(mit[: len(mit) // 2]) == ["MIT-grant"]
    assert names(I.TEMPLATES["BSD-2-Clause-text"] + " " + I.TEMPLATES["MIT"]) == ["BSD-2-Clause-text", "MIT"]


def by_definition(text):
    """(line, license) by every window of every template, the longest common subsequence of each, and the best match first."""
    import zstandard

    at = I.spans(text)
    own = [text[a:b].lower() for a, b in at]
    free, found = list(own), []
    known = []
    for name, t in I.TEMPLATES.items():
        raw = zstandard.ZstdCompressionDict(" ".join(I.words(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.append((name, I.words(t), zstandard.ZstdCompressor(level=I.LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)))
    plain = zstandard.ZstdCompressor(level=I.LEVEL, write_content_size=False)
    while True:
        best = None
        for name, ws, packed in known:
            n = len(ws)
            for i in range(len(free)):
                row, here = [0] * (n + 1), None
                for j in range(i, min(i + n + int(I.EXTRA * n), len(free))):
                    new = [0]
                    for k in range(n):
                        new.append(row[k] + 1 if ws[k] == free[j] else max(row[k + 1], new[k]))
                    row = new
                    extra = j + 1 - i - row[n]
                    if row[n] >= I.WORDING * n and extra <= I.EXTRA * n and (here is None or 2 * row[n] - n - extra > here[0]):
                        here = 2 * row[n] - n - extra, j + 1
                if here:
                    block = " ".join(own[i : here[1]]).encode()
                    key = (len(packed.compress(block)) - len(plain.compress(block)), -here[0], name, i, here[1])
                    best = min(best, key) if best else key
        if best is None:
            return {(text.count("\n", 0, place), name) for place, name in found}
        _, _, name, i, j = best
        common = I.wording(next(ws for k, ws, _ in known if k == name), free[i:j])[2]
        found.append((at[i + common[0]][0], name))
        for c in common:
            free[i + c] = None


def test_against_every_window_of_every_template():
    import random

    r = random.Random(11)
    short = [n for n in I.TEMPLATES if len(I.words(I.TEMPLATES[n])) < 30]
    texts = [None, "", "license", "Licensed under", "\n\n", "Licensed\nunder\nCC\nBY 4.0. Licensed under CC BY-SA 4.0."]
    for _ in range(25):
        parts = []
        for _ in range(r.randint(1, 3)):
            parts += [w for w in I.TEMPLATES[r.choice(short)].split() if r.random() < 0.93]
            parts += ["wood"] * r.choice([0, 0, 2])
        texts.append("".join(w + r.choice([" ", " ", "\n"]) for w in parts))
    s = I.Scanner(I.TEMPLATES)
    for t in texts:
        got = {(f["line"], f["license"]) for f in s.text(t)["found"]}
        assert got == (by_definition(t) if t and I.CANDIDATE.search(t) else set())


def test_precision_and_recall_on_planted_notices(spark):
    """Notices whose words stand in a document word for word are found, and what is found without a difference stands there."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    s, total = I.Scanner(I.TEMPLATES), 0
    whole = {n: f" {' '.join(I.words(t))} " for n, t in I.TEMPLATES.items()}
    for t in docs:
        text = f" {' '.join(I.words(t or ''))} "
        stands = {n for n, ws in whole.items() if ws in text}
        stands -= {n for n in stands if any(n != m and whole[n].strip() in whole[m] for m in stands)}
        found = s.text(t)["found"]
        total += len(stands)
        assert stands <= {f["license"] for f in found}
        assert {f["license"] for f in found if not f["missing"] and not f["extra"]} <= {n for n, ws in whole.items() if ws in text}
    assert total > 5


def wrapped(text, width, mark):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


@pytest.mark.parametrize("mark", ["", " * ", "// ", "-- ", "\t#  "])
@pytest.mark.parametrize("width", [12, 40, 72])
def test_wrapped_notices(width, mark):
    for name, notice in I.TEMPLATES.items():
        found = I.Scanner(I.TEMPLATES).text(f"one\n{wrapped(PROSE * 4, width, mark)}\n{wrapped(notice, width, mark)}\n{wrapped(PROSE * 4, width, mark)}")["found"]
        line = 1 + len(wrapped(PROSE * 4, width, mark).split("\n"))
        assert [(f["license"], f["line"], f["missing"], f["extra"]) for f in found] == [(name, line, [], [])]


def test_blocks_lose_nothing():
    """Notices at random places and distances, against the whole text as one block."""
    import random

    r, s = random.Random(5), I.Scanner(I.TEMPLATES)
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 5)):
            notice = [w for w in r.choice(list(I.TEMPLATES.values())).split() if r.random() < 0.97 or I.CANDIDATE.search(w) or w in ("public", "domain")]
            parts += [*notice, *(r.choice(["", "--", "wood", "x" * 900, "tree", "été"]) for _ in range(r.choice([0, 3, 60, 200])))]
        text = "".join(w + r.choice([" ", " ", "\n", "\r\n\t"]) for w in parts)
        got = s.text(text)["found"]
        assert len({(f["line"], f["license"]) for f in got}) == len(got)
        want = {(text.count("\n", 0, at), name) for at, name, *_ in s.matches(text, I.spans(text))}
        assert {(f["line"], f["license"]) for f in got} == want
