import random
import time

import pytest

from frametide.llm import license_scan as L

SCHEMA = "doc_id long, text string, start string, license int, k1 int"
FILL = " ".join(f"filler{i}" for i in range(60))
LONG = " ".join(f"clause{i} of the long grant" for i in range(30))


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c > "\x7f" or c.isdigit() or "a" <= c <= "z" else " " for c in lowered).split(" ") if lowered else []


def brute(text, templates):
    """The best share of each template's distinct shingles over all stretches a quarter longer than it, and the first such place."""
    w, out = [x for x in words_of(text) if x], {}
    for name, t in templates.items():
        x = [y for y in words_of(t) if y]
        k = min(5, len(x))
        places = [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
        shingles, length = set(places), len(places) + -(-len(places) // 4)
        own = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        hits = [i for i, s in enumerate(own) if s in shingles]
        best = max(((len({own[j] for j in hits if i <= j < i + length}), -i, max(j for j in hits if i <= j < i + length) + k) for i in hits), default=None)
        if best and best[0] >= 0.8 * len(shingles) - 1e-9:
            out[name] = (best[0] / len(shingles), -best[1], best[2])
    return out


def edited(text, n, rng):
    """``text`` with ``n`` words replaced."""
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"changed{rng.randrange(10**6)}"
    return " ".join(w)


def test_planted_notices(spark):
    templates = {**L.TEMPLATES, "long": LONG}
    texts = [None, "", "short", FILL, *(f"{FILL}\n{t.upper()}!\n{FILL}" for t in L.TEMPLATES.values()), LONG, " ".join(LONG.split()[:60]) + " " + FILL, "released under the mit", f"{FILL} {LONG} {FILL} {LONG}", "All rights reserved", "x All rights, reserved."]
    texts += ["Licensed under the Apache License, Version 2.0. " * 50]
    rows = list(enumerate(texts)) + [(None, texts[5]), (5, texts[5])]
    got = {}
    for r in L.scan(spark.createDataFrame([(*x, "s", 1, 2) for x in rows], SCHEMA), templates).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.containment, r.start, r.end))
    for i, t in enumerate(texts):
        want = [(k, *v) for k, v in brute(t, templates).items()]
        assert sorted(got.get(i, [])) == sorted(want * (2 if i == 5 else 1)), t
    assert sorted(got[None]) == sorted((k, *v) for k, v in brute(texts[5], templates).items())


def test_recall_of_edited_copies(spark):
    """Copies with 0.8 to 0.99 of a license's shingles, at random places in other text."""
    rng = random.Random(3)
    long = [n for n, t in L.TEMPLATES.items() if len(t.split()) > 44]
    texts = []
    for i in range(240):
        t = L.TEMPLATES[long[i % len(long)]]
        filler = [f"w{rng.randrange(5000)}" for _ in range(300)]
        at = rng.randrange(300)
        texts.append(" ".join([*filler[:at], edited(t, rng.randrange(0, 1 + len(t.split()) // 25), rng), *filler[at:]]))
    want = {(i, k): v for i, t in enumerate(texts) for k, v in brute(t, L.TEMPLATES).items()}
    below = sum(v[0] < 1 for v in want.values())
    got = {(r.doc_id, r.license): (r.containment, r.start, r.end) for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert below > 100 and set(got) <= set(want)
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want)


def test_bands_guarantee_retrieval():
    assert L.collision(0.66) > 0.998 and L.collision(0.47) > 0.94 and L.collision(1.0) == pytest.approx(1)
    rng = random.Random(1)
    for s in (0.3, 0.5, 0.7):
        draws = [[rng.random() < s for _ in range(L.HASHES)] for _ in range(20_000)]
        met = sum(any(a and b for a, b in zip(d, d[1:] + d[:1])) for d in draws) / 20_000
        assert met == pytest.approx(L.collision(s), abs=0.02)


def test_limits_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert L.scan(df).count() == 0
    with pytest.raises(ValueError):
        L.scan(df, {"none": "..."})
    many = spark.createDataFrame([(f"t{i}", " ".join(f"x{i}y{j}" for j in range(30 + i % 200))) for i in range(600)], "license string, text string")  # over 50,000 shingles
    one = spark.createDataFrame([(7, " ".join(f"x599y{j}" for j in range(229)))], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.containment) for r in L.scan(one, many).collect()] == [(7, "t599", 1.0)]


def test_very_long_texts_take_time_in_proportion(spark):
    took = []
    for n in (8_000, 32_000):
        df = spark.createDataFrame([(1, "All rights reserved. " * n + L.TEMPLATES["ISC-text"])], "doc_id long, text string")
        began = time.time()
        assert sorted(r.license for r in L.scan(df).collect()) == ["ISC-text", "rights-reserved"]
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 5
