import random
import re

import numpy as np
import pytest

from tessera.llm import periodic_runs
from tessera.llm.queries import with_periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(s, least, periods):
    out = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            a = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            t = s[a : i + q]
            if len(t) >= max(least, periods * q) and i > a and not any(t[r:] == t[:-r] for r in range(1, q)):
                out.append((a, len(t), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def strings():
    rng = random.Random(3)
    for i in range(1500):
        n = rng.randint(0, 48)
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(n)]
        if i % 3 == 0 and n > 6:
            a, p = rng.randrange(n), rng.randint(1, 8)
            s = [s[x] if x < a else s[min(a + (x - a) % p, n - 1)] for x in range(n)]
        yield s


def test_runs_and_lyndon_arrays_by_brute_force():
    for s in strings():
        for least, periods in ((2, 2), (4, 3), (6, 4)):
            assert periodic_runs.runs_of(s, least, periods) == brute(s, least, periods)
        for up in (True, False):
            suffix = [[x if up else -x for x in s[i:]] for i in range(len(s))]
            smaller = [next((j for j in range(i + 1, len(s)) if suffix[j] < suffix[i]), len(s)) for i in range(len(s))]
            assert periodic_runs.lyndon(s, up)[0] == smaller


def test_stretches_hold_every_run():
    for s in strings():
        first = np.array([0, len(s)])
        found = list(periodic_runs.stretches(np.array(s, np.int64), first, 6, 4))
        assert all(any(a <= start and start + length <= b for _, a, b in found) for start, length, _ in brute(s, 6, 4))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("s", [[0] * 5000, fibonacci(5000), [0, 1] * 2500, ([0] * 50 + [1]) * 100, [0] * 2500 + [1] + [0] * 2500, [i.bit_count() % 2 for i in range(5000)], [i * i % 97 for i in range(5000)]])
def test_words_are_compared_a_few_times_only(s):
    assert all(periodic_runs.lyndon(s, up)[2] <= 3 * len(s) for up in (True, False))


def by_hand(text, least=6, periods=4):
    w = WORD.findall(text or "")
    found = brute([sorted(set(w)).index(x) for x in w], least, periods) if len(w) < 400 else None
    keep = [True] * len(w)
    for a, n, q in found or []:
        keep[a + q : a + n] = [False] * (n - q)
    return len(w), found, " ".join(x for x, k in zip(w, keep, strict=True) if k)


def test_documents(docs, rows):
    got = periodic_runs.collapse(docs).collect()
    plain = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in got if r.n_words < 400]
    want = [(i, *by_hand(t)) for i, t, *_ in rows if len(WORD.findall(t or "")) < 400]
    assert sorted(plain, key=repr) == sorted(want, key=repr)
    assert len(got) == len(rows) and any(r[2] for r in plain)


def test_long_text_of_many_words(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(20000)}é"
    passage = [word() for _ in range(30000)]
    text = [word() for _ in range(50000)] + passage * 4 + ["tail"] + ["ab", "c"] * 5
    (got,) = periodic_runs.collapse(spark.createDataFrame([(None, "\n".join(text))], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got.runs] == [(50000, 120000, 30000), (170001, 10, 2)]
    assert got.kept_text == " ".join(text[:80000] + ["tail", "ab", "c"])


def test_no_rows_and_wrong_limits(empty):
    assert periodic_runs.collapse(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.collapse(empty, periods=1)


def test_planted_periods(spark):
    import zlib

    texts = {i: " ".join(f"x{j}" for j in range(i % 37)) for i in range(200)}
    got = {r.doc_id: r.text for r in with_periods(spark.createDataFrame([*texts.items(), (None, "a b")], "doc_id long, text string")).collect()}
    assert got.pop(None) == "a b"
    for i, t in texts.items():
        h, w = zlib.crc32(str(i).encode()), t.split()
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        assert got[i] == " ".join(w)
