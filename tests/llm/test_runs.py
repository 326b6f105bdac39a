"""Periodic runs against a scan of every lag."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from barspan.llm import runs, text
from barspan.llm.queries import op12_periodic_runs, periodic_text


def plain_runs(ws):
    n, out = len(ws), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(ws[k] == ws[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(ws, found):
    gone = {k for a, length, q in found for k in range(a + q, a + length)}
    return " ".join(w for k, w in enumerate(ws) if k not in gone)


def found_runs(texts):
    data, offsets = text.raw(text.texts_of(pa.array(texts, pa.large_string())))
    starts, ends, first = text.word_bounds(data, offsets)
    out = [[] for _ in texts]
    for k, *run in runs.all_runs(text.word_codes(data, starts, ends), first).tolist():
        out[k].append(tuple(run))
    return out


def periodic(rng, n, kinds):
    ws = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n > 20:
        a = rng.randrange(n - 10)
        p = 1 + rng.randrange((n - a) // rng.randint(3, 10) + 1)
        for i in range(a, n):
            ws[i] = ws[a + (i - a) % p]
        if rng.random() < 0.5:
            ws[rng.randrange(n)] = "odd"
    return ws


@pytest.mark.parametrize("seed", range(6))
def test_equals_a_scan_of_every_lag(seed):
    rng = random.Random(seed)
    for _ in range(30):
        texts = [periodic(rng, rng.randint(0, 400), rng.choice([1, 2, 3, 30, 200])) for _ in range(rng.randint(1, 6))]
        assert found_runs([" ".join(ws) for ws in texts]) == [plain_runs(ws) for ws in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4))
def test_few_letters(texts):
    assert found_runs([" ".join(ws) for ws in texts]) == [plain_runs(ws) for ws in texts]


@pytest.mark.parametrize("period", [1, 15, 16, 17, 31, 32, 33, 63, 64, 100])
@pytest.mark.parametrize("turns", [3, 4, 5])
def test_periods_around_the_limits(period, turns):
    """A run of exactly ``turns`` periods, one word more and one less, amid other words."""
    for more in (-1, 0, 1):
        ws = [f"x{k % period}" for k in range(turns * period + more)]
        ws = [f"a{k}" for k in range(50)] + ws + [f"b{k}" for k in range(50)]
        assert found_runs([" ".join(ws)]) == [plain_runs(ws)]


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(text, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["a b c d e f g h", "a a a a a a a", "a b a b a b a b a", "é è é è é è é è"]
    assert found_runs(texts) == [plain_runs(t.split()) for t in texts]


def test_awkward_rows(spark):
    long = " ".join(f"w{k % 5000}" for k in range(40_000))
    rows = [(None, "a a a a a a a"), (1, None), (1, ""), (1, " \n\t "), (2, "b  b\nb b\tb b c"), (2, "b  b\nb b\tb b c"), (3, long), (4, "x" * 300_000), (5, "a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a")]
    docs = spark.createDataFrame([(*r, "x", 5, [1]) for r in rows], "doc_id long, text string, collapsed string, period int, runs array<int>")
    found = {}
    for r in runs.periodic_runs(docs.repartition(3)).collect():
        found.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert found[None] == [([(0, 7, 1)], "a")]
    assert found[1] == [([], "")] * 3
    assert found[2] == [([(0, 6, 1)], "b c")] * 2
    assert found[3] == [([(0, 40_000, 5000)], " ".join(f"w{k}" for k in range(5000)))]
    assert found[4] == [([], "x" * 300_000)]
    assert found[5] == [([(0, 6, 1)], "a\xa0a")]
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_query(spark, tmp_path):
    """The query's digests and edit, recomputed; doc ids whose crc32 ends in 0 are edited."""
    import hashlib
    import zlib

    rng = random.Random(3)
    rows = [(k, " ".join(periodic(rng, rng.randint(0, 200), 20)) if k % 9 else None) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    edited = 0
    for doc_id, t in rows:
        ws, h = (t or "").split(), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and ws:
            edited += 1
            n, original = len(ws), list(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                ws[i] = original[a + (i - a) % p]
        found, r = plain_runs(ws), got[doc_id]
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(ws, found).encode()).hexdigest()
    assert edited > 10 and len(got) == len(rows)
    assert periodic_text  # the edit is part of the query, not of the operator
