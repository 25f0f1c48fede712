import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.spans import coalesce_spans, latest_range, pack, union_runs, unpack

SCHEMA = "entity string, lo bigint, hi bigint"


def brute(spans, limits):
    out = set()
    for e in {s[0] for s in spans if s[0] is not None} | set(limits):
        held = sorted({x for k, a, b in spans if k == e and a is not None and b is not None for x in range(a, b + 1)})
        runs = []
        for x in held:
            if runs and runs[-1][1] == x - 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        out |= {(e, "period", a, b) for a, b in runs}
        if e in limits:
            first, last = limits[e]
            points = [first - 1, *(x for x in held if first <= x <= last), last + 1]
        else:
            points = held
        out |= {(e, "gap", a + 1, b - 1) for a, b in zip(points, points[1:]) if b > a + 1}
    return out


def found(df):
    return {tuple(r) for r in df.select("entity", "kind", "lo", "hi").collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    spans = [("abc"[rng.integers(3)], int(a), int(a + n)) for a, n in zip(rng.integers(-40, 200, 60), rng.integers(-2, 9, 60))]
    spans += [spans[0], ("a", None, 4), ("b", 4, None), (None, 1, 2), ("d", 7, 7)]
    limits = {"a": (1, 120), "e": (5, 9)}
    df = spark.createDataFrame(spans, SCHEMA)
    lim = spark.createDataFrame([(e, a, b) for e, (a, b) in limits.items()] + [("b", 9, 3), ("c", None, 4)], "entity string, first bigint, last bigint")
    for bits in (3, 18):
        assert found(coalesce_spans(df, lim, bits=bits, salts=2)) == brute(spans, limits)
    assert found(coalesce_spans(df, bits=4)) == brute(spans, {})


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(coalesce_spans(df)) == set()
    extra = spark.createDataFrame([("a", 1, 2, "x", 0)], SCHEMA + ", shard string, kind int")
    assert found(coalesce_spans(extra)) == {("a", "period", 1, 2)}


def test_wide_span(spark):
    df = spark.createDataFrame([("a", 1, 2_000_000_000), ("a", 5, 6)], SCHEMA)
    assert found(coalesce_spans(df)) == {("a", "period", 1, 2_000_000_000)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 250), st.integers(0, 20)), max_size=60))
def test_round_trip(pairs):
    lo = np.array([min(a, 255) for a, _ in pairs], np.int64)
    hi = np.minimum(lo + np.array([n for _, n in pairs], np.int64), 255)
    a, b = union_runs(lo, hi)
    x, y = unpack(pack(a, b, 8)) if len(a) else (a, b)
    assert list(x) == list(a) and list(y) == list(b)


def test_ranges(spark):
    rows = [("a", "3-9", 1), ("a", "1 – 4 ", 2), ("b", "0-3", 1), ("c", "9-3", 1), ("d", None, 1), ("e", "p. 3-4", 1), ("f", "12 — 12", 1), ("g", " ", 1)]
    df = spark.createDataFrame(rows, "book_id string, page_range string, added_at int")
    got = {r["entity"]: (r["first"], r["last"]) for r in latest_range(df).collect()}
    assert got == {"a": (1, 4), "b": (None, None), "c": (None, None), "d": (None, None), "e": (None, None), "f": (12, 12), "g": (None, None)}


def test_long_spans_are_not_cut_into_shards(spark):
    year = 365 * 24 * 3600 * 1_000_000
    rows = [("a", 5, year), ("a", year + 1, year + 9), ("a", year + 20, 3 * year), ("a", 100, 200), ("a", 2 * year, 2 * year + 5), ("b", 1, 2), ("c", -year, year), ("c", 3 * year, 3 * year)]
    got = sorted((r["entity"], r["kind"], r["lo"], r["hi"]) for r in coalesce_spans(spark.createDataFrame(rows, "entity string, lo long, hi long")).collect())
    assert got == [("a", "gap", year + 10, year + 19), ("a", "period", 5, year + 9), ("a", "period", year + 20, 3 * year), ("b", "period", 1, 2),
                   ("c", "gap", year + 1, 3 * year - 1), ("c", "period", -year, year), ("c", "period", 3 * year, 3 * year)]
