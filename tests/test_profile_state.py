"""Mergeable profiles: merged states against the profile of all rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from widen.operators.profile_state import merge_states, profile_state, state_profile, stored_state, write_state


def rows_of(n, seed):
    random.seed(seed)
    return [(random.choice([None, "a", "a", "b", "c"]), f"v{random.randint(0, 5000)}", random.choice([None, math.nan, 1.5, -2.0]),
             random.randint(-9, 9), random.random() < 0.3, None) for _ in range(n)]


SCHEMA = "few string, many string, x double, i int, flag boolean, nothing string"


def plain(rows, k=3):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = {}
    for j, c in enumerate(names):
        v = [r[j] for r in rows if r[j] is not None and not (isinstance(r[j], float) and math.isnan(r[j]))]
        number = c in ("x", "i", "flag")
        shown = [str(x).lower() if c == "flag" else str(x) for x in v]
        top = sorted(Counter(shown).items(), key=lambda p: (-p[1], p[0]))[:k]
        out[c] = (len(rows), len(rows) - len(v), float(min(v)) if v and number else None, float(max(v)) if v and number else None,
                  sum(v) / len(v) if v and number else None, len(set(shown)), top)
    return out


def compared(profile, rows, exact_top=True):
    want = plain(rows)
    got = {r.column: r for r in profile.collect()}
    assert set(got) == set(want)
    for c, (n, missing, lo, hi, mean, distinct, top) in want.items():
        r = got[c]
        assert (r.n_rows, r.n_missing) == (n, missing)
        assert (None if r.min is None else float(r.min), None if r.max is None else float(r.max)) == (lo, hi)
        assert r.mean == (None if mean is None else pytest.approx(mean))
        assert r.unique_count == pytest.approx(distinct, rel=0.05)
        if c != "many" or exact_top:
            assert [(e.value, e.n) for e in r.cell_examples] == top


def test_merged_equals_all_rows(spark):
    parts = [rows_of(n, s) for s, n in enumerate((700, 1, 0, 2500))]
    states = [profile_state(spark.createDataFrame(p, SCHEMA).repartition(3)) for p in parts]
    everything = [r for p in parts for r in p]
    compared(state_profile(merge_states(*states)), everything)
    compared(state_profile(profile_state(spark.createDataFrame(everything, SCHEMA))), everything)
    # in any order and grouping
    compared(state_profile(merge_states(merge_states(states[3], states[0]), merge_states(states[2], states[1]))), everything)


def test_few_tracked_values_err_within_the_bound(spark):
    rows = [("hot",) if i % 3 == 0 else (f"v{i}",) for i in range(9000)]
    state = profile_state(spark.createDataFrame(rows, "v string"), tracked=256)
    top = state_profile(merge_states(state, state), 1).first().cell_examples[0]
    assert top.value == "hot" and abs(top.n - 6000) <= 18000 / (0.75 * 256) + 1


def test_stored_states_grow_without_old_rows(spark, tmpdir_path):
    path = f"{tmpdir_path}/state"
    parts = [rows_of(300, s) for s in (7, 8, 8)]  # twice the same rows: they count twice
    for p in parts:
        write_state(profile_state(spark.createDataFrame(p, SCHEMA)), path)
    compared(state_profile(stored_state(spark, path)), [r for p in parts for r in p])
    assert spark.read.parquet(path).count() == 3 * 6


def test_new_columns_and_odd_types(spark):
    old = spark.createDataFrame([("a",), ("b",)], "s string")
    new = spark.createDataFrame([("a", 5)], "s string, extra int").withColumn("list", F.array(F.lit(1)))
    got = {r.column: r for r in state_profile(merge_states(profile_state(old), profile_state(new))).collect()}
    assert set(got) == {"s", "extra"} and (got["extra"].n_rows, got["extra"].n_missing) == (3, 2)
    with pytest.raises(ValueError):
        profile_state(new.select("list"))
    when = spark.sql("SELECT timestamp_ntz'2020-01-02 03:04:05' AS t")
    assert state_profile(profile_state(when)).first().cell_examples[0].value == "2020-01-02 03:04:05"
