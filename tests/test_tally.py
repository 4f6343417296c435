"""The one pass of a sweep against the operators that take a pass each."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.settings import SIX
from rows import people_rows
from veilframe.functions.draws import TRIAL
from veilframe.operators import drift, privacy, tally, utility
from veilframe.operators.masks import evaluate_masks, wide
from veilframe.operators.moments import masked_cube, original_cube
from veilframe.plans.sweep import SweepOptions, measure, prepare
from veilframe.spec import MaskingConfig, MaskSpec

SPEC = MaskSpec()


def separately(df, configs, identifiers=None):
    frame = evaluate_masks(df, SPEC, configs, TRIAL)
    original, cube = original_cube(wide(df, SPEC), SPEC), masked_cube(frame, SPEC)
    return (
        privacy.privacy_metrics(frame, SPEC, identifiers)
        .join(utility.fidelity(original, cube, SPEC), "config_id")
        .join(drift.mean_drift(drift.drift_table(wide(df, SPEC), frame, SPEC)), "config_id")
    )


def same_rows(found, expected):
    found, expected = (sorted((r.asDict() for r in side.collect()), key=lambda r: r["config_id"]) for side in (found, expected))
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-12)


def odd_people(spark):
    """Missing cells, repeated rows, a text that looks like a missing one, numbers outside the bounds."""
    some = [(20 + i % 7, ("Female", "Male", None, "nan")[i % 4], i % 2) for i in range(60)]
    return people_rows(spark, [*some, *some, (None, "Male", 1), (30, "Female", None), (None, None, None), (12, "Male", 0), (99, "x", 1)])


@pytest.mark.parametrize("identifiers, configs", [(None, SIX), (("gender",), SIX[:1]), (("age", "education"), SIX[:1]), ((), SIX[:1])])
def test_one_pass_gives_what_separate_passes_give(spark, identifiers, configs):
    df, options = odd_people(spark), SweepOptions(models=None, identifiers=identifiers)
    same_rows(measure(prepare(df, SPEC), SPEC, configs, options), separately(df, configs, identifiers))


def test_texts_that_are_too_many_for_numbers(spark, crowd):
    prepared = prepare(crowd, SPEC)
    prepared.cells = tally.cell_numbers(prepared.cube, SPEC, 1)
    assert prepared.cells is None
    same_rows(measure(prepared, SPEC, SIX[:1], SweepOptions(models=None)), separately(crowd, SIX[:1]))


def test_a_table_without_rows(spark):
    df = people_rows(spark, [(30, "Male", 1)]).limit(0)
    assert measure(prepare(df, SPEC), SPEC, SIX[:1], SweepOptions(models=None)).count() == 0


def test_rows_are_masked_twice(spark, crowd):
    """A pass for each measure (cube, classes, buckets, open buckets) read the table four times."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(age):
        read.add(1)
        return age

    seen = crowd.withColumn("age", counted("age"))
    prepared, rows = prepare(seen, SPEC), crowd.count()
    before = read.value
    assert measure(prepared, SPEC, [MaskingConfig("noise", noise_std=2.0)], SweepOptions(models=None)).count() == 1
    assert read.value - before <= 2 * rows


def test_swapped_rows_are_ordered_once(spark, crowd):
    """The order was found anew by whatever read the frame."""
    frame = evaluate_masks(crowd, SPEC, [MaskingConfig("data_swapping", swap_fraction=0.3)], TRIAL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert sorted(r[0] for r in frame.select("m_age").collect()) == sorted(float(r[0]) for r in crowd.select("age").collect())


@pytest.mark.parametrize("hashed", [tally._hash, lambda a, b: np.zeros(len(a), np.uint64), lambda a, b: a.view(np.uint64) % 3])
def test_classes_are_exact_whatever_the_hash(monkeypatch, hashed):
    monkeypatch.setattr(tally, "_hash", hashed)
    rng = np.random.default_rng(3)
    a, b, n = rng.integers(0, 9, 500), rng.integers(0, 5, 500), rng.integers(1, 4, 500)
    expected = {}
    for key, size in zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True):
        expected[key] = expected.get(key, 0) + size
    x, y, sizes, _ = tally.combined(a, b, n)
    assert len(x) == len(expected)
    assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), sizes.tolist(), strict=True)) == expected


def test_classes_of_a_task_and_of_all_tasks():
    parts, sizes = 3, {}
    tasks = [tally.Classes(2, parts) for _ in range(2)]
    values = pa.array([0.0, -0.0, 1.5, None, float("nan"), 1.5, None, 2.5])
    for task in tasks:
        for setting in (0, 1):
            flat = np.zeros(8, np.int64)
            task.add(np.full(8, setting), pa.array(["a", "a", "b", "a", "a", "b", "a", None]), tally.bits_of(values), flat)
    bodies = {}
    for task in tasks:
        for setting, _, text, part, body in task.taken():
            bodies.setdefault((setting, text, part), []).append(body)
    for (setting, _, _), some in bodies.items():
        ((_, _, (classes, smallest, rows), _),) = tally.joined_classes(some)
        old = sizes.get(setting, (0, 99, 0))
        sizes[setting] = (old[0] + classes, min(old[1], smallest), old[2] + rows)
    # zero, missing and not a number under a; 1.5 under b; 2.5 under none
    assert sizes == {0: (5, 2, 16), 1: (5, 2, 16)}


@pytest.mark.parametrize("size", [3, 2**40])
def test_cells_of_few_and_of_many_texts(size):
    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 3, 200) for _ in range(3)]
    cells, rows = tally.cells_of(columns, [size] * 3)
    keys = list(zip(*(c.tolist() for c in columns), strict=True))
    assert len(rows) == len(set(keys)) == len({(k, c) for k, c in zip(keys, cells.tolist(), strict=True)})
    assert all(keys[row] == key for key, row in zip(keys, rows[cells], strict=True))


def test_merged_cells_keep_precision_of_large_numbers():
    rng = np.random.default_rng(7)
    x, y = 1e9 + rng.random(4000), rng.random(4000)
    whole = tally.measured_cells(np.zeros(4000, np.int64), 1, [x, y], [x, y])
    parts = [tally.measured_cells(np.zeros(len(i), np.int64), 1, [x[i], y[i]], [x[i], y[i]]) for i in np.array_split(np.arange(4000), 7)]
    n, numbers = tally.merged_cells(np.zeros(7, np.int64), 1, *(np.concatenate(c) for c in zip(*parts, strict=True)))
    assert n[0] == 4000 and numbers[0] == pytest.approx(whole[1][0], rel=1e-6, abs=1e-4)
    assert numbers[0][2] / 4000 == pytest.approx(np.var(x), rel=1e-6)
