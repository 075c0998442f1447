import math

import numpy as np
import pytest

from docscore.llm import embedding_dedup as dedup


def brute(rows, cosine=0.95):
    """All pairs: ({place: linked places}, component id per place)."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    if good:
        x = dedup.unit(np.array([np.array(rows[k][1], float) for k in good]))
        near = x @ x.T
        for a, b in zip(*np.nonzero(near >= cosine)):
            if a != b:
                links[good[a]].add(good[b])
    component = list(range(len(rows)))
    for k in range(len(rows)):
        stack, seen = [k], {k}
        while stack:
            for other in links[stack.pop()] - seen:
                seen.add(other)
                stack.append(other)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        component[k] = min(ids) if ids else None
    return links, component


def wanted(rows, cosine=0.95):
    links, component = brute(rows, cosine)
    return sorted(((i, len(links[k]), component[k], i == component[k]) for k, (i, _) in enumerate(rows)), key=repr)


def found(spark, rows, kind="array<float>", **options):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    kept = [tuple(r) for r in frame.collect()]  # as stored
    return sorted(map(tuple, dedup.near_duplicates(frame, **options).collect()), key=repr), kept


def near(rng, centre, count, low, high):
    """Unit vectors at cosines between ``low`` and ``high`` of a centre."""
    out = []
    for c in rng.uniform(low, high, count):
        side = rng.standard_normal(len(centre))
        side -= side @ centre * centre
        out.append(c * centre + math.sqrt(1 - c * c) * side / np.linalg.norm(side))
    return out


@pytest.mark.parametrize("tile", [1024, 7])
def test_groups_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(dedup, "TILE", tile)
    rng = np.random.default_rng(2)
    vectors = list(rng.standard_normal((80, 24)))
    for v in vectors[:6]:
        vectors += near(rng, v / np.linalg.norm(v), 12, 0.985, 1.0)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(500 + i, rows[3][1]) for i in range(20)]
    # every pair is met with a chance that leaves nothing out here
    got, kept = found(spark, rows, miss=1e-9)
    assert got == wanted(kept)


def test_recall_at_the_threshold_and_no_false_link(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(400):
        centre = rng.standard_normal(48)
        centre /= np.linalg.norm(centre)
        rows += [(2 * k, centre.tolist()), (2 * k + 1, near(rng, centre, 1, 0.94, 0.96)[0].tolist())]
    got, kept = found(spark, rows)
    want = {i: n for i, n, *_ in wanted(kept)}
    assert all(n <= want[i] for i, n, *_ in got)
    assert sum(n for _, n, *_ in got) >= 0.97 * sum(want.values()) > 0


def test_registered_table_against_brute_force(spark):
    got = sorted(map(tuple, dedup.query(spark, "/root/testdata/sf0.01").collect()))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = wanted(rows)
    assert len(got) == len(want)
    assert sum(n for _, n, *_ in got) >= 0.9 * sum(n for _, n, *_ in want)


def test_odd_rows(spark):
    rows = [
        (9, [1.0, 0.0]), (4, [2.0, 0.0]), (4, [2.0, 0.0]), (7, [0.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (5, [0.0, -0.0]), (6, [float("nan"), 1.0]),
        (8, [None, 1.0]), (10, [float("inf"), 1.0]), (None, [0.0, 3.0]), (None, [-1.0, -1.0]), (None, [-1.0, -1.0]), (11, [1e-30, 0.0]), (12, [1e30, 1e20]), (13, [-0.0, 5.0]),
    ]
    got, kept = found(spark, rows)
    want = sorted(((i, n, c, True if i is None and c is None else i == c) for i, n, c, _ in wanted(kept)), key=repr)
    assert got == want


def test_doubles_beyond_the_range_of_squares(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300])]
    got, kept = found(spark, rows, "array<double>")
    assert got == wanted(kept)


def test_empty_table_extra_columns_and_lengths(spark):
    assert found(spark, [])[0] == []
    frame = spark.createDataFrame([(1, [1.0], 2, 3), (2, [2.0], 2, 3)], "vec_id long, embedding array<float>, node int, vector int")
    assert sorted(map(tuple, dedup.near_duplicates(frame).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    with pytest.raises(ValueError, match="entries"):
        found(spark, [(1, [1.0]), (2, [1.0, 2.0])])


def test_plan_holds_its_promises():
    for count in (10, 1000, 10**6, 10**9):
        projections, tables = dedup.plan(count)
        near_, far = dedup.meeting_chance(math.sqrt(0.1), 2.0), dedup.meeting_chance(math.sqrt(2), 2.0)
        assert (1 - near_**projections) ** tables <= 0.01
        assert count * far**projections <= 0.1 or projections == 4


def test_meeting_chance_is_what_signatures_show():
    rng = np.random.default_rng(4)
    a = dedup.unit(rng.standard_normal((300, 64)))
    b = np.array([near(rng, v, 1, 0.95, 0.95)[0] for v in a])
    met = (dedup.signatures(a, 1, 200) == dedup.signatures(b, 1, 200)).mean()
    assert abs(met - dedup.meeting_chance(math.sqrt(0.1), 2.0)) < 0.02
