"""Queries that look at every observation, against brute force over all rows."""

from pricelode.plans import registry
from pricelode.sources.observations import observations


def test_windows_of_all_observations(spark, sf):
    rows = [r for r in observations(spark, sf).select("id", "chain", "day", "collected_at", "valid_from", "valid_until").collect()]
    open_rows = [r for r in rows if r.valid_from]
    want = set()
    for r in open_rows:
        met = [o for o in open_rows if o.id != r.id and o.valid_from <= r.valid_until and o.valid_until >= r.valid_from]
        if met:
            want.add((r.id, len(met), min(max(o.valid_from, r.valid_from) for o in met), max(min(o.valid_until, r.valid_until) for o in met)))
    got = [tuple(r) for r in registry.queries()["window_overlap_counts"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[0] % 40 for r in got} == set(range(40))
    classes = registry.queries()["window_overlaps"](spark, sf).collect()
    assert sum(r["pairs"] for r in classes) * 2 == sum(n for _, n, _, _ in want)

    newest = {}
    for d in {r.day for r in rows}:
        for r in open_rows:
            if r.valid_from <= d <= r.valid_until:
                newest[d, r.chain] = max(newest.get((d, r.chain), (r.collected_at, r.id)), (r.collected_at, r.id))
    got = [tuple(r) for r in registry.queries()["newest_snapshots"](spark, sf).collect()]
    assert len(got) == len(newest) and set(got) == {(d, c, i) for (d, c), (_, i) in newest.items()}
