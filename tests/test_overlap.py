import datetime as dt
import random

import pytest

from launchlens import operators as op

BASE = dt.date(2019, 6, 1)


def day(n):
    return BASE + dt.timedelta(days=n)


def brute_counts(launches, bands):
    out = {}
    for p, c, d in launches:
        for name, (lo, hi) in bands.items():
            near = {q for q, c2, e in launches
                    if None not in (p, q, c, c2, d, e) and q != p and c2 == c and lo <= (e - d).days <= hi}
            out[p, c, d, name] = len(near)
    return out


def counts_of(df, bands):
    return {(r.pattern, r.merchant_class, r.launch_date, n): r[f"existing_{n}"]
            for r in df.collect() for n in bands}


def test_counts_on_band_edges(frame):
    rows = [("a", "c", day(0))] + [(f"p{n}", "c", day(-n)) for n in (1, 30, 31, 60, 61, 90, 91)]
    rows += [("same", "c", day(0)), ("after", "c", day(3)), ("other", "x", day(-5)), (None, "c", day(-5)),
             ("classless", None, day(-5)), ("undated", "c", None)]
    df = frame(rows, "pattern string, merchant_class string, launch_date date")
    got = counts_of(op.launch_overlap_counts(df), op.BANDS)
    assert got == brute_counts(rows, op.BANDS)
    # Days 30 and 60 belong to two bands each; the row without a pattern counts for none.
    assert [got["a", "c", day(0), n] for n in ("1m", "2m", "3m")] == [2, 3, 3]


@pytest.mark.parametrize("seed", [3, 4])
def test_counts_against_brute_force(frame, seed):
    rng = random.Random(seed)
    # One class holds most launches.
    rows = [(f"p{i}", "hot" if rng.random() < 0.7 else f"c{rng.randrange(3)}", day(rng.randrange(200)))
            for i in range(150)]
    df = frame(rows, "pattern string, merchant_class string, launch_date date")
    assert counts_of(op.launch_overlap_counts(df), op.BANDS) == brute_counts(rows, op.BANDS)


def test_counts_need_a_band_without_the_launch_day(frame):
    df = frame([("a", "c", day(0))], "pattern string, merchant_class string, launch_date date")
    with pytest.raises(ValueError):
        op.launch_overlap_counts(df, {"x": (-3, 0)})


DAILY = ("channel string, merchant_class string, solid_flag string, pattern string, launch_date date, "
         "sale_date date, totalsales double, units double, margins double")


def brute_metrics(rows, windows, horizon=21):
    keys = {r[:5] for r in rows}
    out = {}
    for key in keys:
        *group, p, d = key
        for name, n in windows.items():
            hits = [r for r in rows
                    if None not in (*group, p, r[3]) and list(r[:3]) == group and r[3] != p
                    and 1 <= (d - r[4]).days <= n and 0 <= (r[5] - d).days <= horizon]
            units = sum(r[7] for r in hits)
            sales, margins = sum(r[6] for r in hits), sum(r[8] for r in hits)
            out[(*key, name)] = (
                len({r[3] for r in hits}), sales if hits else None, units if hits else None,
                margins / units if units else None, sales / units if units else None)
    return out


def metrics_of(df, windows):
    return {
        (r.channel, r.merchant_class, r.solid_flag, r.pattern, r.launch_date, n): (
            r[f"launched_{n}"], r[f"existing_{n}_totalsales"], r[f"existing_{n}_units"],
            r[f"existing_{n}_avgmargins"], r[f"existing_{n}_avg_price"])
        for r in df.collect() for n in windows}


def close(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k] == tuple(v if v is None else pytest.approx(v) for v in want[k]), k


def test_metrics_on_window_edges(frame):
    def row(p, launch, sale, flag="Solid", channel="Web", cls="c"):
        return (channel, cls, flag, p, day(launch), day(sale), 10.0, 2.0, 4.0)

    rows = [row("a", 0, 5), row("l1", -1, 0), row("l30", -30, 21), row("l31", -31, 21), row("l60", -60, 22),
            row("l61", -61, 0), row("l90", -90, 21), row("l90", -90, 3), row("l91", -91, 3), row("same", 0, 3),
            row("flag", -5, 3, flag="Non-Solid"), row("web", -5, 3, channel="Pos"), row("cls", -5, 3, cls="x"),
            row("early", -5, -1), row(None, -5, 3), row("nocls", -5, 3, cls=None), row("after", 2, 4)]
    got = metrics_of(op.launch_overlap_metrics(frame(rows, DAILY)), op.WINDOWS)
    close(got, brute_metrics(rows, op.WINDOWS))
    key = ("Web", "c", "Solid", "a", day(0))
    assert [got[(*key, n)][0] for n in ("1m", "2m", "3m")] == [2, 3, 5]


@pytest.mark.parametrize("seed", [5, 6])
def test_metrics_against_brute_force(frame, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(30):
        launch = rng.randrange(150)
        cls = "hot" if rng.random() < 0.6 else "c"
        for age in sorted(rng.sample(range(200), rng.randrange(1, 25))):
            rows.append(("Web", cls, "Solid", f"p{i}", day(launch), day(launch + age),
                         float(rng.randrange(100)), float(rng.randrange(-1, 4)), float(rng.randrange(50))))
    close(metrics_of(op.launch_overlap_metrics(frame(rows, DAILY)), op.WINDOWS),
          brute_metrics(rows, op.WINDOWS))


def test_overlap_plans_have_no_self_join_pairs(frame):
    df = frame([("Web", "c", "Solid", "p", day(0), day(1), 1.0, 1.0, 1.0)], DAILY)
    for out in (op.launch_overlap_metrics(df),
                op.launch_overlap_counts(df.select("pattern", "merchant_class", "launch_date").distinct())):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Cartesian" not in plan and "Join Cross" not in plan
        assert ">=" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_counts_with_several_launches_of_a_pattern(frame):
    import random
    from datetime import date, timedelta

    from launchlens import operators as op

    random.seed(7)
    rows = [(f"c{random.randint(0, 1)}", f"p{random.randint(0, 6)}", date(2020, 1, 1) + timedelta(random.randint(0, 150))) for _ in range(90)]
    rows = list(dict.fromkeys(rows)) + [("c0", None, date(2020, 2, 1)), (None, "p1", date(2020, 2, 1)), ("c0", "p1", None)]
    got = op.launch_overlap_counts(frame(rows, "merchant_class string, pattern string, launch_date date"))
    bands = {"1m": (-30, -1), "2m": (-60, -30), "3m": (-90, -60)}

    def want(group, pattern, day, low, high):
        if pattern is None or group is None or day is None:
            return 0
        return len({p for g, p, d in rows if g == group and p not in (None, pattern) and d is not None and low <= (d - day).days <= high})

    found = sorted(((r.merchant_class, r.pattern, r.launch_date, r.existing_1m, r.existing_2m, r.existing_3m) for r in got.collect()), key=str)
    assert found == sorted(((g, p, d, *[want(g, p, d, *b) for b in bands.values()]) for g, p, d in rows), key=str)
