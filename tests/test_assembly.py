"""Streamed image assembly: any cut into batches, doubled and late pixels, times, parts."""

import datetime as dt
import random

import pytest

from lumisheet.errors import ShapeError
from lumisheet.streaming import assemble, assembled
from lumisheet.streaming.assembly import state_session

START = dt.datetime(2024, 1, 1)
SCHEMA = "image_id long, y int, x int, l float, height int, width int, ts timestamp"


@pytest.fixture(scope="module")
def state(spark):
    return state_session(spark)


def run(state, folder, batches, **options):
    """Each list of (image, y, x, l, height, width, second) is a file, and so a batch."""
    for i, rows in enumerate(batches):
        state.createDataFrame([(*r[:6], START + dt.timedelta(seconds=r[6])) for r in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    stream = state.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    got = assembled(stream, str(folder), "l", **{"wait": "100 seconds", "delay": "10 seconds", **options}).collect()
    return sorted((r.image_id, r.part, (r.opened - START).total_seconds(), (r.closed - START).total_seconds(), r.whole, r.y, r.x, r.l) for r in got)


def plain(rows, wait, delay):
    """The same by rules: pixel by pixel in order of time."""
    out, mark = [], max(r[6] for r in rows) - delay
    for key in {(r[0], *r[4:6]) for r in rows}:
        left = sorted((r[6], r[1], r[2], r[3]) for r in rows if (r[0], *r[4:6]) == key)
        while left:
            opened, close, held = left[0][0], left[0][0] + wait, {}
            for t, y, x, v in left:
                if t <= close and (y, x) not in held:
                    held[y, x] = v
                    if len(held) == key[1] * key[2]:
                        close = t
            if close > mark:
                break
            out += [(key[0], 0, opened, close, len(held) == key[1] * key[2], y, x, v) for (y, x), v in held.items()]
            left = [p for p in left if p[0] > close]
    return sorted(out)


def test_any_cut_gives_the_result_of_the_rules(state, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 2, 3]), rng.randrange(2), rng.randrange(3), rng.randrange(9) / 8, 2, 3, rng.randrange(600)) for _ in range(300)]
    rows.sort(key=lambda r: r[6] + rng.random() * 8)  # disorder within the delay
    rows.append((9, 0, 0, 1.0, 1, 1, 900))
    expected = plain(rows, 100, 10)
    assert len({r[:3] for r in expected if r[4]}) > 5 and len({r[:3] for r in expected if not r[4]}) > 1
    for cuts in (1, 5):
        at = [0, *sorted(rng.sample(range(1, len(rows)), cuts - 1)), len(rows)]
        assert run(state, tmp_path / str(cuts), [rows[a:b] for a, b in zip(at, at[1:])]) == expected


def test_doubled_late_and_odd_pixels(state, tmp_path):
    first = [(1, 0, 0, 0.5, 1, 2, 5), (1, 0, 0, 0.25, 1, 2, 5), (1, 0, 0, 0.1, 1, 2, 6), (1, 0, 1, float("inf"), 1, 2, 8), (1, 0, 1, 0.7, 1, 2, 8), (1, 7, 0, 0.7, 1, 2, 8)]
    odd = [(None, 0, 0, 0.5, 1, 2, 5), (2, None, 0, 0.5, 1, 2, 5), (2, 0, 0, 0.5, None, 2, 5), (3, 0, 0, 0.5, 0, 0, 5)]
    got = run(state, tmp_path, [first + odd, [(5, 0, 0, 0.0, 1, 1, 500)], [(5, 0, 0, 0.5, 1, 1, 501)], [(1, 0, 0, 0.9, 1, 2, 20)], [(6, 0, 0, 0.0, 1, 1, 800)]])
    assert got == [(1, 0, 5, 8, True, 0, 0, 0.25), (1, 0, 5, 8, True, 0, 1, pytest.approx(0.7)), (5, 0, 500, 500, True, 0, 0, 0.0), (5, 0, 501, 501, True, 0, 0, 0.5)]


def test_parts_leave_each_on_its_own(state, tmp_path):
    rows = [(1, y, x, 0.5, 5, 2, 10 * y + x) for y in range(5) for x in range(2) if (y, x) != (2, 1)]
    got = run(state, tmp_path, [rows[:4], rows[4:], [(2, 0, 0, 0.0, 1, 1, 900)]], lines=2)
    assert sorted({(r[1], r[2], r[3], r[4]) for r in got}) == [(0, 0, 11, True), (1, 20, 120, False), (2, 40, 41, True)] and len(got) == 9


def test_faults(state, tmp_path):
    df = state.createDataFrame([], SCHEMA)
    for bad in (lambda: assemble(df.drop("height"), "l"), lambda: assemble(df, "l", lines=0), lambda: assemble(df), lambda: assemble(df, "g")):
        with pytest.raises(ShapeError):
            bad()


def test_small_images_share_keys(state, tmp_path):
    """Images in all states beside each other in one key: whole, out of time, opened again, still open; ids of any size."""
    rng = random.Random(5)
    ids = [*range(-200, 400), 2**62, 2**62 + 1, -(2**63), 2**63 - 1, 10**6, 2 * 10**6]
    rows = [(i, 0, rng.randrange(2), rng.randrange(9) / 8, 1, 2, rng.randrange(500)) for i in ids for _ in range(rng.randrange(1, 6))]
    rows += [(7, 0, rng.randrange(3), 0.5, 1, 3, rng.randrange(500)) for _ in range(9)]  # the same id in another size
    rows.sort(key=lambda r: r[6] + rng.random() * 8)
    want = plain(rows, 100, 10)
    assert run(state, tmp_path, [rows[:700], rows[700:900], rows[900:]]) == want
    assert len({r[:3] for r in want if r[4]}) > 100 and len({r[:3] for r in want if not r[4]}) > 100


def test_state_grows_by_cells_not_by_images(state, tmp_path):
    """2,048 open images of two cells are four keys: a few rows of state each, where they were several rows for each image."""
    state.range(2048).selectExpr("id image_id", "0 y", "0 x", "float(0.5) l", "1 height", "2 width", "timestamp_seconds(id) ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = assemble(state.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "l", wait="1 day", delay="1 day")
    query = out.writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 100
