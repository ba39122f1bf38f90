"""Document states with timers and the mail hand-over, broken off and started again."""

import datetime as dt
import random
from datetime import timedelta

import pytest

from ledgerloom.streaming import documents as D
from ledgerloom.streaming import mail as M

CHANGE = "document_id string, changed_at timestamp, state string"
PATIENCE = timedelta(hours=3)


def changes(n=160, seed=1):
    r, at, rows = random.Random(seed), dt.datetime(2024, 1, 1), []
    for _ in range(n):
        at += timedelta(minutes=r.randint(0, 40))
        rows.append((f"d{r.randint(0, 9)}", at, r.choice(D.STATES)))
    return rows


def machine(rows, as_of):
    """A plain loop over each document's changes."""
    out = []
    for name in {r[0] for r in rows}:
        mine = {}
        for _, at, state in rows:
            if _ == name and (at not in mine or D.STATES.index(state) > D.STATES.index(mine[at])):
                mine[at] = state
        state, since, attempt = None, None, 0
        for at, new in [*sorted(mine.items()), (as_of, None)]:
            if state == "processing" and at > since + PATIENCE:
                out.append((name, since + PATIENCE, state, "failed", True, True, attempt))
                state = "failed"
            if new:
                attempt += new == "processing"
                out.append((name, at, state, new, (state, new) in D.MOVES, False, attempt))
                state, since = new, at
    return sorted(out)


def test_moves_like_a_loop(spark):
    rows = changes()
    end = max(r[1] for r in rows) + timedelta(hours=1)
    got = sorted(map(tuple, D.moves(spark.createDataFrame([*rows, *rows[:5], (None, end, "queued"), ("d1", None, "queued")], CHANGE), PATIENCE, end).collect()))
    assert got == machine(rows, end)
    assert any(r[5] for r in got) and any(not r[4] for r in got) and any(r[2] == "failed" and r[3] == "processing" and r[4] for r in got)
    assert D.moves(spark.createDataFrame([], CHANGE), PATIENCE).count() == 0


def test_stream_of_moves_goes_on_after_restarts(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    D.with_state_store(spark)
    try:
        rows, folder = changes(), tmp_path.as_uri()
        for k in range(3):  # each start reads what came since from the checkpoint
            spark.createDataFrame(rows[[0, 60, 110][k] : [60, 110, 160][k]], CHANGE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            D.write_moves(spark.readStream.schema(CHANGE).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", PATIENCE).awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
        # The watermark is an hour behind the newest change; timers up to there have gone off.
        assert got == machine(rows, max(r[1] for r in rows) - timedelta(hours=1))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def message(k, sender="a@ok.com", files=("x.pdf",), seen=False):
    return (f"m{k:02d}", sender, f"Invoice {k}", seen, list(files), dt.datetime(2024, 1, 1) + timedelta(hours=k))


MESSAGES = [message(k) for k in range(7)] + [message(7, "a@evil.com"), message(8, files=["x.txt"]), message(9, seen=True), message(3)]
WANTED = {f"m{k:02d}" for k in range(7)}


def handed(spark, folder):
    cases = spark.read.schema(M.CASE).parquet(f"{folder}/cases").collect()
    marks = [r.message_id for r in spark.read.schema(M.MARK).parquet(f"{folder}/marks").collect()]
    assert len({c.exception_id for c in cases}) == len(cases) == len({c.message_id for c in cases})
    return {c.message_id for c in cases}, marks


def test_passes_take_the_oldest_up_to_the_limit(spark, tmp_path):
    folder, box = tmp_path.as_uri(), spark.createDataFrame(MESSAGES, M.MESSAGE)
    poll = lambda **k: M.poll_once(box, f"{folder}/cases", f"{folder}/marks", ["@ok.com"], 3, **k)
    assert poll() == 3 and handed(spark, folder)[0] == {"m00", "m01", "m02"}
    # A message without a case stays unread for a later pass.
    assert poll(create=lambda m: M.cases_of(m.filter("message_id <> 'm04'"))) == 2
    assert [poll(), poll()] == [2, 0]
    cases, marks = handed(spark, folder)
    assert cases == WANTED == set(marks) and len(marks) == 7


@pytest.mark.parametrize("where", ["before cases", "before marks"])
def test_a_pass_that_breaks_off_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, where):
    folder, box = tmp_path.as_uri(), spark.createDataFrame(MESSAGES, M.MESSAGE)

    def broken(*_):
        raise RuntimeError("power cut")

    poll = lambda **k: M.poll_once(box, f"{folder}/cases", f"{folder}/marks", ["@ok.com"], 4, **k)
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="power cut"):
        if where == "before marks":
            m.setattr(M, "mark", broken)
        poll(**({"create": broken} if where == "before cases" else {}))
    while poll():
        pass
    cases, marks = handed(spark, folder)
    assert cases == WANTED == set(marks) and len(marks) == 7


def test_stream_of_mail_after_a_broken_batch(spark, tmp_path, monkeypatch):
    folder = tmp_path.as_uri()

    def arrive(rows):
        spark.createDataFrame(rows, M.MESSAGE).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        live = spark.readStream.schema(M.MESSAGE).parquet(f"{folder}/in")
        q = M.hand_over(live, f"{folder}/box", f"{folder}/cases", f"{folder}/marks", f"{folder}/state", ["@ok.com"], 5)
        q.awaitTermination()

    arrive(MESSAGES[:4])
    with monkeypatch.context() as m:
        m.setattr(M, "mark", lambda *_: (_ for _ in ()).throw(RuntimeError("power cut")))
        with pytest.raises(Exception, match="power cut"):
            run()
    run()
    arrive(MESSAGES[4:])
    run()
    cases, marks = handed(spark, folder)
    assert cases == WANTED == set(marks) and len(marks) == 7
