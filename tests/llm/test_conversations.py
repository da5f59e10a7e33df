import random
from collections import defaultdict

from tests.llm.helpers import MESSAGE, message, with_clashes
from threadloom.llm import conversations as C


def replayed(spark, tmp_path, rows, clash=False, **options):
    path = str(tmp_path / "messages.parquet")
    df = spark.createDataFrame(rows, MESSAGE)
    (with_clashes(df) if clash else df).repartition(3).write.mode("overwrite").parquet(path)
    return {(r.user_id, r.session_id): r for r in C.replay(spark, path, **options).collect()}


def side(role):
    role = (role or "").strip().lower()
    return "u" if role in C.USER_SIDE else "a" if role in C.ASSISTANT_SIDE else "s" if role in C.OTHER_SIDE else None


def verdict(ms):
    by = defaultdict(list)
    for m in ms:
        by[m[1]].append(m)
    if any(len({(side(m[7]), m[8]) for m in x}) > 1 for x in by.values()):
        return "conflict"
    firsts = [min(x, key=lambda m: m[6]) for x in by.values()]
    requests = defaultdict(list)
    for m in firsts:
        requests[m[4]].append(m)
    if any(sorted(m[5] for m in x) != list(range(len(x))) for x in requests.values()):
        return "gap"
    if any(side(m[7]) is None for m in firsts):
        return "role"
    dated = all(m[9] is not None for m in firsts)
    order = sorted(requests.values(), key=lambda x: (min(m[9] for m in x) if dated else 0, min(m[6] for m in x)))
    turns = [m for x in order for m in sorted(x, key=lambda m: m[5]) if side(m[7]) in ("u", "a") and (m[8] or "").strip(" \n\t​")]
    if {side(m[7]) for m in turns} != {"u", "a"}:
        return "one_sided"
    for i, m in enumerate(turns):
        if side(m[7]) == "u" and not (i + 1 < len(turns) and (side(turns[i + 1][7]) == "a" or turns[i + 1][4] == m[4])):
            return "unanswered"
    return [("user" if side(m[7]) == "u" else "assistant", m[8]) for m in turns]


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows, seq = [], 0
    roles = ["user", "assistant"] * 12 + ["Human ", "BOT", "system", None, "???", "tool"]
    for s in range(150):
        stamped = rng.random() < 0.6
        for r in range(rng.randrange(1, 4)):
            for i in range(rng.randrange(1, 4)):
                seq += 1
                if rng.random() < 0.02:
                    continue
                content = rng.choice(["hello", "fine", "ok"]) if rng.random() > 0.06 else rng.choice([None, " ", "​"])
                role = roles[i % 2] if rng.random() > 0.2 else rng.choice(roles)
                m = message(seq, content, role, session=f"s{s}", request=f"q{s}-{r}", index=i, ts=rng.randrange(10**6) if stamped or rng.random() < 0.3 else None)
                rows.append(m)
                if rng.random() < 0.1:
                    other = list(m)
                    other[6] += 10_000 + seq
                    if rng.random() < 0.4:
                        other[8] = "changed"
                    rows.append(tuple(other))
                if rng.random() < 0.05:
                    rows.append(m)
    groups = defaultdict(list)
    for m in rows:
        groups[m[2], m[3]].append(m)
    rng.shuffle(rows)
    got = replayed(spark, tmp_path, rows, clash=True)
    assert set(got) == set(groups)
    for key, ms in groups.items():
        want, r = verdict(ms), got[key]
        assert (r.reason or [tuple(t) for t in r.turns]) == want, (key, want, r)


def test_late_rows_change_nothing(spark, tmp_path):
    rows = [message(i, f"t{i}", ("user", "assistant")[i % 2], session=f"s{i // 4}", request=f"r{i // 4}", index=i % 4) for i in range(40)]
    late = [r[:10] + (r[10] + 86_400_000 * (i % 9) * 40, r[11]) for i, r in enumerate(rows)]
    for options in ({}, {"gap": "1 hour", "slices": 3}, {"gap": "30 days", "delay": "1 second", "slices": 5}):
        got = replayed(spark, tmp_path, late, **options)
        assert len(got) == 10 and all(r.reason is None and len(r.turns) == 4 for r in got.values())
        assert any(r.parts > 1 for r in got.values())


def test_the_stream_closes_by_silence_and_gives_up_late_rows(spark, tmp_path):
    minute = 60_000
    at = lambda seq, session, t, role, i: message(seq, f"m{seq}", role, session=session, request=f"r-{session}-{seq - i}", index=i)[:10] + (1_700_000_000_000 + t * minute, 2)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(source)
    put([at(1, "a", 0, "user", 0), at(2, "a", 1, "assistant", 1), at(3, "b", 1, "user", 0)])
    stream = C.conversation_stream(spark.readStream.schema(MESSAGE).parquet(source), "10 minutes", "5 minutes")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        seen = lambda: sorted(((r.session_id, r.reason, len(r.turns)) for r in spark.read.schema(stream.schema).parquet(out).collect()), key=str)
        query.processAllAvailable()
        assert seen() == []  # nothing has been silent for long enough
        put([at(4, "b", 9, "assistant", 1), at(5, "c", 17, "user", 0), at(6, "c", 17, "assistant", 1)])
        query.processAllAvailable()
        assert seen() == [("a", None, 2)]  # b went on at minute 9
        put([at(7, "a", 2, "user", 0), at(8, "c", 30, "user", 0)])  # a's row is behind the watermark
        query.processAllAvailable()
        assert seen() == [("a", None, 2), ("b", None, 2)]
        dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
        assert dropped == 1
        put([at(9, "d", 90, "user", 0)])
        query.processAllAvailable()
        assert [x for x in seen() if x[0] == "c"] == [("c", "one_sided", 1), ("c", None, 2)]  # silent for 13 minutes: two parts
    finally:
        query.stop()


def test_a_long_session_of_many_requests(spark, tmp_path):
    rows = [message(2 * i + j, "t", ("user", "assistant")[j], request=f"r{i:06}", index=j) for i in range(4000) for j in (0, 1)]
    got = replayed(spark, tmp_path, rows)
    assert got[("u", "s")].reason is None and len(got[("u", "s")].turns) == 8000


def test_nulls_and_empty(spark, tmp_path):
    rows = [(None,) * 12, message(1, "hi", key="k1"), message(2, "yes", "assistant", key="k2", index=1), (None, None, None, "s9", None, None, None, "user", "x", None, None, None)]
    got = replayed(spark, tmp_path, rows)
    assert got[("u", "s")].reason is None and got[(None, None)].reason == "gap"
    assert replayed(spark, tmp_path / "none", rows[:0]) == {}


def test_a_very_long_text(spark, tmp_path):
    rows = [message(1, "x" * 2_000_000), message(2, "ok", "assistant", index=1)]
    got = replayed(spark, tmp_path, rows)
    assert len(got[("u", "s")].turns[0].content) == 2_000_000
