import datetime as dt
import random

import pytest

from quillmill.operators import quota

LOG = "id long, api_key_id long, timestamp timestamp"
KEYS = "api_key_id long, rate_limit int"
START = dt.datetime(2024, 1, 1, 23, 50)


def _sequential(log, limits, seconds=60):
    token, state, out = seconds * 10**6, {}, {}
    for i, key, ts in sorted(log, key=lambda r: (r[2] or START, r[0])):
        limit = limits.get(key)
        if ts is None or limit is None:
            out[i] = (True, None)
        elif limit <= 0:
            out[i] = (False, 0)
        else:
            us = (ts - START) // dt.timedelta(microseconds=1)
            level, before = state.get(key, (limit * token, us))
            level = min(limit * token, level + limit * min(us - before, token))
            ok = level >= token
            state[key] = (level - token * ok, us)
            out[i] = (ok, (level - token * ok) // token)
    return out


def _log(seed, keys, n, mean):
    rnd, rows, now = random.Random(seed), [], dict.fromkeys(keys, 0)
    for i in range(n):
        k = rnd.choice(keys)
        now[k] += 0 if rnd.random() < .3 else int(rnd.expovariate(1 / mean) * 10**6)
        rows.append((i, k, START + dt.timedelta(microseconds=now[k])))
    return rows


@pytest.mark.parametrize("limit", [1, 2, 7, 40])
def test_a_run_is_a_function_of_its_first_level(limit):
    rnd, token = random.Random(limit), 1000
    for mean in (20, 400, 3000):
        run, gaps, sizes = quota.Run(limit, token), [0], []
        run.request(0)
        for _ in range(300):
            gaps.append(rnd.choice([0, int(rnd.expovariate(1 / mean))]))
            run.request(gaps[-1])
            sizes.append(len(run.lo))
            if len(gaps) % 50 == 0:
                times = [sum(gaps[:j + 1]) for j in range(len(gaps))]
                for level in [0, token - 1, token, limit * token] + [rnd.randint(0, limit * token) for _ in range(10)]:
                    now, before = level, times[0]
                    for t in times:
                        now = min(limit * token, now + limit * min(t - before, token))
                        now, before = now - (token if now >= token else 0), t
                    assert run.after(level) == now
        if max(gaps) >= token:  # a full bucket, whatever the first level
            assert sizes[-1] == 1
        elif limit > 1:
            assert max(sizes) <= 2 * limit + 4


@pytest.mark.parametrize("chunk", [7, 50_000])
def test_verdicts_equal_a_sequential_bucket(spark, chunk):
    log = _log(1, [1, 1, 1, 1, 2, 3, 4, 5], 3000, 3.0)
    log += [(9000, 1, None), (9001, None, START), (9002, 99, START), (9003, 6, START), (9004, 6, START), (9005, 7, START)]
    log += [(9100 + j, 8, START) for j in range(12)]
    limits = {1: 6, 2: 1, 3: 50, 4: 3, 5: 2, 6: 1, 7: 0, 8: 10}
    keys = spark.createDataFrame([*limits.items(), (99, None)], KEYS)
    got = quota.enforce(spark.createDataFrame(log, LOG).repartition(5), keys, chunk=chunk).collect()
    assert {r.id: (r.admitted, r.tokens_left) for r in got} == _sequential(log, limits) and len(got) == len(log)
    stamps = {i: t for i, _, t in log}
    assert all(r.timestamp == stamps[r.id] for r in got)


def test_a_hot_key_lies_in_many_groups_and_empty_logs_pass(spark):
    log = _log(2, [1], 2000, 1.0)
    keys = spark.createDataFrame([(1, 30)], KEYS)
    done = quota.enforce(spark.createDataFrame(log, LOG), keys, chunk=100)
    assert {r.id: (r.admitted, r.tokens_left) for r in done.collect()} == _sequential(log, {1: 30})
    counts = quota.refused(done).first()
    assert counts.requests == 2000 and 0 < counts.refused < 2000
    assert quota.enforce(spark.createDataFrame([], LOG), keys).count() == 0
