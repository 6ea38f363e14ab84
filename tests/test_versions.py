"""Tables in versions under crashes and replays; the streams that keep them; trees of copies."""

import math

import pytest
from pyspark.sql import functions as F

from caseloom.operators import memory, report
from caseloom.sources import parity
from caseloom.sources.versions import Conflict, Versions
from caseloom.streaming import cards, kept

KEYS = {"cases": ["case_id"], "options": ["case_id"]}


def bank(spark, ids, text="old", options=2):
    cases = spark.createDataFrame([(k, text) for k in ids], "case_id long, text string")
    rows = [(k, f"{text}{n}") for k in ids for n in range(options)]
    return {"cases": cases, "options": spark.createDataFrame(rows, "case_id long, option string")}


def held(tables, version=None):
    return sorted(map(tuple, tables.read("cases", version).collect())), sorted(map(tuple, tables.read("options", version).collect()))


def test_rows_and_children_change_together(spark, tmp_path):
    tables = Versions(spark, str(tmp_path), KEYS, buckets=4)
    assert tables.read("cases") is None and tables.replace(bank(spark, range(20))) == 1
    before = held(tables)
    delta = bank(spark, [3, 4, 99], "new", 1)
    assert tables.upsert(delta, keys=spark.createDataFrame([(3,), (4,), (5,), (99,)], "case_id long")) == 2
    cases, options = held(tables)
    assert [c for c in cases if c[1] == "new"] == [(3, "new"), (4, "new"), (99, "new")] and len(cases) == 20
    assert [o for o in options if o[0] in (3, 4, 5, 99)] == [(3, "new0"), (4, "new0"), (99, "new0")]  # 5 was named but not told anew
    assert held(tables, 1) == before  # a reader of version 1 still has it


@pytest.mark.parametrize("step", ["_stage", "_write", "_announce", "_publish"])
def test_a_crash_at_any_step_changes_nothing(spark, tmp_path, monkeypatch, step):
    tables = Versions(spark, str(tmp_path), KEYS, buckets=4)
    tables.replace(bank(spark, range(8)))
    before = held(tables)
    with monkeypatch.context() as m:

        def crash(*_, **__):
            raise OSError("lost")

        m.setattr(Versions, step, crash)
        with pytest.raises(OSError):
            tables.upsert(bank(spark, [1], "new"), applied=("s", 0))
    assert held(Versions(spark, str(tmp_path), KEYS)) == before
    assert tables.upsert(bank(spark, [1], "new"), applied=("s", 0)) == 2
    after = held(tables)
    assert tables.upsert(bank(spark, [2], "again"), applied=("s", 0)) is None and held(tables) == after
    tables.clean(keep=1)
    assert held(tables) == after and tables.numbers() == [2]


def test_second_writer_is_refused(spark, tmp_path, monkeypatch):
    tables = Versions(spark, str(tmp_path), KEYS)
    tables.replace(bank(spark, [1]))
    stale = tables.state()
    tables.replace(bank(spark, [2]))
    monkeypatch.setattr(Versions, "state", lambda self, version=None: dict(stale, tables=dict(stale["tables"])))
    with pytest.raises(Conflict):
        tables.replace(bank(spark, [3]))


def test_files_stay_few(spark, tmp_path):
    tables = Versions(spark, str(tmp_path), KEYS, buckets=2)
    for k in range(4):
        tables.upsert(bank(spark, range(k, k + 5)))
    table = tables.state()["tables"]["cases"]
    assert len(table["folders"]) <= 2 and tables.read("cases").count() == 8


def arrive(spark, frame, path, k):
    frame.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.drop("arrival").schema).parquet(path)


def test_card_stream_folds_late_reviews_where_they_belong(spark, tmp_path):
    rows = [(f"u{k % 2}", k % 3, k, 1 + k * 7 % 4, 86400 * (k + 1), 1 if k in (4, 5) else k * 3 // 18) for k in range(18)]
    rows += [("u0", 0, 90, 9, 86400, 0), ("u0", None, 91, 3, 86400, 0)]  # no grade, no case
    log = spark.createDataFrame(rows, "user_hash string, case_id long, seq long, grade int, sec long, arrival int").withColumn("ts", F.col("sec").cast("timestamp")).drop("sec")
    tables = Versions(spark, f"{tmp_path}/t", {"cards": ["user_hash", "case_id"]}, buckets=2)
    for k in range(3):
        cards.keep_cards(arrive(spark, log, f"{tmp_path}/in", k), tables, f"{tmp_path}/cp", "5 days").awaitTermination()
        want = {(r.user_hash, r.case_id): r for r in memory.fold_reviews(log.where(F.col("arrival") <= k)).collect()}
        got = {(r.user_hash, r.case_id): r for r in tables.read("cards").collect()}
        assert got.keys() == want.keys()
        for key, w in want.items():
            assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[key][2:], (w.difficulty, w.stability, w.lapses, w.last_review, w.reviews))), (k, key)


def test_item_stats_equal_the_batch_form_at_every_batch(spark, tmp_path, monkeypatch):
    rows = [(k, k * 5 % 4, f"u{k % 3}", k % 2 == 0, 1000 + 400 * k, (k * 7) % 40, k % 3) for k in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, case_id long, user_hash string, is_correct boolean, time_ms long, sec long, arrival int").withColumn("ts", (F.col("sec") + 1000).cast("timestamp"))
    tables = Versions(spark, f"{tmp_path}/t", kept.ITEM_KEYS, buckets=2)
    publish = Versions._publish
    for k in range(3):
        stream = arrive(spark, frame, f"{tmp_path}/in", k)
        if k == 1:  # the batch is written, and its version is lost
            monkeypatch.setattr(Versions, "_publish", lambda self, n: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(Exception, match="lost"):
                kept.keep_item_stats(stream, tables, f"{tmp_path}/cp").awaitTermination()
            monkeypatch.setattr(Versions, "_publish", publish)
        if k == 2:  # the version is there, and the stream does not learn of it

            def late(self, n):
                publish(self, n)
                raise OSError("lost")

            monkeypatch.setattr(Versions, "_publish", late)
            with pytest.raises(Exception, match="lost"):
                kept.keep_item_stats(stream, tables, f"{tmp_path}/cp").awaitTermination()
            monkeypatch.setattr(Versions, "_publish", publish)
        kept.keep_item_stats(stream, tables, f"{tmp_path}/cp").awaitTermination()
        want = sorted(map(tuple, report.item_stats(frame.where(F.col("arrival") <= k)).select("case_id", "n", "accuracy", "mean_ms").collect()))
        assert sorted(map(tuple, kept.item_stats_now(tables).collect())) == want


def test_results_count_once(spark, tmp_path):
    rows = [(k % 4, k, f"f{k:02d}", "AB"[k % 2 if k % 4 == 1 else 0], ["HIGH", "LOW"][k // 4 % 2], f"full{k}" if k in (3, 7) else None, "C" if k % 5 == 0 else None, f"said{k}" if k % 2 else None, k // 8) for k in range(24)]
    frame = spark.createDataFrame(rows, "case_id long, pos long, file string, option string, confidence string, full_rationale string, answer string, explanation string, arrival int")
    from caseloom.operators import review

    tables = Versions(spark, f"{tmp_path}/t", kept.RESULT_KEYS, buckets=2)
    for k in range(3):
        stream = arrive(spark, frame, f"{tmp_path}/in", k)
        kept.keep_outcomes(stream, tables, f"{tmp_path}/cp").awaitTermination()
        kept.keep_outcomes(stream, tables, f"{tmp_path}/cp-new").awaitTermination()  # a lost checkpoint: epochs that were applied come again
        part = frame.where(F.col("arrival") <= k)
        want = review.merge_verdicts(part).join(review.apply_results(part), "case_id", "left").orderBy("case_id").collect()
        got = kept.outcomes(tables.read("outcomes")).orderBy("case_id").collect()
        assert [(r.case_id, r.action, r.option, r.file, r.rationale, r.new_key, r.level) for r in got] == [(r.case_id, r.action, r.option, r.file, r.rationale, r.new_key, r.level) for r in want]


def test_ban_list(spark, tmp_path):
    day = 86400
    rows = [(k, "a", day * k, 0) for k in range(3)] + [(10, "b", day, 0), (10, "b", day, 0), (11, "b", day, 0)] + [(20, "c", day * 2, 0), (21, "c", day * 12, 1), (22, "c", day * 13, 1), (23, "a", day * 20, 1), (24, None, day, 0)]
    frame = spark.createDataFrame(rows, "id long, user_hash string, sec long, arrival int").withColumn("created_at", (F.col("sec") + 1000 * day).cast("timestamp")).drop("sec")
    tables = Versions(spark, f"{tmp_path}/t", kept.BAN_KEYS, buckets=2)
    for k, want in enumerate(([("a", 3)], [("a", 3)])):
        kept.keep_bans(arrive(spark, frame, f"{tmp_path}/in", k), tables, f"{tmp_path}/cp").awaitTermination()
        assert [(r.user_hash, r.strike_count) for r in tables.read("bans").collect()] == want
    now = frame.where("user_hash is not null").select("id", "user_hash", "created_at").distinct()
    last = {r.user_hash for r in report.recent_strikes(now, F.lit(1020 * day).cast("timestamp")).where("strikes >= 3").collect()}
    assert last <= {"a"}


def test_one_changed_row_is_one_range(spark, tmp_path):
    a = spark.range(5000).select(F.col("id").alias("case_id"), F.concat(F.lit("t"), "id").alias("text"))
    b = a.withColumn("text", F.when(F.col("case_id") == 777, "changed").otherwise(F.col("text")))
    ta, tb, again = (parity.keep_tree(parity.key_tree(x, ["case_id", "text"]), f"{tmp_path}/{n}") for n, x in (("a", a), ("b", b), ("c", a.repartition(7))))
    assert parity.differing_ranges(ta, again).count() == 0
    ranges = parity.differing_ranges(ta, tb)
    assert [r.part for r in ranges.collect()] == [777 // parity.WIDTH]
    a.write.parquet(f"{tmp_path}/rows")
    rows = parity.rows_of(spark.read.parquet(f"{tmp_path}/rows"), ranges)
    assert rows.count() == parity.WIDTH and "GreaterThanOrEqual(case_id" in rows._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(None, "x"), (None, "x"), (-5, "y"), (3, None)], "case_id long, text string")
    assert parity.differing_ranges(parity.key_tree(odd, ["case_id", "text"]), parity.key_tree(odd.where("text is not null"), ["case_id", "text"])).collect()[0].part == 0
