import datetime as dt

from pyspark.sql import functions as F

from quillon.functions.keys import is_blank, number_key
from quillon.operators.orphans import OrphanState

T = lambda d: dt.datetime(2024, 1, d)
REFS = "id long, side string, target_table string, key string, created_at timestamp_ntz"
PARENTS = "target_table string, key string, seen_at timestamp_ntz, op int"
GONE = "target_table string, key string"
DOC = "document_metadata"


def kinds(state):
    return {r.id: r.kind for r in state.orphans().collect()}


def test_state_follows_arrivals_removals_and_deletions(spark):
    refs = spark.createDataFrame([(i, "entity_end", DOC, k, t) for i, k, t in ((1, "a", T(5)), (2, "b", T(5)), (3, "c", None), (4, "d", T(5)))], REFS)
    state = OrphanState(spark).advance(refs, spark.createDataFrame([(DOC, "a", T(1), 1)], PARENTS))
    assert kinds(state) == {2: "missing", 3: "missing", 4: "missing"}
    state.advance(parents=spark.createDataFrame([(DOC, "b", T(9), 1), (DOC, "c", T(9), 1)], PARENTS))
    assert kinds(state) == {2: "late", 4: "missing"}
    state.advance(deletions=spark.createDataFrame([(DOC, "d"), (DOC, "a")], GONE))
    assert kinds(state) == {2: "late", 4: "deleted"}  # a is still there
    state.advance(parents=spark.createDataFrame([(DOC, "a", T(1), -1)], PARENTS))
    assert kinds(state) == {1: "deleted", 2: "late", 4: "deleted"}
    state.advance(parents=spark.createDataFrame([(DOC, "b", None, 1)], PARENTS))
    assert kinds(state) == {1: "deleted", 4: "deleted"}
    report = {(r.period, r.kind): r.orphans for r in state.snapshot().collect()}
    assert report == {("2024-01", "deleted"): 2}


def test_one_step_equals_many(spark):
    refs = spark.createDataFrame([(i, "entity_start", DOC, f"k{i % 7}", T(1 + i % 20)) for i in range(200)], REFS)
    parents = spark.createDataFrame([(DOC, f"k{i}", T(3 * i + 1), 1) for i in range(5)], PARENTS)
    gone = spark.createDataFrame([(DOC, "k5")], GONE)
    whole = kinds(OrphanState(spark).advance(refs, parents, gone))
    steps = OrphanState(spark)
    for low in (0, 50, 100, 150):
        steps.advance(refs.where(f"id >= {low} and id < {low + 50}"), parents.where(F.col("key") == f"k{low // 50}") if low else parents.where("key in ('k0', 'k4')"))
    steps.advance(deletions=gone)
    assert kinds(steps) == whole and set(whole.values()) == {"late", "deleted", "missing"}


def test_empty(spark):
    state = OrphanState(spark).advance(spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS), spark.createDataFrame([], GONE))
    assert kinds(state) == {} and state.snapshot().count() == 0


def test_number_keys(spark):
    rows = [("3_2017_vbhn-hđlp",), (" 3 / 2017 / VBHN-HĐLP",), ("3-2017-vbhn-hdlp",), ("3_2017_vbhn-hđlq",), (None,), (" 　",), ("ê",), ("ê",), ("e",)]
    got = spark.createDataFrame(rows, "x string").select("x", number_key(F.col("x")).alias("k"), is_blank(F.col("x")).alias("b")).collect()
    keys = [r.k for r in got]
    assert keys[0] == keys[1] == keys[2] == "3_2017_vbhn_hdlp" and keys[3] != keys[0]
    assert keys[4] is None and keys[6] == keys[7] != keys[8]
    assert [r.b for r in got[4:6]] == [True, True] and not got[0].b


def parts(spark, state, name):
    import glob

    return {int(p.rsplit("/", 1)[1]): spark.read.parquet(p).count() for p in glob.glob(f"{state.path}/{name}/*")}


def test_an_advance_writes_only_what_changes(spark, tmp_path):
    refs = spark.range(5000).selectExpr("id", "'entity_end' AS side", f"'{DOC}' AS target_table", "concat('k', id % 2500) AS key", "timestamp_ntz'2024-01-05' AS created_at")
    parents = spark.range(2000).selectExpr(f"'{DOC}' AS target_table", "concat('k', id) AS key", "timestamp_ntz'2024-01-01' AS seen_at", "1 AS op")
    state = OrphanState(spark, path=str(tmp_path / "state")).advance(refs, parents)
    state.advance(refs.where("id < 50").selectExpr("id + 5000 AS id", "side", "target_table", "key", "created_at"), parents.where("key in ('k1', 'k2')").selectExpr("target_table", "concat('k2', substr(key, 2), '00') AS key", "seen_at", "op"))
    written, held = parts(spark, state, "refs"), parts(spark, state, "index")
    assert written[2] < 0.05 * written[1] and held[2] < 0.05 * held[1]
    assert state.orphans().count() == 1000 - 4 == state.snapshot().agg(F.sum("orphans")).first()[0]


def test_opened_again_after_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    refs = spark.createDataFrame([(1, "entity_end", DOC, "a", T(5)), (2, "entity_end", DOC, "b", T(5)), (2, "entity_end", DOC, "b", T(5))], REFS)
    OrphanState(spark, path=path).advance(refs, spark.createDataFrame([(DOC, "a", T(1), 1)], PARENTS), batch=0)
    arrival = spark.createDataFrame([(DOC, "b", T(2), 1)], PARENTS)
    broken = OrphanState(spark, path=path)
    with monkeypatch.context() as m:
        m.setattr(OrphanState, "_commit", lambda *a: 1 / 0)
        try:
            broken.advance(parents=arrival, batch=1)
        except ZeroDivisionError:
            pass
    again = OrphanState(spark, path=path)
    assert again.version == 1 and sorted(r.id for r in again.orphans().collect()) == [2, 2]
    again.advance(parents=arrival, batch=1)
    again.advance(parents=spark.createDataFrame([(DOC, "a", T(1), -1)], PARENTS), batch=1)  # a replay
    assert kinds(OrphanState(spark, path=path)) == {}


def test_merged_logs_give_the_same(spark, tmp_path, monkeypatch):
    from quillon.operators import orphans

    monkeypatch.setattr(orphans, "COMPACT_EVERY", 2)
    state = OrphanState(spark, path=str(tmp_path / "state"))
    for day in range(1, 6):
        state.advance(spark.createDataFrame([(day, "entity_end", DOC, f"k{day}", T(day))], REFS), spark.createDataFrame([(DOC, f"k{day - 1}", T(day), 1)], PARENTS))
    assert kinds(state) == {1: "late", 2: "late", 3: "late", 4: "late", 5: "missing"} == kinds(OrphanState(spark, path=state.path))
    assert len(parts(spark, state, "refs")) <= 2
    assert {(r.kind, r.orphans) for r in state.snapshot().collect()} == {("late", 4), ("missing", 1)}
