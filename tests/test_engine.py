"""Semantics that the registered queries don't show: nulls, mappers, immutability, writes, batches, schema."""

import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions.conditions import MISSING, and_, eq, gt, in_array, is_not_null, is_null, map_with, ne, not_in_subquery, or_, placeholder, sql_join
from weftline.functions.scalars import int_div, json_array_some, json_merge, search_normalize
from weftline.operators.query import Database
from weftline.operators.write import KeyConflict, MutationBatch, Writer, violations
from weftline.plans import model as M
from weftline.plans.batch import QueryBatch, QueryTimeout, Tracer, future, future_count, future_first_or_default, prepare, run_all, with_timeout
from weftline.plans.schema import Migrations, SchemaManager, enum_order, outside_enum, validated
from weftline.sources.tables import Store, Transaction


@pytest.fixture(scope="module")
def db(spark):
    m = M.Model()
    users = m.entity("users", "id", id=M.integer(), name=M.text(), age=M.integer(), seen=M.integer(stored="last_seen", mapper=M.int_datetime))
    users.has_many("posts", "posts", "id", "user_id").has_many("top_posts", "posts", ["id", M.Literal("top")], ["user_id", "kind"])
    users.has_check("grown", lambda u: gt(u.age, 30))
    posts = m.entity("posts", "id", id=M.integer(), user_id=M.integer(), views=M.integer(), kind=M.enum("low", "mid", "top"))
    posts.has_one("user", "users", "user_id", "id")
    tables = {
        "users": spark.createDataFrame([(1, "alice", 25, 86400), (2, "bob", None, None), (3, "Chloé", 45, 0)], "id int, name string, age int, last_seen int"),
        "posts": spark.createDataFrame([(1, 1, 100, "top"), (2, 1, 150, "low"), (3, 2, None, "mid"), (4, None, 7, "top")], "id int, user_id int, views int, kind string"),
    }
    return Database(spark, m, tables.__getitem__)


def values(q):
    return [tuple(r) for r in q.to_list()]


def test_null_rules(db):
    assert values(db.users.where(lambda u: eq(u.age, None)).select(lambda u: u.id)) == [(2,)]
    assert values(db.users.where(lambda u: ne(u.age, None)).order_by(lambda u: u.id).select(lambda u: u.id)) == [(1,), (3,)]
    with pytest.raises(ValueError):
        db.users.where(lambda u: gt(u.age, MISSING))
    assert db.users.where(lambda u: in_array(u.id, [])).count() == 0
    assert db.users.where(lambda u: and_(or_(), and_())).count() == 3
    # A null in the list lets no row through.
    assert db.users.where(lambda u: not_in_subquery(u.id, db.posts.select(lambda p: {"u": p.user_id}))).count() == 0


def test_null_order(db):
    assert [r[0] for r in db.users.select(lambda u: {"age": u.age}).order_by(lambda u: u.age).to_list()] == [25, 45, None]
    assert [r[0] for r in db.users.select(lambda u: {"age": u.age}).order_by(lambda u: [(u.age, "DESC")]).to_list()] == [None, 45, 25]


def test_queries_do_not_change(db):
    q = db.users
    q.where(lambda u: eq(u.id, 1))
    q.limit(1)
    q.order_by(lambda u: u.name)
    assert q.count() == 3 and len(q.to_list()) == 3


def test_optional_reference_keeps_rows(db):
    got = values(db.posts.select(lambda p: {"id": p.id, "name": p.user.name}).order_by(lambda p: p.id))
    assert got == [(1, "alice"), (2, "alice"), (3, "bob"), (4, None)]


def test_one_join_for_one_path(db):
    plan = db.posts.where(lambda p: eq(p.user.name, "alice")).select(lambda p: {"n": p.user.name, "a": p.user.age}).df()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_mapped_column(db):
    day = datetime.datetime(2025, 1, 2)
    assert db.users.where(lambda u: eq(u.seen, day)).first()["seen"] == day
    assert db.users.where(lambda u: is_null(u.seen)).count() == 1


def test_collections(db):
    q = db.users.select(lambda u: {"id": u.id, "ids": u.posts.order_by(lambda p: [(p.views, "DESC")]).select(lambda p: p.id).to_list(), "n": u.posts.count(), "sum": u.posts.sum(lambda p: p.views), "top": u.top_posts.count()})
    assert values(q.order_by(lambda r: r.id)) == [(1, [2, 1], 2, 250, 1), (2, [3], 1, None, 0), (3, [], 0, None, 0)]
    first = db.users.select(lambda u: {"id": u.id, "p": u.posts.order_by(lambda p: p.id).first_or_default()}).order_by(lambda r: r.id).to_list()
    assert first[0].p.id == 1 and first[2].p is None


def test_collection_strategies_agree(db):
    shape = lambda u: {"id": u.id, "n": u.posts.count(), "ids": u.posts.order_by(lambda p: p.id).select(lambda p: p.id).to_list()}
    want = values(db.users.where(lambda u: gt(u.age, 30)).select(shape))
    for name in ("lateral", "cte", "temptable"):
        assert values(db.with_options(collection_strategy=name).users.where(lambda u: gt(u.age, 30)).select(shape)) == want


def test_raw_values_without_mappers(db):
    assert db.with_options(disable_mappers=True).users.where(lambda u: eq(u.id, 1)).first()["seen"] == 86400


def test_fragments(db):
    q = db.users.select(lambda u: {"id": u.id, "s": sql_join([u.id, u.age, None, F.lit(2)], " + "), "m": map_with(u.name, F.upper)})
    assert values(q.order_by(lambda r: r.id)) == [(1, 28, "ALICE"), (2, None, "BOB"), (3, 50, "CHLOÉ")]


def test_mutation_cte_and_list(db):
    gone = db.mutation_cte("gone", Writer(db, "posts").delete(lambda p: eq(p.user_id, 1)))
    got = db.users.inner_join(gone, lambda u, g: eq(u.id, g.user_id), lambda u, g: {"name": u.name, "post": g.id})
    assert sorted(values(got)) == [("alice", 1), ("alice", 2)] and db.posts.count() == 4
    assert "gone" in [c.name for c in db.ctes()]
    db.clear_ctes()
    assert db.ctes() == []


def test_search_function(spark):
    SchemaManager(spark, M.Model()).use_search_normalize()
    assert spark.sql("select search_normalize('ÉCOLE Ñ')").first()[0] == "ecole n"


def test_count_ignores_limit_and_projection(db):
    assert db.users.limit(1).count() == 3
    assert db.users.select(lambda u: {"n": u.name}).count() == 3
    assert db.users.order_by(lambda u: u.id).limit(2).count_over()[1] == 3
    assert db.users.where(lambda u: eq(u.id, 9)).count_over() == ([], 0)
    assert db.users.exists() and not db.users.where(lambda u: eq(u.id, 9)).exists()
    assert (db.users.min(lambda u: u.age), db.users.max(lambda u: u.age), db.users.sum(lambda u: u.age)) == (25, 45, 70)


def test_first(db):
    assert db.users.order_by(lambda u: u.id).first()["name"] == "alice"
    assert db.users.where(lambda u: eq(u.id, 9)).first_or_default() is None
    with pytest.raises(LookupError):
        db.users.where(lambda u: eq(u.id, 9)).first_or_throw()


def test_scalars(spark):
    row = spark.range(1).select(
        int_div(F.lit(-7), 2), json_merge(F.lit(None).cast("string"), '{"a":1}'), json_array_some(F.lit('[{"a":{"b":"x"}}]'), lambda e: e.a.b == "x"), search_normalize("ÀÉœŁ"),
    ).first()
    assert tuple(row) == (-3, '{"a":1}', True, "aeoel")


def test_prepared_and_futures(db):
    ready = prepare(lambda: db.users.where(lambda u: eq(u.name, placeholder("n"))), "n")
    assert [len(ready.execute(n=x)) for x in ("alice", "nobody")] == [1, 0]
    with pytest.raises(ValueError):
        ready.execute()
    q = db.users.order_by(lambda u: u.id)
    rows, one, n = run_all([future(q), future_first_or_default(q), future_count(q)])
    assert (len(rows), one["id"], n) == (3, 1, 3)


def test_query_batch(db):
    b = QueryBatch()
    b.add_list(db.users.select(lambda u: {"id": u.id, "age": u.age}).order_by(lambda u: [(u.id, "DESC")]))
    b.add_count(db.posts)
    b.add_first_or_default(db.users.where(lambda u: eq(u.id, 9)))
    assert b.execute() == [[{"id": 3, "age": 45}, {"id": 2, "age": None}, {"id": 1, "age": 25}], 4, None]


def test_equal_collections_are_read_once(db):
    q = db.users.select(lambda u: {"n": u.posts.count(), "sum": u.posts.sum(lambda p: p.views), "ids": u.posts.order_by(lambda p: [(p.views, "DESC"), p.id]).select(lambda p: p.id).to_list(), "some": u.posts.where(lambda p: gt(p.views, 120)).count()})
    plan = q.df()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Window" not in plan
    assert sorted(values(q), key=str) == [(0, None, [], 0), (1, None, [3], 0), (2, 250, [2, 1], 1)]


def test_not_in_is_no_null_aware_join(db, spark):
    q = db.users.where(lambda u: not_in_subquery(u.id, db.posts.where(lambda p: gt(p.id, 2)).select(lambda p: {"v": p.views})))
    assert q.count() == 0
    q = db.users.where(lambda u: not_in_subquery(u.age, db.posts.where(lambda p: gt(p.id, 99)).select(lambda p: {"v": p.views})))
    assert q.count() == 3
    q = db.users.where(lambda u: not_in_subquery(u.age, db.posts.where(lambda p: is_not_null(p.views)).select(lambda p: {"v": p.views})))
    assert sorted(r.id for r in q.to_list()) == [1, 3]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in q.df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_options_limit_and_trace(db):
    slow = []
    tracer = Tracer(expected=0.0, on_slow=lambda phase, took: slow.append(phase))
    own = db.with_options(timeout=60, tracer=tracer)
    assert len(own.users.to_list()) == own.users.count() == 3
    assert slow == ["list", "count"] and set(tracer.phases) == {"list", "count"}


def test_timeout(spark):
    slow = lambda: spark.range(4, numPartitions=4).rdd.map(lambda x: __import__("time").sleep(30)).count()
    with pytest.raises(QueryTimeout):
        with_timeout(spark, slow, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_overwrites_with_null(db):
    w = Writer(db, "users").upsert_bulk([{"id": 1, "age": None}, {"id": 9, "age": 3}])
    assert rows(w.after) == [(1, "alice", None, 86400), (2, "bob", None, None), (3, "Chloé", 45, 0), (9, None, 3, None)]
    assert w.affected_count() == 2
    kept = Writer(db, "users").upsert_bulk([{"id": 1, "age": 99}], set_where=lambda old, new: old.age > 30)
    assert kept.affected_count() == 0


def test_update_loses_no_row(db, spark):
    """A required reference without a partner gives null; columns without a mapping stay."""
    m = M.Model()
    m.entity("users", "id", id=M.integer(), name=M.text())
    m.entity("posts", "id", id=M.integer(), user_id=M.integer(), kind=M.text()).has_one("user", "users", "user_id", "id", True)
    own = Database(spark, m, db.tables)
    w = Writer(own, "posts").update(lambda p: gt(p.id, 1), lambda p: {"kind": p.user.name})
    assert rows(w.after) == [(1, 1, 100, "top"), (2, 1, 150, "alice"), (3, 2, None, "bob"), (4, None, 7, None)] and w.affected_count() == 3
    w = Writer(own, "posts").update(lambda p: eq(p.user.name, "bob"), {"kind": "x"})
    assert rows(w.after) == [(1, 1, 100, "top"), (2, 1, 150, "low"), (3, 2, None, "x"), (4, None, 7, "top")]
    w = Writer(own, "posts").update(lambda p: eq(p.id, 3), {"kind": "y"})
    assert (3, 2, None, "y") in rows(w.after) and w.after.count() == 4
    assert (3, 2, 1, "mid") in rows(Writer(own, "posts").update(lambda p: eq(p.id, 3), {"views": 1}).after)
    with pytest.raises(ValueError):
        Writer(own, "posts").update(lambda p: eq(p.id, 3), {"nothing": 1})


def test_key_conflicts_fail(db, spark):
    two = [{"id": 1, "age": 1}, {"id": 1, "age": 2}]
    frame = spark.createDataFrame([(1, 1), (1, 2)], "id int, age int")
    for act in (Writer(db, "users").upsert_bulk, lambda r: Writer(db, "users").merge_bulk(r, on="id"), Writer(db, "users").bulk_update, Writer(db, "users").insert_bulk):
        with pytest.raises(KeyConflict):
            act(two)
        with pytest.raises(Exception, match="one key"):
            act(frame).after.collect()
    with pytest.raises(Exception, match="a key that exists"):
        Writer(db, "users").insert({"id": 2, "name": "again"}).after.collect()
    assert Writer(db, "users").insert({"id": 9, "name": "new"}).after.count() == 4
    for bad in ([{"age": 3}], [{"id": 1}], [{"id": None, "age": 3}]):
        with pytest.raises(ValueError):
            Writer(db, "users").bulk_update(bad)
    assert Writer(db, "users").bulk_update([]).affected_count() == 0
    w = Writer(db, "users").bulk_update([{"id": 1, "age": None}, {"id": 3, "name": "z"}, {"id": 77, "age": 1}])
    assert rows(w.after) == [(1, "alice", None, 86400), (2, "bob", None, None), (3, "z", 45, 0)] and w.affected_count() == 2


def test_numbers_go_on_over_partitions(db, spark):
    frame = spark.range(50, numPartitions=7).selectExpr("cast(id as string) as name")
    got = Writer(db, "users").insert_numbered(frame, "id").affected.collect()
    assert sorted(r.id for r in got) == list(range(4, 54)) and [r.name for r in sorted(got, key=lambda r: r.id)] == [str(i) for i in range(50)]


def test_a_batch_gives_one_state(db, spark, tmp_path):
    b = MutationBatch(db)
    b.add_delete_where_in("gone", "users", "id", [1])
    b.add_update_where_in("named", "users", "id", [2], {"name": "z"})
    b.add_upsert_bulk("up", "users", [{"id": 7, "name": "new"}, {"id": 3, "name": "c"}])
    b.add_insert_bulk("more", "posts", [{"id": 9, "user_id": 7}])
    b.add_bulk_update("kinds", "posts", [{"id": 1, "kind": "low"}])
    store = Store(spark, str(tmp_path))
    got = b.commit(store)
    assert rows(got["users"]) == [(2, "z", None, None), (3, "c", 45, 0), (7, "new", None, None)]
    assert rows(got["posts"])[0] == (1, 1, 100, "low") and got["posts"].count() == 5
    again = Store(spark, str(tmp_path))
    assert rows(again("users")) == rows(got["users"])
    again.commit("users", again("users").limit(1))
    with pytest.raises(RuntimeError):
        store.commit("users", store("users"))
    b.add_update_where_in("twice", "users", "id", [2], {"name": "y"})
    with pytest.raises(Exception, match="several legs"):
        b.states()["users"].collect()


def test_update_and_delete_walk_relations(db):
    w = Writer(db, "posts").update(lambda p: eq(p.user.name, "alice"), lambda p: {"views": p.views + 1})
    assert sorted(r.views for r in w.affected.collect()) == [101, 151]
    assert [tuple(r) for r in w.returning(lambda p: {"id": p.id, "who": p.user.name}).order_by(lambda r: r.id).to_list()] == [(1, "alice"), (2, "alice")]
    d = Writer(db, "posts").delete(lambda p: gt(p.views, 120))
    assert d.after.count() == 3 and d.affected.count() == 1
    with pytest.raises(ValueError):
        Writer(db, "posts").delete(None)


def test_insert_with_children_and_guard(db):
    kids = {"posts": ("user_id", [[{"id": 10}], [{"id": 11}, {"id": 12}]])}
    out = Writer(db, "users").insert_with_children([{"name": "x"}, {"name": "y"}], "id", kids)
    assert rows(out["posts"].affected.select("id", "user_id")) == [(10, 4), (11, 5), (12, 5)]
    none = Writer(db, "users").insert_with_children({"name": "x"}, "id", {"posts": ("user_id", [[{"id": 1}]])}, unless_exists=lambda u: eq(u.name, "bob"))
    assert none["users"].affected_count() == 0 and none["posts"].affected_count() == 0


def test_mutation_batch_sees_one_state(db):
    b = MutationBatch(db)
    assert b.add_insert_bulk("none", "users", []) is None
    b.add_delete_where_in("gone", "users", "id", [1])
    b.add_update_where_in("named", "users", "id", [1, 2], {"name": "z"})
    b.add_upsert_bulk("up", "users", [{"id": 7, "name": "new"}])
    b.add_dependent_insert("posts", "posts", "up", lambda u: {"id": u.id + 100, "user_id": u.id})
    got = b.execute()
    assert [got[k].count() for k in ("gone", "named", "posts")] == [1, 2, 1]


def test_checks_enums_and_validation(db, spark):
    assert [r.id for r in violations(db, "users").collect()] == [1]  # a null passes, as in SQL
    posts = db.model["posts"]
    assert outside_enum(posts, spark.createDataFrame([(1, 1, 1, "odd")], "id int, user_id int, views int, kind string")).count() == 1
    assert validated(db.model["users"], db.raw_frame("users")) == []
    ranked = db.posts.order_by(lambda p: [(enum_order(posts.columns["kind"].values, p.kind), "ASC"), p.id]).select(lambda p: p.kind).to_list()
    assert [r[0] for r in ranked] == ["low", "mid", "top", "top"]


def test_store_and_transaction(db, spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit("users", db.raw_frame("users"))
    with pytest.raises(RuntimeError), Transaction(store):
        store.commit("users", store("users").limit(1))
        raise RuntimeError("undone")
    assert store("users").count() == 3
    with Transaction(store):
        store.commit("users", Writer(db, "users", store("users")).delete(lambda u: eq(u.id, 1)).after)
        with pytest.raises(RuntimeError), Transaction(store):
            pass
    assert store("users").count() == 2


def test_schema_manager(spark):
    m = M.Model()
    m.entity("made", "id", id=M.integer(), name=M.text())
    s = SchemaManager(spark, m)
    s.ensure_deleted()
    assert [o.kind for o in s.analyze()] == ["create_table"]
    s.ensure_created()
    assert s.analyze() == []
    m["made"].prop("extra", M.bigint())
    assert "add columns (`extra` bigint)" in s.scaffold() and compile(s.scaffold(), "step", "exec")
    assert s.migrate() == [] and "extra" in spark.table("made").columns
    assert s.column_keys("made") == ["id", "name", "extra"]
    runner = Migrations(spark, "journal_t")
    runner.add("one", lambda sp: sp.sql("create table if not exists step1 (x int) using parquet"), lambda sp: sp.sql("drop table step1"))
    assert runner.status() == [("one", False)]
    assert runner.up() == ["one"] and runner.up() == [] and runner.down() == "one" and runner.applied() == []
    s.ensure_deleted()
    spark.sql("drop table journal_t")


def test_sequence():
    q = M.Model().sequence("s", start=5)
    assert (q.next_value(), q.current_value(), q.take(3), q.next_value()) == (5, 5, 6, 9)
    q.resync(40)
    assert q.next_value() == 41
