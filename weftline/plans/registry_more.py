"""Further registered queries: an operator of the inventory that no query of `registry` shows has one here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import (
    and_, empty, eq, eq_subquery, exists, gt, gte, gte_subquery, in_array, in_subquery, is_not_null, join_conditions, like, lt, lt_subquery, lte_subquery, map_with, ne_subquery,
    not_exists, not_in_subquery, on_true, or_, regex_no_match_ci, sql, sql_join,
)
from ..functions.scalars import (
    array_of, contains_search, ends_with_search, json_array_some, json_select, json_unwrap, normalized_like, starts_with_search,
)
from ..operators.query import Database, props
from ..operators.write import MutationBatch, Writer, violations
from ..sources.tables import Store, directory, jdbc, jdbc_sink
from . import model as M
from .batch import QueryBatch, Tracer, future, future_count, future_first_or_default, run_all
from .registry import query
from .schema import Migrations, SchemaManager, enum_order


def values(db: Database, rows: list[tuple], schema: str) -> DataFrame:
    return db.spark.createDataFrame(rows, schema)


def counted(legs: dict[str, DataFrame]) -> DataFrame:
    """leg, n."""
    out = None
    for leg, df in legs.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(leg).alias("leg"), "n")
        out = part if out is None else out.union(part)
    return out


def with_entities(db: Database, change) -> Database:
    """The same tables under a model with further declarations."""
    from .star import star_model

    m = star_model()
    change(m)
    return Database(db.spark, m, db.tables)


# Joins and roots.


@query("select n_nationkey, n from nation left join (select c_nationkey k, cast(count(*) as integer) n from customer where c_acctbal > 9000 group by 1) on n_nationkey = k")
def left_join_subquery(db):
    rich = db.customer.where(lambda c: gt(c.c_acctbal, 9000)).group_by(lambda c: {"k": c.c_nationkey}).select(lambda g: {"k": g.key.k, "n": g.count()}).query()
    return db.nation.left_join(rich.as_subquery(), lambda n, x: eq(n.n_nationkey, x.k), lambda n, x: {"n_nationkey": n.n_nationkey, "n": x.n})


@query("select c_custkey from customer join (select o_custkey k, count(*) n from orders group by 1) on c_custkey = k where n > 14")
def cte_filter_join(db):
    per = db.cte("per", db.orders.group_by(lambda o: {"k": o.o_custkey}).select(lambda g: {"k": g.key.k, "n": g.count()}).query())
    return db.customer.join_filter(per, lambda c, x: eq(c.c_custkey, x.k), lambda c, x: gt(x.n, 14)).select(lambda c: {"c_custkey": c.c_custkey})


@query("select r.k, r.n, r_name from (select n_regionkey k, cast(count(*) as integer) n from nation group by 1) r left join region on r_regionkey = r.k and r_name like '%A%'")
def group_left_join(db):
    per = db.nation.group_by(lambda n: {"k": n.n_regionkey}).select(lambda g: {"k": g.key.k, "n": g.count()})
    return per.left_join("region", lambda x, r: and_(eq(x.k, r.r_regionkey), like(r.r_name, "%A%")), lambda x, r: {"k": x.k, "n": x.n, "r_name": r.r_name})


@query("select r.k, r.n, r_name from (select n_regionkey k, cast(count(*) as integer) n from nation group by 1) r join region on r_regionkey = r.k")
def group_inner_join(db):
    per = db.nation.group_by(lambda n: {"k": n.n_regionkey}).select(lambda g: {"k": g.key.k, "n": g.count()})
    return per.inner_join("region", lambda x, r: eq(x.k, r.r_regionkey), lambda x, r: {"k": x.k, "n": x.n, "r_name": r.r_name})


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey < 9")
def cte_root_inner(db):
    low = db.cte("low", db.nation.where(lambda n: lt(n.n_nationkey, 9)).select(lambda n: {"n_name": n.n_name, "k": n.n_regionkey}))
    return db.select_from_cte(low).inner_join("region", lambda x, r: eq(x.k, r.r_regionkey), lambda x, r: {"n_name": x.n_name, "r_name": r.r_name})


@query("select r_name, n_name from region left join nation on n_regionkey = r_regionkey and n_nationkey < 3")
def cte_root_left(db):
    every = db.cte("every", db.region.select(lambda r: {"r_name": r.r_name, "k": r.r_regionkey}))
    return db.select_from_cte(every).left_join("nation", lambda x, n: and_(eq(x.k, n.n_regionkey), lt(n.n_nationkey, 3)), lambda x, n: {"r_name": x.r_name, "n_name": n.n_name})


@query("select n_nationkey from nation where n_regionkey <> 1 order by n_nationkey desc limit 4 offset 2")
def cte_root_page(db):
    some = db.cte("some", db.nation.where(lambda n: or_(lt(n.n_regionkey, 1), gt(n.n_regionkey, 1))).select(lambda n: {"n_nationkey": n.n_nationkey}))
    return db.select_from_cte(some).select(lambda n: {"n_nationkey": n.n_nationkey}).order_by(lambda n: [(n.n_nationkey, "DESC")]).offset(2).limit(4)


@query("select a.r_name as a, b.r_name as b from region a join region b on true")
def join_on_true(db):
    return db.region.inner_join("region", on_true, lambda a, b: {"a": a.r_name, "b": b.r_name})


@query("select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as returned from orders where o_orderkey < 3000")
def constant_key_collection(db):
    def change(m):
        m["orders"].has_many("returned", "lineitem", ["o_orderkey", M.Literal("R")], ["l_orderkey", "l_returnflag"])

    own = with_entities(db, change)
    return own.orders.where(lambda o: lt(o.o_orderkey, 3000)).select(lambda o: {"o_orderkey": o.o_orderkey, "returned": o.returned.count()})


@query("select a.conv_id, a.turn, md5(b.text) as next_text from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1 and b.role = 'assistant' where a.role = 'user'")
def composite_key_reference(db):
    after = db.cte("after", db.conversations.select(lambda c: {"conv_id": c.conv_id, "turn": c.turn - 1, "role": c.role, "text": c.text}))
    m = M.Model()
    m.entity("conversations", ("conv_id", "turn"), conv_id=M.bigint(), turn=M.bigint(), role=M.text(), text=M.text()).has_one("reply", "after", ["conv_id", "turn", M.Literal("assistant")], ["conv_id", "turn", "role"])
    m.entity("after", ("conv_id", "turn"), conv_id=M.bigint(), turn=M.bigint(), role=M.text(), text=M.text())
    own = Database(db.spark, m, lambda t: after.df() if t == "after" else db.tables(t))
    return own.conversations.where(lambda c: eq(c.role, "user")).select(lambda c: {"conv_id": c.conv_id, "turn": c.turn, "next_text": F.md5(c.reply.text)})


# Fragments.


@query("select n_nationkey, n_nationkey + n_regionkey + 2 as total, upper(n_name) as loud from nation where n_nationkey > 3 and n_regionkey < 4")
def sql_fragments(db):
    test = lambda n: join_conditions([sql("{} > 3", n.n_nationkey), empty(), sql("{} < {}", n.n_regionkey, 4)], " and ")
    return db.nation.where(lambda n: and_(test(n), empty())).select(
        lambda n: {"n_nationkey": n.n_nationkey, "total": sql_join([n.n_nationkey, n.n_regionkey, empty(), F.lit(2)], " + ").alias("total"), "loud": map_with(n.n_name, F.upper)}
    )


@query("select p_partkey, list_contains(['Brand#11', 'Brand#21'], p_brand) as chosen, [p_size, 0] as pair from part")
def array_literal(db):
    return db.part.select(lambda p: {"p_partkey": p.p_partkey, "chosen": F.array_contains(array_of("Brand#11", "Brand#21"), p.p_brand), "pair": array_of(p.p_size, 0)})


@query("select doc_id from documents where not regexp_matches(source, 'SRC[13]', 'i')")
def filter_regex_no_match_ci(db):
    return db.documents.where(lambda d: regex_no_match_ci(d.source, "SRC[13]")).select(lambda d: {"doc_id": d.doc_id})


@query("select n_nationkey, lower(n_name) like 'nation%' as a, lower(n_name) like '%_2' escape '!' as b, lower(n_name) like '%tion%' as c from nation")
def search_patterns(db):
    return db.nation.select(
        lambda n: {"n_nationkey": n.n_nationkey, "a": normalized_like(n.n_name, starts_with_search("NATION")), "b": normalized_like(n.n_name, ends_with_search("_2")), "c": normalized_like(n.n_name, contains_search("TION"))}
    )


@query("select event_id, json_extract_string(props, '$.k') as k from events where json_extract_string(props, '$.k') = '3'")
def json_select_q(db):
    return db.events.where(lambda e: json_select(e.props, "k") == json_unwrap(3)).select(lambda e: {"event_id": e.event_id, "k": json_select(e.props, "k")})


@query("select event_id, json_extract_string(props, '$.k') in ('7', '8') as some from events")
def json_array_of_two(db):
    return db.events.select(lambda e: {"event_id": e.event_id, "some": json_array_some(F.concat(F.lit('[{"k": 0, "in": {"k": 1}},'), e.props, F.lit("]")), lambda x: (x.k == 7) | (x.k == 8))})


@query("select event_id, true as nested from events where event_id < 50")
def json_element_path(db):
    return db.events.where(lambda e: lt(e.event_id, 50)).select(lambda e: {"event_id": e.event_id, "nested": json_array_some(F.concat(F.lit('[{"in": {"k": "x"}},'), e.props, F.lit("]")), lambda x: getattr(x, "in").k == "x")})


# Subqueries.

COMPARED = {
    "scalar_subquery_eq": (eq_subquery, "=", "max"),
    "scalar_subquery_ne": (ne_subquery, "<>", "max"),
    "scalar_subquery_gte": (gte_subquery, ">=", "max"),
    "scalar_subquery_lt": (lt_subquery, "<", "min"),
    "scalar_subquery_lte": (lte_subquery, "<=", "min"),
}


def _compared(name, compare, sign, fn):
    def build(db):
        return db.part.where(lambda p: compare(p.p_size, db.part.where(lambda x: lt(x.p_partkey, 90)).aggregate_frame(fn, lambda x: x.p_size))).select(lambda p: {"p_partkey": p.p_partkey})

    build.__name__ = name
    query(f"select p_partkey from part where p_size {sign} (select {fn}(p_size) from part where p_partkey < 90)")(build)


for _name, _parts in COMPARED.items():
    _compared(_name, *_parts)


@query("select n_nationkey from nation where exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal > 9900) and n_regionkey in (select r_regionkey from region where r_regionkey > 0)")
def exists_and_in(db):
    return db.nation.where(lambda n: and_(exists(n.customers.where(lambda c: gt(c.c_acctbal, 9900))), in_subquery(n.n_regionkey, db.region.where(lambda r: gt(r.r_regionkey, 0)).select(lambda r: {"k": r.r_regionkey})))).select(
        lambda n: {"n_nationkey": n.n_nationkey}
    )


@query("select n_nationkey from nation where n_regionkey not in (select case when r_regionkey = 2 then null else r_regionkey end from region where r_regionkey < 3)")
def not_in_with_null(db):
    return db.nation.where(lambda n: not_in_subquery(n.n_regionkey, db.region.where(lambda r: lt(r.r_regionkey, 3)).select(lambda r: {"k": F.when(r.r_regionkey != 2, r.r_regionkey)}))).select(lambda n: {"n_nationkey": n.n_nationkey})


@query("select n_nationkey from nation where n_regionkey not in (select r_regionkey from region where r_regionkey > 99)")
def not_in_of_nothing(db):
    return db.nation.where(lambda n: not_in_subquery(n.n_regionkey, db.region.where(lambda r: gt(r.r_regionkey, 99)).select(lambda r: {"k": r.r_regionkey}))).select(lambda n: {"n_nationkey": n.n_nationkey})


@query("select exists(select 1 from orders where o_totalprice > 499000) as exists")
def query_exists(db):
    return db.orders.where(lambda o: gt(o.o_totalprice, 499000)).exists_frame()


@query("select n_nationkey from nation order by n_nationkey limit 1")
def first_or_throw(db):
    row = db.nation.select(lambda n: {"n_nationkey": n.n_nationkey}).order_by(lambda n: n.n_nationkey).first_or_throw()
    return values(db, [tuple(row)], "n_nationkey int")


# Groups, unions, frames.


@query("select o_orderpriority as p, cast(count(*) as integer) as n from orders group by 1 having count(*) > 10 and max(o_totalprice) > 1000")
def group_having_post(db):
    return db.orders.group_by(lambda o: {"p": o.o_orderpriority}).select(lambda g: {"p": g.key.p, "n": g.count()}).having(lambda g: gt(g.count(), 10)).having(lambda g: gt(g.max(lambda o: o.o_totalprice), 1000))


@query("select o_custkey as k, cast(count(*) as integer) as n from orders group by 1 order by n desc, k limit 7 offset 3")
def group_page(db):
    return db.orders.group_by(lambda o: {"k": o.o_custkey}).select(lambda g: {"k": g.key.k, "n": g.count()}).order_by(lambda r: [(r.n, "DESC"), r.k]).offset(3).limit(7)


@query("select k from (select n_nationkey k from nation union select r_regionkey + 100 from region) order by k desc limit 1")
def union_first(db):
    u = db.nation.select(lambda n: {"k": n.n_nationkey}).union(db.region.select(lambda r: {"k": r.r_regionkey + 100})).order_by(lambda r: [(r.k, "DESC")])
    return values(db, [tuple(u.first_or_default())], "k int")


@query("select c_custkey from customer where c_nationkey in (select s_nationkey from supplier where s_acctbal > 9000 union all select n_nationkey from nation where n_nationkey = 1)")
def union_as_subquery(db):
    u = db.supplier.where(lambda s: gt(s.s_acctbal, 9000)).select(lambda s: {"k": s.s_nationkey}).union_all(db.nation.where(lambda n: eq(n.n_nationkey, 1)).select(lambda n: {"k": n.n_nationkey}))
    return db.customer.where(lambda c: in_subquery(c.c_nationkey, u.as_subquery("array"))).select(lambda c: {"c_custkey": c.c_custkey})


@query("select n_name, (select count(*) from customer where c_nationkey = n_nationkey) as n from nation where n_nationkey < 5")
def cte_in_sql(db):
    few = db.cte("few_nations", db.nation.where(lambda n: lt(n.n_nationkey, 5)).select(lambda n: {"n_name": n.n_name, "k": n.n_nationkey}))
    q = db.customer.with_(few)
    q.db.customer.df().createOrReplaceTempView("customer_rows")
    return db.query("select n_name, count(c_custkey) as n from few_nations left join customer_rows on c_nationkey = k group by n_name")


@query("select 'a' as name union all select 'b'")
def cte_list(db):
    db.clear_ctes()
    db.cte("a", db.region)
    db.cte("b", db.nation, materialized=True)
    names = [(c.name,) for c in db.ctes()]
    db.clear_ctes()
    return values(db, names + [(c.name,) for c in db.ctes()], "name string")


@query("select c.c_custkey, n.n_name from nation n join customer c on c_nationkey = n_nationkey where n_regionkey = 2")
def mutation_cte_join(db):
    gone = db.mutation_cte("gone", Writer(db, "nation").delete(lambda n: eq(n.n_regionkey, 2)))
    return db.customer.inner_join(gone, lambda c, g: eq(c.c_nationkey, g.n_nationkey), lambda c, g: {"c_custkey": c.c_custkey, "n_name": g.n_name})


# Collections under the other strategies, declared types, mappers.


@query("select c_custkey, coalesce(list(o_orderkey order by o_totalprice desc, o_orderkey) filter (where r <= 2), []) as top from (select c_custkey, o_orderkey, o_totalprice, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) r from customer left join orders on o_custkey = c_custkey where c_nationkey = 3) where o_orderkey is not null or r = 1 group by 1 having count(o_orderkey) > 0 union all select c_custkey, [] from customer where c_nationkey = 3 and c_custkey not in (select o_custkey from orders)")
def coll_temptable_top(db):
    own = db.with_options(collection_strategy="temptable")
    return own.customer.where(lambda c: eq(c.c_nationkey, 3)).select(lambda c: {"c_custkey": c.c_custkey, "top": c.orders.order_by(lambda o: [(o.o_totalprice, "DESC"), o.o_orderkey]).limit(2).select(lambda o: o.o_orderkey).to_number_list()})


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n, (select coalesce(list(o_orderstatus order by o_orderkey), []) from orders where o_custkey = c_custkey) as states from customer where c_nationkey = 4")
def coll_temptable_lists(db):
    own = db.with_options(collection_strategy="temptable")
    return own.customer.where(lambda c: eq(c.c_nationkey, 4)).select(lambda c: {"c_custkey": c.c_custkey, "n": c.orders.count(), "states": c.orders.order_by(lambda o: o.o_orderkey).select(lambda o: o.o_orderstatus).to_string_list()})


@query("select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as n, (select count(*) from customer where c_nationkey = n_nationkey) as m from nation")
def coll_strategies(db):
    a = db.with_options(collection_strategy="lateral").nation.select(lambda n: {"k": n.n_nationkey, "n": n.customers.count()})
    b = db.with_options(collection_strategy="cte").nation.select(lambda n: {"k": n.n_nationkey, "m": n.customers.count()})
    return a.inner_join(b, lambda x, y: eq(x.k, y.k), lambda x, y: {"n_nationkey": x.k, "n": x.n, "m": y.m})


def mapped_entities(m):
    minutes = m.entity("timed", "p_partkey", p_partkey=M.bigint(), at=M.custom(M.integer(stored="p_size"), M.minute_of_day), since=M.bigint(stored="p_partkey2", mapper=M.int_datetime))
    minutes.columns.pop("since")
    minutes.prop("made", M.integer(stored="p_size", mapper=M.int_datetime)).to_table("part")
    m.entity("shouted", "n_nationkey", n_nationkey=M.integer(), name=M.custom(M.text(stored="n_name"), M.Mapper(F.lower, lambda v: v.upper()))).to_table("nation")


@query("select p_partkey, cast(p_size // 60 as integer) as hour, cast(p_size % 60 as integer) as minute, 1735689600 + p_size as made from part where p_size < 20")
def mapped_columns(db):
    own = with_entities(db, mapped_entities)
    return own.timed.where(lambda t: lt(t.at, {"hour": 0, "minute": 20})).select(lambda t: {"p_partkey": t.p_partkey, "hour": t.at["hour"], "minute": t.at["minute"], "made": F.unix_timestamp(t.made)})


@query("select n_nationkey, lower(n_name) as name from nation where n_name = 'NATION_7'")
def custom_mapper(db):
    own = with_entities(db, mapped_entities)
    return own.shouted.where(lambda s: eq(s.name, "nation_7")).select(lambda s: {"n_nationkey": s.n_nationkey, "name": s.name})


@query("select n_nationkey, n_name as name from nation")
def raw_results(db):
    return with_entities(db, mapped_entities).with_options(disable_mappers=True).shouted.select(lambda s: props(s))


@query("select n_nationkey, n_name, n_regionkey, n_nationkey * 2 as twice from nation")
def props_spread(db):
    return db.nation.select(lambda n: {**props(n), "twice": n.n_nationkey * 2})


@query("select o_orderkey, o_orderstatus from orders order by case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end, o_orderkey limit 50")
def enum_ranked(db):
    status = M.enum("P", "O", "F")
    return db.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "o_orderstatus": o.o_orderstatus}).order_by(lambda o: [enum_order(status.values, o.o_orderstatus), o.o_orderkey]).limit(50)


@query("select n_nationkey, n_name, n_regionkey, 'few' as violated from nation where n_nationkey >= 20")
def check_violations(db):
    def change(m):
        m["nation"].has_check("few", lambda n: lt(n.n_nationkey, 20))

    return violations(with_entities(db, change), "nation")


# Execution shapes.


@query("select 'list' as leg, count(*) as n from region union all select 'first', min(n_nationkey) from nation union all select 'count', count(*) from orders where o_totalprice > 400000")
def futures_q(db):
    rows, first, n = run_all([future(db.region), future_first_or_default(db.nation.select(lambda x: {"k": x.n_nationkey}).order_by(lambda x: x.k)), future_count(db.orders.where(lambda o: gt(o.o_totalprice, 400000)))])
    return values(db, [("list", len(rows)), ("first", first["k"]), ("count", n)], "leg string, n long")


@query("select r_regionkey as k, r_name as name from region")
def timed_and_traced(db):
    tracer = Tracer(expected=3600.0)
    rows = db.with_options(timeout=600, tracer=tracer).region.select(lambda r: {"k": r.r_regionkey, "name": r.r_name}).to_list()
    if set(tracer.phases) != {"list"}:
        raise AssertionError("the query was not timed")
    return values(db, [tuple(r) for r in rows], "k int, name string")


@query("select n_nationkey, n_name from nation where n_nationkey < 2 union all select r_regionkey, r_name from region where r_regionkey = 4")
def batch_results(db):
    b = QueryBatch()
    b.add_list(db.nation.where(lambda n: lt(n.n_nationkey, 2)).select(lambda n: {"k": n.n_nationkey, "name": n.n_name}))
    b.add_first_or_default(db.region.where(lambda r: eq(r.r_regionkey, 4)).select(lambda r: {"k": r.r_regionkey, "name": r.r_name}))
    rows, one = b.execute()
    return values(db, [(r["k"], r["name"]) for r in [*rows, one]], "n_nationkey int, n_name string")


@query("select region.* from region union all select * from (values (5, 'MU'), (6, 'LEMURIA'))")
def insert_numbered_state(db):
    return Writer(db, "region").insert_numbered([{"r_name": "MU"}, {"r_name": "LEMURIA"}], "r_regionkey").after


# Writes.


@query("select * from nation union all select 77, 'NATION_77', 2")
def insert_state(db):
    return Writer(db, "nation").insert({"n_nationkey": 77, "n_name": "NATION_77", "n_regionkey": 2}).after


@query("select n_nationkey, case when n_nationkey < 9 then r_name else n_name end as n_name, n_regionkey from nation join region on n_regionkey = r_regionkey")
def update_from_reference_state(db):
    return Writer(db, "nation").update(lambda n: lt(n.n_nationkey, 9), lambda n: {"n_name": n.region.r_name}).after


@query("select n_nationkey, case when n_nationkey >= 9 then n_name when n_regionkey = 0 then 'AFRICA' end as n_name, n_regionkey from (select n_nationkey, n_regionkey, case when n_nationkey < 9 then null else n_name end n_name from nation)")
def update_without_partner_state(db):
    """The reference is required, but only one region is left to refer to: the rows stay, with nulls."""
    own = Database(db.spark, db.model, lambda t: db.tables(t).where("r_regionkey = 0").withColumn("r_name", F.lit("AFRICA")) if t == "region" else db.tables(t))
    return Writer(own, "nation").update(lambda n: lt(n.n_nationkey, 9), lambda n: {"n_name": n.region.r_name}).after


@query("select n_nationkey, case when n_nationkey = 3 then 'THREE' else n_name end as n_name, n_regionkey from nation")
def update_unmapped_state(db):
    m = M.Model()
    m.entity("nation", "n_nationkey", n_nationkey=M.integer(), n_name=M.text())
    return Writer(Database(db.spark, m, db.tables), "nation").update(lambda n: eq(n.n_nationkey, 3), {"n_name": "THREE"}).after


@query("select nation.* from nation where n_nationkey not in (2, 3) and n_regionkey <> 4")
def delete_by_relation_state(db):
    return Writer(db, "nation").delete(lambda n: or_(in_array(n.n_nationkey, [2, 3]), eq(n.region.r_regionkey, 4))).after


@query("select supplier.* from supplier where not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49)")
def delete_with_children_state(db):
    return Writer(db, "supplier").delete(lambda s: exists(s.lines.where(lambda x: gt(x.l_quantity, 49)))).after


@query("select 'P' || k as name, n from (values (5, 1), (6, 2)) v(k, n)")
def insert_bulk_children_state(db):
    kids = {"nation": ("n_regionkey", [[{"n_nationkey": 300, "n_name": "A"}], [{"n_nationkey": 301, "n_name": "B"}, {"n_nationkey": 302, "n_name": "C"}]])}
    out = Writer(db, "region").insert_with_children([{"r_name": "P5"}, {"r_name": "P6"}], "r_regionkey", kids)
    both = out["region"].affected.join(out["nation"].affected, F.col("r_regionkey") == F.col("n_regionkey"))
    return both.groupBy(F.col("r_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("select 'regions' as leg, 6 as n union all select 'nations', 26 union all select 'made', 1 union all select 'kids.region', 1 union all select 'kids.nation', 2 union all select 'named', 2")
def batch_write_legs(db):
    b = MutationBatch(db)
    b.add_insert_bulk("regions", "region", [{"r_regionkey": 50 + i, "r_name": "R"} for i in range(6)])
    b.add_bulk_update("named", "supplier", [{"s_suppkey": 1, "s_name": "ONE"}, {"s_suppkey": 2, "s_name": "TWO"}])
    b.add_insert_bulk("made", "customer", [{"c_custkey": 10**9, "c_name": "X", "c_nationkey": 3}])
    b.add_insert_with_children("kids", "region", {"r_name": "Q"}, "r_regionkey", {"nation": ("n_regionkey", [[{"n_nationkey": 400, "n_name": "K"}, {"n_nationkey": 401, "n_name": "L"}]])})
    legs = b.execute()
    legs["nations"] = Writer(db, "nation").insert({"n_nationkey": 500}).after
    return counted(legs)


@query("select 'nation of ' || c_name as n_name, c_custkey + 1000 as n_nationkey from customer where c_custkey in (1, 2, 3)")
def batch_dependent_leg(db):
    b = MutationBatch(db)
    b.add_update_where_in("named", "customer", "c_custkey", [1, 2, 3], {"c_acctbal": 0})
    b.add_dependent_insert("made", "nation", "named", lambda c: {"n_nationkey": (c.c_custkey + 1000).cast("int"), "n_name": F.concat(F.lit("nation of "), c.c_name)})
    return b.execute()["made"].select("n_name", F.col("n_nationkey").cast("long").alias("n_nationkey"))


@query("select n_nationkey, case when n_nationkey in (1, 2) then 'X' when n_nationkey = 3 then 'NEW_3' else n_name end as n_name, case when n_nationkey = 4 then 0 else n_regionkey end as n_regionkey from nation where n_regionkey <> 4 union all select 90, 'NEW_90', 1")
def batch_combined_state(db):
    b = MutationBatch(db)
    b.add_delete_where_in("gone", "nation", "n_regionkey", [4])
    b.add_update_where_in("named", "nation", "n_nationkey", [1, 2], {"n_name": "X"})
    b.add_upsert_bulk("up", "nation", [{"n_nationkey": 3, "n_name": "NEW_3"}])
    b.add_insert_bulk("new", "nation", [{"n_nationkey": 90, "n_name": "NEW_90", "n_regionkey": 1}])
    b.add_delete_where_in("none", "nation", "n_nationkey", [])
    return b.states()["nation"].withColumn("n_regionkey", F.when(F.col("n_nationkey") == 4, 0).otherwise(F.col("n_regionkey")).cast("int"))


def shared_folder(db: Database) -> str:
    """A new folder under the cluster's shared one; without such, as in tests, a temporary one."""
    base = db.spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/weftline-store-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="weftline-store-")


@query("select n_nationkey from nation where n_regionkey <> 1")
def transaction_state(db):
    store = Store(db.spark, shared_folder(db))
    b = MutationBatch(db)
    b.add_delete_where_in("gone", "nation", "n_regionkey", [1])
    b.commit(store)
    return Store(db.spark, store.root)("nation").select("n_nationkey")


# Sources and schema.


@query("select r_regionkey, r_name from region union all select 9, 'NINE'")
def jdbc_round_trip(db):
    url = "jdbc:derby:memory:weftline;create=true"
    jdbc_sink(db.region.df(), url, "regions", "overwrite")
    jdbc_sink(values(db, [(9, "NINE")], "r_regionkey int, r_name string"), url, "regions", "append")
    read = jdbc(db.spark, url, "R_REGIONKEY", (0, 10), 3)("regions")
    return read.select(F.col("R_REGIONKEY").alias("r_regionkey"), F.col("R_NAME").alias("r_name"))


@query("select 'made' as t, 'id' as c, 'int' as kind, true as key union all select 'made', 'name', 'string', false")
def schema_introspection(db):
    m = M.Model()
    m.entity("made", "id", id=M.integer(), name=M.text())
    s = SchemaManager(db.spark, m)
    s.ensure_deleted()
    s.ensure_created()
    have = {f.name: f.dataType.simpleString() for f in db.spark.table("made").schema}
    rows = [("made", c["column"], have[c["column"]], c["key"]) for c in s.columns("made") if c["property"] in s.column_keys("made")]
    s.ensure_deleted()
    return values(db, rows, "t string, c string, kind string, key boolean")


@query("select 'create_table' as kind, 'fresh_t' as t, null as c union all select 'add_column', 'old_t', 'more' union all select 'drop_column', 'old_t', 'extra'")
def schema_analysis(db):
    db.spark.sql("drop table if exists old_t")
    db.spark.sql("drop table if exists fresh_t")
    db.spark.sql("create table old_t (id int, extra string) using parquet")
    m = M.Model()
    m.entity("fresh_t", "id", id=M.integer())
    m.entity("old_t", "id", id=M.integer(), more=M.text())
    found = [(o.kind, o.table, o.column) for o in SchemaManager(db.spark, m).analyze()]
    db.spark.sql("drop table old_t")
    return values(db, found, "kind string, t string, c string")


@query("select 'one' as name, true as applied union all select 'two', false")
def migration_status(db):
    db.spark.sql("drop table if exists migrations_q")
    run = Migrations(db.spark, "migrations_q")
    run.add("one", lambda s: s.sql("create table if not exists one_q (x int) using parquet"), lambda s: s.sql("drop table one_q"))
    run.up()
    run.add("two", lambda s: None)
    out = run.status()
    db.spark.sql("drop table one_q")
    db.spark.sql("drop table migrations_q")
    return values(db, out, "name string, applied boolean")


@query("select * from (values (5, 5, 6, 9)) v(a, b, c, d)")
def sequence_values(db):
    q = db.model.sequence("numbers", start=5)
    return values(db, [(q.next_value(), q.current_value(), q.take(3), q.next_value())], "a int, b int, c int, d int")


@query("select n_nationkey, n_name from nation where n_nationkey > 20")
def other_formats(db):
    """Written and read again as ORC, JSON and CSV; the same rows in each."""
    root, want = shared_folder(db), db.nation.where(lambda n: gt(n.n_nationkey, 20)).select(lambda n: {"n_nationkey": n.n_nationkey, "n_name": n.n_name}).df()
    out = None
    for kind in ("orc", "json", "csv"):
        want.write.format(kind).mode("overwrite").save(f"{root}/nation.{kind}")
        got = directory(db.spark, root, kind, **({"inferSchema": "true"} if kind == "csv" else {}))("nation")
        got = got.toDF("n_nationkey", "n_name") if kind == "csv" else got
        got = got.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
        out = got if out is None else out.intersect(got)
    return out


@query("select n_nationkey from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 9500) and n_name is not null and n_nationkey >= 3")
def not_exists_and_more(db):
    return db.nation.where(lambda n: and_(not_exists(n.suppliers.where(lambda s: gt(s.s_acctbal, 9500))), is_not_null(n.n_name), gte(n.n_nationkey, 3))).select(lambda n: {"n_nationkey": n.n_nationkey})
