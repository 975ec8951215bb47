"""Queries over the driver's tables, one or more for each operator, and the same in DuckDB's SQL.

The tables hold no nulls, so null rules are shown on keys made null by nullif. Dates go out as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.names import normalize_names
from weftline.operators import casting, groups, reslice, runs, verbs
from weftline.schema import Schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(func: Query) -> Query:
        QUERIES[name] = func
        if sql is not None:
            ORACLE_SQL[name] = sql
        return func

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and customers by customer; some keys are null on either side."""
    left = read(spark, sf_dir, "orders").selectExpr("nullif(o_custkey, 7) as k", "o_orderkey", "o_totalprice")
    right = read(spark, sf_dir, "customer").selectExpr("nullif(c_custkey, 11) as k", "c_name", "c_acctbal")
    return left, right


_SIDES = """with l as (select nullif(o_custkey, 7) as k, o_orderkey, o_totalprice from orders),
r as (select nullif(c_custkey, 11) as k, c_name, c_acctbal from customer) """


def _texts(df: DataFrame) -> DataFrame:
    """Integers as text: a null among integers looks different in different clients."""
    return df.select([F.col(c).cast("string").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def _joined(name: str, kind: str, sql: str) -> None:
    @register(name, _SIDES + f"select * replace (k::varchar as k, o_orderkey::varchar as o_orderkey) from ({sql})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(verbs.join(*_sides(spark, sf_dir), kind, ["k"]))


_BOTH = "select k, o_orderkey, o_totalprice, c_name, c_acctbal from l"
_joined("join_inner", "inner", f"{_BOTH} join r using (k)")
_joined("join_left_semi", "semi", "select * from l where exists (select 1 from r where r.k = l.k)")
_joined("join_left_anti", "anti", "select * from l where not exists (select 1 from r where r.k = l.k)")
_joined("join_left_outer", "left", f"{_BOTH} left join r using (k)")
_joined("join_right_outer", "right", f"{_BOTH} right join r using (k)")
_joined("join_full_outer", "full", f"{_BOTH} full join r using (k)")


@register("join_nan_keys", "select o_orderkey, k, n_name from (select o_orderkey, nullif(o_custkey % 40, 7)::double as k from orders) left join (select nullif(n_nationkey, 5)::double as k, n_name from nation) using (k)")
def join_nan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN keys meet nothing and come out null, whatever side they are on."""
    left = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "if(o_custkey % 40 = 7, double('NaN'), double(o_custkey % 40)) as k")
    right = read(spark, sf_dir, "nation").selectExpr("if(n_nationkey = 5, double('NaN'), double(n_nationkey)) as k", "n_name")
    return verbs.join(left, right, "left outer", ["k"]).select("o_orderkey", "k", "n_name")


@register("join_cross", "select * from nation cross join region")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbs.join(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"), "cross", [])


@register("join_suffixes", """select o_custkey, a.v as v_x, b.v as v_y from (select o_custkey, count(*) as v from orders group by 1) a
join (select o_custkey, count(distinct o_orderpriority) as v from orders group by 1) b using (o_custkey)""")  # fmt: skip
def join_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey")
    return verbs.join(orders.agg(F.count("*").alias("v")), orders.agg(F.countDistinct("o_orderpriority").alias("v")), "inner", ["o_custkey"])


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = read(spark, sf_dir, "customer").selectExpr("nullif(c_nationkey, 3) as n", "c_mktsegment as s")
    right = read(spark, sf_dir, "supplier").selectExpr("nullif(s_nationkey, 3) as x", "'BUILDING' as y")
    return left, right


_SEGMENTS = "with l as (select nullif(c_nationkey, 3) as n, c_mktsegment as s from customer), r as (select nullif(s_nationkey, 3) as n, 'BUILDING' as s from supplier) "


@register("union_all", _SEGMENTS + "select n::varchar as n, s from (select * from l union all select * from r)")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(verbs.union(*_segments(spark, sf_dir), unique=False))


@register("union_unique", _SEGMENTS + "select n::varchar as n, s from (select * from l union select * from r)")
def union_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(verbs.union(*_segments(spark, sf_dir), unique=True))


@register("intersect_keep", _SEGMENTS + "select n::varchar as n, s from (select * from l where exists (select 1 from r where l.n is not distinct from r.n and l.s is not distinct from r.s))")
def intersect_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(verbs.intersect(*_segments(spark, sf_dir), unique=False))


@register("intersect_unique", _SEGMENTS + "select n::varchar as n, s from (select * from l intersect select * from r)")
def intersect_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(verbs.intersect(*_segments(spark, sf_dir), unique=True))


@register("except_keep", _SEGMENTS + "select n::varchar as n, s from (select * from l where not exists (select 1 from r where l.n is not distinct from r.n and l.s is not distinct from r.s))")
def except_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(verbs.except_rows(*_segments(spark, sf_dir), unique=False))


@register("except_unique", _SEGMENTS + "select n::varchar as n, s from (select * from l except select * from r)")
def except_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(verbs.except_rows(*_segments(spark, sf_dir), unique=True))


@register("concat_by_name", "select n_nationkey::varchar as n_nationkey, n_name, null::varchar as r_regionkey, null as r_name from nation union all select null, null, r_regionkey::varchar, r_name from region")
def concat_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(verbs.concat(read(spark, sf_dir, "nation").drop("n_regionkey"), read(spark, sf_dir, "region")))


@register("distinct_rows", "select distinct nullif(o_orderpriority, '1-URGENT') as p, o_orderstatus from orders")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbs.drop_duplicates(read(spark, sf_dir, "orders").selectExpr("nullif(o_orderpriority, '1-URGENT') as p", "o_orderstatus"))


@register("fill_default", """select event_id, coalesce(nullif(event_type, 'click'), '') as t, case when event_id % 7 = 0 then 0.0 else value end as v,
strftime(case when event_id % 5 = 0 then timestamp '2000-01-01' else ts end, '%Y-%m-%d %H:%M:%S') as at, coalesce(nullif(event_id % 3 = 0, true), false) as b from events""")  # fmt: skip
def fill_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").selectExpr(
        "event_id", "nullif(event_type, 'click') as t", "if(event_id % 7 = 0, null, value) as v", "if(event_id % 5 = 0, null, ts) as at", "nullif(event_id % 3 = 0, true) as b"
    )
    return verbs.fill_default(events).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@register("rename_swap", "select n_nationkey as n_regionkey, n_name, n_regionkey as n_nationkey from nation")
def rename_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbs.rename(read(spark, sf_dir, "nation"), {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"})


@register("cast_positional", "select o_orderkey::varchar as k, trunc(o_totalprice)::int as price, strftime(o_orderdate, '%Y-%m-%d') as day, o_custkey::double as c from orders")
def cast_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_custkey")
    return casting.cast_frame(casting.cast_frame(orders, "k:str,price:int,day:date,c:double"), "k:str,price:int,day:str,c:double")


@register("alter_by_name", "select l_linenumber::bigint as l_linenumber, l_orderkey, l_returnflag, trunc(l_quantity)::int as l_quantity from lineitem")
def alter_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casting.alter(read(spark, sf_dir, "lineitem"), "l_linenumber:long,l_orderkey:long,l_returnflag:str,l_quantity:int")


@register("replace_types", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def replace_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casting.replace_types(read(spark, sf_dir, "nation"), [("int", "long")])


@register("zoned_times", "select event_id, strftime(timezone('UTC', timezone('America/New_York', ts)), '%Y-%m-%d %H:%M:%S') as utc, strftime(ts, '%Y-%m-%d %H:%M:%S') as wall from events")
def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wall clock keeps its reading when it gets a zone, and gets it back without."""
    events = read(spark, sf_dir, "events").select("event_id", "ts")
    zone = "timestamp(us,America/New_York)"
    zoned = casting.cast_frame(events.select("event_id", "ts", F.col("ts").alias("wall")), f"event_id:long,ts:{zone},wall:{zone}")
    back = casting.cast_frame(zoned, f"event_id:long,ts:{zone},wall:datetime")
    utc = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    return back.select("event_id", utc.alias("utc"), F.date_format("wall", "yyyy-MM-dd HH:mm:ss").alias("wall"))


@register("json_declared", "select event_id, (props->>'k')::bigint as k from events")
def json_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casting.parse_json_columns(read(spark, sf_dir, "events").select("event_id", "props"), "props:{k:long}").select("event_id", "props.k")


@register("json_inferred", "select event_id, (props->>'k')::bigint as k from events")
def json_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casting.parse_json_columns(read(spark, sf_dir, "events").select("event_id", "props"), ["props"]).select("event_id", "props.k")


@register("schema_transform", "select n_name, n_regionkey::bigint as n_regionkey from nation")
def schema_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return casting.alter(nation, Schema(nation).transform("*-n_nationkey+n_regionkey:long"))


@register("group_apply", "select event_id, nullif(event_type, 'click') as t, count(*) over (partition by nullif(event_type, 'click'), user_id % 50) as ct from events")
def group_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").selectExpr("event_id", "nullif(event_type, 'click') as t", "user_id % 50 as u")

    def size(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(ct=len(g))[["event_id", "t", "ct"]]

    return groups.group_apply(events, ["t", "u"], size, "event_id:long,t:str,ct:long")


@register("group_apply_whole", "select r_regionkey, r_name, count(*) over () as ct from region")
def group_apply_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_apply(read(spark, sf_dir, "region"), [], lambda g: g.assign(ct=len(g)), "r_regionkey:int,r_name:str,ct:long")


_RUNS = """with e as (select event_id, event_type, user_id, case when lag(event_id) over w is null or lag(event_type) over w is not distinct from event_type then 0 else 1 end as c
from events window w as (order by event_id)), n as (select *, sum(c) over (order by event_id)::bigint as run_no from e) """


@register("run_numbers", _RUNS + "select event_id, event_type, run_no from n")
def run_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over the whole table: blocks and a sum over their ends, no single-task window."""
    return runs.run_numbers(read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], ["event_id"])


@register("run_numbers_grouped", """with e as (select event_id, event_type, user_id, case when lag(event_id) over w is null or lag(event_type) over w is not distinct from event_type then 0 else 1 end as c
from events window w as (partition by user_id order by event_id)) select event_id, user_id, sum(c) over (partition by user_id order by event_id)::bigint as run_no from e""")  # fmt: skip
def run_numbers_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return runs.run_numbers(events, ["event_type"], ["event_id"], ["user_id"]).drop("event_type")


@register("row_slices", _RUNS + "select event_id, run_no, ((row_number() over (partition by run_no order by event_id) - 1) // 2)::bigint as slice_no from n")
def row_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    return runs.row_slices(events, ["event_type"], ["event_id"], 2).drop("event_type")


@register("size_slices", """with recursive e as (select user_id, event_id, length(props) as s, row_number() over (partition by user_id order by event_id) as r from events),
f as (select user_id, event_id, r, s as total, 0::bigint as slice_no from e where r = 1
union all select e.user_id, e.event_id, e.r, case when f.total + e.s > 20 then e.s else f.total + e.s end, case when f.total + e.s > 20 then f.slice_no + 1 else f.slice_no end
from f join e on e.user_id = f.user_id and e.r = f.r + 1) select user_id, event_id, slice_no from f""")  # fmt: skip
def size_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "props")
    return runs.size_slices(events, ["user_id"], ["event_id"], F.length("props"), 20).drop("props")


@register("reslice_rows", "select sum(l_linenumber)::bigint as total, count(*)::bigint as n, true as bounded from lineitem")
def reslice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 1000 rows; all rows come through."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": [batch.num_rows], "total": [sum(batch.column(0).to_pylist())]}, schema=pa.schema([("n", pa.int64()), ("total", pa.int64())]))

    sizes = reslice.map_batches(read(spark, sf_dir, "lineitem").select("l_linenumber"), measure, "n:long,total:long", row_limit=1000)
    return sizes.agg(F.sum("total").alias("total"), F.sum("n").alias("n"), (F.max("n") <= 1000).alias("bounded"))


@register("merge_by_key", "select l_suppkey, count(*)::bigint as n from lineitem group by all")
def merge_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier has some hundred lines at any size of the table."""
    items = read(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey as long) as l_suppkey")

    def count(rows: pa.Table) -> pa.Table:
        return rows.slice(0, 1).append_column("n", pa.array([rows.num_rows], pa.int64()))

    return reslice.merge_by_key(items, ["l_suppkey"], count, "l_suppkey:long,n:long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a key's batches: its key and the number of its rows."""
    first, n = None, 0
    for b in batches:
        first, n = first or b.slice(0, 1), n + b.num_rows
    yield pa.RecordBatch.from_arrays([*first.columns, pa.array([n], pa.int64())], names=[*first.schema.names, "n"])


@register("batches_null_keys", "select case when user_id % 40 < 2 then null else user_id % 40 end::double as k, count(*)::bigint as n from events group by 1")
def batches_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and NaN keys are one group."""
    keys = "case user_id % 40 when 0 then null when 1 then double('NaN') else double(user_id % 40) end as k"
    return reslice.batches_by_key(read(spark, sf_dir, "events").selectExpr(keys), ["k"], _counted, "k:double,n:long")


@register("merge_null_keys", "select case when user_id % 400 < 2 then null else user_id % 400 end::double as k, count(*)::bigint as n from events group by 1")
def merge_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = "case user_id % 400 when 0 then null when 1 then double('NaN') else double(user_id % 400) end as k"

    def count(rows: pa.Table) -> pa.Table:
        return rows.slice(0, 1).append_column("n", pa.array([rows.num_rows], pa.int64()))

    return reslice.merge_by_key(read(spark, sf_dir, "events").selectExpr(keys), ["k"], count, "k:double,n:long")


@register("batches_by_key", "select o_custkey, count(*)::bigint as n from orders group by all")
def batches_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's batches one after another, never together in memory."""
    return reslice.batches_by_key(read(spark, sf_dir, "orders").selectExpr("cast(o_custkey as long) as o_custkey"), ["o_custkey"], _counted, "o_custkey:long,n:long")


# the namespace's bytes and the name, hashed; then the version's and the variant's bits
_UUID5 = """with h as (select n_name, sha1('\\x6B\\xA7\\xB8\\x10\\x9D\\xAD\\x11\\xD1\\x80\\xB4\\x00\\xC0\\x4F\\xD4\\x30\\xC8'::blob || encode(n_name)) as s from nation)
select n_name, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', s[17]) - 1) % 4, 1) || s[18:20] || '-' || s[21:32] as u from h"""


@register("uuid5_column", _UUID5)
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from weftline.functions.hashing import uuid5_column

    return read(spark, sf_dir, "nation").select("n_name", uuid5_column(uuid.NAMESPACE_DNS, F.col("n_name")).alias("u"))


@register("alter_unsafe", """select event_id, ((user_id + 128) % 256 - 128)::bigint as user_id, (event_id % 65536)::bigint as low from events""")
def alter_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers cut to a byte and to an unsigned short."""
    events = read(spark, sf_dir, "events").selectExpr("event_id", "cast(user_id as long) as user_id", "cast(event_id as long) as low")
    cut = casting.alter(events, "event_id:long,user_id:byte,low:ushort", safe=False)
    return cut.selectExpr("event_id", "cast(user_id as long) as user_id", "cast(low as long) as low")


@register("row_slices_whole", "select event_id, ((row_number() over (order by event_id) - 1) // 1000)::bigint as slice_no from events")
def row_slices_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table is one run."""
    return runs.row_slices(read(spark, sf_dir, "events").select("event_id"), [], ["event_id"], 1000).select("event_id", "slice_no")


_TEXTS = "cast(event_id as string) as k", "if(event_id % 2 = 0, 'TRUE', '0') as b", "cast(value as string) as v", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as at", "date_format(ts, 'yyyy-MM-dd') as d"


@register("cast_texts", """select event_id as k, event_id % 2 = 0 as b, value as v, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as at, strftime(ts, '%Y-%m-%d') as d from events""")
def cast_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of text as numbers, truth values, times and days."""
    made = casting.alter(read(spark, sf_dir, "events").selectExpr(*_TEXTS), "k:long,b:bool,v:double,at:datetime,d:date")
    return made.withColumns({"at": F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "d": F.date_format("d", "yyyy-MM-dd")})


@register("rows_converted", """select event_id as k, case when event_id % 5 <> 0 then event_id % 3 = 0 end as b, case when event_id % 7 <> 0 then value end as v,
strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as at, strftime(ts, '%Y-%m-%d') as d, (props->>'k')::bigint + 1 as p from events""")  # fmt: skip
def rows_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of text through the converters of untyped values: yes and no, NaN as text, ISO times, JSON."""
    texts = (
        "cast(event_id as string) as k", "case when event_id % 5 = 0 then null when event_id % 3 = 0 then 'Yes' else 'no' end as b", "if(event_id % 7 = 0, 'nan', cast(value as string)) as v",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") as at", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as d", "props as p",
    )

    schema = pa.schema([("k", pa.int64()), ("b", pa.bool_()), ("v", pa.float64()), ("at", pa.string()), ("d", pa.string()), ("p", pa.int64())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = casting.apply_schema("k:long,b:bool,v:double,at:datetime,d:date,p:{k:long}", (list(r.values()) for r in batch.to_pylist()), deep=True)
            made = [(k, b, v, f"{at:%Y-%m-%d %H:%M:%S}", d.isoformat(), p["k"] + 1) for k, b, v, at, d, p in rows]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in made], schema=schema)

    return read(spark, sf_dir, "events").selectExpr(*texts).mapInArrow(convert, "k long, b boolean, v double, at string, d string, p long")


@register("replace_nested_types", "select n_nationkey::bigint as k, n_regionkey::bigint as r, 'array<struct<k:bigint,r:bigint>>' as type from nation")
def replace_nested_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers inside lists of structs become long ones."""
    nested = read(spark, sf_dir, "nation").selectExpr("array(struct(cast(n_nationkey as int) as k, cast(n_regionkey as int) as r)) as a")
    made = casting.replace_types(nested, [("int", "long")])
    return made.selectExpr("a[0].k as k", "a[0].r as r", "typeof(a) as type")


@register("names_normalized", 'select n_nationkey::bigint as "_1_key", n_name as a_name, n_name as a_name_1, n_nationkey::bigint as _1 from nation')
def names_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that need quotes, renamed at once."""
    odd = read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as long) as `1 key`", "n_name as a_name", "n_name as `a name`", "cast(n_nationkey as long) as `__`")
    return verbs.rename(odd, normalize_names(odd.columns))


@register("indicator", "select r_name, 7 as found from region")
def indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbs.with_indicator(read(spark, sf_dir, "region").select("r_name"), "found", 7)


@register("slices_by_test", "select user_id, ((count(*) + 2) // 3)::bigint as slices, ((count(*) + 2) // 3)::bigint as firsts from events group by user_id")
def slices_by_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of three rows of each user; what is not read of a slice is passed over."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = reslice.Peekable(x for b in batches for x in b.column(0).to_pylist())
        user = ids.peek()
        firsts = [next(own) for own in reslice.slices(ids, lambda n, item, last: n == 3)]
        yield pa.RecordBatch.from_pydict({"user_id": [user], "slices": [len(firsts)], "firsts": [sum(f == user for f in firsts)]})

    return reslice.batches_by_key(read(spark, sf_dir, "events").select("user_id"), ["user_id"], count, "user_id:long,slices:long,firsts:long")


@register("slices_by_rows_and_size", "select user_id, ((count(*) + 1) // 2)::bigint as slices from events group by user_id")
def slices_by_rows_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of one size fill a slice before five rows do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = reslice.Peekable(x for b in batches for x in b.column(0).to_pylist())
        user = ids.peek()
        yield pa.RecordBatch.from_pydict({"user_id": [user], "slices": [sum(1 for _ in reslice.size_row_slices(ids, lambda _: 10, row_limit=5, size_limit=29))]})

    return reslice.batches_by_key(read(spark, sf_dir, "events").select("user_id"), ["user_id"], count, "user_id:long,slices:long")


@register("flagship", "select c_nationkey, count(*)::bigint as customers from customer where c_nationkey in (select s_nationkey from supplier) group by c_nationkey")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation that has a supplier."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return verbs.join(customers, suppliers, "left semi", ["k"]).groupBy(F.col("k").alias("c_nationkey")).agg(F.count("*").alias("customers"))
