"""Queries that run schemas, names, options, converters, files and plugins over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.collections import Options, load_json
from weftline.functions import names, scalars
from weftline.functions.arrow import batch_to_dicts, batch_to_pandas
from weftline.operators import casting, groups, verbs
from weftline.plans.catalogue import read, register
from weftline.plugins.dispatch import conditional_broadcaster, conditional_dispatcher, run_once
from weftline.plugins.methods import extensible_class, extension_method
from weftline.plugins.signatures import FunctionWrapper, Param, function_wrapper
from weftline.schema import Schema, schemas_equal
from weftline.sources.files import Files, abs_path, join

#: Tables whose schemas are compared.
TABLES = ("nation", "region", "customer", "orders", "events", "labels", "conversations")
_KINDS = "case column_type when 'INTEGER' then 'int' when 'BIGINT' then 'long' when 'VARCHAR' then 'str' when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'datetime' end"
_DESCRIBED = " union all ".join(f"select '{t}' as t, column_name as c, {_KINDS} as kind from (describe {t})" for t in TABLES)


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of what the driver found."""
    return spark.createDataFrame(rows, Schema(schema).spark)


def _mapped_batches(df: DataFrame, rows: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """A function of the rows of each batch."""
    kinds = Schema(schema)
    arrow = kinds.arrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(list(rows(batch_to_dicts(batch))), schema=arrow)

    return df.mapInArrow(run, kinds.spark)


def _mapped(df: DataFrame, row: Callable[[dict], dict], schema: str) -> DataFrame:
    """A function of each row, batch by batch."""
    return _mapped_batches(df, lambda batch: map(row, batch), schema)


@register("schema_printed", _DESCRIBED)
def schema_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of tables with the types that a schema prints, read back from the printed text."""
    printed = {t: repr(Schema(read(spark, sf_dir, t))) for t in TABLES}
    return _listed(spark, [(t, c, str(kind)) for t, text in printed.items() for c, kind in Schema(text).items()], "t:str,c:str,kind:str")


@register("schemas_alike", f"""with d as ({_DESCRIBED}), s as (select t, list(kind order by c) as kinds, list(c order by c) as cs from d group by t)
select a.t as a, b.t as b, a.cs = b.cs and a.kinds = b.kinds as same, a.t = 'nation' and b.t = 'nation' as like_longs from s a cross join s b""")  # fmt: skip
def schemas_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tables of one schema, and those like nation's with whole numbers of any width."""
    found = {t: Schema(read(spark, sf_dir, t)) for t in TABLES}
    longs = Schema("n_nationkey:long,n_name:str,n_regionkey:long")

    def like(t: str) -> bool:
        return schemas_equal(found[t], longs, ignore=[("int", "long")])

    return _listed(spark, [(a, b, found[a] == found[b], like(a) and like(b)) for a in TABLES for b in TABLES], "a:str,b:str,same:bool,like_longs:bool")


def _cut(name: str, chosen: Callable[[Schema], Schema], sql: str) -> None:
    """Orders cut or cast to a schema that is made from their own."""

    @register(name, f"select {sql} from orders")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = read(spark, sf_dir, "orders")
        return casting.alter(orders, chosen(Schema(orders).exclude(["o_orderdate", "nothing"])))


_ALL = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_cut("schema_exclude", lambda s: s, _ALL)
_cut("schema_extract", lambda s: s.extract(["o_totalprice", "o_orderkey"]), "o_totalprice, o_orderkey")
_cut("schema_remove", lambda s: s - "o_orderkey:long,o_custkey:long", "o_orderstatus, o_totalprice, o_orderpriority")
_cut("schema_intersect", lambda s: s.intersect("x:int,o_totalprice:double,o_custkey:str,o_orderkey:long", use_other_order=True), "o_totalprice, o_orderkey")
_cut("schema_alter", lambda s: s.alter("o_custkey:double,o_totalprice:str").exclude(["o_totalprice"]), "o_orderkey, o_custkey::double as o_custkey, o_orderstatus, o_orderpriority")
_cut("schema_append", lambda s: (Schema().append(s.extract(["o_orderkey"])) + "o_custkey:double").assert_not_empty(), "o_orderkey, o_custkey::double as o_custkey")


@register("schema_union", "select n_nationkey::varchar as k, n_name, null::varchar as r_name from nation union all select null, null, r_name from region")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty frame of two schemas' union, and the rows of both."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    empty = Schema(nation).union(Schema(region)).empty(spark)
    return verbs.concat(empty, nation, region).selectExpr("cast(n_nationkey as string) as k", "n_name", "r_name")


@register("options_parsed", """select event_id, event_id * 1024 as size, (event_id % 50) * 86400 + user_id * 60 as span, event_id % 2 = 0 as flag, user_id as whole,
strftime(ts + interval 1 minute, '%Y-%m-%d %H:%M') as later from events""")  # fmt: skip
def options_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, spans, truth values, numbers and times written as options are."""

    def parsed(r: dict) -> dict:
        options = Options({"size": f"{r['event_id']}kb", "span": f"{r['event_id'] % 50}d{r['user_id']}m", "flag": "no" if r["event_id"] % 2 else "YES", "whole": str(r["user_id"]), "at": r["at"]})
        later = scalars.as_type(options.get_or_throw("at", str), dt.datetime) + options.get("step", dt.timedelta(minutes=1))
        return {
            "event_id": r["event_id"], "size": scalars.to_size(options["size"]), "span": int(scalars.to_timedelta(options["span"]).total_seconds()),
            "flag": options.get("flag", False), "whole": options.get("whole", 0), "later": f"{later:%Y-%m-%d %H:%M}",
        }

    events = read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as at")
    return _mapped(events, parsed, "event_id:long,size:long,span:long,flag:bool,whole:long,later:str")


@register("names_quoted", """select c_custkey, '`' || replace(c_name || '`,' || c_mktsegment, '`', '``') || '`' as quoted, c_name || '`,' || c_mktsegment as first,
c_mktsegment as second, 'x;' || c_custkey || ';`,`' as replaced from customer""")  # fmt: skip
def names_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with quotes and delimiters, quoted, listed and split again."""

    def row(r: dict) -> dict:
        quoted = names.quote_name(f"{r['c_name']}`,{r['c_mktsegment']}")
        first, second = names.split_names(f"{quoted}, {names.quote_name(r['c_mktsegment'])}")
        return {"c_custkey": r["c_custkey"], "quoted": quoted, "first": first, "second": second, "replaced": names.replace_unquoted(f"x,{r['c_custkey']},`,`", ",", ";")}

    return _mapped(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), row, "c_custkey:long,quoted:str,first:str,second:str,replaced:str")


@register("rows_nested", "select event_id, (props->>'k')::bigint as k, (props->>'k')::bigint + event_id as listed, event_type as keyed, event_id % 2 = 0 as whole from events")
def rows_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs, lists and maps from JSON; keys that a struct lacks are dropped, a repeated key is refused. Types are parsed once a batch."""

    def values(r: dict) -> list:
        return [r["props"], f'[{r["event_id"]}, "{load_json(r["props"])["k"]}"]', f'{{"kind": "{r["event_type"]}"}}', r["event_id"] % 2 == 0]

    def row(r: dict, struct: dict, listed: list, mapped: list, whole: str) -> dict:
        try:
            load_json('{"k": 1, "k": 2}')
        except KeyError:
            return {"event_id": r["event_id"], "k": struct["k"], "listed": sum(listed), "keyed": dict(mapped)["kind"], "whole": whole == "True"}
        raise AssertionError("a repeated key passed")

    def nested(rows: list[dict]) -> Iterator[dict]:
        made = casting.apply_schema("s:{k:long},l:[long],m:<str,str>,t:str", map(values, rows), deep=True)
        return (row(r, *converted) for r, converted in zip(rows, made, strict=True))

    return _mapped_batches(read(spark, sf_dir, "events").select("event_id", "event_type", "props"), nested, "event_id:long,k:long,listed:long,keyed:str,whole:bool")


@register("rows_listed", "select n_name, n_nationkey::bigint as n_nationkey from nation")
def rows_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lists, of chosen columns in a chosen order."""
    return _listed(spark, [tuple(r) for r in casting.rows_of(read(spark, sf_dir, "nation"), ["n_name", "n_nationkey"])], "n_name:str,n_nationkey:long")


@register("arrow_frames", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey + 1::bigint as above from nation")
def arrow_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow batches as pandas frames with nullable types, and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch_to_pandas(batch, use_extension_types=True)
            assert isinstance(frame.dtypes["above"], pd.Int64Dtype)
            yield pa.RecordBatch.from_pandas(frame.assign(above=frame["above"] + 1), schema=batch.schema)

    nation = read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as long) as n_nationkey", "n_name", "cast(n_regionkey as long) as above")
    return nation.mapInArrow(run, Schema(nation).spark)


@register("empty_frames", "select 'nation' as t, (select count(*) = 0 from nation) as empty union all select 'none', (select count(*) = 0 from nation where n_nationkey < 0)")
def empty_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return _listed(spark, [("nation", verbs.is_empty(nation)), ("none", verbs.is_empty(nation.where("n_nationkey < 0")))], "t:str,empty:bool")


@register("files_found", " union all ".join(f"select '{t}.parquet' as name, true as there, true as file, 'PAR1' as begins" for t in ("nation", "region")))
def files_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files by a pattern, and how they begin."""
    files, folder = Files(spark), abs_path(sf_dir)
    found = [p for pattern in ("natio?.parquet", "reg*.parquet") for p in files.glob(join(folder, pattern))]
    return _listed(spark, [(p.rsplit("/", 1)[1], files.exists(p), files.isfile(p) and not files.isdir(p), files.read_bytes(p)[:4].decode()) for p in found], "name:str,there:bool,file:bool,begins:str")


@conditional_dispatcher
def _key_of(df: DataFrame) -> str:
    return "none"


@_key_of.candidate(lambda df: "n_name" in df.columns)
def _key_of_nation(df: DataFrame) -> str:
    return "n_nationkey"


@_key_of.candidate(lambda df: df.columns[1] == "r_name", priority=2.0)
def _key_of_region(df: DataFrame) -> str:
    return "r_regionkey"


@conditional_broadcaster
def _facts(df: DataFrame) -> str:
    return "nothing"


@_facts.candidate(lambda df: len(df.columns) > 1, priority=2.0)
def _wide(df: DataFrame) -> str:
    return "wide"


@_facts.candidate(lambda df: df.columns[9] != "")
def _very_wide(df: DataFrame) -> str:
    """Its condition raises for a frame of fewer columns, so it does not match."""
    return "very wide"


@_facts.candidate(lambda df: "r_name" in df.columns)
def _named(df: DataFrame) -> str:
    return "named"


@register("dispatched", """select 'nation' as t, 'n_nationkey' as key, 'wide' as facts, count(*) as n from nation union all select 'region', 'r_regionkey', 'wide,named', count(*) from region
union all select 'text', 'none', 'nothing', count(*) from nation""")  # fmt: skip
def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions chosen by what a frame is like: the first that fits, or all."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    frames = {"nation": nation, "region": region, "text": nation.selectExpr("upper(n_name) as x")}
    return _listed(spark, [(t, _key_of(df), ",".join(_facts(df)), df.count()) for t, df in frames.items()], "t:str,key:str,facts:str,n:long")


@function_wrapper(None)
class GroupFunction(FunctionWrapper):
    """A function of a pandas frame, and perhaps of one more value, to a pandas frame."""

    def __init__(self, func: Callable):
        super().__init__(func, "^px?$", "^p$")


@GroupFunction.annotated_param(pd.DataFrame, "p")
class _PandasParam(Param):
    pass


def _counted(group: pd.DataFrame) -> pd.DataFrame:
    return group.head(1).assign(n=len(group))


def _unlike(group: list) -> pd.DataFrame:
    return pd.DataFrame(group)


@register("checked_function", "select event_type, user_id % 50 as u, count(*) as n, 'p' || 'p' as code, true as refused from events group by 1, 2")
def checked_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of groups that is checked by its annotations before it is sent; one of another form is refused."""
    func = GroupFunction(_counted)
    try:
        refused = not GroupFunction(_unlike)
    except TypeError:
        refused = True
    code = func.input_code + func.output_code
    events = read(spark, sf_dir, "events").selectExpr("event_type", "user_id % 50 as u")
    made = groups.group_apply(events, ["event_type", "u"], _counted, "event_type:str,u:long,n:long")
    return made.selectExpr("event_type", "u", "n", f"'{code}' as code", f"{str(refused).lower()} as refused")


@extensible_class
class Names:
    """A table's column of names; more methods are attached."""

    def __init__(self, df: DataFrame, column: str):
        self.df, self.column = df, column


@extension_method
def lengths(names: Names) -> DataFrame:
    return names.df.selectExpr(f"`{names.column}` as name", f"cast(length(`{names.column}`) as long) as n")


@register("extension_methods", "select n_name as name, length(n_name) as n from nation")
def extension_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Names(read(spark, sf_dir, "nation"), "n_name").lengths()


@register("once_a_key", "select event_id, event_type || '-str' as made, (event_id % 2)::varchar || case when event_id % 3 = 0 then '.0-float' else '-int' end as kept from events")
def once_a_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each worker keeps what it has made of a value; equal values of two types are two keys."""

    @run_once
    def made(x: object) -> str:
        return f"{x}-{type(x).__name__}"

    def row(r: dict) -> dict:
        k = r["event_id"] % 2
        return {"event_id": r["event_id"], "made": made(r["event_type"]), "kept": made(k if r["event_id"] % 3 else float(k))}

    return _mapped(read(spark, sf_dir, "events").select("event_id", "event_type"), row, "event_id:long,made:str,kept:str")
