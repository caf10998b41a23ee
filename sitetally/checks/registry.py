"""Registered queries and the SQL DuckDB answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import duckdb_sql, spark_sql, spark_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return spark_view(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        return spark_sql(self.spark, self.sf_dir, text)


# -- DuckDB fragments -----------------------------------------------------------
def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def norm_k2(x: str) -> str:
    return f"lower(trim(regexp_replace(strip_accents({x}), '\\s+', ' ', 'g')))"


def sha(x: str, n: int = 16) -> str:
    return f"substr(sha1({x}), 1, {n})"


def key(room: str, material: str) -> str:
    return f"concat('v1:', {norm(room)}, '::', {norm(material)})"


def ident(prefix: str, *parts: str) -> str:
    return f"concat('{prefix}', {sha('concat_ws(chr(124), ' + ', '.join(norm(p) for p in parts) + ')')})"


def scope(niveau="niveau", occupation="occupation", numero="numero") -> str:
    return ident("excel-scope-", niveau, occupation, numero)


def room(niveau="niveau", occupation="occupation", piece="piece", numero="numero") -> str:
    return ident("excel-room-", niveau, occupation, piece, numero)


def new_room(x: str) -> str:
    return f"concat('pdf-room-', {sha(f'coalesce(nullif({norm(x)}, chr(0)), chr(0))')})".replace(
        "chr(0)), chr(0)", "''), 'sans-nom'")


def room_label(n="niveau", o="occupation", p="piece", u="numero") -> str:
    return f"concat({o}, ' · ', {p}, ' · n° ', {u}, ' (', {n}, ')')"


def scope_label(n="niveau", o="occupation", u="numero") -> str:
    return f"concat({o}, ' · lot n° ', {u}, ' (', {n}, ')')"


def broken(m: str) -> str:
    return f"(upper(trim({m})) like '#REF%' or upper(trim({m})) in ('#N/A', '#VALUE!', '#NAME?', '#DIV/0!'))"


def greedy(rows: str, keys: str, order: str, carried: str, clash: str) -> str:
    """Recursive CTE ``kept``: rows of a group in order, each added to the list of kept ones unless ``clash`` holds for one of those.

    ``carried`` are the fields of a list entry ``e``; ``r`` is the row at hand.
    """
    entry = ", ".join(f"{c} := r.{c}" for c in carried.split())
    same = " and ".join(f"r.{k} = s.{k}" for k in keys.split(", "))
    names = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""nr as (select *, row_number() over (partition by {keys} order by {order}) as k from ({rows})),
        scan as (select {keys}, k, [struct_pack({entry})] as kept from nr r where k = 1
          union all select {names}, r.k, case when len(list_filter(s.kept, lambda e: {clash})) > 0 then s.kept else list_append(s.kept, struct_pack({entry})) end
          from scan s join nr r on {same} and r.k = s.k + 1),
        kept as (select {keys}, unnest(kept) as e from (select * from scan qualify row_number() over (partition by {keys} order by k desc) = 1))"""


def block(a: str, b: str) -> str:
    """Longest common block of two texts as (k letters, -i, the first place in a); the first in a wins. Null without one."""
    return (f"list_reverse_sort(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(list_filter(range(1, length({a}) - i + 2), "
            f"lambda k: instr({b}, substr({a}, i, k)) > 0), lambda k: struct_pack(k := k, i := -i)))))[1]")


def ratios(pairs: str) -> str:
    """Recursive CTE ``rt(a, b, ratio)``: twice the letters in matched blocks, the longest block first, then left and right of it."""
    return f"""ps as (select distinct a, b from ({pairs}) where a <> '' and b <> ''),
        sg as (select a, b, a as sa, b as sb, {block('a', 'b')} as t from ps
          union all select a, b, sa, sb, {block('sa', 'sb')} as t from (
            select a, b, unnest([substr(sa, 1, -t.i - 1), substr(sa, t.k - t.i)]) as sa,
              unnest([substr(sb, 1, instr(sb, substr(sa, -t.i, t.k)) - 1), substr(sb, instr(sb, substr(sa, -t.i, t.k)) + t.k)]) as sb
            from sg where t is not null) where sa <> '' and sb <> ''),
        rt as (select a, b, coalesce(sum(2 * t.k), 0) / (length(a) + length(b)) as ratio from sg group by a, b)"""


ORACLE_VIEWS = {
    "b_lst": f"select *, {scope()} as scope_id, {room()} as room_id, {room_label()} as room_label from {{b_listing}}",
    "b_ident": f"""select job_id, niveau, occupation, piece, numero, scope_id, room_id, room_label, {norm('piece')} as piece_norm,
                   {norm('room_label')} as label_norm, min(row_idx) as first_seen from {{b_lst}} group by all""",
    "b_sc": f"select distinct job_id, scope_id, niveau, occupation, numero, {scope_label()} as scope_label from {{b_ident}}",
}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql, ORACLE_VIEWS)
        return build
    return register
