"""Tables over a data folder: the eight relational tables with their full column sets, keys and NOT NULL facts."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from gritstone.session import shared_dir

MONEY = "DECIMAL(15,2)"
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Primary keys of the relational model; all key columns are NOT NULL. The delivered lineitem repeats
# (l_orderkey, l_linenumber), so that pair is declared but never used as proof of uniqueness.
KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "partsupp": ("ps_partkey", "ps_suppkey"),
    "lineitem": ("l_orderkey", "l_linenumber"),
}
NOT_NULL = {t: set(k) for t, k in KEYS.items()} | {
    "orders": {"o_orderkey", "o_custkey"},
    "lineitem": {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"},
    "customer": {"c_custkey", "c_nationkey"},
    "supplier": {"s_suppkey", "s_nationkey"},
    "nation": {"n_nationkey", "n_regionkey"},
}


# Which column of another table a column refers to.
REFERENCES = {
    "nation": (("n_regionkey", "region", "r_regionkey"),),
    "supplier": (("s_nationkey", "nation", "n_nationkey"),),
    "customer": (("c_nationkey", "nation", "n_nationkey"),),
    "partsupp": (("ps_partkey", "part", "p_partkey"), ("ps_suppkey", "supplier", "s_suppkey")),
    "orders": (("o_custkey", "customer", "c_custkey"),),
    "lineitem": (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")),
}

# The delivered columns. Known types spare a look at the files' footers for every view.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def _pick(number: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {number} {arms} ELSE '{values[-1]}' END"


#: Each table's columns as SQL that Spark and DuckDB read alike. Columns that the data lack are derived from keys.
VIEWS = {
    "region": "SELECT r_regionkey, r_name FROM region",
    "nation": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "supplier": f"""SELECT s_suppkey, s_name, 'addr ' || CAST(s_suppkey AS STRING) AS s_address, s_nationkey,
      'ph ' || CAST(s_suppkey AS STRING) AS s_phone, CAST(s_acctbal AS {MONEY}) AS s_acctbal,
      CASE WHEN s_suppkey % 10 = 3 THEN 'x Customer y Complaints' ELSE 'ok' END AS s_comment FROM supplier""",
    "customer": f"""SELECT c_custkey, c_name, 'addr ' || CAST(c_custkey AS STRING) AS c_address, c_nationkey,
      CAST(10 + c_nationkey AS STRING) || '-' || CAST(c_custkey AS STRING) AS c_phone,
      CAST(c_acctbal AS {MONEY}) AS c_acctbal, c_mktsegment, 'c' AS c_comment FROM customer""",
    "part": f"""SELECT p_partkey, p_name, 'Mfgr#' || CAST(p_partkey % 5 + 1 AS STRING) AS p_mfgr, p_brand, p_type, p_size,
      {_pick("p_partkey % 6", ["SM CASE", "SM BOX", "MED BAG", "MED BOX", "LG CASE", "LG PACK"])} AS p_container,
      CAST(p_retailprice AS {MONEY}) AS p_retailprice FROM part""",
    "orders": f"""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS {MONEY}) AS o_totalprice,
      CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority,
      'Clerk#' || lpad(CAST(o_orderkey % 100 + 1 AS STRING), 9, '0') AS o_clerk, 0 AS o_shippriority,
      {_pick("o_orderkey % 3", ["special requests", "final deposits", "plain"])} AS o_comment FROM orders""",
    "lineitem": f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS {MONEY}) AS l_quantity,
      CAST(l_extendedprice AS {MONEY}) AS l_extendedprice, CAST(l_discount AS {MONEY}) AS l_discount,
      CAST(l_tax AS {MONEY}) AS l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate,
      CAST(l_shipdate AS DATE) + CAST((l_orderkey + l_partkey) % 40 - 10 AS INT) AS l_commitdate,
      CAST(l_shipdate AS DATE) + CAST((l_partkey + l_linenumber) % 30 + 1 AS INT) AS l_receiptdate,
      {_pick("l_partkey % 2", ["DELIVER IN PERSON", "NONE"])} AS l_shipinstruct,
      {_pick("(l_orderkey + l_linenumber) % 7", ["REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB"])} AS l_shipmode
      FROM lineitem""",
    "partsupp": """SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
      CAST((l_partkey * 7 + l_suppkey * 13) % 200 + 1 AS BIGINT) AS ps_availqty,
      CAST(((l_partkey * 31 + l_suppkey * 17) % 100000) / 100.0 + 1 AS DECIMAL(15,2)) AS ps_supplycost FROM lineitem""",
}


def tables_in(sql: str) -> list[str]:
    """The views that a text may use: those whose name it holds as a word."""
    words = set(re.findall(r"\w+", sql.lower()))
    return [n for n in VIEWS if n in words]


def with_views(sql: str, names: list[str] | tuple[str, ...] = tuple(VIEWS)) -> str:
    """``sql`` over the full column sets, as one statement: common table expressions that shadow the base tables."""
    shadow = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names if n != "partsupp")
    if "partsupp" in names:
        shadow = f"partsupp AS ({VIEWS['partsupp']}),\n{shadow}"
    head = sql.lstrip()
    if head[:5].upper() == "WITH ":
        return f"WITH {shadow},\n{head[5:]}"
    return f"WITH {shadow}\n{head}"


@dataclass(frozen=True)
class TableInfo:
    """What rules may rely on for one table."""

    name: str
    columns: dict[str, bool]  # column -> nullable
    keys: tuple[tuple[str, ...], ...] = ()
    rows: int | None = None
    references: tuple[tuple[str, str, str], ...] = ()  # (column, table, its column)


@dataclass(frozen=True)
class SchemaContext:
    """The tables that a query may use, with a hash that changes when any fact does."""

    tables: dict[str, TableInfo] = field(default_factory=dict)

    @property
    def snapshot_hash(self) -> str:
        told = "\n".join(f"{t.name}|{sorted(t.columns.items())}|{t.keys}|{t.rows}|{t.references}" for _, t in sorted(self.tables.items()))
        return sha256(told.encode()).hexdigest()

    def columns(self, table: str) -> dict[str, bool]:
        info = self.tables.get(table.lower())
        return info.columns if info else {}

    def not_null(self, table: str, column: str) -> bool:
        return self.columns(table).get(column.lower()) is False

    def unique(self, table: str, column: str) -> bool:
        info = self.tables.get(table.lower())
        return bool(info) and (column.lower(),) in info.keys


class Catalog:
    """The tables of a folder as temporary views of a session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).parquet(f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name == "partsupp":
            return self._partsupp()
        return self.spark.sql(VIEWS[name].replace(f"FROM {name}", "FROM {src}"), src=self.base(name))

    def _partsupp(self) -> DataFrame:
        """The one table that is derived by a shuffle: written to the shared folder once for each application and folder."""
        context = self.spark.sparkContext
        made = context.__dict__.setdefault("_gritstone_partsupp", {})
        known = made.get(self.folder)
        if known is None:
            df = self.spark.sql(VIEWS["partsupp"].replace("FROM lineitem", "FROM {src}"), src=self.base("lineitem"))
            path = f"{shared_dir(self.spark)}/gritstone/partsupp-{uuid.uuid4().hex}"
            df.write.parquet(path)
            known = made[self.folder] = (path, df.schema)
        return self.spark.read.schema(known[1]).parquet(known[0])

    def register(self, names: list[str] | tuple[str, ...] = tuple(VIEWS)) -> Catalog:
        for name in names:
            self.table(name).createOrReplaceTempView(name)
        return self

    def facts(self, names: list[str] | tuple[str, ...] = tuple(VIEWS)) -> DataFrame:
        """The schema context as rows, with the tables' numbers of rows, which Parquet's footers hold."""
        context = self.schema_context(names, rows=True)
        told = [
            (t.name, column, place, nullable, any(column in k for k in t.keys), next((f"{table}.{other}" for own, table, other in t.references if own == column), None), t.rows)
            for t in context.tables.values()
            for place, (column, nullable) in enumerate(t.columns.items(), 1)
        ]
        return self.spark.createDataFrame(told, "table_name string, column_name string, place bigint, nullable boolean, in_key boolean, refers_to string, row_estimate bigint")

    def schema_context(self, names: list[str] | tuple[str, ...] = tuple(VIEWS), rows: bool = False) -> SchemaContext:
        """Introspected columns, with the declared NOT NULL facts (Parquet calls every column nullable) and keys."""
        tables = {}
        for name in names:
            df = self.table(name)
            known = NOT_NULL.get(name, set())
            keys = () if name == "lineitem" else (KEYS[name],)
            tables[name] = TableInfo(name, {f.name.lower(): f.name.lower() not in known for f in df.schema.fields}, keys, df.count() if rows else None, REFERENCES.get(name, ()))
        return SchemaContext(tables)
