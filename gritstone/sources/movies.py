"""A film database of 21 tables, derived from the relational tables by portable SQL, and join-order questions over it.

The tables have the names and key columns of the public join-order schema; the questions are our own. Each lists 9 to 12
tables by commas, filters some of them, and returns minima, so that what is measured is the order of joins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from gritstone.sources.catalog import Catalog


def _pick(number: str, *values: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


TABLES = {
    "kind_type": f"SELECT CAST(r_regionkey AS BIGINT) AS id, {_pick('r_regionkey', 'movie', 'tv series', 'video', 'episode', 'video game')} AS kind FROM region",
    "company_type": f"SELECT CAST(r_regionkey AS BIGINT) AS id, {_pick('r_regionkey', 'production companies', 'distributors', 'special effects', 'miscellaneous')} AS kind FROM region WHERE r_regionkey < 4",
    "comp_cast_type": f"SELECT CAST(r_regionkey AS BIGINT) AS id, {_pick('r_regionkey', 'cast', 'crew', 'complete', 'verified')} AS kind FROM region WHERE r_regionkey < 4",
    "info_type": f"SELECT CAST(n_nationkey AS BIGINT) AS id, {_pick('n_nationkey', 'rating', 'votes', 'genres', 'countries', 'release dates', 'budget', 'trivia', 'birth notes', 'other')} AS info FROM nation",
    "role_type": f"SELECT CAST(n_nationkey AS BIGINT) AS id, {_pick('n_nationkey', 'actor', 'actress', 'producer', 'writer', 'director', 'editor', 'guest')} AS role FROM nation WHERE n_nationkey < 7",
    "link_type": f"SELECT CAST(n_nationkey AS BIGINT) AS id, {_pick('n_nationkey', 'follows', 'followed by', 'remake of', 'version of', 'references')} AS link FROM nation WHERE n_nationkey < 5",
    "keyword": "SELECT p_partkey AS id, p_name || '-' || CAST(p_partkey % 50 AS STRING) AS keyword FROM part",
    "char_name": "SELECT p_partkey AS id, p_type || ' ' || p_name AS name FROM part",
    "company_name": "SELECT s_suppkey AS id, s_name AS name, '[' || CAST(s_nationkey AS STRING) || ']' AS country_code FROM supplier",
    "name": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'f' ELSE 'm' END AS gender FROM customer",
    "aka_name": "SELECT c_custkey AS id, c_custkey AS person_id, 'aka ' || c_name AS name FROM customer WHERE c_custkey % 3 <> 1",
    "person_info": "SELECT c_custkey AS id, c_custkey AS person_id, CAST(c_custkey % 25 AS BIGINT) AS info_type_id, c_mktsegment AS info FROM customer",
    "title": "SELECT o_orderkey AS id, 'Title ' || CAST(o_orderkey AS STRING) AS title, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS production_year, o_orderkey % 5 AS kind_id FROM orders",
    "aka_title": "SELECT o_orderkey AS id, o_orderkey AS movie_id, 'Aka ' || CAST(o_orderkey AS STRING) AS title FROM orders WHERE o_orderkey % 4 = 0",
    "movie_link": "SELECT o_orderkey AS id, o_orderkey AS movie_id, o_orderkey - o_orderkey % 100 AS linked_movie_id, o_orderkey % 5 AS link_type_id FROM orders WHERE o_orderkey % 3 = 0",
    "complete_cast": "SELECT o_orderkey AS id, o_orderkey AS movie_id, o_orderkey % 2 AS subject_id, 2 + o_custkey % 2 AS status_id FROM orders WHERE o_orderkey % 5 <> 0",
    "movie_info_idx": "SELECT o_orderkey AS id, o_orderkey AS movie_id, o_custkey % 2 AS info_type_id, CAST(o_orderkey % 10 AS STRING) || '.' || CAST(o_custkey % 10 AS STRING) AS info FROM orders",
    "movie_info": f"SELECT l_orderkey AS movie_id, 2 + l_partkey % 4 AS info_type_id, {_pick('l_suppkey % 4', 'Drama', 'Horror', 'Action', 'Comedy')} AS info FROM lineitem",
    "movie_keyword": "SELECT l_orderkey AS movie_id, l_partkey AS keyword_id FROM lineitem WHERE l_linenumber % 2 = 1",
    "movie_companies": "SELECT l_orderkey AS movie_id, l_suppkey AS company_id, l_partkey % 4 AS company_type_id, CASE WHEN l_linenumber % 3 = 0 THEN '(presents)' ELSE '(co-production)' END AS note FROM lineitem",
    "cast_info": "SELECT l_orderkey AS movie_id, l_suppkey * 15 + l_linenumber % 15 AS person_id, l_partkey AS person_role_id, l_partkey % 7 AS role_id, CASE WHEN l_linenumber % 4 = 1 THEN '(voice)' ELSE '(uncredited)' END AS note FROM lineitem",
}

JOINS = {
    "job_01": """SELECT MIN(t.title) AS film, MIN(cn.name) AS company, MIN(k.keyword) AS word, COUNT(*) AS found
FROM company_name cn, company_type ct, keyword k, kind_type kt, movie_companies mc, movie_info mi, info_type it, movie_keyword mk, title t
WHERE mc.company_id = cn.id AND mc.company_type_id = ct.id AND mc.movie_id = t.id AND mk.movie_id = t.id AND mk.keyword_id = k.id AND mi.movie_id = t.id
  AND mi.info_type_id = it.id AND t.kind_id = kt.id AND mk.movie_id = mc.movie_id AND ct.kind = 'distributors' AND it.info = 'genres' AND kt.kind = 'movie' AND t.production_year > 1999""",
    "job_02": """SELECT MIN(n.name) AS person, MIN(chn.name) AS part_played, MIN(t.title) AS film, COUNT(*) AS found
FROM aka_name an, cast_info ci, char_name chn, company_name cn, movie_companies mc, name n, role_type rt, title t, kind_type kt
WHERE ci.movie_id = t.id AND ci.person_id = n.id AND an.person_id = n.id AND ci.person_role_id = chn.id AND ci.role_id = rt.id AND mc.movie_id = t.id
  AND mc.company_id = cn.id AND kt.id = t.kind_id AND an.person_id = ci.person_id AND rt.role = 'actress' AND n.gender = 'f' AND cn.country_code = '[7]' AND ci.note = '(uncredited)'""",
    "job_03": """SELECT MIN(mi.info) AS genre, MIN(mx.info) AS rating, MIN(t.title) AS film, COUNT(*) AS found
FROM cast_info ci, info_type it1, info_type it2, movie_info mi, movie_info_idx mx, name n, role_type rt, title t, kind_type kt, complete_cast cc
WHERE mi.movie_id = t.id AND mx.movie_id = t.id AND ci.movie_id = t.id AND ci.person_id = n.id AND ci.role_id = rt.id AND mi.info_type_id = it1.id AND mx.info_type_id = it2.id
  AND kt.id = t.kind_id AND cc.movie_id = t.id AND it1.info = 'genres' AND it2.info = 'rating' AND mi.info = 'Horror' AND mx.info > '7' AND rt.role = 'writer' AND kt.kind <> 'episode'""",
    "job_04": """SELECT MIN(t1.title) AS film, MIN(t2.title) AS linked, MIN(lt.link) AS kind_of_link, COUNT(*) AS found
FROM link_type lt, movie_link ml, title t1, title t2, kind_type kt1, kind_type kt2, movie_companies mc1, company_name cn1, movie_keyword mk, keyword k
WHERE ml.movie_id = t1.id AND ml.linked_movie_id = t2.id AND ml.link_type_id = lt.id AND t1.kind_id = kt1.id AND t2.kind_id = kt2.id AND mc1.movie_id = t1.id AND mc1.company_id = cn1.id
  AND mk.movie_id = t1.id AND mk.keyword_id = k.id AND lt.link IN ('follows', 'remake of') AND t1.production_year BETWEEN 1997 AND 2000 AND mc1.note = '(presents)'""",
    "job_05": """SELECT MIN(an.name) AS other_name, MIN(pi.info) AS about, MIN(t.title) AS film, COUNT(*) AS found
FROM aka_name an, name n, person_info pi, info_type it, cast_info ci, role_type rt, title t, movie_info_idx mx, info_type it2, kind_type kt
WHERE an.person_id = n.id AND pi.person_id = n.id AND pi.info_type_id = it.id AND ci.person_id = n.id AND ci.role_id = rt.id AND ci.movie_id = t.id AND mx.movie_id = t.id
  AND mx.info_type_id = it2.id AND t.kind_id = kt.id AND it.info = 'birth notes' AND rt.role IN ('director', 'producer') AND it2.info = 'votes' AND n.gender = 'm'""",
    "job_06": """SELECT MIN(cn.name) AS company, MIN(mi.info) AS genre, MIN(k.keyword) AS word, MIN(t.title) AS film, COUNT(*) AS found
FROM comp_cast_type c1, comp_cast_type c2, complete_cast cc, company_name cn, company_type ct, keyword k, movie_companies mc, movie_info mi, movie_keyword mk, title t, info_type it
WHERE cc.subject_id = c1.id AND cc.status_id = c2.id AND cc.movie_id = t.id AND mc.movie_id = t.id AND mc.company_id = cn.id AND mc.company_type_id = ct.id AND mk.movie_id = t.id
  AND mk.keyword_id = k.id AND mi.movie_id = t.id AND mi.info_type_id = it.id AND c1.kind = 'crew' AND c2.kind = 'verified' AND ct.kind = 'production companies' AND it.info = 'countries' AND t.production_year >= 1998""",
    "job_07": """SELECT MIN(chn.name) AS part_played, MIN(n.name) AS person, MIN(mx.info) AS rating, MIN(t.title) AS film, COUNT(*) AS found
FROM cast_info ci, char_name chn, complete_cast cc, comp_cast_type c1, comp_cast_type c2, info_type it, keyword k, kind_type kt, movie_info_idx mx, movie_keyword mk, name n, title t
WHERE cc.movie_id = t.id AND cc.subject_id = c1.id AND cc.status_id = c2.id AND ci.movie_id = t.id AND ci.person_role_id = chn.id AND ci.person_id = n.id AND mx.movie_id = t.id AND mx.info_type_id = it.id
  AND mk.movie_id = t.id AND mk.keyword_id = k.id AND t.kind_id = kt.id AND c1.kind = 'cast' AND kt.kind = 'tv series' AND it.info = 'rating' AND mx.info > '5' AND k.keyword LIKE 'red%'""",
    "job_08": """SELECT MIN(alt.title) AS other_title, MIN(t.title) AS film, MIN(cn.name) AS company, COUNT(*) AS found
FROM aka_title alt, company_name cn, company_type ct, info_type it, keyword k, kind_type kt, movie_companies mc, movie_info mi, movie_keyword mk, title t
WHERE alt.movie_id = t.id AND mi.movie_id = t.id AND mk.movie_id = t.id AND mc.movie_id = t.id AND k.id = mk.keyword_id AND it.id = mi.info_type_id AND cn.id = mc.company_id AND ct.id = mc.company_type_id
  AND kt.id = t.kind_id AND cn.country_code IN ('[3]', '[8]') AND it.info = 'release dates' AND t.production_year > 1996""",
}


def used(sql: str) -> list[str]:
    words = set(sql.replace(",", " ").split())
    return [t for t in TABLES if t in words]


def register(spark: SparkSession, sf: str, names: Iterable[str] = tuple(TABLES)) -> None:
    """The named tables as views over the folder's relational tables."""
    catalog = Catalog(spark, sf)
    for base in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        catalog.base(base).createOrReplaceTempView(f"base_{base}")
    for name in names:
        text = TABLES[name]
        base = text.split(" FROM ")[-1].split()[0]
        spark.sql(text.replace(f" FROM {base}", f" FROM base_{base}")).createOrReplaceTempView(name)


def oracle(sql: str) -> str:
    return "WITH " + ",\n".join(f"{t} AS ({TABLES[t]})" for t in used(sql)) + "\n" + sql


def run(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    register(spark, sf, used(sql))
    return spark.sql(sql)
