"""Symbol resolution, search and membership over the suppliers and what the customers typed."""

from pyspark.sql import functions as F

from barloom.catalog.base import query, with_ctes
from barloom.operators import symbols as s
from barloom.sources.adapters import names, symbol_inputs, universe

CTES = {
    "universe": "SELECT 'S' || s_suppkey AS symbol FROM supplier WHERE s_acctbal >= 0",
    "names": """SELECT 'S' || s_suppkey AS symbol, s_suppkey AS position, 0 AS place, s_name AS name FROM supplier
        UNION ALL SELECT 'S' || s_suppkey, s_suppkey, 1, 'Trading House ' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "mapped": """SELECT name, symbol, position, place FROM (SELECT lower(trim(name)) AS name, symbol, position, place, row_number() OVER
        (PARTITION BY lower(trim(name)) ORDER BY position, place) AS k FROM names) AS x
        WHERE k = 1 AND symbol IN (SELECT symbol FROM universe)""",
    "inputs": """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' s' || c_custkey
        WHEN 1 THEN 'SUPPLIER#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 2 THEN 'nation_' || c_nationkey
        WHEN 3 THEN 'buy Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' today' WHEN 4 THEN c_name ELSE '  ' END AS text FROM customer""",
    "q": "SELECT *, lower(trim(text)) AS q FROM inputs",
    "distinct_q": "SELECT DISTINCT q FROM q WHERE q <> ''",
    "partial": """SELECT q, arg_min(symbol, struct_pack(a := position, b := place)) AS symbol FROM distinct_q
        JOIN mapped ON contains(name, q) OR contains(q, name) GROUP BY 1""",
}


@query("resolve_symbols", with_ctes(
    CTES,
    "c_custkey:i, text, resolved, status",
    """SELECT c_custkey, text, coalesce(u.symbol, m.symbol, p.symbol) AS resolved, CASE WHEN q.q = '' THEN 'empty'
       WHEN coalesce(u.symbol, m.symbol, p.symbol) IS NULL THEN 'not found' ELSE 'ok' END AS status
       FROM q LEFT JOIN universe AS u ON upper(q.q) = u.symbol LEFT JOIN mapped AS m ON q.q = m.name LEFT JOIN partial AS p ON q.q = p.q""",
))
def resolve_symbols(spark, sf_dir):
    found = s.resolve_symbols(symbol_inputs(spark, sf_dir), names(spark, sf_dir), universe(spark, sf_dir))
    return found.select("c_custkey", "text", "resolved", "status")


@query("search_symbols", with_ctes(
    {
        **CTES,
        "hits": """SELECT symbol, 0 AS tier, symbol AS k, 0 AS position, 0 AS place FROM universe WHERE contains(lower(symbol), 's1')
            UNION ALL SELECT symbol, 1, '', position, place FROM mapped WHERE contains(name, 's1')""",
        "best": """SELECT symbol, tier, k, position FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tier, k, position, place) AS i
            FROM hits) AS x WHERE i = 1 ORDER BY tier, k, position LIMIT 20""",
    },
    "symbol, company",
    "SELECT best.symbol, name AS company FROM best LEFT JOIN names ON names.symbol = best.symbol AND names.place = 0",
))
def search_symbols(spark, sf_dir):
    return s.search_symbols(names(spark, sf_dir), universe(spark, sf_dir), "S1")


@query("search_symbols_by_name", with_ctes(
    {
        **CTES,
        "best": """SELECT symbol, min(struct_pack(a := position, b := place)) AS o FROM mapped WHERE contains(name, 'nation_1')
            GROUP BY 1 ORDER BY 2 LIMIT 5""",
    },
    "symbol, company",
    "SELECT best.symbol, name AS company FROM best LEFT JOIN names ON names.symbol = best.symbol AND names.place = 0",
))
def search_symbols_by_name(spark, sf_dir):
    return s.search_symbols(names(spark, sf_dir), universe(spark, sf_dir), "Nation_1", 5)


@query("company_name", with_ctes(
    CTES,
    "c_custkey:i, symbol, company",
    """SELECT c_custkey, text AS symbol, name AS company FROM q LEFT JOIN names ON upper(q.q) = names.symbol AND place = 0""",
))
def company_name(spark, sf_dir):
    asked = symbol_inputs(spark, sf_dir).select("c_custkey", F.col("text").alias("symbol"))
    return s.company_name(asked, names(spark, sf_dir)).select("c_custkey", "symbol", "company")


@query("is_available", with_ctes(
    CTES, "c_custkey:i, available", "SELECT c_custkey, upper(q) IN (SELECT symbol FROM universe) AS available FROM q"
))
def is_available(spark, sf_dir):
    asked = symbol_inputs(spark, sf_dir).select("c_custkey", F.col("text").alias("symbol"))
    return s.is_available(asked, universe(spark, sf_dir)).select("c_custkey", "available")
