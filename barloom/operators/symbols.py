"""Resolving and searching symbols by ticker or company name.

`names` has one row per symbol: symbol, position (mapping order) and names, an
ordered array. `universe` has one row per available symbol. Substring matches
go through an inverted index of fragments: a text is looked up by the fragment
that the fewest others hold, and what is found is checked, so rows without a rare
fragment in common never meet. Fragments have 3, 6, 12 or 24 characters, the most that
fit a text, since texts that share most short ones, as numbered names do, differ in long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy(text: str | Column) -> Column:
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\n\r\f\v"))


def name_map(names: DataFrame) -> DataFrame:
    """Lower-case name -> symbol, the first in mapping order, with its order `ord`."""
    each = names.select("symbol", "position", F.posexplode("names").alias("_at", "_name"))
    each = each.select("symbol", F.lower(tidy("_name")).alias("name"), F.struct("position", "_at").alias("ord"))
    return each.groupBy("name").agg(F.min_by("symbol", "ord").alias("symbol"), F.min("ord").alias("ord"))


def _available(names: DataFrame, universe: DataFrame) -> DataFrame:
    return name_map(names).join(universe.select("symbol"), "symbol", "left_semi")


FRAGMENT = 3
#: lengths of fragments; each is twice the one before
LENGTHS = (FRAGMENT, 6, 12, 24)


def _pieces(text: str, n: int) -> Column:
    """The pieces of n characters of a column, one for each place."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    count = F.greatest(F.size(chars) - (n - 1), F.lit(0))
    out = F.slice(chars, 1, count)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(chars, k, count), lambda a, b: F.concat(a, b))
    return out


def fragments(text: str, n: int) -> Column:
    """The distinct pieces of n characters of a column, at most as many as it has characters."""
    return F.array_distinct(_pieces(text, n))


def _hashed(texts: DataFrame, text: str) -> DataFrame:
    """Adds for each length the hashes of a text's pieces, a longer one's from those of its halves.

    Hashes move in place of fragments: two fragments of one hash make a candidate more, which the check turns down.
    """
    out = texts.withColumn(f"_f{FRAGMENT}", F.transform(_pieces(text, FRAGMENT), lambda x: F.xxhash64(x)))
    for n in LENGTHS[:-1]:
        half = F.col(f"_f{n}")
        count = F.greatest(F.size(half) - n, F.lit(0))
        out = out.withColumn(f"_f{2 * n}", F.zip_with(F.slice(half, 1, count), F.slice(half, n + 1, count), lambda a, b: F.xxhash64(a, b)))
    return out


def _length_of(size: str) -> Column:
    """The length of the fragments that a text is looked up by; one shorter than a fragment is one itself."""
    return F.greatest(*[F.when(F.col(size) >= n, F.lit(n)) for n in LENGTHS], F.least(F.col(size), F.lit(FRAGMENT)))


def _lengths(texts: DataFrame) -> list[int]:
    """The lengths that texts (size) are looked up by, at most six."""
    return sorted(r.n for r in texts.select(_length_of("size").alias("n")).filter("n > 0").distinct().collect())


def _exploded(texts: DataFrame, pieces: Column) -> DataFrame:
    """id, size and f: a row for each fragment."""
    return texts.select("id", "size", F.explode(F.array_distinct(pieces)).alias("f"))


def _rarest(texts: DataFrame, among: DataFrame) -> DataFrame:
    """Of each text (id, size; a row a fragment f) the fragment that the fewest of `among` hold; texts with one that none holds go."""
    held = among.groupBy("f").agg(F.count(F.lit(1)).alias("_held"))
    each = texts.join(held, "f", "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    return each.groupBy("id", "size").agg(F.min_by("f", F.struct("_held", "f")).alias("f"), F.min("_held").alias("_held")).filter("_held > 0").drop("_held")


def _sized(texts: DataFrame, text: str) -> DataFrame:
    """With id and size: exploded rows and candidates carry these, the texts come back for the check alone."""
    return texts.withColumns({"id": F.unhex(F.md5(text)), "size": F.char_length(text)})


def _candidates(asked: DataFrame, named: DataFrame, of_names: list[int]) -> DataFrame:
    """The ids (asked, named) of queries longer than a fragment and names that share the rarest fragment of the shorter of the two."""

    def met(inner: DataFrame, text: str, outer: DataFrame, other: str, lengths: list[int]) -> DataFrame:
        """(inner, outer) ids that share the inner text's rarest fragment, where the inner one is not the longer."""
        among = _exploded(_hashed(outer, other), F.concat(F.array().cast("array<bigint>"), *[F.col(f"_f{n}") for n in lengths]))
        own = F.coalesce(*[F.when(_length_of("size") == n, F.col(f"_f{n}")) for n in LENGTHS])
        rare = _rarest(_exploded(_hashed(inner, text), own), among)
        inner = rare.select("f", F.col("id").alias("inner"), F.col("size").alias("_inner_size"))
        outer = among.select("f", F.col("id").alias("outer"), F.col("size").alias("_outer_size"))
        return inner.join(outer, "f").filter(F.col("_inner_size") <= F.col("_outer_size")).select("inner", "outer")

    longer, long_names = asked.filter(F.col("size") > FRAGMENT), named.filter(F.col("size") >= FRAGMENT)
    in_names = met(longer, "_q", named, "name", _lengths(longer)).select(F.col("inner").alias("asked"), F.col("outer").alias("named"))
    in_queries = met(long_names, "name", asked, "_q", [n for n in of_names if n >= FRAGMENT]).select(F.col("outer").alias("asked"), F.col("inner").alias("named"))
    return in_names.unionByName(in_queries).distinct()


def _partial_matches(queries: DataFrame, available: DataFrame) -> DataFrame:
    """Per query the first name in mapping order that contains it or that it contains."""
    asked, named = _sized(queries.select("_q"), "_q"), _sized(available.select("name", "symbol", "ord"), "name")

    # a query no longer than a fragment is one: the first name that holds it is known per fragment
    short = [fragments("name", n) for n in range(1, FRAGMENT + 1)]
    first = named.select("symbol", "ord", F.explode(F.concat(*short)).alias("_q")).groupBy("_q").agg(F.min_by("symbol", "ord").alias("symbol"), F.min("ord").alias("ord"))
    contained = asked.filter(F.col("size") <= FRAGMENT).join(first, "_q").select("_q", "symbol", "ord")
    # a name shorter than a fragment is found the same way
    of_names = _lengths(named)
    grams = [fragments("_q", n) for n in of_names if n < FRAGMENT]
    tiny = asked.select("_q", F.explode(F.concat(F.array().cast("array<string>"), *grams)).alias("name")).join(named.filter(F.col("size") < FRAGMENT).select("name", "symbol", "ord"), "name")
    tiny = tiny.groupBy("_q").agg(F.min_by("symbol", "ord").alias("symbol"), F.min("ord").alias("ord"))

    pairs = _candidates(asked, named, of_names)
    texts = pairs.join(asked.select(F.col("id").alias("asked"), "_q"), "asked").join(named.select(F.col("id").alias("named"), "name", "symbol", "ord"), "named")
    checked = texts.filter(F.contains("name", "_q") | F.contains("_q", "name")).select("_q", "symbol", "ord")
    both = contained.unionByName(tiny).unionByName(checked)
    return both.groupBy("_q").agg(F.min_by("symbol", "ord").alias("_partial"))


def resolve_symbols(inputs: DataFrame, names: DataFrame, universe: DataFrame, text: str = "text") -> DataFrame:
    """Add `resolved` and `status`: ticker first, then exact name, then name containing or contained.

    Each distinct input is resolved once; unresolved inputs stay, with null.
    """
    available = _available(names, universe)
    inputs = inputs.withColumn("_q", F.lower(tidy(text)))
    queries = inputs.filter(F.col("_q") != "").select("_q").distinct()
    tickers = universe.select(F.upper("symbol").alias("_u"), F.col("symbol").alias("_ticker"))
    tickers = tickers.filter(F.col("_u") == F.col("_ticker")).dropDuplicates(["_u"])
    found = (
        queries.join(tickers, F.upper("_q") == F.col("_u"), "left")
        .join(available.select(F.col("name").alias("_q"), F.col("symbol").alias("_exact")), "_q", "left")
        .join(_partial_matches(queries, available), "_q", "left")
        .select("_q", F.coalesce("_ticker", "_exact", "_partial").alias("resolved"))
    )
    status = F.when(F.coalesce(F.col("_q"), F.lit("")) == "", "empty").when(F.col("resolved").isNull(), "not found")
    return inputs.join(found, "_q", "left").withColumn("status", status.otherwise("ok")).drop("_q")


def search_symbols(names: DataFrame, universe: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Available symbols that contain the query, in order, then those with a name that does; no symbol twice."""
    wanted = query.strip().lower()
    none = F.struct(F.lit(0).cast("long").alias("position"), F.lit(0).alias("_at"))
    by_symbol = universe.filter(F.lower("symbol").contains(wanted)).select(
        "symbol", F.lit(0).alias("tier"), F.col("symbol").alias("_key"), none.alias("ord")
    )
    by_name = _available(names, universe).filter(F.col("name").contains(wanted)).select(
        "symbol",
        F.lit(1).alias("tier"),
        F.lit("").alias("_key"),
        F.struct(F.col("ord.position").cast("long").alias("position"), F.col("ord._at").alias("_at")).alias("ord"),
    )
    hits = by_symbol.unionByName(by_name).filter(F.lit(wanted != ""))
    ranked = hits.groupBy("symbol").agg(F.min(F.struct("tier", "_key", "ord")).alias("_rank"))
    top = ranked.orderBy("_rank").limit(limit)
    return company_name(top, names).select("symbol", "company").orderBy("_rank")


def company_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Add `company`, the primary name of the symbol or null."""
    primary = names.select(F.upper("symbol").alias("_key"), F.get("names", F.lit(0)).alias("company"))
    return symbols.withColumn("_key", F.upper(tidy("symbol"))).join(primary, "_key", "left").drop("_key")


def is_available(symbols: DataFrame, universe: DataFrame) -> DataFrame:
    """Add `available`."""
    known = universe.select(F.col("symbol").alias("_key")).distinct().withColumn("_known", F.lit(True))
    out = symbols.withColumn("_key", F.upper(tidy("symbol"))).join(known, "_key", "left")
    return out.withColumn("available", F.coalesce("_known", F.lit(False))).drop("_key", "_known")
