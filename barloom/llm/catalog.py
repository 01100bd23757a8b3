"""Queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import align, chat, decontaminate, lexical, licenses, ngram_join, packing, pii, quality, ranking, repeats, secrets, shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), default_tokenizer()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(documents(spark, sf_dir), n=4, percent=85)


# words and shingles by the definition, every pair that shares a shingle, and the links followed to the end
ORACLES["op7_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS sh
  FROM w
), g AS (SELECT DISTINCT sh FROM (SELECT list_sort(sh) AS sh FROM s WHERE len(sh) > 0)
), gi AS (SELECT row_number() OVER (ORDER BY sh) AS g, sh, len(sh) AS n FROM g
), t AS (SELECT g, n, hash(x) AS x FROM (SELECT g, n, unnest(sh) AS x FROM gi)
), p AS (
  SELECT a.g AS a, b.g AS b FROM t a JOIN t b ON a.x = b.x AND a.g <> b.g
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT g AS a, g AS b FROM gi UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
), d AS (SELECT s.doc_id, len(s.sh) AS n_shingles, gi.g FROM s LEFT JOIN gi ON gi.sh = list_sort(s.sh)
), first AS (SELECT reach.a AS g, min(d.doc_id) AS component_id FROM reach JOIN d ON d.g = reach.b GROUP BY 1)
SELECT d.doc_id, d.n_shingles::BIGINT AS n_shingles, coalesce(first.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN first ON first.g = d.g
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_figures(documents(spark, sf_dir))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# for the registered query; a real key is passed in by the caller
TRIAL_KEY = "trial key"


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), TRIAL_KEY, counts=True)


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))

    def of(kinds: list[str]) -> F.Column:
        return F.filter("secrets", lambda x: x.kind.isin(kinds))

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    base = [r.kind for r in secrets.BASE]
    return found.select("doc_id", *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base),
                        F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


@query
def op10_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ranking.score(docs, ranking.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shuffle(documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(documents(spark, sf_dir), default_tokenizer(), default_pieces())


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings."""
    own = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.formatted(turns, default_tokenizer()), default_tokenizer())


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


# every document scored for every item by the definition
ORACLES["op13_lexical"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), c AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0
), q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM i) GROUP BY ALL
), t AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, c GROUP BY term, big_n
), s AS (
  SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term), c GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
