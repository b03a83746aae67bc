"""The operators applied to the supplied tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.packing import pack

    pieces = pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.exact import deduplicate

    return deduplicate(table(spark, folder, "documents"))


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.counts import count_tokens

    return count_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


SQL["op2_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.suffixes import remove_repeats

    found = remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.toxicity import fit, score_toxicity

    docs = table(spark, folder, "documents")
    return score_toxicity(docs, fit(docs, table(spark, folder, "labels")))


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.quality import fit, judge

    docs = table(spark, folder, "documents")
    return judge(docs, fit(docs, table(spark, folder, "labels")))


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.lines import SHORT, drop_boilerplate

    found = drop_boilerplate(table(spark, folder, "documents"), short=SHORT)
    return found.select("doc_id", F.col("n_lines_removed").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


SQL["op7_line_dedup"] = r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT greatest(5, ceil(0.9 * count(DISTINCT source))) AS most FROM documents),
b AS (SELECT line, count(DISTINCT source) AS sites, min(struct_pack(d := doc_id, p := pos)) AS first FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
      HAVING count(DISTINCT source) >= CASE WHEN regexp_matches(line, '^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){4}[^\x20\x09-\x0D]') THEN 5 ELSE (SELECT most FROM w) END),
k AS (SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AND (l.doc_id <> b.first.d OR l.pos <> b.first.p) AS gone FROM l LEFT JOIN b ON l.line = b.line),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS x FROM k GROUP BY doc_id)
SELECT doc_id, n_removed, sha256(x) AS text_sha256 FROM r
"""


def domains(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled table of the mixture: quality 1 is the domain ``high``, 0 is ``low``."""
    return table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


@query
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.mixing import TARGETS, fit, measure, rates

    docs = table(spark, folder, "documents")
    measured = measure(docs)
    model = fit(docs, domains(spark, folder), TARGETS, measured=measured)
    found = rates(docs, model, measured=measured)
    probability = [F.round(F.col("posterior")[k], 6).alias(f"p_{d}") for k, d in enumerate(model.domains)]
    return found.select("doc_id", "tokens", *probability, F.round("rate", 6).alias("rate"), "copies")


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.language import fit, identify

    found = identify(table(spark, folder, "pages"), fit(table(spark, folder, "documents")))
    return found.withColumn("probability", F.round("probability", 6))


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.spelling import count_words, group_variants, letter_runs, without_letter

    docs = table(spark, folder, "documents")
    runs = docs.select("doc_id", F.explode(letter_runs(F.col("text"))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    words = runs.select(F.when(h % 31 == 0, without_letter(F.col("run"), h % F.length("run"))).otherwise(F.col("run")).alias("word"))
    return group_variants(count_words(words))


@query
def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


SQL["op12_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""


@query
def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from pubmeter.llm.setsketch import near_duplicates

    found = near_duplicates(table(spark, folder, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL["op13_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(words) - 1)), lambda i: array_to_string(words[i:i + 2], ' '))) AS shingles FROM w WHERE len(words) > 0),
t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM g),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(len(shingles), 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(least, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(least, w.doc_id)) AS kept
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN low USING (doc_id)
"""
