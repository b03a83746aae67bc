"""Words, term weights, topic descriptions, language and topic assignment.

The stop words of these queries are the publishing words plus a few common ones: the lists that Spark ships are
read from a running session, which the SQL side does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.embedding import embed, hashed_embedding
from pubmeter.operators.language import identify_language, language_profile
from pubmeter.operators.merging import merge_topics, remap_documents
from pubmeter.operators.tokens import (
    PUBLISHING_WORDS,
    class_tfidf,
    reduce_outliers,
    rerank_terms,
    term_counts,
    top_terms,
    topic_centroids,
    topic_info,
    topic_labels,
    vocabulary,
)
from pubmeter.plans.topics import describe_topics, document_info, model_topics, reranked_terms
from pubmeter.session import cut_lineage
from workloads import roles
from workloads.registry import Tables, query
from workloads.roles import SQL, prelude

STOP = (*PUBLISHING_WORDS, "the", "of", "and", "der", "die", "le", "la", "el", "de")
MIN_DF, MAX_DF = 0.1, 0.8


def by_source(t: Tables) -> DataFrame:
    """Whole documents, with the number of their source as topic."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return t.documents.select(F.col("doc_id").alias("id"), number.alias("topic"), F.col("text").alias("title"))


SQL["by_source"] = r"SELECT doc_id AS id, CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) AS topic, text AS title FROM documents"
SQL["stop"] = "SELECT unnest([" + ", ".join(f"'{w}'" for w in STOP) + "]) AS w"


def counts_sql(source: str) -> str:
    return rf"""tok AS (SELECT id, topic, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM
  (SELECT id, topic, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]{{2,}}') AS ws FROM {source})),
kept AS (SELECT topic, w, lead(w) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM tok WHERE w NOT IN (SELECT w FROM stop)),
counts AS (SELECT topic, term, count(*) AS n FROM (SELECT topic, w AS term FROM kept UNION ALL SELECT topic, w || ' ' || nxt FROM kept WHERE nxt IS NOT NULL) GROUP BY ALL)"""


def weights_sql(low: float, high: float) -> str:
    return f"""vocab AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS f FROM counts GROUP BY term
  HAVING count(*) >= {low} * (SELECT count(DISTINCT topic) FROM counts) AND count(*) <= {high} * (SELECT count(DISTINCT topic) FROM counts)),
used AS (SELECT c.topic, c.term, c.n, v.f FROM counts c JOIN vocab v ON c.term = v.term),
sizes AS (SELECT topic, sum(n) AS size FROM used GROUP BY topic), average AS (SELECT floor(avg(size)) AS a FROM sizes),
weights AS (SELECT u.topic, u.term, u.n, u.n / s.size * ln(1 + a / f) AS weight FROM used u JOIN sizes s ON u.topic = s.topic, average)"""


def top_sql(k: int) -> str:
    return f"top AS (SELECT * FROM (SELECT topic, term, n, weight, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS rank FROM weights) WHERE rank <= {k})"


def source_sql(*parts: str) -> str:
    return prelude("by_source", "stop").rstrip() + ", " + ", ".join((counts_sql("by_source"), *parts)) + " "


def source_counts(t: Tables) -> DataFrame:
    return term_counts(by_source(t), "topic", "title", STOP)


@query(source_sql() + "SELECT * FROM counts")
def words_and_pairs(t: Tables) -> DataFrame:
    """Single words and neighbouring pairs of whole texts, without stop words."""
    return term_counts(by_source(t), "topic", "title", STOP)


@query(source_sql(weights_sql(MIN_DF, MAX_DF)) + "SELECT * FROM vocab")
def topic_vocabulary(t: Tables) -> DataFrame:
    return vocabulary(source_counts(t), "topic", MIN_DF, MAX_DF)


@query(source_sql(weights_sql(MIN_DF, MAX_DF)) + "SELECT * FROM weights", doubles="weight")
def term_weights(t: Tables) -> DataFrame:
    return class_tfidf(source_counts(t), "topic", MIN_DF, MAX_DF)


@query(source_sql(weights_sql(MIN_DF, MAX_DF), top_sql(10)) + "SELECT topic, term, weight, rank FROM top", doubles="weight")
def top_terms_by_topic(t: Tables) -> DataFrame:
    return top_terms(class_tfidf(source_counts(t), "topic", MIN_DF, MAX_DF)).select("topic", "term", "weight", "rank")


INFO = """info AS (SELECT d.topic, any_value(d.n) AS count, string_agg(term, '|' ORDER BY rank) AS representation,
  d.topic || ' - ' || string_agg(term, ' ' ORDER BY rank) FILTER (rank <= 3) AS label
  FROM (SELECT topic, count(*) AS n FROM {0} GROUP BY topic) d JOIN top t ON d.topic = t.topic GROUP BY d.topic)"""


@query(source_sql(weights_sql(MIN_DF, MAX_DF), top_sql(10), INFO.format("by_source")) + "SELECT topic, count, representation FROM info")
def topic_descriptions(t: Tables) -> DataFrame:
    """Size and ranked terms of each topic."""
    top = top_terms(class_tfidf(source_counts(t), "topic", MIN_DF, MAX_DF))
    info = topic_info(by_source(t), top)
    return info.withColumn("representation", F.array_join("representation", "|"))


@query(
    source_sql(weights_sql(0.001, 0.8), top_sql(10), INFO.format("by_source"))
    + "SELECT topic, CASE topic WHEN 3 THEN '3 - Third' ELSE label END AS label FROM info"
)
def topic_label_texts(t: Tables) -> DataFrame:
    """Labels from the leading terms, one of them overridden."""
    _, info = describe_topics(by_source(t).select("id", "topic"), by_source(t), stop=STOP)
    better = t.spark.createDataFrame([(3, "3 - Third")], "topic int, label string")
    return topic_labels(info.drop("label"), better).select("topic", "label")


SQL["assigned"] = "SELECT id, vec, CASE WHEN id % 5 = 0 THEN -1 ELSE topic END AS topic FROM vectors"
SQL["seeds"] = """SELECT topic, list(m ORDER BY pos) AS vec FROM (SELECT topic, pos, avg(x) AS m FROM
  (SELECT topic, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM assigned WHERE topic <> -1) GROUP BY topic, pos) GROUP BY topic"""
SQL["reassigned"] = """SELECT a.id, CASE WHEN a.topic = -1 AND b.s >= 0.1 THEN b.topic ELSE a.topic END AS topic FROM assigned a LEFT JOIN
  (SELECT * FROM (SELECT a.id, c.topic, round(list_cosine_similarity(a.vec, c.vec), 9) AS s,
    row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_cosine_similarity(a.vec, c.vec), 9), c.topic) AS rn
    FROM assigned a, seeds c WHERE a.topic = -1) WHERE rn = 1) b ON a.id = b.id"""
REASSIGNED = ("vectors", "assigned", "seeds", "reassigned")


def reassigned(t: Tables) -> DataFrame:
    topic = F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("topic"))
    assigned = roles.vectors(t).withColumn("topic", topic)
    return reduce_outliers(assigned, topic_centroids(assigned.where("topic <> -1")))


@query(prelude(*REASSIGNED) + "SELECT * FROM reassigned")
def outliers_reassigned(t: Tables) -> DataFrame:
    """Every fifth vector starts as an outlier and joins the closest topic, if that is close enough."""
    return reassigned(t)


@query(
    prelude(*REASSIGNED, "stop").rstrip()
    + ", moved AS (SELECT r.id, r.topic, text AS title FROM reassigned r JOIN documents ON doc_id = r.id), "
    + ", ".join((counts_sql("moved"), weights_sql(0.001, 0.8), top_sql(10)))
    + " SELECT topic, term, weight, rank FROM top",
    doubles="weight",
)
def terms_after_reassignment(t: Tables) -> DataFrame:
    """The topic terms recomputed for the new assignment."""
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    weights, _ = describe_topics(reassigned(t), texts, stop=STOP)
    return top_terms(weights).select("topic", "term", "weight", "rank")


@query(
    prelude("vectors", "centroids")
    + """SELECT topic, term, similarity, rank FROM (SELECT v.topic, 'v' || v.id AS term, round(list_cosine_similarity(v.vec, c.vec), 9) AS similarity,
    row_number() OVER (PARTITION BY v.topic ORDER BY round(list_cosine_similarity(v.vec, c.vec), 9) DESC, 'v' || v.id) AS rank
    FROM vectors v JOIN centroids c ON v.topic = c.topic) WHERE rank <= 10""",
    doubles="similarity",
)
def terms_reranked_by_vector(t: Tables) -> DataFrame:
    """Candidate terms by closeness to their topic; the given vectors stand for term vectors."""
    named = roles.vectors(t).withColumn("term", F.concat(F.lit("v"), "id"))
    return rerank_terms(named, named.select("term", "vec"), topic_centroids(named))


@query(
    source_sql(weights_sql(0.001, 0.8), top_sql(30)).rstrip().rstrip(",")
    + """, spelled AS (SELECT term, [CAST(length(term) AS DOUBLE), length(term) - length(replace(term, 'e', '')), length(term) - length(replace(term, 'n', '')), 1] AS vec FROM (SELECT DISTINCT term FROM top)),
    centre AS (SELECT topic, [topic + 1.0, 2, 1, topic % 3] AS cv FROM (SELECT DISTINCT topic FROM top)),
    scored AS (SELECT topic, term, round(list_cosine_similarity(vec, cv), 9) AS similarity FROM top JOIN spelled USING (term) JOIN centre USING (topic)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, term) AS rank FROM scored)
    SELECT topic, term, similarity, rank FROM ranked WHERE rank <= 10""",
    doubles="similarity",
)
def topic_terms_reranked(t: Tables) -> DataFrame:
    """Each topic's leading terms by closeness of their vectors, here counts of letters, to a vector of the topic."""
    texts = by_source(t)
    weights = class_tfidf(source_counts(t))
    centre = texts.select("topic").distinct().select("topic", F.array((F.col("topic") + 1).cast("double"), F.lit(2.0), F.lit(1.0), (F.col("topic") % 3).cast("double")).alias("vec"))
    count = lambda letter: F.length("id") - F.length(F.replace("id", F.lit(letter), F.lit("")))
    spell = lambda terms: terms.select("id", F.array(F.length("id").cast("double"), count("e").cast("double"), count("n").cast("double"), F.lit(1.0)).alias("vec"))
    return reranked_terms(weights, centre, spell).select("topic", "term", "similarity", "rank")


SQL["parts"] = """SELECT part, topic, list(m ORDER BY pos) AS vec FROM (SELECT part, topic, pos, avg(x) AS m FROM
  (SELECT id % 3 + 1 AS part, topic, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM vectors) GROUP BY ALL) GROUP BY part, topic"""


def _merge_step(i: int) -> str:
    return f"""best{i} AS (SELECT * FROM (SELECT n.topic, n.vec, k.merged, round(1 - list_cosine_similarity(n.vec, k.vec), 9) AS d,
    row_number() OVER (PARTITION BY n.topic ORDER BY round(1 - list_cosine_similarity(n.vec, k.vec), 9), k.merged) AS rn FROM parts n, known{i - 1} k WHERE n.part = {i}) WHERE rn = 1),
  map{i} AS (SELECT {i} AS part, topic, vec, 1 - d >= 0.2 AS found, CASE WHEN 1 - d >= 0.2 THEN merged ELSE (SELECT max(merged) FROM known{i - 1})
    + row_number() OVER (PARTITION BY 1 - d >= 0.2 ORDER BY topic) END AS merged FROM best{i}),
  known{i} AS (SELECT merged, vec FROM known{i - 1} UNION ALL SELECT merged, vec FROM map{i} WHERE NOT found)"""


MERGED = f"""known1 AS (SELECT topic AS merged, vec FROM parts WHERE part = 1), {_merge_step(2)}, {_merge_step(3)},
mapping AS (SELECT 1 AS part, topic, topic AS merged FROM parts WHERE part = 1 UNION ALL SELECT part, topic, merged FROM map2 UNION ALL SELECT part, topic, merged FROM map3)"""


def merged(t: Tables) -> DataFrame:
    parted = roles.vectors(t).withColumn("part", F.col("id") % 3 + 1)
    mapping, _ = merge_topics(topic_centroids(parted, by="part"), 0.2)
    return mapping


@query(prelude("vectors", "parts").rstrip() + f", {MERGED} SELECT part, topic, merged FROM mapping")
def merged_topics(t: Tables) -> DataFrame:
    """Topics of three parts folded into one set."""
    return merged(t)


@query(
    prelude("vectors", "parts").rstrip()
    + f", {MERGED} SELECT DISTINCT v.id, d.text, m.merged AS topic FROM vectors v JOIN mapping m ON v.id % 3 + 1 = m.part AND v.topic = m.topic JOIN documents d ON d.doc_id = v.id"
)
def documents_with_merged_topic(t: Tables) -> DataFrame:
    """Document texts with their topic after the merge."""
    parted = roles.vectors(t).select("id", "topic", (F.col("id") % 3 + 1).alias("part"))
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    return document_info(texts, remap_documents(parted, merged(t)), text="text")


TRIPLES = r"""words AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents),
word_counts AS (SELECT doc_id, lang, ' ' || w || ' ' AS p, count(*) AS c FROM words GROUP BY ALL),
tri AS (SELECT doc_id, lang, triple, sum(c) AS c FROM (SELECT doc_id, lang, c, unnest(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS triple FROM word_counts) GROUP BY ALL),
by_lang AS (SELECT lang, triple, sum(c) AS n FROM tri GROUP BY ALL),
feats AS (SELECT DISTINCT triple FROM by_lang),
totals AS (SELECT lang, sum(n) AS total FROM by_lang JOIN feats USING (triple) GROUP BY lang),
profile AS (SELECT t.lang AS language, f.triple, CAST(round(ln((coalesce(b.n, 0) + 1) / (total + (SELECT count(*) FROM feats))) * 1000000) AS BIGINT) AS logp
  FROM feats f, totals t LEFT JOIN by_lang b ON b.lang = t.lang AND b.triple = f.triple)"""


@query(f"WITH {TRIPLES} SELECT language, triple, logp / 1000000 AS logp FROM profile", doubles="logp")
def language_profiles(t: Tables) -> DataFrame:
    profile = language_profile(t.documents, "text", "lang")
    return profile.withColumn("logp", F.col("logp") / 1_000_000)


@query(
    f"""WITH {TRIPLES}, scored AS (SELECT doc_id, language, sum(c * logp) AS s FROM tri JOIN profile p USING (triple) GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, language) AS rn FROM scored) WHERE rn = 1)
    SELECT d.doc_id, b.language, b.s / 1000000 AS score FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id""",
    doubles="score",
)
def identified_language(t: Tables) -> DataFrame:
    """Language of whole texts from profiles learned on the labelled documents."""
    profile = language_profile(t.documents, "text", "lang")
    return identify_language(t.documents.select("doc_id", "text"), "doc_id", "text", profile)


@query()
def hashed_text_vectors(t: Tables) -> DataFrame:
    """Unit vectors of hashed words and pairs; no SQL counterpart for the hash."""
    vectors = hashed_embedding(t.documents, "doc_id", "text", 64)
    return vectors.select("doc_id", F.transform("vec", lambda x: F.round(x.cast("double"), 6)).alias("vec"))


def _length_encoder():
    """An encoder of three text measures: characters, words, characters in words."""
    import numpy as np

    def encode(texts: list[str]) -> np.ndarray:
        words = [t.split() for t in texts]
        return np.array([[len(t), len(w), sum(map(len, w))] for t, w in zip(texts, words)], dtype=np.float32)

    return encode


@query(
    r"""SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\S+')) AS words,
    CAST(coalesce(list_sum([length(w) for w in regexp_extract_all(text, '\S+')]), 0) AS BIGINT) AS in_words FROM documents"""
)
def encoder_vectors(t: Tables) -> DataFrame:
    """Vectors from a batch encoder that each task loads once."""
    return embed(t.documents, "doc_id", "text", _length_encoder).select(
        "doc_id", F.col("vec")[0].cast("bigint").alias("chars"), F.col("vec")[1].cast("bigint").alias("words"), F.col("vec")[2].cast("bigint").alias("in_words")
    )


@query()
def modelled_topics(t: Tables) -> DataFrame:
    """Partition, embed, cluster, reassign, merge and describe in one run; clustering is iterative."""
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    model = model_topics(texts, 0.03, part_size=2_500, min_samples=3, min_cluster_size=5, stop=STOP)
    return model.info.select("topic", "count", "label")


@query(
    r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS square FROM documents""",
    doubles="square",
)
def hashed_vector_lengths(t: Tables) -> DataFrame:
    """Hashed vectors have unit length, or none where a text has no words."""
    vectors = hashed_embedding(t.documents, "doc_id", "text", 64)
    return vectors.select("doc_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 5).alias("square"))


@query("SELECT count(*) AS documents, count(DISTINCT doc_id) AS ids, count(*) AS counted, true AS described, true AS numbered, true AS ordered FROM documents")
def modelled_topic_checks(t: Tables) -> DataFrame:
    """Every document has one topic, the topics' counts add up to the documents, each is described, has a vector and a label."""
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    model = model_topics(texts, 0.03, part_size=2_500, min_samples=3, min_cluster_size=5, stop=STOP)
    info = cut_lineage(model.info)
    real = info.where("topic <> -1").select("topic")
    held = model.documents.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("id").alias("ids"))
    counted = info.agg(F.sum("count").alias("counted"), F.bool_and(F.col("label").startswith(F.concat(F.col("topic").cast("string"), F.lit(" - ")))).alias("described"))
    vectors = model.centroids.select(F.col("topic").cast("int").alias("topic"))
    apart = real.join(vectors, "topic", "left_anti").unionByName(real.groupBy("topic").count().where("count > 1").select("topic")).agg((F.count(F.lit(1)) == 0).alias("numbered"))
    rising = model.weights.agg((F.min("weight") >= 0).alias("ordered"))
    return held.join(counted).join(apart).join(rising)
