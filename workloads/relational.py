"""Joins, memberships, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.functions.text import doi_key, safe_int, strip_quotes
from pubmeter.operators.counting import (
    distinct_counts,
    dominant_category,
    frequency,
    share_of_total,
    share_where,
    share_within,
    unpivot_all,
    weighted_mean,
)
from pubmeter.operators.membership import group_any, members, non_members, with_flag
from pubmeter.operators.ordering import average_rank, extremes, first_per_key, level_order, sequence_id, top_with_ties
from pubmeter.operators.skew import skew_join
from pubmeter.plans.matching import first_addresses, primary_topics, with_domain
from workloads import roles
from workloads.registry import Tables, query
from workloads.roles import prelude


# --- joins --------------------------------------------------------------------------------------------


@query(
    """SELECT p_size % 6 AS domain_id, count(*) AS n, sum(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    doubles="score",
)
def inner_join(t: Tables) -> DataFrame:
    joined = skew_join(roles.work_topics(t), roles.topics(t).select("topic_id", "domain_id"), "topic_id", "inner", roles.work_topics(t))
    return joined.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query(
    prelude("pubs", "works")
    + """SELECT count(*) AS n, count(DISTINCT w.work_id) AS works FROM (SELECT DISTINCT doi, title FROM pubs) p
    RIGHT JOIN works w ON w.title = p.title WHERE p.title IS NOT NULL AND p.doi <> ''"""
)
def outer_join_filtered(t: Tables) -> DataFrame:
    """An outer join whose optional side is then required is written as the inner join it is."""
    listed = roles.pubs(t).where(F.col("doi") != "").select("doi", "title").distinct()
    held = roles.works(t).select("title", "work_id")
    joined = skew_join(held, listed, "title", "inner", held.select("title"))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("work_id").alias("works"))


@query(
    prelude("pubs", "works")
    + """SELECT DISTINCT p.doi, w.work_id FROM (SELECT DISTINCT doi FROM pubs WHERE doi <> '') p JOIN works w ON lower(p.doi) = lower(w.doi)"""
)
def case_insensitive_join(t: Tables) -> DataFrame:
    listed = roles.pubs(t).where(F.col("doi") != "").select("doi", F.lower("doi").alias("k")).distinct()
    held = roles.works(t).select(F.lower("doi").alias("k"), "work_id")
    return skew_join(held, listed, "k", "inner", held.select("k")).select("doi", "work_id").distinct()


@query(
    prelude("pubs", "quoted_dois", "identifiers")
    + """SELECT q.doi, i.article_id FROM quoted_dois q JOIN identifiers i ON replace(replace(q.doi, '"', ''), '''', '') = i.identifier
    WHERE i.identifier <> ''"""
)
def cleaned_key_join(t: Tables) -> DataFrame:
    """Quotes are taken off into a key column before the join."""
    listed = roles.quoted_dois(t).withColumn("identifier", strip_quotes(F.col("doi"))).where(F.col("identifier") != "")
    held = roles.identifiers(t).select("identifier", "article_id")
    return skew_join(held, listed, "identifier", "inner", held.select("identifier")).select("doi", "article_id")


@query(
    prelude("pubs", "works")
    + """SELECT p.title, p.year, w.work_id FROM (SELECT DISTINCT title, year FROM pubs) p
    JOIN works w ON p.title = w.title AND try_cast(p.year AS BIGINT) = w.publication_year"""
)
def composite_key_join(t: Tables) -> DataFrame:
    listed = roles.pubs(t).select("title", "year").distinct().withColumn("publication_year", safe_int(F.col("year")))
    held = roles.works(t).select("title", F.col("publication_year").cast("bigint").alias("publication_year"), "work_id")
    return skew_join(held, listed, ["title", "publication_year"], "inner", held.select("title", "publication_year")).select("title", "year", "work_id")


@query(prelude("work_topics", "topics", "primary_topic") + "SELECT * FROM primary_topic")
def primary_topic(t: Tables) -> DataFrame:
    """Best-scored topic per work; equal scores go to the smaller topic."""
    return primary_topics(roles.work_topics(t), roles.topics(t))


@query(
    prelude("works", "work_topics", "topics", "domains", "primary_topic")
    + """SELECT w.work_id, d.domain FROM works w LEFT JOIN primary_topic p ON w.work_id = p.work_id LEFT JOIN domains d ON p.domain_id = d.domain_id"""
)
def topic_domain_chain(t: Tables) -> DataFrame:
    """Left joins from work to topic to domain; the constant rank condition is applied before the join."""
    best = primary_topics(roles.work_topics(t), roles.topics(t))
    return with_domain(roles.works(t).select("work_id"), best, roles.domains(t))


@query(
    prelude("authorships", "institutions", "authors")
    + """SELECT DISTINCT a.work_id, a.author_id, au.author_name, i.institution_name FROM authorships a
    JOIN institutions i ON a.institution_id = i.institution_id LEFT JOIN authors au ON a.author_id = au.author_id WHERE i.country = 'NATION_3'"""
)
def authorship_chain(t: Tables) -> DataFrame:
    home = roles.institutions(t).where(F.col("country") == roles.COUNTRY).select("institution_id", "institution_name")
    local = skew_join(roles.authorships(t), home, "institution_id", "inner", roles.authorships(t)).drop("institution_id").distinct()
    return skew_join(local, roles.authors(t), "author_id", "left", roles.authorships(t))


@query(
    """SELECT o.o_orderkey, l.n FROM orders o LEFT JOIN (SELECT 'ORD:' || l_orderkey AS ut, count(*) AS n FROM lineitem GROUP BY 1) l
    ON l.ut = 'ORD:' || o.o_orderkey"""
)
def computed_key_join(t: Tables) -> DataFrame:
    sized = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    keyed = sized.select(F.concat(F.lit("ORD:"), "l_orderkey").alias("ut"), "n")
    left = t.orders.select("o_orderkey", F.concat(F.lit("ORD:"), "o_orderkey").alias("ut"))
    return left.join(keyed, "ut", "left").drop("ut")


@query(
    prelude("address_names", "addresses")
    + """SELECT DISTINCT f.article_id, f.author_seq, f.address_no, a.institution, a.country FROM
    (SELECT article_id, author_seq, min(address_no) AS address_no FROM address_names GROUP BY ALL) f
    LEFT JOIN addresses a ON a.article_id = f.article_id AND a."order" = f.address_no"""
)
def first_address_bridge(t: Tables) -> DataFrame:
    """The smallest address number per author leads to the address."""
    first = first_addresses(roles.address_names(t))
    places = roles.addresses(t).withColumnRenamed("order", "address_no").distinct()
    return first.join(places, ["article_id", "address_no"], "left")


@query(
    prelude("articles", "disciplines")
    + "SELECT a.article_id, d.specialty, d.discipline FROM articles a LEFT JOIN disciplines d ON a.discipline_code = d.discipline_code"
)
def lookup_enrichment(t: Tables) -> DataFrame:
    """A lookup below the broadcast threshold, which the optimizer checks, is broadcast; a larger one is shuffled."""
    listed = roles.articles(t).select("article_id", "discipline_code")
    return listed.join(roles.disciplines(t), "discipline_code", "left").drop("discipline_code")


@query(
    prelude("doc_topic", "meta", "language")
    + "SELECT d.id, topic, doi, language FROM doc_topic d LEFT JOIN meta m ON d.id = m.id LEFT JOIN language l ON d.id = l.id"
)
def same_name_left_join(t: Tables) -> DataFrame:
    return roles.doc_topic(t).join(roles.meta(t), "id", "left").join(roles.language(t), "id", "left")


@query(
    prelude("inference")
    + """SELECT DISTINCT l_orderkey AS title, l_suppkey AS list_author, gender FROM lineitem LEFT JOIN inference ON l_suppkey = author_id"""
)
def renamed_key_left_join(t: Tables) -> DataFrame:
    people = t.lineitem.select(F.col("l_orderkey").alias("title"), F.col("l_suppkey").alias("list_author"))
    known = roles.inference(t).withColumnRenamed("author_id", "list_author")
    return skew_join(people.distinct(), known, "list_author", "left", people)


@query(
    """SELECT a.event_type, a.user_id, a.total, b.n FROM (SELECT event_type, user_id, sum(value) AS total FROM events GROUP BY ALL) a
    LEFT JOIN (SELECT event_type, user_id, count(*) AS n FROM events WHERE value > 20 GROUP BY ALL) b
    ON a.event_type = b.event_type AND a.user_id = b.user_id""",
    doubles="total",
)
def two_key_left_join(t: Tables) -> DataFrame:
    """Both sides are aggregates on the same keys, so the join needs no shuffle of its own."""
    keys = ["event_type", "user_id"]
    sums = t.events.groupBy(*keys).agg(F.sum("value").alias("total"))
    large = t.events.where(F.col("value") > 20).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sums.join(large, keys, "left")


@query("SELECT doc_id, lang, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def semi_join(t: Tables) -> DataFrame:
    return members(t.documents.select("doc_id", "lang", "source"), t.labels.where("quality = 1"), "doc_id")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(t: Tables) -> DataFrame:
    return non_members(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id")


@query(
    prelude("meta", "identifiers", "articles", "disciplines", "matches_b")
    + "SELECT id, doi, doi IS NOT NULL AND EXISTS (SELECT 1 FROM matches_b b WHERE b.doi = m.doi) AS matched FROM meta m"
)
def membership_flag(t: Tables) -> DataFrame:
    return with_flag(roles.meta(t), roles.matches_b(t), "doi", "matched")


@query("SELECT d.doc_id, d.lang, e.label AS topic FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def bind_by_id(t: Tables) -> DataFrame:
    """Columns of two tables side by side, by key instead of by position."""
    return t.documents.select("doc_id", "lang").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic")), "doc_id")


@query(
    prelude("pubs", "identifiers")
    + """SELECT count(DISTINCT i.article_id) AS n FROM (SELECT DISTINCT lower(trim(replace(replace(doi, '"', ''), '''', ''))) AS k FROM pubs WHERE doi <> '') p
    JOIN identifiers i ON lower(i.identifier) = p.k WHERE i.identifier <> ''"""
)
def normalised_doi_join(t: Tables) -> DataFrame:
    """Both sides normalised, so that prefixed or quoted spellings match too."""
    listed = roles.pubs(t).select(doi_key(F.col("doi")).alias("k")).where(F.col("k").isNotNull()).distinct()
    held = roles.identifiers(t).select(doi_key(F.col("identifier")).alias("k"), "article_id")
    return skew_join(held, listed, "k", "inner", held.select("k")).agg(F.count_distinct("article_id").alias("n"))


# --- aggregates ---------------------------------------------------------------------------------------


@query(prelude("pubs") + "SELECT DISTINCT title, doi, year FROM pubs")
def distinct_rows(t: Tables) -> DataFrame:
    return roles.pubs(t).select("title", "doi", "year").distinct()


@query(
    prelude("pubs")
    + """SELECT title, year, doi, issn FROM (SELECT title, year, doi, issn, row_number() OVER (PARTITION BY title ORDER BY year, doi NULLS LAST, issn) AS rn
    FROM pubs) WHERE rn = 1"""
)
def one_row_per_title(t: Tables) -> DataFrame:
    return first_per_key(roles.pubs(t).select("title", "year", "doi", "issn"), ["title"])


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey")
def distinct_per_group(t: Tables) -> DataFrame:
    return distinct_counts(t.lineitem, ["l_suppkey"], "l_orderkey")


@query(prelude("pubs") + "SELECT count(*) AS n_rows, count(DISTINCT doi) AS dois, count(DISTINCT author_id) AS authors FROM pubs")
def global_counts(t: Tables) -> DataFrame:
    p = roles.pubs(t)
    dois = distinct_counts(p, [], "doi").scalar()
    authors = distinct_counts(p, [], "author_id").scalar()
    return p.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", dois.alias("dois"), authors.alias("authors"))


@query(
    """SELECT l_suppkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned,
      count(DISTINCT CASE WHEN l_quantity > 40 THEN l_orderkey END) AS large, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey"""
)
def conditional_distinct(t: Tables) -> DataFrame:
    """Several conditional distinct counts from one pass and one shuffle of flags."""
    return distinct_counts(
        t.lineitem, ["l_suppkey"], "l_orderkey", {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 40}
    )


@query(
    prelude("doc_topic", "language")
    + """SELECT topic, count(DISTINCT CASE WHEN language = 'en' THEN d.id END) + max(CASE WHEN language IS NULL THEN 1 ELSE 0 END) AS n_en, count(DISTINCT d.id) AS n
    FROM doc_topic d LEFT JOIN language l ON d.id = l.id GROUP BY topic"""
)
def distinct_with_missing(t: Tables) -> DataFrame:
    """The rule by which a missing value is one more distinct value."""
    joined = roles.doc_topic(t).join(roles.language(t), "id", "left")
    return distinct_counts(joined, ["topic"], "id", {"n_en": F.col("language") == "en"}, missing_counts=True)


@query(
    """SELECT count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) / count(DISTINCT l_orderkey) AS share FROM lineitem""",
    doubles="share",
)
def distinct_ratio(t: Tables) -> DataFrame:
    counts = distinct_counts(t.lineitem, [], "l_orderkey", {"returned": F.col("l_returnflag") == "R"})
    return counts.select(F.try_divide("returned", "n").alias("share"))


@query(prelude("language") + "SELECT language, count(*) AS n FROM language WHERE language IS NOT NULL GROUP BY language")
def frequency_table(t: Tables) -> DataFrame:
    return frequency(roles.language(t), "language")


@query("SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey", doubles="total")
def sum_per_group(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))


@query(
    "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / sum(l_quantity) AS p FROM lineitem GROUP BY l_suppkey",
    doubles="p",
)
def conditional_share(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(share_where(F.col("l_quantity"), F.col("l_returnflag") == "R").alias("p"))


@query(prelude("fractions") + "SELECT o_custkey, avg(Women) AS m, count(*) AS n FROM orders LEFT JOIN fractions f ON o_orderkey = f.id GROUP BY o_custkey", doubles="m")
def mean_of_known(t: Tables) -> DataFrame:
    """Mean over the rows that have a value."""
    joined = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey").join(roles.fractions(t), "id", "left")
    return joined.groupBy("o_custkey").agg(F.avg("Women").alias("m"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_suppkey, sum(l_discount * l_quantity) / sum(l_quantity) AS m FROM lineitem GROUP BY l_suppkey""",
    doubles="m",
)
def weighted_means(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("m"))


@query(
    """SELECT l_orderkey, l_suppkey, bool_or(l_quantity > 48) OVER (PARTITION BY l_orderkey) AS some_large
    FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_quantity FROM lineitem)"""
)
def any_per_group(t: Tables) -> DataFrame:
    """A group's flag on all its rows, without holding a group in one task."""
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity").distinct()
    return group_any(rows, "l_orderkey", F.col("l_quantity") > 48, "some_large", t.lineitem).drop("l_quantity")


@query(
    """SELECT (sum(CASE WHEN event_type IN ('click', 'view') THEN n ELSE 0 END) + 1000 * 0.42) / sum(n) AS bound
    FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""",
    doubles="bound",
)
def subset_sum_over_total(t: Tables) -> DataFrame:
    counts = frequency(t.events, "event_type")
    part = F.sum(F.when(F.col("event_type").isin("click", "view"), F.col("n")).otherwise(0))
    return counts.agg(((part + 1000 * 0.42) / F.sum("n")).alias("bound"))


@query(
    """SELECT l_orderkey, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS A, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS R
    FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey""",
    doubles="A R",
)
def pivot_fixed_values(t: Tables) -> DataFrame:
    kept = t.lineitem.where(F.col("l_returnflag").isin("A", "R"))
    return kept.groupBy("l_orderkey").pivot("l_returnflag", ["A", "R"]).agg(F.sum("l_quantity")).fillna(0, ["A", "R"])


@query(
    """SELECT o_custkey, 'total' AS measure, sum(o_totalprice) AS value FROM orders GROUP BY 1
    UNION ALL SELECT o_custkey, 'largest', max(o_totalprice) FROM orders GROUP BY 1""",
    doubles="value",
)
def unpivot_named(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("largest"))
    return wide.unpivot(["o_custkey"], ["total", "largest"], "measure", "value")


@query(
    """SELECT 'quantity' AS measure, avg(l_quantity) AS value FROM lineitem UNION ALL SELECT 'discount', avg(l_discount) FROM lineitem
    UNION ALL SELECT 'tax', avg(l_tax) FROM lineitem""",
    doubles="value",
)
def unpivot_every_column(t: Tables) -> DataFrame:
    wide = t.lineitem.agg(*[F.avg(f"l_{c}").alias(c) for c in ("quantity", "discount", "tax")])
    return unpivot_all(wide, [], "measure", "value")


# --- shares, ranks, order -----------------------------------------------------------------------------


@query(
    """SELECT *, n / sum(n) OVER (PARTITION BY l_suppkey) AS p FROM
    (SELECT l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL)""",
    doubles="p",
)
def share_in_group(t: Tables) -> DataFrame:
    return share_within(distinct_counts(t.lineitem, ["l_suppkey", "l_returnflag"], "l_orderkey"), "n", ["l_suppkey"])


@query("SELECT *, n / sum(n) OVER () AS p FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY ALL)", doubles="p")
def share_of_grand_total(t: Tables) -> DataFrame:
    return share_of_total(distinct_counts(t.orders, ["o_custkey"], "o_orderkey"), "n")


@query(
    """SELECT l_suppkey, CASE WHEN max(n) / sum(n) < 0.35 THEN 'Mixed' ELSE (array_agg(l_returnflag ORDER BY n DESC, l_returnflag DESC))[1] END AS flag
    FROM (SELECT l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey"""
)
def dominant_value(t: Tables) -> DataFrame:
    counts = distinct_counts(t.lineitem.withColumnRenamed("l_returnflag", "flag"), ["l_suppkey", "flag"], "l_orderkey")
    return dominant_category(counts, "l_suppkey", "flag", "n", 0.35, "Mixed")


@query(
    """SELECT l_quantity, count(*) AS n, any_value(r) AS rank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity)
    + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem) GROUP BY l_quantity""",
    doubles="l_quantity rank",
)
def average_ranks(t: Tables) -> DataFrame:
    return average_rank(t.lineitem, "l_quantity")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS topic FROM customer")
def zero_based_ids(t: Tables) -> DataFrame:
    return sequence_id(t.customer.select("c_custkey"), "c_custkey")


@query("SELECT u.user_id || ':' || u.event_id AS name, row_number() OVER (ORDER BY u.user_id || ':' || u.event_id) - 1 AS topic FROM events u")
def zero_based_text_ids(t: Tables) -> DataFrame:
    """Ids by position in the order of a text key."""
    name = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_id").cast("string"))
    return sequence_id(t.events.select(name.alias("name")), "name")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, rank() OVER (ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 25", doubles="l_quantity")
def top_rows_with_ties(t: Tables) -> DataFrame:
    """Ties of the last value are all kept, however many."""
    return top_with_ties(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), "l_quantity", 25)


@query("SELECT s_suppkey, s_acctbal FROM (SELECT *, rank() OVER (ORDER BY s_acctbal) AS r FROM supplier) WHERE r <= 25", doubles="s_acctbal")
def bottom_rows_with_ties(t: Tables) -> DataFrame:
    return top_with_ties(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", 25, ascending=True)


@query(
    """SELECT o_custkey, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) WHERE r <= 10
    UNION ALL SELECT o_custkey, n FROM (SELECT *, rank() OVER (ORDER BY n) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) WHERE r <= 10"""
)
def extreme_rows(t: Tables) -> DataFrame:
    return extremes(frequency(t.orders, "o_custkey"), "n", 10)


@query("SELECT event_type, avg(value) AS p FROM events GROUP BY event_type ORDER BY p DESC", doubles="p")
def ordered_by_measure(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.avg("value").alias("p")).orderBy(F.desc("p"))


@query(
    """SELECT c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 3 END AS ord, count(*) AS n
    FROM customer GROUP BY c_mktsegment ORDER BY ord DESC"""
)
def ordered_by_level(t: Tables) -> DataFrame:
    """An explicit category order, reversed; categories outside it have no place."""
    counts = frequency(t.customer, "c_mktsegment")
    ordered = counts.withColumn("ord", level_order(F.col("c_mktsegment"), ["MACHINERY", "BUILDING", "HOUSEHOLD"]))
    return ordered.orderBy(F.desc("ord"))


# --- set operations -----------------------------------------------------------------------------------


@query(
    """SELECT name, kind, balance FROM (SELECT c_name AS name, 'customer' AS kind, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_name, 'supplier', s_acctbal FROM supplier UNION ALL SELECT n_name, 'nation', NULL FROM nation)""",
    doubles="balance",
)
def union_by_name(t: Tables) -> DataFrame:
    """Columns meet by name, absent ones are missing."""
    people = t.customer.select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    firms = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    places = t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return people.unionByName(firms).unionByName(places, allowMissingColumns=True)


@query("SELECT text FROM documents UNION SELECT text FROM conversations UNION SELECT text FROM benchmark")
def union_distinct(t: Tables) -> DataFrame:
    return t.documents.select("text").unionByName(t.conversations.select("text")).unionByName(t.benchmark.select("text")).distinct()


@query(prelude("works", "pubs") + "SELECT work_id, title FROM works w WHERE NOT EXISTS (SELECT 1 FROM pubs p WHERE p.title = w.title)")
def difference(t: Tables) -> DataFrame:
    return non_members(roles.works(t).select("work_id", "title"), roles.pubs(t), "title")


@query(
    """SELECT in_prev, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM
    (SELECT DISTINCT o_custkey, o_custkey IN (SELECT s_suppkey FROM supplier) AS in_prev FROM orders) GROUP BY in_prev""",
    doubles="p",
)
def overlap_share(t: Tables) -> DataFrame:
    flagged = with_flag(t.orders.select("o_custkey").distinct(), t.supplier, "o_custkey", "in_prev", "s_suppkey")
    return share_of_total(distinct_counts(flagged, ["in_prev"], "o_custkey"), "n")
