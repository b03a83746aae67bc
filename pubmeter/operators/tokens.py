"""Words, word pairs and their weights per topic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.functions.text import tokens
from pubmeter.functions.vectors import cosine
from pubmeter.operators.neighbours import nearest
from pubmeter.operators.ordering import first_rows
from pubmeter.session import cut_lineage

# Languages whose common words are dropped, as named by Spark.
STOP_LANGUAGES = (
    "danish dutch english finnish french german hungarian italian norwegian portuguese russian spanish swedish turkish"
).split()

# Words of publishing boilerplate that never describe a topic. Only single words are listed: the
# tokens are tested one by one, before word pairs are made.
PUBLISHING_WORDS = """
ttttusepackage amssymb amsmath mathrsfs amsbsy amsfonts oddsidemargin wasysym 69pt upgreek 12pt documentclass
ttttbegin ttttsetlength document mso font tstyle 4pt 0pt style 0cm margin calibri 0001pt qformat msonormaltable
pagination rowband size 0400 colband bottom netcommons retraction retracted elsevier iop withdrawn conference
proceedings welcome committee workshop ieee listing publication editorial reviewers editor submissions editors
reviewer resumen introducción método resultados discusión conclusión agradecimientos referencias abstract keywords
introduction method results discussion conclusion acknowledgements references corrects erratum corrigendum pp isbn
press book london cambridge edited advertisement org cacm collabratec interests revista maple resúmenes reseña
artigo resumo partir palavras trabalho estudo análise conclusões referências catalog online presenta economía
artículo artikkelen artiklen journal http acm blog vol cet cette article dx 3329 4038 dermatol br 185 我们发现 cadi
articles week papers note scipost submission journals contiene resúmen instructions publishing reply comment replies
chez cas étude traitement résultats travail être prise après cover image 1002 ressenya paraules clau resum estudi
incluyeron número clave palabras zusammenfassung
""".split()

MIN_DF = 0.001
MAX_DF = 0.8
TOP_TERMS = 10
# Bytes of counts that a task gathers before it combines them, and of combined counts that it goes on with.
GATHERED, HELD = 64_000_000, 32_000_000
# Bytes of words that a task gathers before it counts them into blocks, and texts that it adds at a time.
WORDS_GATHERED, TEXTS = 32_000_000, 1_000
# Buckets of terms for each partition of a shuffle: one is merged in memory at a time. Pairs of one first word lie in so many of them.
BUCKETS, SPLITS = 8, 16


def stop_words(extra: Sequence[str] = PUBLISHING_WORDS) -> list[str]:
    """The common words of all stop languages and the extra ones."""
    words = {w.lower() for language in STOP_LANGUAGES for w in StopWordsRemover.loadDefaultStopWords(language)}
    return sorted(words | set(extra))


def terms(df: DataFrame, text: str, stop: Sequence[str] | None = None, output: str = "terms") -> DataFrame:
    """Adds the array of single words and neighbouring word pairs left after the stop words."""
    pairs = NGram(n=2, inputCol="_kept", outputCol="_pairs").transform(kept_words(df, text, stop, "_kept"))
    return pairs.withColumn(output, F.concat("_kept", "_pairs")).drop("_kept", "_pairs")


def kept_words(df: DataFrame, text: str, stop: Sequence[str] | None = None, output: str = "words") -> DataFrame:
    """Adds the array of the words left after the stop words."""
    words = df.withColumn("_words", tokens(F.col(text)))
    remover = StopWordsRemover(
        inputCol="_words", outputCol=output, stopWords=list(stop if stop is not None else stop_words()), caseSensitive=True
    )
    return remover.transform(words).drop("_words")


def term_counts(df: DataFrame, topic: str, text: str, stop: Sequence[str] | None = None, uses: bool = False) -> DataFrame:
    """``topic, term, n``: counts are combined in each map task, and meet by term.

    All counts of a term lie in one partition, so what is grouped by term from here on is not shuffled again. With ``uses`` they travel
    as compressed blocks, a third of their size, and have the columns ``df, f, place`` of :func:`term_uses` from where they meet.
    """
    if uses:
        return _counts_with_uses(df, topic, text, stop)
    listed = terms(df.select(topic, text), text, stop).select(topic, "terms")
    names = [topic, "term", "n"]

    def counted(batch: pa.RecordBatch) -> pa.Table:
        words = batch.column(1)
        rows = pa.Table.from_arrays([batch.column(0).take(pc.list_parent_indices(words)), pc.list_flatten(words)], names[:2])
        return rows.group_by(names[:2], use_threads=False).aggregate([([], "count_all")]).select([*names[:2], "count_all"]).rename_columns(names)

    def combined(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(names[:2], use_threads=False).aggregate([("n", "sum")]).select([*names[:2], "n_sum"]).rename_columns(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(counted(batch))
            size += held[-1].nbytes
            if size > GATHERED:
                held = [combined(held)]
                size = held[0].nbytes
                if size > HELD:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from combined(held).to_batches()

    schema = T.StructType([listed.schema[topic], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    parts = listed.mapInArrow(count, schema).repartition("term")
    # one sort in place of a hash table of all counts of a partition, and what follows finds its rows in order
    same = Window.partitionBy("term", topic)
    summed = parts.select(topic, "term", F.sum("n").over(same).alias("n"), F.row_number().over(same.orderBy("n")).alias("_place"))
    return summed.where("_place = 1").drop("_place")


def _counts_with_uses(df: DataFrame, topic: str, text: str, stop: Sequence[str] | None) -> DataFrame:
    """``topic, term, n, df, f, place``: counts of terms with all that is known of the term, one row per topic and term.

    A task counts pairs of word numbers and writes them, sorted, as one compressed block per bucket of terms. Blocks meet by bucket.
    """
    listed = kept_words(df.select(topic, text), text, stop).select(topic, "words")
    buckets = min(BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2**16)
    names = [topic, "term", "n"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                held.append(batch.slice(start, TEXTS))
                size += held[-1].nbytes
                if size > WORDS_GATHERED:
                    yield from blocks(pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
        if held:
            yield from blocks(pa.Table.from_batches(held).combine_chunks())

    def blocks(texts: pa.Table) -> Iterator[pa.RecordBatch]:
        topics, lists = (c.chunk(0) for c in texts.columns)
        topics = topics.dictionary_encode(null_encoding="encode")
        words = lists.flatten().dictionary_encode()
        if not len(words):
            return
        wide, kinds = len(words.dictionary) + 1, len(topics.dictionary)
        if wide * wide * kinds >= 2**63:
            for half in (texts.slice(0, len(texts) // 2), texts.slice(len(texts) // 2)):
                yield from blocks(half.combine_chunks())
            return
        # words by their place in the alphabet, so that neighbours begin alike
        order = pc.sort_indices(words.dictionary)
        spelled, rank = words.dictionary.take(order), np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        word, text = rank[words.indices.to_numpy()], pc.list_parent_indices(lists).to_numpy()
        of = topics.indices.to_numpy().astype(np.int64)[text]
        paired = text[1:] == text[:-1]
        # one number for first word, second word or none, and topic
        pairs = ((word[:-1] * wide + word[1:] + 1) * kinds + of[:-1])[paired]
        keys = np.sort(np.concatenate([word * wide * kinds + of, pairs]))
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.diff(np.r_[starts, len(keys)])
        both, of = np.divmod(keys[starts], kinds)
        first, second = np.divmod(both, wide)
        del keys, starts, both
        code = np.fromiter((zlib.crc32(w.encode()) for w in spelled.to_pylist()), dtype=np.uint64, count=len(spelled))
        split = np.where(second > 0, code[second - 1] % np.uint64(SPLITS) + np.uint64(1), np.uint64(0))
        mixed = (code[first] + split * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, first, second, of, n = (x[order] for x in (bucket, first, second, of, n))
        one, other = spelled.take(pa.array(first)), spelled.take(pa.array(np.maximum(second - 1, 0)))
        term = pc.if_else(pa.array(second > 0), pc.binary_join_element_wise(one, other, " "), one)
        rows = pa.Table.from_arrays([topics.dictionary.take(pa.array(of)), term, pa.array(n, pa.int64())], names)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        written = [written_block(rows.slice(a, b - a)) for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(written, pa.binary())], ["bucket", "block"])

    def written_block(rows: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        pq.write_table(rows, sink, compression="zstd", use_dictionary=[topic], column_encoding={"term": "DELTA_BYTE_ARRAY", "n": "DELTA_BINARY_PACKED"}, write_statistics=False)
        return sink.getvalue().to_pybytes()

    def merged(group: pa.Table) -> pa.Table:
        rows = pa.concat_tables(pq.read_table(pa.BufferReader(b.as_buffer())) for b in group["block"]).combine_chunks()
        topics, term = (rows[c].chunk(0).dictionary_encode(null_encoding="encode") for c in names[:2])
        order = pc.sort_indices(topics.dictionary, null_placement="at_start")
        place = np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        key = term.indices.to_numpy().astype(np.int64) * len(place) + place[topics.indices.to_numpy()]
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.add.reduceat(rows["n"].to_numpy()[by_key], starts)
        spelled, of = np.divmod(key[starts], len(place))
        heads = np.flatnonzero(np.r_[True, spelled[1:] != spelled[:-1]])
        df = np.diff(np.r_[heads, len(spelled)])
        number = np.arange(len(spelled)) - np.repeat(heads, df) + 1
        columns = [topics.dictionary.take(order).take(pa.array(of)), term.dictionary.take(pa.array(spelled)), pa.array(n), pa.array(np.repeat(df, df)), pa.array(np.repeat(np.add.reduceat(n, heads), df)), pa.array(number, pa.int32())]
        return pa.Table.from_arrays(columns, [*names, "df", "f", "place"])

    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([listed.schema[topic], T.StructField("term", T.StringType()), long("n"), long("df"), long("f"), T.StructField("place", T.IntegerType())])
    return listed.mapInArrow(packed, "bucket int, block binary").groupBy("bucket").applyInArrow(merged, schema)


def term_uses(counts: DataFrame, topic: str = "topic", min_df: float = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """``topic, term, n, df, f, place``: counts of terms used by a share of the topics between the limits, with the term's number
    of topics and total count, numbered from 1 within the term. All counts are written out once, before the limits apply.
    """
    if {"df", "f", "place"} <= set(counts.columns):
        known = counts
    else:
        # terms are counted once per topic already
        term = Window.partitionBy("term")
        known = counts.select(topic, "term", "n", F.count(F.lit(1)).over(term).alias("df"), F.sum("n").over(term).alias("f"), F.row_number().over(term.orderBy(topic)).alias("place"))
    used = cut_lineage(known, compression="zstd")
    topics = used.agg(F.count_distinct(topic).alias("t")).scalar()
    return used.where((F.col("df") >= topics * min_df) & (F.col("df") <= topics * max_df))


def vocabulary(counts: DataFrame, topic: str = "topic", min_df: float = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """``term, df, f``: terms used by a share of the topics between the limits, with their total count."""
    return term_uses(counts, topic, min_df, max_df).where("place = 1").select("term", "df", "f")


def class_tfidf(
    counts: DataFrame, topic: str = "topic", min_df: float = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    """``topic, term, n, weight``: share of the term in its topic times ln(1 + A / f).

    A is the whole part of the mean number of kept terms per topic and f the total count of the term.
    """
    kept = term_uses(counts, topic, min_df, max_df).where(F.col("term").isNotNull())
    # a small table, written so that its size is known: the weights then stay where they are, and no topic meets in one task
    sizes = cut_lineage(kept.groupBy(topic).agg(F.sum("n").alias("_size")))
    average = sizes.agg(F.floor(F.avg("_size")).alias("a")).scalar()
    weight = F.col("n") / F.col("_size") * F.log1p(average / F.col("f"))
    return kept.join(sizes, topic).select(topic, "term", "n", weight.alias("weight"))


def top_terms(weights: DataFrame, topic: str = "topic", k: int = TOP_TERMS) -> DataFrame:
    """The ``k`` heaviest terms of each topic with their rank; ties in alphabetical order."""
    # rounded so that the order of a sum cannot swap equal weights
    order = [F.desc(F.round("weight", 12)), F.asc("term")]
    return first_rows(weights, [topic], order, k, "rank")


def rerank_terms(
    candidates: DataFrame, term_vectors: DataFrame, centroids: DataFrame, topic: str = "topic", k: int = TOP_TERMS
) -> DataFrame:
    """``topic, term, similarity, rank``: each topic's candidate terms by closeness of vector to the topic's.

    ``term_vectors`` is (term, vec), ``centroids`` (topic, vec); only a topic's own candidates are compared.
    """
    paired = candidates.select(topic, "term").distinct().join(term_vectors.withColumnRenamed("vec", "_tv"), "term")
    scored = paired.join(centroids.select(topic, F.col("vec").alias("_cv")), topic)
    similar = scored.select(topic, "term", F.round(F.coalesce(cosine(F.col("_tv"), F.col("_cv")), F.lit(0.0)), 9).alias("similarity"))
    return first_rows(similar, [topic], [F.desc("similarity"), F.asc("term")], k, "rank")


def topic_info(doc_topic: DataFrame, top: DataFrame, topic: str = "topic") -> DataFrame:
    """``topic, count, representation``: size and ranked terms of each topic."""
    sizes = doc_topic.groupBy(topic).agg(F.count(F.lit(1)).alias("count"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))  # at most k terms per topic
    words = top.groupBy(topic).agg(F.transform(ranked, lambda t: t["term"]).alias("representation"))
    return sizes.join(words, topic, "left")


def topic_labels(info: DataFrame, overrides: DataFrame | None = None, topic: str = "topic", words: int = 3) -> DataFrame:
    """Adds ``label``: the topic id and its first terms, or the given override (topic, label)."""
    head = F.trim(F.array_join(F.slice("representation", 1, words), " "))
    own = F.concat(F.col(topic).cast("string"), F.lit(" - "), F.coalesce(head, F.lit("NA")))
    if overrides is None:
        return info.withColumn("label", own)
    named = overrides.select(F.col(topic), F.col("label").alias("_label"))
    return info.join(named, topic, "left").withColumn("label", F.coalesce("_label", own)).drop("_label")


def reduce_outliers(
    doc_topic: DataFrame,
    centroids: DataFrame,
    threshold: float = 0.1,
    id: str = "id",
    vec: str = "vec",
    by: str | None = None,
    topic: str = "topic",
) -> DataFrame:
    """``id, topic``: outliers move to the most similar topic if its similarity reaches the threshold."""
    keys = [*([by] if by else []), id]
    outliers = doc_topic.where(F.col(topic) == -1).select(*([by] if by else []), F.col(id).alias("_key"), F.col(vec).alias("_vec"))
    targets = centroids.where(F.col(topic) != -1).select(*([by] if by else []), F.col(topic).alias("_key"), F.col("vec").alias("_vec"))
    best = nearest(outliers, targets, 1, "_key", "_vec", by)
    moved = best.where(1 - F.col("distance") >= threshold).select(F.col("id").alias("_id"), F.col("neighbour").alias("_new"))
    joined = doc_topic.select(*keys, topic).join(moved, F.col(id) == F.col("_id"), "left")
    return joined.select(*keys, F.coalesce(F.col("_new").cast("int"), F.col(topic)).alias(topic))


def topic_centroids(doc_vectors: DataFrame, topic: str = "topic", vec: str = "vec", by: str | None = None) -> DataFrame:
    """``topic, vec, n``: the mean vector of each topic, combined in each map task."""
    keys = [*([by] if by else []), topic]
    v = array_to_vector(F.transform(vec, lambda x: x.cast("double")))
    means = doc_vectors.select(*keys, v.alias("_v")).groupBy(*keys).agg(
        Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n")
    )
    return means.select(*keys, vector_to_array("_m").alias("vec"), "n")


def pooled_centroids(means: DataFrame, topic: str = "topic", by: str | None = None) -> DataFrame:
    """``topic, vec, n``: the mean vector of each topic, of the means ``vec`` of ``n`` vectors each."""
    keys = [*([by] if by else []), topic]
    weighted = means.select(*keys, array_to_vector("vec").alias("_v"), "n").groupBy(*keys).agg(
        Summarizer.mean(F.col("_v"), F.col("n").cast("double")).alias("_m"), F.sum("n").alias("n")
    )
    return weighted.select(*keys, vector_to_array("_m").alias("vec"), "n")
