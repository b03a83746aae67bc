"""Spelling variants: words one edit apart, found by pivotal bigrams, and the frequent form behind each rare one."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.llm.common import in_small_batches
from pubmeter.operators.ordering import row_index
from pubmeter.session import cut_lineage

# Code points and occurrences from which on a word counts.
LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form is this many times as frequent as its variant.
RATIO = 10
# With one edit, two disjoint bigrams are pivots; they are taken from the three rarest, of which two are always disjoint.
PREFIX = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Counters of bigrams for the order of rarity: a table of a fixed size. Bigrams that share one count as equally frequent.
SLOTS = 1 << 16
# Pieces of what lies on one side of a surviving pivot; the edit is in one of them, all others are equal.
PIECES = 3
# Words that a task marks and cuts.
WORDS_PER_TASK = 20_000
# More than any sum of counts.
FAR = 1 << 60


def letter_runs(text: Column) -> Column:
    """The maximal runs of Latin letters (A-Z, a-z and U+00C0 to U+00FF) of ``text``, A-Z in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(0)), lambda run: F.translate(run, UPPER, LOWER))


def without_letter(word: Column, place: Column) -> Column:
    """``word`` without the code point at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place.cast("int")), F.substring(word, (place + 2).cast("int"), F.length(word)))


def count_words(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of at least ``least_length`` code points that occur ``least_count`` times or more.

    ``words`` has one row per occurrence. Counts combine in the map tasks, so a word that is a third of all is no hot key.
    """
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def prefix(word: str, counts: np.ndarray) -> list[tuple[int, int]]:
    """Place and count of the three rarest occurrences of bigrams of ``word``, by place; of one bigram the first are the rarest."""
    grams = ((int(counts[zlib.crc32(word[i : i + 2].encode()) % SLOTS]), word[i : i + 2], i) for i in range(len(word) - 1))
    return sorted((place, count) for count, _, place in heapq.nsmallest(PREFIX, grams))


def widened(word: str, grams: list[tuple[int, int]]) -> list[int]:
    """The places of a prefix and the place after each, where the same bigram stands there too.

    An edit before an occurrence moves it by one place, so where bigrams repeat the last one of a prefix may be followed by
    the one that the other word's prefix ends with.
    """
    places = {place for place, _ in grams}
    return sorted(places | {p + 1 for p in places if word[p + 1 : p + 3] == word[p : p + 2]})


def pivots(grams: list[tuple[int, int]]) -> tuple[int, int]:
    """The places of two disjoint bigrams of the least total count; ``grams`` are places and counts by rising place.

    One pass of dynamic programming: for each bigram the cheapest pair that ends there is its own count and that of the
    cheapest bigram at least two places before.
    """
    before, last, best = (FAR, -1), (FAR, -2), (2 * FAR, -1, -1)
    for place, count in grams:
        # the last bigram overlaps with this one if it starts one place before; every earlier one is disjoint
        free = min(before, last) if last[1] < place - 1 else before
        best = min(best, (free[0] + count, free[1], place))
        before, last = min(before, last), (count, place)
    return best[1:]


def near_words(words: DataFrame) -> DataFrame:
    """``a, b`` with ``a < b``: the numbers of all pairs of words that differ by one inserted, deleted or replaced code point.

    ``words`` is ``id, word``: distinct words of at least four code points, and their numbers. Bigrams are ordered by how many
    words hold one of the same counter. A word's prefix are its three rarest occurrences of bigrams, and its pivots the two
    disjoint ones of the prefix with the least total count. One edit leaves a pivot whole, so of two
    near words the one with the rarer prefix has a pivot in the prefix of the other. The edit lies on one side of it. For each of the
    three possible lengths of the other word that fixes the pivot's place there, and it fixes where the other word's side is cut into
    pieces, one of which holds the edit. So pivots and prefixes meet by equality of (side, length, place, everything but
    that piece), by 64 bits of hash, and the two short pieces are verified by their edit distance. What meets is close to what is near, however
    many words share a bigram.
    """
    in_small_batches(words.sparkSession)
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda place: F.substring("word", place, F.lit(2)))
    slots = F.transform(grams, lambda gram: F.pmod(F.crc32(gram.cast("binary")), F.lit(SLOTS)).cast("int"))
    # at most SLOTS rows, whatever the input
    used = words.select(F.explode(F.array_distinct(slots)).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[used["slot"].to_numpy()] = used["n"].to_numpy()
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(word, shared.value) for word in batch.column(1).to_pylist()]
            chosen = np.array([pivots(f) for f in found], np.int32).reshape(-1, 2)
            places = pa.array([widened(w, f) for w, f in zip(batch.column(1).to_pylist(), found)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places, pa.array(chosen[:, 0]), pa.array(chosen[:, 1])], ["id", "word", "places", "first", "second"])

    parts = 1 + words.count() // WORDS_PER_TASK
    marked = cut_lineage(words.select("id", "word").repartition(parts).mapInArrow(mark, "id long, word string, places array<int>, first int, second int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows("asks", "mine", ((i, asked(w, a, b)) for i, w, a, b in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "first", "second")))))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows("holds", "other", ((i, held(w, places)) for i, w, places in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "places")))))

    left, right = marked.mapInArrow(ask, "key long, asks long, mine string"), marked.mapInArrow(hold, "key long, holds long, other string")
    met = left.join(right, "key").where((F.col("asks") != F.col("holds")) & (F.levenshtein("mine", "other", 1) == 1))
    return met.select(F.least("asks", "holds").alias("a"), F.greatest("asks", "holds").alias("b")).distinct()


def _rows(id: str, rest: str, found: Iterator[tuple[int, list[tuple[int, str]]]]) -> pa.RecordBatch:
    keys, ids, rests = [], [], []
    for i, cuts in found:
        for key, piece in cuts:
            keys.append(key)
            ids.append(i)
            rests.append(piece)
    return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(rests, pa.string())], ["key", id, rest])


def bounds(size: int, length: int, place: int, after: bool) -> Iterator[tuple[int, int]]:
    """Where, in a word of ``size``, the pieces begin and end into which one side of the bigram at ``place`` of a word of ``length`` is cut.

    The words agree before the piece and behind it. A side without letters has one piece, and others have no empty ones.
    """
    wide = length - place - 2 if after else place
    for j in range(PIECES):
        low, high = wide * j // PIECES, wide * (j + 1) // PIECES
        if wide >= 0 and (high > low or wide == j == 0):
            head = low + (place + 2 if after else 0)
            end = size - (wide - high) - (0 if after else length - place)
            if head <= end:
                yield head, end


def cut(word: str, length: int, place: int, after: bool, head: int, end: int) -> tuple[int, str]:
    """Hash of all that the other word shares, and the piece of ``word`` in which they may differ."""
    return xxhash.xxh64_intdigest(f"{length}{'>' if after else '<'}{place} {word[:head]} {word[end:]}"), word[head:end]


def held(word: str, places: list[int]) -> list[tuple[int, str]]:
    size = len(word)
    return [cut(word, size, place, after, *b) for place in places for after in (True, False) for b in bounds(size, size, place, after)]


def asked(word: str, first: int, second: int) -> list[tuple[int, str]]:
    """Keys of the words that are one edit away. A bigram moves with the length if the edit lies before it.

    An edit behind the second pivot is left to that one, and the second one looks before it only for edits of the first.
    """
    size, out = len(word), []
    for length in (size - 1, size, size + 1):
        moved = length - size
        out += [cut(word, length, first, True, head, end) for head, end in bounds(size, length, first, True) if head < second + 2]
        out += [cut(word, length, second, True, *b) for b in bounds(size, length, second, True)]
        out += [cut(word, length, first + moved, False, *b) for b in bounds(size, length, first + moved, False)]
        out += [cut(word, length, second + moved, False, head, end) for head, end in bounds(size, length, second + moved, False) if head <= first + 1 <= end]
    return out


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each row of ``words`` (``word, n``), whose words are distinct.

    A word's form is its near word of the largest ``n``, of equal ones the first in code-point order, if that ``n`` is at least
    ``ratio`` times the word's (``ratio`` above 1); otherwise missing, as is ``form_n``. ``root`` is reached from the word by
    following forms to the last. Counts grow by the ratio with every step, so chains are short; they are followed by
    doubling. An empty table stays empty.

    Words need at least four code points; rows without a word or with a shorter one have no near words, and stay.
    """
    # numbered by falling count and then by code points, so a word's best near word is the one of the smallest number
    counted = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    numbered = row_index(counted.withColumn("order", F.struct((-F.col("n")).alias("less"), "word")), "order", "id")
    kept = cut_lineage(numbered.select("id", "word", "n"))
    near = cut_lineage(near_words(kept.where(F.length("word") > PREFIX).select("id", "word")))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("b").alias("best"))
    named = kept.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    joined = kept.join(best, "id", "left").join(named, "best", "left")
    chosen = F.col("form_n") >= ratio * F.col("n")
    forms = cut_lineage(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("form")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n"))
    )
    roots = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = cut_lineage(roots.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
