"""Token counts by a two-tier lookup in the map tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pubmeter.llm.common import in_small_batches, texts, worker_state
from pubmeter.llm.tokenizing import OTHER_SPACE, UNITS, UnitLengths

# Units of the broadcast table, and units that one task proposes for it. The table saves work; it never changes a count.
TABLE = 20_000
PROPOSED = 2_000
# Units that a task follows while it counts.
FOLLOWED = 100_000


def frequent_units(docs: DataFrame, text: str = "text", table: int = TABLE) -> list[str]:
    """The most frequent units (a word with the space before it) of all texts, most frequent first.

    Each task counts its own units and proposes the leading ones, so what is shuffled does not grow with the texts.
    """

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(UNITS.findall(t))
            if len(seen) > 2 * FOLLOWED:
                seen = Counter(dict(seen.most_common(FOLLOWED)))
        top = seen.most_common(PROPOSED)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["unit", "n"])

    found = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(propose, "unit string, n long")
    return [r["unit"] for r in found.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(table).collect()]


def count_tokens(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", limit: int = 1024, table: int = TABLE) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit``, one row per row; ``over_limit`` is ``n_tokens > limit``.

    Tier one is a table of the most frequent units' lengths, at most ``table`` entries, broadcast to all tasks; tier two is
    the worker's own memory of the units it has met, bounded as well, behind which stands the tokenizer. Units never move
    between tasks. A text where a special token or white space beyond ASCII occurs is encoded whole.

    A missing text counts as empty: no bytes, no tokens. Repeated rows and missing ids come out as they went in.
    """
    in_small_batches(docs.sparkSession)
    source = texts(docs, id, text).toDF("id", "text")
    own = Tokenizer.from_file(tokenizer)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    lengths = UnitLengths(own)
    shared = docs.sparkSession.sparkContext.broadcast({u: lengths[u] for u in frequent_units(docs, text, table)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = worker_state(f"units {tokenizer}", lambda: UnitLengths(Tokenizer.from_file(tokenizer)))

        class Tiers(dict):
            def __missing__(self, unit: str) -> int:
                return rest[unit]

        tiers = Tiers(shared.value)
        for batch in batches:
            n_tokens, n_bytes = [], []
            for t in batch.column(1).to_pylist():
                n_bytes.append(len(t.encode()))
                if OTHER_SPACE.search(t) or any(x in t for x in special):
                    n_tokens.append(len(rest.tokenizer.encode(t, add_special_tokens=False).ids))
                else:
                    n_tokens.append(sum(map(tiers.__getitem__, UNITS.findall(t))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = T.StructType([T.StructField(id, source.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return source.mapInArrow(count, kind)
