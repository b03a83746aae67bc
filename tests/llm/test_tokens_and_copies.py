from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pubmeter.llm import exact
from pubmeter.llm.counts import count_tokens
from pubmeter.llm.exact import combine, deduplicate, fingerprints
from pubmeter.llm.packing import pack
from pubmeter.llm.tokenizing import OTHER_SPACE, UNITS, UnitLengths, WordPieces

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
texts = st.text(st.sampled_from("aZé ß\n\t'sd1.,!|<>#́İx  "), max_size=40)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_word_pieces_equal_the_library(text):
    assert np.frombuffer(PIECES.encode(text), "<u2").tolist() == PIECES.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts)
def test_unit_lengths_equal_the_library(text):
    if not OTHER_SPACE.search(text):
        assert sum(map(LENGTHS.__getitem__, UNITS.findall(text))) == len(LENGTHS.tokenizer.encode(text, add_special_tokens=False).ids)


PIECES = WordPieces(WORDS, "<u2")
LENGTHS = UnitLengths(Tokenizer.from_file(BYTES))


@pytest.mark.parametrize("length", [16, 2048])
def test_packing_round_trip(odd, length):
    own = Tokenizer.from_file(WORDS)
    pieces = pack(odd.repartition(3), WORDS, length=length).collect()
    stream = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    for r in stream:
        assert (r["sequence_id"], r["offset"]) == divmod(place, length)
        assert r["offset"] + r["length"] <= length
        place += r["length"]
    docs, now = [], []
    for r in stream:
        if r["start"] == 0:
            now = []
        assert len(now) == r["start"]
        now = now + np.frombuffer(r["ids"], "<u4").tolist()
        if len(now) == r["doc_tokens"]:
            docs.append((r["doc_id"], now))
    want = [(r["doc_id"], [*own.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in odd.collect()]
    assert sorted(docs, key=str) == sorted(want, key=str)


def test_packing_of_nothing(none):
    assert pack(none, WORDS).count() == 0


def test_token_counts(odd, none):
    own = Tokenizer.from_file(BYTES)
    found = sorted(map(tuple, count_tokens(odd, BYTES, limit=20, table=5).collect()), key=str)
    want = []
    for r in odd.collect():
        t = r["text"] or ""
        n = len(own.encode(t, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(t.encode()), n, n > 20))
    assert found == sorted(want, key=str)
    assert count_tokens(none, BYTES).count() == 0


@given(st.binary(max_size=9000), st.binary(max_size=9000))
@settings(max_examples=50, deadline=None)
def test_fingerprints_combine(a, b):
    pair = lambda x: (x >> 31, x & (2**31 - 1))
    fa, fb, fab = fingerprints([a, b, a + b])
    assert combine(pair(fa), pair(fb), len(b)) == pair(fab)
    whole = 0
    for byte in a + b:
        whole = (whole * exact.BASES[0] + byte) % exact.PRIMES[0]
    assert whole == pair(fab)[0]


# primes so small that most fingerprints collide: the comparison alone must tell texts apart
@pytest.mark.parametrize("primes", [exact.PRIMES, (3, 2)])
def test_exact_groups(odd, primes):
    groups = defaultdict(list)
    for r in odd.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    found = deduplicate(odd, primes=primes, spread=1).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], key=str) == sorted(want, key=str)
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_exact_of_nothing(none):
    assert deduplicate(none).count() == 0


def test_collisions_among_many_texts(spark):
    docs = spark.createDataFrame([(k, f"text number {k % 23:03d}") for k in range(200)], "doc_id long, text string")
    found = deduplicate(docs, primes=(5, 3), spread=3).collect()
    assert {r["doc_id"]: r["keep_id"] for r in found} == {k: k % 23 for k in range(200)}
    assert all(r["group_size"] == len(range(r["keep_id"], 200, 23)) for r in found)


def test_many_rows_without_an_id_meet_their_group_once(spark, monkeypatch):
    """Two thousand missing ids in two hundred groups: as many rows are compared, not one for each group and row."""
    from pubmeter.llm import exact

    rows = [(None, f"text of the group {i % 200}") for i in range(2_000)]
    seen, compare = [], exact._compare

    def watched(source, members, spread):
        seen.append(source.join(members.select("key"), "key").count())
        return compare(source, members, spread)

    monkeypatch.setattr(exact, "_compare", watched)
    found = exact.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert seen == [2_000]
    assert len(found) == 2_000 and sum(r["kept"] for r in found) == 200 and {(r["keep_id"], r["group_size"]) for r in found} == {(None, 10)}
