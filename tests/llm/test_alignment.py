"""op12 against a plain version that encodes whole texts and walks over their tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import alignment
from tracewell.llm.common import table

ODD = ["a", "b", " ", "  ", "é", "日本", "\n", "\t", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", " ", "　", "don't", "'s", " the", "1234", "🙂", "\x00", "́", "ﬁ", ".", ",", "!?", "’", "\r\n", "x" * 50, "​", "﻿"]


def plain(text):
    """(a ids, b ids, groups, links) of a text, by offsets."""
    both = alignment.aligner_of(*alignment.vocabularies())
    if not text:
        return [], [], [], []
    a, b = both.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, both.b.model.encode(text)
    letters = alignment._byte_letters()
    bytes_a = [bytes(letters[c] for c in both.a.tokenizer.id_to_token(i)) for i in a]
    names = [both.b.model.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(n[3:5], 16)]) if both.b.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []
    spans = lambda parts: list(zip(np.cumsum([0, *map(len, parts)])[:-1].tolist(), np.cumsum([*map(len, parts)]).tolist()))
    at_a, at_b = spans(bytes_a), spans(bytes_b)
    shared = sorted({e for _, e in at_a} & {e for _, e in at_b})
    groups = [([i for i, (s, e) in zip(a, at_a) if low <= s and e <= high], [i for i, (s, e) in zip(b, at_b) if low <= s and e <= high]) for low, high in zip([0, *shared[:-1]], shared)]
    links, first = [], 0
    for i, (s, e) in zip(a, at_a):
        while first < len(b) and at_b[first][1] <= s:
            first += 1
        j = first
        while j < len(b) and at_b[j][0] < e:
            links.append((i, b[j]))
            j += 1
    return a, b, groups, links


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(rows):
    done = [plain(t) for _, t in rows]
    count = Counter(x for *_, links in done for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        ((d, len(a), len(b), len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(written(g).encode()).hexdigest() if a else "") for (d, _), (a, b, g, x) in zip(rows, done)),
        key=repr,
    )


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


def test_groups_of_odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, "", " ", "▁", "a ▁ b"]
    assert alignment.groups_of(texts) == [written(plain(t)[2]) for t in texts]
    assert sum(1 for g in alignment.groups_of(texts) if g) > 700


def test_whole_texts_where_pieces_are_not_allowed(monkeypatch):
    both = alignment.aligner_of(*alignment.vocabularies())
    texts = ["one two  three é four", "don't stop <s> now", " lead and trail "]
    want = alignment.groups_of(texts)
    monkeypatch.setattr(both, "in_pieces", False)
    assert alignment.groups_of(texts) == want == [written(plain(t)[2]) for t in texts]


def test_a_table_in_many_blocks(spark):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    rows = [*enumerate(texts), (None, "no id here"), (3, "a repeated id"), (3, "a repeated id"), (900, None), (901, ""), (902, "▁"), (903, "word " * 20_000), (904, "x" * 9_000)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, pairs string, block int, id long").repartition(5)
    out = alignment.alignment(docs, limit=50_000)
    assert rows_of(out) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, None)], [(None, "▁")]])
def test_nothing_to_align(spark, rows):
    assert rows_of(alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_ids_keep_their_type(spark):
    out = alignment.alignment(spark.createDataFrame([("x", "some text")], "doc_id string, text string"))
    assert out.schema["doc_id"].dataType.simpleString() == "string" and out.first()["doc_id"] == "x"


def test_bits():
    rng = np.random.default_rng(0)
    for size in (1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(size) < 0.3)
        bits = alignment.Bits.at(places, size)
        assert bits.select().tolist() == places.tolist()
        assert bits.rank(np.arange(size + 1)).tolist() == [int((places < i).sum()) for i in range(size + 1)]
        other = np.flatnonzero(rng.random(size) < 0.5)
        assert (bits & alignment.Bits.at(other, size)).select().tolist() == sorted({*places.tolist()} & {*other.tolist()})
        assert (bits | alignment.Bits.at(other, size)).n == len({*places.tolist()} | {*other.tolist()})


def test_cuts_between_visible_characters_only():
    words, firsts = alignment.cut(pa.array(["a b", None, " c", "é d  e f", ""]), True)
    assert words.to_pylist() == [b" a", b" b", b"  c", " é d  e".encode(), b" f"] and firsts.tolist() == [0, 2, 2, 3, 5, 5]
