"""op2's fingerprints and op4's scores against plain versions."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tracewell.llm import fingerprints, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    """(hash, position) of the selected grams, and the string of them."""
    k, window, mask = fingerprints.K, fingerprints.WINDOW, (1 << 64) - 1
    rotate = lambda x, by: (x << by | x >> 64 - by) & mask if by else x
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]
    if not words:
        return set(), ""
    grams = []
    for i in range(max(len(words) - k + 1, 1)):
        rolled = 0
        for j, w in enumerate(words[i : i + k]):
            rolled ^= rotate(w, min(k, len(words)) - 1 - j)
        grams.append(rolled & (1 << 31) - 1)
    chosen = []
    for start in range(max(len(grams) - window + 1, 1)):
        inside = range(start, min(start + window, len(grams)))
        at = min(inside, key=lambda i: (grams[i], -i))
        if at not in chosen:
            chosen.append(at)
    return {grams[i] for i in chosen}, " ".join(f"{grams[i]:x}@{i}" for i in chosen)


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("case", ["mixed", "one", "repeated ids"])
def test_fingerprints_and_likeness(spark, case):
    rng = np.random.default_rng(5)
    prose = lambda n, k=200: " ".join(f"w{i}" for i in rng.integers(0, k, n))
    texts = [None, "", " \t", "one", "a b c", "a b c d e", prose(16), prose(40, 2), "same " * 90, prose(300), "é 日本 ß " * 30, prose(5000)]
    texts += [texts[9] + " tail", texts[9]]
    rows = {"mixed": [(i * 2, t) for i, t in enumerate(texts)], "one": [(4, prose(50))], "repeated ids": [(3, prose(60)), (3, prose(70)), (3, None), (None, prose(40)), (9, prose(30)), (9, prose(30))]}[case]
    out = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])), reverse=True)
    want = []
    for (d, t), (_, u) in zip(order, [*order[1:], order[0]]):
        t, u = t or "", u or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + u[:n]
        own, other, near = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(u)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), own[1], other[1], round(likeness(own[0], other[0]), 9), round(likeness(own[0], near[0]), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scores_are_sums_of_bins(spark):
    """Scores of all documents against the lookup tables read bin by bin, with features counted plainly."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, " \n "), (-4, "word " * 300_000), (-5, "É" * 10)]
    model = quality.train(docs, labels)
    more = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    out, back = quality.scored(more, model, ["doc_id"])
    for r in out.select(*back, "score").collect():
        x = quality.features(*quality.text_buffer(pa.array([dict(rows)[r.doc_id]])))[0]
        total = model.base
        for table, edges, v in zip(model.tables, model.edges, x):
            total += table[sum(e <= v for e in edges)]
        for (a, b), grid in zip(model.pairs, model.grids):
            total += grid[sum(e <= x[a] for e in model.pair_edges[a]), sum(e <= x[b] for e in model.pair_edges[b])]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-12)


def test_features_counted_plainly():
    texts = ["The Cat sat, on 12 MATS! the cat sat, on\nThe line\nThe line\n\n{x} $$", "a", "", None, "AB cd-ef 'q' é.\n" * 5]
    got = quality.features(*quality.text_buffer(pa.array(texts)))
    for row, t in zip(got, texts):
        t, n = t or "", max(len((t or "").encode()), 1)
        w = WORD.findall(t)
        if not w:
            assert not row.any()
            continue
        x = dict(zip(quality.FEATURES, row))
        lines = [y for y in t.split("\n") if y]
        triples = list(zip(w, w[1:], w[2:]))
        size = [len(y.encode()) for y in w]
        want = {
            "words": math.log1p(len(w)), "word_length": sum(size) / len(w), "longest_word": math.log1p(max(size)), "upper": sum("A" <= c <= "Z" for c in t) / n, "digits": sum("0" <= c <= "9" for c in t) / n,
            "stops": sum(c in ".,;:" for c in t) / n, "exclaims": sum(c in "!?" for c in t) / n, "non_ascii": sum(b >= 128 for b in t.encode()) / n, "distinct": len(set(w)) / len(w), "top_word": max(map(w.count, w)) / len(w),
            "lines": math.log1p(len(lines)), "line_words": len(w) / len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines), "repeated_triples": 1 - len(set(triples)) / max(len(triples), 1),
            "shouted": sum(any("A" <= c <= "Z" for c in y) and not any("a" <= c <= "z" for c in y) for y in w) / len(w), "spaces": sum(c in " \t\n\r\v\f" for c in t) / n,
        }
        for k, v in want.items():
            assert x[k] == pytest.approx(v), (k, t)
