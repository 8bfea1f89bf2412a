"""The string kernel against a dense plain version, and very long texts."""

import math

import numpy as np
import pytest

from tracewell.llm import language


def grams(text):
    t, out = "".join(c if c.isalpha() else " " for c in (text or "").lower()), set()
    t = " " + " ".join(t.split()) + " " if t.split() else " "
    for n in range(1, 5):
        out |= {t[i : i + n] for i in range(len(t) - n + 1)}
    return out


def test_kernel_values_are_those_of_sets():
    texts = ["The cat sat.", "the  CAT", "Été là-bas 12", "", None, "日本語 テキスト", "x", "a b c d e f g", "The cat sat on the mat, " * 40]
    places, offsets, has = language.presence(texts)
    sets = [grams(t) for t in texts]
    own = [places[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    assert has.tolist() == [any(c.isalpha() for c in t or "") for t in texts]
    for t, s, p in zip(texts, sets, own):
        if any(c.isalpha() for c in t or ""):
            assert len(p) == len(s), t  # no two of so few n-grams share a place
    marks = language.Marks([own[0], own[8]])
    matrix = marks.kernel(own)
    assert marks.folded(np.eye(2)).times(places, offsets) == pytest.approx(matrix, abs=1e-6)
    for i in (0, 1, 2, 5, 6, 7, 8):
        for j, k in enumerate((0, 8)):
            assert matrix[i, j] == pytest.approx(len(sets[i] & sets[k]) / math.sqrt(len(sets[i]) * len(sets[k])), abs=1e-6)


def test_pieces_lose_no_ngram(monkeypatch):
    rng = np.random.default_rng(2)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000))
    whole = language.presence([text, "ab"])
    monkeypatch.setattr(language, "PIECE", 1000)
    for a, b in zip(whole, language.presence([text, "ab"])):
        assert (a == b).all()


def test_ridge_is_that_of_the_full_kernel():
    """With every training text a landmark, predictions equal plain ridge regression on the n-gram sets."""
    texts = [f"{w} of the and {w}ing" for w in "hous walk thing farm".split()] + [f"{w} der und die {w}en" for w in "haus geh ding bauer".split()] + [f"{w} de la el {w}ar" for w in "casa and cosa gran".split()]
    langs = ["en"] * 4 + ["de"] * 4 + ["es"] * 4
    places, offsets, _ = language.presence(texts)
    marks = [places[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    marks = language.Marks(marks)
    model = language.fit(marks, marks.kernel(marks.marks), langs)
    sets = [grams(t) for t in texts]
    k = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    target = np.where(np.array(langs)[:, None] == np.array(["de", "en", "es"])[None], 1.0, -1.0)
    alpha = np.linalg.solve(k + language.RIDGE * np.eye(12), target)
    for text in ["the walking and of", "die hausen und", "la casa de el", texts[0]]:
        row = np.array([len(grams(text) & s) / math.sqrt(len(grams(text)) * len(s)) for s in sets])
        want = row @ alpha
        names, scores = model.predict([text])
        assert names == [["de", "en", "es"][want.argmax()]] and scores[0] == pytest.approx(np.clip((want.max() + 1) / 2, 0, 1), abs=1e-5)


def test_very_long_texts_keep_their_language(spark):
    """Texts of one language with very many different n-grams: 2 to 5 MB of invented words from two alphabets' habits, and 200,000 different-looking characters."""
    rng = np.random.default_rng(7)
    parts = {"aa": ["ka", "lo", "mi", "nu", "pe", "ta"], "bb": ["strk", "schw", "blg", "zent", "orf", "ung"]}

    def prose(lang, n):
        own = parts[lang]
        mixed = lambda: "".join(own[i] if i < 6 else chr(97 + int(rng.integers(26))) for i in rng.integers(0, 8, 4))
        return " ".join(mixed() for _ in range(n))

    han = lambda n, low: "".join(map(chr, rng.integers(low, low + 4000, n)))
    rows = [(i, prose(lang, 60), lang) for i, lang in enumerate(["aa", "bb"] * 40)] + [(100 + i, han(400, 0x4E00), "zh") for i in range(30)] + [(200 + i, han(400, 0xAC00), "ko") for i in range(30)]
    long = [(1000, prose("aa", 200_000), "aa"), (1001, prose("bb", 200_000), "bb"), (1002, han(200_000, 0x4E00), "zh"), (1003, han(200_000, 0xAC00), "ko")]
    df = spark.createDataFrame(rows + [(i, t, None) for i, t, _ in long], "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r.lang_pred for r in language.languages(df).collect()}
    assert [got[i] for i, _, _ in long] == [x for _, _, x in long]
