import numpy as np

from tests.conftest import ORACLE
from tests.llm.fixtures import awkward, nothing
from trainkit.llm import langid, queries


def plain_vector(bundler, text):
    """One n-gram at a time."""
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(line.split()) + " "
    out = np.zeros(bundler.dimensions)
    for i in range(len(line) - 2):
        a, b, c = (bundler.letters([ord(x)])[0].astype(int) for x in line[i : i + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_bundling_against_one_gram_at_a_time():
    bundler = langid.Bundler(dimensions=128)
    texts = ["The cat, the dog!", "Été à Paris", "12 34", "", None, "x", "a-b  c", "abc abc abc"]
    vectors, lettered = bundler.bundle(texts)
    assert lettered.tolist() == [True, True, False, False, False, True, True, True]
    for text, vector in zip(texts, vectors, strict=True):
        if text and any(c.isalpha() for c in text):
            assert np.allclose(vector, plain_vector(bundler, text))


def test_slices_of_a_long_text_add_up(monkeypatch):
    """No n-gram across a cut is lost, and none is made up."""
    text = "der hund, und   die katze: ΣΑΣ ab3c " * 50 + " " * 400 + "x" + "." * 300 + "ende"
    whole = langid.Bundler(dimensions=64).bundle([text])[0]
    assert np.allclose(whole[0], plain_vector(langid.Bundler(dimensions=64), text))
    for chars in (1, 2, 7, 230):
        monkeypatch.setattr(langid, "CHARS_AT_ONCE", chars)
        assert np.allclose(langid.Bundler(dimensions=64).bundle(["a", text, None, "b"])[0][1], whole[0])


def test_large_alphabets():
    text = "".join(chr(0x4E00 + 7 * i % 5000) for i in range(3000))
    bundler = langid.Bundler(dimensions=32)
    assert np.allclose(bundler.bundle([text])[0][0], plain_vector(bundler, text))


def test_awkward_rows(spark):
    docs = awkward(spark)
    prototypes = langid.learn_prototypes(docs, "doc_id", "text", "lang")
    assert {r.lang for r in prototypes.collect()} == {"de", "en", "fr"}
    got = langid.identify(docs, prototypes).collect()
    assert len(got) == 11
    by_id = {r.id: r for r in got}
    assert by_id[2].lang == by_id[3].lang == by_id[4].lang == "und" and by_id[3].score == 0.0
    assert by_id[6].lang == "de" and by_id[8].lang == "fr"
    assert all(0 <= r.score <= 1 for r in got)
    rows = lambda x: sorted(map(repr, x))
    for few in (1, 2, 3):  # prototypes in several broadcasts
        assert rows(langid.identify(docs, prototypes, languages_at_once=few).collect()) == rows(got)


def test_nothing_to_learn_and_empty_table(spark):
    prototypes = langid.learn_prototypes(nothing(spark), "doc_id", "text", "lang")
    assert prototypes.count() == 0
    assert {r.lang for r in langid.identify(awkward(spark), prototypes).collect()} == {"und"}
    assert langid.identify(nothing(spark), prototypes).count() == 0


def test_query_against_one_gram_at_a_time(spark):
    """The language and score of every short document, from prototypes that add up plain vectors."""
    docs = spark.read.parquet(f"{ORACLE}/documents.parquet").where("length(text) < 400").select("doc_id", "text", "lang")
    rows, bundler = docs.collect(), langid.Bundler()
    vectors = {r.doc_id: plain_vector(bundler, r.text) for r in rows if any(c.isalpha() for c in r.text)}
    units = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    languages = sorted({r.lang for r in rows if r.lang})
    means = [sum(units[r.doc_id] for r in rows if r.lang == x and r.doc_id in units) for x in languages]
    means = np.array([m / np.linalg.norm(m) for m in means])
    got = {r.id: r for r in langid.identify(docs, langid.learn_prototypes(docs, "doc_id", "text", "lang")).collect()}
    assert len(got) == len(rows) > 50
    for i, v in units.items():
        cosines = means @ v
        assert abs(got[i].score - max(0, cosines.max())) < 1e-4
        assert cosines[languages.index(got[i].lang)] > cosines.max() - 1e-4


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{ORACLE}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op1_language_id(spark, ORACLE).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert len(held) > 200
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
