import zlib

import numpy as np

from loomgraph.llm import language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_predictions_are_the_kernel_machine_itself():
    """The folded matrix gives what kernels, Nyström map and regression give one after the other."""
    texts = ["der hund und die katze", "the dog and the cat", "die stadt und der wald", "the town and the wood", "und der", "the and"]
    labels = ["de", "en"] * 3
    x = np.stack([language_id.presence(t) for t in texts])
    model = language_id.fit(labels, x)
    k = lambda a, b: (a & b).sum() / np.sqrt(a.sum() * b.sum())
    gram = np.array([[k(a, b) for b in x] for a in x])
    y = np.array([[1, -1], [-1, 1]] * 3)
    # All texts are landmarks, so this is ridge regression with the kernel; classes weigh the same.
    alpha = np.linalg.solve(gram + language_id.RIDGE * 2 / (1 / 3) * np.eye(6), y)
    new = language_id.presence("der hund and the katze")
    want = np.array([k(new, a) for a in x]) @ alpha
    got = new.astype(float) @ model.weights / np.sqrt(new.sum())
    assert np.allclose(got, want, atol=1e-4)


def test_defined_results_for_odd_rows(spark, make_docs):
    rows = [(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * 3, "de" if i % 2 else "en") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 _²!", "en"), (103, "x" * 2_000_000, None), (None, "und der hund", None), (104, "und der hund", "zz" if zlib.crc32(b"104") % 3 == 1 else None)]
    got = language_id.identify(make_docs(rows + odd)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 66
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (100, 101, 102))
    assert by[103].lang_pred in ("de", "en") and by[None].lang_pred == by[104].lang_pred == "de"
    nothing = make_docs([(1, "a", None), (2, None, "en")])
    assert {r.lang_pred for r in language_id.identify(nothing).collect()} == {"und"}
    assert language_id.identify(make_docs(rows).limit(0)).collect() == []


def test_texts_without_letters_go_even_if_nothing_can_be_learnt(make_docs):
    rows = [(1, None, None), (2, "", None), (3, "12 34 !", None), (4, "some words", None)]
    assert [(r.doc_id, r.lang) for r in language_id.recognised(make_docs(rows)).collect()] == [(4, None)]


def test_sums_of_tasks_are_the_fit_in_one_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL")
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text and language_id.has_letter(r.text)]
    model = language_id.train(docs.repartition(7), per_language=10_000)
    order = sorted(range(len(rows)), key=lambda k: rows[k].lang)
    here = language_id.fit([rows[k].lang for k in order], np.stack([language_id.presence(rows[k].text) for k in order]))
    assert model.languages == here.languages
    grams = np.stack([language_id.presence(r.text) for r in rows])
    # Landmarks differ (their order within a language is a hash), what they say doesn't.
    assert (language_id.score(model, grams)[0] == language_id.score(here, grams)[0]).mean() > 0.99
    again = language_id.train(docs.repartition(3), per_language=10_000)
    assert np.array_equal(model.weights, again.weights) or np.allclose(model.weights, again.weights, atol=1e-6)


def test_columns_of_any_name_and_repeated_rows_stay(spark):
    names = ["doc_id", "text", "lang", "bits", "mark", "rank", "held_out", "score", "a.b"]
    rows = [(i, "der hund und die katze" if i % 2 else "the dog and the cat", None if i % 7 == 0 else "de" if i % 2 else "en", *"abcdef") for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:5], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    kept = language_id.recognised(docs)
    assert kept.columns == names and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    want = [(*r[:2], "de" if r[0] % 2 else "en", *r[3:]) for r in rows + rows[:5]]
    assert sorted(map(tuple, kept.collect())) == sorted(want)
    assert language_id.identify(docs).count() == 45
