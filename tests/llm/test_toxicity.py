import zlib

import pytest

from quillspark.llm.toxicity import EXACT, FUZZY, NEAR, NO_HIT, SEEDS, STEM, LexiconAutomaton, ToxicityModel, common_words, features, mine_lexicon, op4_toxicity, train


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    words = ["stupid", "worthless", "scum", "patent", "stupor", "clown", "idiot"]
    for stems in ([], ["lowei"]):
        auto = LexiconAutomaton(words, stems)
        trials = {w[:k] + c + w[j:] for w in words for k in range(len(w) + 1) for j in (k, k + 1, k + 2) for c in ("", "x", "s", "é")} | {"lowei", "loweischaft", "lowe", "", "the"}
        for t in trials:
            want = EXACT if t in words else STEM if any(t.startswith(s) for s in stems) else max([NO_HIT, *[FUZZY if len(w) >= 6 else NEAR for w in words if len(w) >= 5 and distance(t, w) <= 1]])
            assert auto.classify(t) == want, t


def test_context_separates_quotation_from_abuse():
    auto = LexiconAutomaton(SEEDS, [])
    abuse, quoted, said = (dict(zip(["bias", "exact", "stem", "fuzzy", "quoted", "addressed", "density"], features(auto, t))) for t in ("you are an idiot", 'the word "idiot" is old', "he said idiot once"))
    assert abuse["exact"] > 0 and abuse["addressed"] > 0 and abuse["quoted"] == 0
    assert quoted["exact"] == 0 and quoted["quoted"] > 0 and said["quoted"] > 0
    assert features(auto, None) == features(auto, "") == [1, 0, 0, 0, 0, 0, 0]


def named(automaton, text):
    return dict(zip(["bias", "exact", "stem", "fuzzy", "quoted", "addressed", "density"], features(automaton, text)))


def test_quotation_is_a_window_not_a_parity():
    auto = LexiconAutomaton(SEEDS, [])
    assert named(auto, 'a 5" disk. ' + "some words here. " * 20 + "you are an idiot")["exact"] > 0  # a stray mark far before
    assert named(auto, 'a 5" disk, you are an idiot')["exact"] > 0  # and one without a second mark
    assert named(auto, "they wore a « big idiot » sign")["quoted"] > 0


def test_short_misspellings_need_an_address_and_must_not_be_words():
    auto = LexiconAutomaton(SEEDS, [], common={"closer"})
    assert named(auto, "you are an idiiot")["fuzzy"] > 0 and named(auto, "that morron lost")["fuzzy"] == 0
    assert named(auto, "your clwn")["fuzzy"] > 0 and named(auto, "come closer, you")["fuzzy"] == 0 and named(auto, "you scun")["fuzzy"] == 0


def test_words_of_clean_rows_are_no_misspellings(spark):
    rows = [("come closer now", 0), ("a closer look", 0), ("you idiiot", 0), ("you morron", 1), ("closer", 1)]
    assert common_words(spark.createDataFrame(rows, "text string, toxic int"), SEEDS, []) == {"closer"}


@pytest.fixture(scope="module")
def labelled_rows(spark):
    """A toxic word in every toxic row after many different words; a word of one copied document; and a rare one."""
    rows = [(f"w{k % 37} zorgul w{k % 11} then copied phrase stays", 1) for k in range(300)] + [(f"w{k % 37} w{k % 11} then", 0) for k in range(900)]
    return spark.createDataFrame(rows, "text string, toxic int")


@pytest.mark.parametrize("partitions", [1, 2, 8])
def test_the_lexicon_does_not_depend_on_the_layout(labelled_rows, partitions):
    words, stems = mine_lexicon(labelled_rows.repartition(partitions))
    assert "zorgu" in stems or "zorg" in stems or "zorgul" in words
    assert not {"copied", "phrase", "stays"} & set(words) and (words, stems) == mine_lexicon(labelled_rows.coalesce(1))


@pytest.fixture(scope="module")
def scored(spark):
    return op4_toxicity(*[spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]).collect()


def test_held_out_recall_and_precision(scored, spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    hits = sum(p == y == 1 for p, y in held)
    assert hits / sum(y for _, y in held) >= 0.9 and hits / sum(p for p, _ in held) >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)


def test_no_labels_and_odd_rows(spark, odd_docs, make_docs):
    none = spark.createDataFrame([(None, 1, 1), (4, 0, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    rows = op4_toxicity(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and all(r.predicted == 0 for r in rows)
    assert op4_toxicity(make_docs([]), none).count() == 0
    model = train(make_docs([(1, "you stupid idiot")]), none)
    assert model.score("you stupid idiot") > 0.3 > model.score("a fine day")
    assert isinstance(model, ToxicityModel)
