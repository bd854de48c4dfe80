import numpy as np
import pytest

from factloom.llm import hashing, language_id, mixing, near_dedup


@pytest.mark.parametrize("size", [16, 64, 1024, 4096])
def test_words_that_fool_polynomials_stay_apart(size):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes, starts = hashing.all_word_hashes(np.frombuffer(f"{word} {other} {word.upper()}".encode(), np.uint8))
    assert hashes[0] == hashes[2] != hashes[1] and starts.tolist() == [0, size + 1, 2 * size + 2]


def test_such_documents_are_not_linked(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2, percent=80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(1, 1, True), (2, 2, True)]


def test_hot_ids_do_not_widen_the_language_sample(spark):
    rows = [(None, "en", f"the word number {i} is here again") for i in range(3000)] + [(7, "de", "das ist immer wieder derselbe Satz")] * 3000
    pieces, langs = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 100)
    assert 100 <= len(pieces) <= 300 + 3 and langs.count("de") <= 3


def test_hot_ids_do_not_widen_the_mixing_sample(spark):
    rows = [(None, "a", "red red red blue")] * 2000 + [(i, "b", "green green green grey") for i in range(50)]
    model = mixing.train(spark.createDataFrame(rows, "doc_id long, domain string, text string"), docs_per_domain=20)
    assert model.domains == ["a", "b"] and set(model.words) == {"red", "green", "grey"}
