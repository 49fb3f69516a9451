"""Copies of benchmark items that were edited or re-parameterised."""

import pytest

from gristmill.llm import decontaminate

WORDS = "the old miller walks along quiet river banks before sunrise because every morning fresh water must turn heavy stones which grind golden wheat into fine flour for hungry village bakers who wait outside their little wooden doors".split()
#: Long enough that no run of windows is taken for a copy by itself.
WHOLE = 1000


@pytest.fixture
def found(spark):
    def run(item, *texts, **more):
        bench = spark.createDataFrame([(1, item)], "item_id long, text string")
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r.doc_id for r in decontaminate.decontaminate(docs, bench, **more).collect()}

    return run


def test_edits_do_not_split_a_copy(found):
    half = len(WORDS) // 2
    put_in, left_out = [*WORDS[:half], "really", *WORDS[half:]], [*WORDS[:half], *WORDS[half + 1 :]]
    parts = [*WORDS[:14], *["filler"] * 40, *WORDS[20:34]]
    docs = [" ".join(x) for x in (put_in, left_out, parts)]
    assert found(" ".join(WORDS), *docs, run=WHOLE) == {0, 1}


def test_long_passage_is_a_copy(found):
    docs = [" ".join(["so", *WORDS[3:24], "and", "more", "of", "it"]), " ".join(WORDS[:12])]
    assert found(" ".join(WORDS), *docs) == {0}


def test_slots_of_several_words(found):
    item = "yesterday our friend Mary ran 5 km while little brother Mary Ann slept 3 hours under trees"
    docs = ["yesterday our friend Eve Lou ran 7km while little brother Eve Lou Fay slept 2 hours under trees"]
    assert found(item, *docs, run=WHOLE) == {0}


def test_short_item_with_long_names_is_kept(found):
    item = "what did Mary Ann Smith Jones buy there yesterday"
    assert found(item, f"so then {item} she asked", item.replace("Mary Ann Smith Jones", "Eve")) == {0}


def test_names_that_begin_sentences(found):
    item = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"
    assert found(item, item.replace("Tom", "Anna"), f"Quiz\n{item}", item.lower()) >= {0, 1}
    assert found("Tom has five red apples in his big old basket.", "Anna has five red apples in his big old basket.") == {0}


def test_copy_does_not_depend_on_what_precedes(found):
    item = "What is the capital city of France today?"
    assert found(item, f"Question 7\n{item}", item, f"by Anna Smith\n{item}", f"Well. {item} Paris") == {0, 1, 2, 3}
    assert found("A man walks 60 miles from here to the old town", "version 3\nA man walks 60 miles from here to the old town") == {0}


def test_joined_sentences_stay_a_copy(found):
    item = "she picked seven ripe pears yesterday, how many pears remain after lunch today"
    assert found(item, item.replace(", how", ". How")) == {0}
