"""Language identification with unequal samples and many letters."""

import random

import numpy as np

from gristmill.llm.langid import LanguageModel, train


def _texts(alphabet, seed, n=60, words=60):
    """Samples over a vocabulary drawn from ``alphabet``, and texts over the same vocabulary."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(alphabet, k=r.randint(2, 6))) for _ in range(400)]
    make = lambda: " ".join(r.choices(vocabulary, k=words))
    return "\n".join(make() for _ in range(n)), [make() for _ in range(20)]


def _right(model, lang, texts):
    return np.mean([model.langs[k] == lang for k in model.rates(texts).argmin(axis=1)])


def test_a_rare_label_ruins_no_other():
    a, ta = _texts("aeioulnrst", 1)
    b, tb = _texts("aeioulnrst", 2)
    model = LanguageModel({"a": a, "b": b, "rare": "xyzq"})
    assert _right(model, "a", ta) == 1 and _right(model, "b", tb) == 1
    model = LanguageModel({"a": a, "b": b[:1500], "rare": "x"})
    assert _right(model, "a", ta) == 1 and _right(model, "b", tb) == 1


def test_every_letter_counts():
    blocks = {"latin": range(0x61, 0x7B), "russian": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "han_1": range(0x4E00, 0x5200), "han_2": range(0x5200, 0x5600), "hangul": range(0xAC00, 0xB000), "beyond": range(0x20000, 0x20400)}
    made = {k: _texts([chr(p) for p in v], 3) for k, v in blocks.items()}
    model = LanguageModel({k: sample for k, (sample, _) in made.items()})
    for k, (_, texts) in made.items():
        assert _right(model, k, texts) == 1
        if k != "greek":  # two small letters share one capital
            assert (model.rates(texts) == model.rates([t.upper() for t in texts])).all()


def test_labels_on_rows_without_letters_do_not_crowd_out_a_language(spark):
    rows = [(i, "12 34", "xx") for i in range(4000)] + [(i, "kurzer satz", "xx") for i in (4001, 4003, 4007, 4011)] + [(i, "the cat sat", "en") for i in range(5000, 5020)]
    assert train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["en", "xx"]
