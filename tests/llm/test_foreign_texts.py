import random

import pytest

from cloister.llm.langid import fit_languages, identify_languages

SYLLABLES = {"xa": ["ba", "ko", "ri", "na", "tu"], "yb": ["éch", "ùl", "or", "énn", "ist"], "zc": ["ß", "sch", "ung", "ver", "äk"]}
FOREIGN = {"cyrillic": ["жа", "щу", "фы", "гло", "дэ"], "latin": ["wix", "gop", "zyl", "muc", "fej"]}


def _text(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.mark.parametrize("learned", [["xa"], ["xa", "yb"], ["xa", "yb", "zc"]])
def test_foreign_and_junk_texts_are_rejected(spark, learned):
    rng = random.Random(3)
    fit = [(i, _text(rng, SYLLABLES[learned[i % len(learned)]], rng.randint(2, 60)), learned[i % len(learned)]) for i in range(600)]
    model = fit_languages(spark.createDataFrame(fit, "doc_id long, text string, lang string"))
    clean = [_text(rng, SYLLABLES[rng.choice(learned)], rng.randint(2, 60)) for _ in range(200)]
    mixed = [" ".join(_text(rng, SYLLABLES[name], 15) for name in learned) for _ in range(50)]
    foreign = [_text(rng, s, n) for s in FOREIGN.values() for n in (8, 40, 400) for _ in range(15)]
    junk = ["".join(rng.choice("qwxzjvkpdfghm") for _ in range(9)) + " " + "".join(rng.choice("qwxzjvkpdfghm") for _ in range(200)) for _ in range(30)]
    texts = [*clean, *mixed, *foreign, *junk]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rejected = {r["doc_id"]: r["rejected"] for r in identify_languages(table, model).collect()}
    counts, at = [], 0
    for group in (clean, mixed, foreign, junk):
        counts.append(sum(rejected[at + i] for i in range(len(group))))
        at += len(group)
    assert counts[0] <= 2 and counts[1] <= 1
    assert counts[2] == len(foreign) and counts[3] == len(junk)
