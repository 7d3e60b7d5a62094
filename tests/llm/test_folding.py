"""Signs inside and after words, as the toxicity lexicon sees them."""

import pytest

from factloom.llm.toxicity import Lexicon, folded


@pytest.mark.parametrize("text", ["a$$hole", 'idiot!"', "idiot!)", "idiot!, you", "idiot!\tyou", "idiot!\ryou", "(idiot!]", "idiot!!! you", "!d!ot|", "idi​ot!​"])
def test_signs_are_letters_only_before_letters(text):
    lexicon = Lexicon({folded(w).strip(): 3.0 for w in ("asshole", "idiot")})
    assert lexicon.features(text)[0] > 0


def test_long_runs_of_signs_are_read_once():
    assert folded("!" * 300_000 + "x").strip() == "i" * 300_000 + "x"
    assert folded("idiot" + "!" * 300_000) == " idiot "
