"""Operators look at whole texts and whole items."""

from tidemark.llm import decontam, toxicity


def test_capitals_are_counted_over_the_whole_text():
    text = ("A" + "b" * 4) * 2000
    assert toxicity.Lexicon([], []).features(text)[2] == 0.2


def test_a_leak_without_the_last_sentence_is_found():
    first = " ".join(f"w{i}" for i in range(60))
    last = "a b c d e f"
    plain = decontam.Index([(1, f"{first}. {last}.")])
    assert list(plain.search(f"x {first} y")) == [1]
    marked = decontam.Index([(1, f"{first}\nAnswer: {last}")])
    assert not marked.search(f"x {first} y") and list(marked.search(f"x {first} {last}")) == [1]
