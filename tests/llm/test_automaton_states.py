"""An automaton's states, cut to the last words of a window."""

import random

import pytest

from scrivener.llm import op5_suffix_automata as words5


@pytest.mark.parametrize("window", [1, 3, 6])
def test_states_are_cut_to_the_last_words_at_once(window):
    rng = random.Random(window)
    lists = [[rng.randrange(3) for _ in range(rng.randrange(1, 50))] for _ in range(9)]
    automaton = words5.SuffixAutomaton()
    for owner, words in enumerate(lists):
        automaton.add(words, owner)
    automaton.finish()
    shortest = automaton.shortest(window)
    for state, got in enumerate(shortest):
        while state and automaton.length[automaton.link[state]] >= window:
            state = automaton.link[state]
        assert got == state
    for words in lists:
        assert list(automaton.stream(words, window, shortest)) == list(automaton.stream(words, window))


def test_an_empty_automaton():
    automaton = words5.SuffixAutomaton()
    automaton.finish()
    assert automaton.shortest(13) == [0] and list(automaton.stream(["a", "b"], 1)) == [None, None]
