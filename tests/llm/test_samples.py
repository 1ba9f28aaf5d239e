import numpy as np

from millrace.llm import substrings


def test_sample_choice_does_not_depend_on_the_size_of_the_data(monkeypatch):
    seen = []
    inner = substrings._slide
    monkeypatch.setattr(substrings, "_slide", lambda values, *rest: seen.append(values) or inner(values, *rest))
    text = bytes(range(33, 123))
    for data in (text, text + bytes(100_000)):
        substrings.samples(data, np.array([0]), np.array([len(data)]), 50)
    assert (seen[0][:40] == seen[1][:40]).all()
