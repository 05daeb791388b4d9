import inspect

from sieveline.llm import toxicity


def test_the_fit_learns_from_12_000_labelled_rows():
    assert inspect.signature(toxicity.score_documents).parameters["sample"].default == toxicity.SAMPLE == 12_000
