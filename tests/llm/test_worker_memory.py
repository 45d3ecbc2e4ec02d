"""What a task of the pipeline holds in its Python worker."""

import tracemalloc

from patchweave.llm import toxicity


def test_the_scorer_remembers_few_words():
    score = toxicity._scorer(toxicity.OrdinalModel())
    tracemalloc.start()
    most = 0
    for k in range(250):
        score(" ".join("".join(chr(97 + (1000 * k + i) // 26**j % 26) for j in range(5)) for i in range(1000)))
        most = max(most, tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert most < 16e6
