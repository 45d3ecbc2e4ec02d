"""What a worker keeps between the tasks of the packing."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import cloudpickle
from tokenizers import Tokenizer

from patchweave.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)


class _Docs:
    """Stands for a table; keeps the function that tasks get."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


class _Context:
    @staticmethod
    def get():
        return _Context()

    def partitionId(self):
        return 0


def test_tasks_of_a_worker_share_a_tokenizer(spark, monkeypatch):
    made = []
    start = packing.ChunkTokenizer.__init__
    monkeypatch.setattr(packing.ChunkTokenizer, "__init__", lambda self, path: (made.append(path), start(self, path))[1])
    monkeypatch.setattr(packing, "TaskContext", _Context)
    monkeypatch.setattr(packing, "_TOKENIZERS", {})
    docs = _Docs()
    packing.pack(docs)
    sent = cloudpickle.dumps(docs.run)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one task"]})
    results = [[b.to_pylist() for b in cloudpickle.loads(sent)(iter([batch]))] for _ in range(2)]
    assert results[0] == results[1] and len(made) == 1


def test_bounded_table_gives_the_ids_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(packing, "_SLOTS", 1 << 11)
    monkeypatch.setattr(packing, "_PER_CALL", 700)
    monkeypatch.setattr(packing, "_BLOCK", 1 << 9)
    rng = random.Random(5)
    plain = Tokenizer.from_file(PATH)
    odd = ["can't", "I'LL", "'st", "''s", "a.'s", "x&&&", "***", "(a)", "3rd", "12.5", "Ünïß,", "œuvre", "Œ", "µ", "²", "½x", "×", "İx", "ΑΣ", "क़.", "é́,", "é", "<|endoftext|>", "a<|endoftext|>b", "<|", "a\x1cb", "a\xa0b", "\x00", " ", "日本語", "w" * 49, "w" * 70_000, "\U0001f600", "ªº", "ŉ", "ß", "ÿ"]
    letters = "abcdeèéñüßœEÉÑ.,'&$1"
    tok = packing.ChunkTokenizer(PATH)
    for _ in range(40):
        texts = ["", " \t", *(" ".join(rng.choice(odd) if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(rng.randrange(300))) for _ in range(8))]
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert tok.ids(texts) == want
        assert tok.table.used <= (1 << 11) + 8 * 300
    assert tok.ids([]) == []
