"""Each stage of the pipeline against a plain version of its decisions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from test_near_dedup import plain_components

import corpus_pipeline
from patchweave.llm import mixing, toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    clean = stages["toxicity"](spark, docs, SF).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = toxicity._scorer(model)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in docs.collect() if score(r.text)[0] < model.cut)

    unique = stages["exact_dedup"](spark, clean, SF).cache()
    last = {}
    for r in clean.collect():
        key = (r.text or "").encode().lower()
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(last.values())

    near = stages["near_dedup"](spark, unique, SF).cache()
    plain = plain_components([(r.doc_id, r.text) for r in unique.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in plain.items() if i == c)

    mixed = stages["mixing"](spark, near, SF).cache()
    taken = {r.doc_id: r.taken for r in mixing.report(near).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    assert +words == Counter({i: n for i, n in taken.items() if n})

    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, mixed, SF).collect()
    tokens = Counter()
    for r in mixed.collect():
        tokens[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    made, crc = Counter(), defaultdict(list)
    for p in pieces:
        made[p.doc_id] += p.length
        crc[p.doc_id].append(p)
    assert made == tokens
    single = next(r for r in mixed.collect() if len(crc[r.doc_id]) == 1)
    ids = np.array([*tok.encode(single.text, add_special_tokens=False).ids, 1], "<u4")
    assert crc[single.doc_id][0].ids_crc32 == zlib.crc32(ids.tobytes())
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        assert {"toxicity": clean, "exact_dedup": unique, "near_dedup": near, "mixing": mixed}[name].columns == docs.columns


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_awkward_rows(spark, tmp_path):
    """Nulls, ties, repeated rows and clashing columns: what is left of each text is what the docstring says."""
    long, tied = "word " * 3_000, "one two three four five six seven eight"
    rows = [(1, None, "a"), (2, "", None), (3, " \t", "b"), (4, tied, "a"), (5, tied, "a"), (5, tied, "a"), (6, tied.upper(), None), (7, long, "b"), (None, "left alone here", "a"), (None, tied, "a"), (9, "é \U0001f600", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n_shingles", "2 AS set_key", "3 AS taken", "4 AS start", "5 AS keep_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.STAGES[2][1](spark, corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)), str(tmp_path)), str(tmp_path))
    assert kept.columns == docs.columns
    # Equal texts leave the largest id; " \t" and "" are different texts without words.
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 3, 6, 7, None, 9])
    # Where the mix takes nothing a document ends; the rest is packed whole or repeated, never lost.
    taken = {r.doc_id for r in mixing.report(kept).collect() if r.taken}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == taken and not taken & {2, 3}
