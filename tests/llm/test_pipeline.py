import zlib

import __spark_entry__ as entry_points
import corpus_pipeline
import numpy as np
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F
from tillbook.llm import decontamination, secrets, simhash, toxicity
from tillbook.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark, labels, benchmark_items):
    docs = table(spark, FOLDER, "documents").withColumns({"_k1": F.lit(1), "_masked": F.lit("x"), "a.b": F.lit(2)})
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        left[name] = set(before) - set(after)
        if name == "toxicity":
            scores = toxicity.classify(table(spark, FOLDER, "documents"), labels).collect()
            assert left[name] == {r.doc_id for r in scores if r.predicted} != set()
        if name == "near_duplicates":
            groups = simhash.near_duplicates(spark.createDataFrame([(r.doc_id, r.text) for r in before.values()], "doc_id long, text string"))
            assert set(after) == {r.component_id for r in groups.collect()} and left[name]
        if name == "decontamination":
            items = [decontamination.item_of(r.text) for r in benchmark_items.collect()]
            finder = decontamination.Finder(items)
            assert left[name] == {i for i, r in before.items() if finder(r.text)} and left[name]
        if name == "secret_scan":
            assert not left[name] and not secrets.digest(docs).where("n_assign + n_access + n_hex > 0").collect()
            changed = {i for i in after if after[i].text != before[i].text}
            assert all("[secret]" in after[i].text for i in changed)
            assert all(after[i] == before[i] for i in set(after) - changed)


def test_run_packs_what_is_left(spark):
    """Every id of every text that the stages before leave is in one place, and sequences have no gaps."""
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
    encode = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode
    want = {r.doc_id: encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}

    rows = corpus_pipeline.run(spark, FOLDER).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc_id, own in pieces.items():
        at = 0
        for number, r in enumerate(sorted(own, key=lambda r: r.piece)):
            ids = np.array(want[doc_id][at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (number, at, zlib.crc32(ids))
            at += r.length
        assert at == len(want[doc_id])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * -(-sum(map(len, want.values())) // 2048) + 1


def test_registered():
    names = list(entry_points.queries())
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert {"op1_warc", "op3_lm_scoring", "op11_jaccard_join", "op12_merkle"} <= set(entry_points.oracle_sql())
