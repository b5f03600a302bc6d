import sentencepiece

import corpus_pipeline
from lumisheet.llm import decontaminate, langid, pieces, pii, simhash
from lumisheet.llm.common import table


def test_stages(spark, sf_dir, odd_docs):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, []
    bench = [(str(r.item_id), decontaminate.words(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    sam = decontaminate.SuffixAutomaton(bench)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.durable(stage(spark, docs, sf_dir))
        after = {r.doc_id: r for r in docs.collect()}
        assert after.keys() <= before.keys() and docs.count() == len(after)
        seen.append(name)
        if name == "language_id":
            assert after.keys() == {k for k, r in before.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "simhash_near_dedup":
            prints = {k: simhash.fingerprint(r.text.encode()) for k, r in before.items()}
            for k in before.keys() - after.keys():
                assert any((prints[k] ^ prints[j]).bit_count() <= 4 for j in before if j != k)
            kept = sorted(after)
            assert not any((prints[a] ^ prints[b]).bit_count() <= 4 for i, a in enumerate(kept) for b in kept[:i])
            assert all(after[k] == before[k] for k in after)
        elif name == "benchmark_decontamination":
            for k, r in before.items():
                ws = decontaminate.words(r.text)
                hit = sum(b - a for a, b in sam.scan(ws)[0])
                assert (k in after) == (not (hit and 20 * hit >= len(ws)))
        elif name == "pii_redaction":
            assert after.keys() == before.keys() and not any(pii.base_spans(r.text)[0] for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            assert all(r.ids == model.encode(before[k].text) for k, r in after.items())
        if name != "sentencepiece":
            assert docs.columns == columns
    assert len(seen) == 5
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_odd_rows(spark, sf_dir, odd_docs, empty_docs):
    for rows in (odd_docs, empty_docs):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.durable(stage(spark, docs, sf_dir))
        assert docs.count() == (5 if rows is odd_docs else 0)
    assert langid.UNKNOWN == "und"
