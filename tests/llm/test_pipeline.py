import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from quantloom.llm import bpe, minhash, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def story(i, n=40):
    return " ".join(f"word{(i * 7919 + j * 104729) % 9973}" for j in range(n))


def test_stages_one_after_another(spark, tmp_path):
    passage = " ".join(f"shared{j}" for j in range(60))
    docs = [(i, story(i) + f"\nline {i} {story(i + 500, 9)}", "en", f"s{i % 3}", 0) for i in range(60)]
    docs += [(100 + i, story(i) + f" extra{i}", "en", "s0", 0) for i in range(10)]  # near copies
    docs += [(200 + i, passage + "\n" + story(900 + i), "en", "s1", 0) for i in range(6)]
    docs += [(300 + i, "JUNK!! " * (20 + i), "en", "s2", 0) for i in range(40)]
    docs += [(400, None, "en", None, 0), (401, "", None, "s1", None)]
    labels = [(i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(30)]
    write(spark, tmp_path, docs, labels)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen, now = {}, frame
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe_encoding":
            assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
    model = quality.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(frame, model).collect()}
    assert {r["doc_id"] for r in seen["quality_classifier"]} == {d for d, s in scores.items() if s >= corpus_pipeline.MIN_QUALITY}
    assert not [r for r in seen["quality_classifier"] if 300 <= r["doc_id"] < 400] and len([r for r in seen["quality_classifier"] if r["doc_id"] < 100]) == 60
    texts = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert passage in texts[200] and all(passage not in texts[200 + i] and story(900 + i) in texts[200 + i] for i in range(1, 6))
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"] if 201 <= r["doc_id"] < 206)
    sets = {r["doc_id"]: minhash.shingle_set(minhash.words_of(r["text"]), 5) for r in seen["line_dedup"]}
    kept = {r["doc_id"] for r in seen["minhash_near_dedup"]}
    for a in sets:
        twins = [b for b in sets if b < a and sets[a] and sets[b] and minhash.linked(sets[a], sets[b], 80)]
        assert (a in kept) == (not twins)
    assert {r["doc_id"] for r in seen["mixing_sources"]} <= kept
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    mixed = sorted((r["doc_id"], tuple(own.encode_ordinary(r["text"] or ""))) for r in seen["mixing_sources"])
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in seen["bpe_encoding"]) == mixed
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for r in seen["bpe_encoding"])
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in run) == mixed


def test_pipeline_on_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
