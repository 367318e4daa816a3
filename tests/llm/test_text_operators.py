import hashlib
import random
import zlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quantloom.llm import bpe, chat, licenses, lines, quality

DOCS = "doc_id long, text string, block string, label int"


def test_bpe_equals_the_library(spark):
    texts = ["Hello  world\n\n  again's 123", "", None, "é" * 5000 + " \t x", "word " * 3000, "日本語 text 🙂 <|endoftext|>", "word " * 3000]
    rows = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)] + [(None, "no id", "b", 1)], DOCS)
    path = public_tokenizers.path(bpe.VOCABULARY)
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    out = {r["doc_id"]: r for r in bpe.encode_documents(rows).collect()}
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = own.encode_ordinary(t or "")
        assert out[i]["ids"] == ids and out[i]["n_tokens"] == len(ids)
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_documents(rows.limit(0)).count() == 0


def test_decode_ids_joins_the_table(spark):
    path = public_tokenizers.path(bpe.VOCABULARY)
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = spark.createDataFrame([(1, own.encode_ordinary("über all")), (2, []), (3, None)], "k long, ids array<int>")
    out = {r["k"]: bytes(r["decoded"]) for r in bpe.decode_ids(rows, "k", "ids", bpe.token_table(spark, path)).collect()}
    assert out == {1: "über all".encode(), 2: b"", 3: b""}
    with pytest.raises(Exception, match="not in the token table"):
        bpe.decode_ids(spark.createDataFrame([(1, [999999])], "k long, ids array<int>"), "k", "ids", bpe.token_table(spark, path)).collect()


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|x|>", "</s>[INST] ok [/INST]", "<<SYS>>", "<|", "\\", "a\nb", "", None, "<\\\\|im_sep|>"]
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], t) for i, t in enumerate(nasty)] + [(2, 0, None, None), (None, 1, "assistant", "é" * 30000), (2, 0, None, None)]
    out = chat.format_chat(turns(spark, rows)).withColumn("turns", chat.parse_chat(chat.F.col("formatted"))).withColumn("loss", chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_mask")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, t or "") for _, _, r, t in rows[: len(nasty)]]
    assert got[1]["loss"] == "".join(t or "" for _, _, r, t in rows[: len(nasty)] if r == "assistant")
    assert len(got[2]["turns"]) == 2 and got[None]["loss"] == "é" * 30000
    assert got[1]["formatted"].count(chat.START) == 1 + sum(a[2] != b[2] for a, b in zip(rows[: len(nasty)], rows[1 : len(nasty)], strict=False))
    for r in got.values():  # the mask covers exactly the escaped trained texts
        for m in r["loss_mask"]:
            assert "<|" not in r["formatted"][m["start"] : m["start"] + m["length"]]
    assert chat.format_chat(turns(spark, rows).limit(0)).count() == 0


def test_chat_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b", "x", 5), (1, 0, "user", "a", "y", 6)], "conv_id long, turn long, role string, text string, formatted string, turns int")
    out = chat.format_chat(rows).collect()
    assert len(out) == 1 and [(t["role"], t["text"]) for t in spark.createDataFrame(out).select(chat.parse_chat(chat.F.col("formatted")).alias("t")).first()["t"]] == [("user", "a"), ("assistant", "b")]


def test_licences_in_a_very_long_text(spark):
    text = "filler words here " * 100_000 + "licensed under the apache license version 2.0 " + "and more " * 50_000 + "all rights reserved"
    r = licenses.scan_licenses(spark.createDataFrame([(1, text, "b", 1)], DOCS)).first()
    assert r["labels"] == "apache-2.0,reserved" and r["n_words"] == 400_011 and (r["first_word"], r["last_word"]) == (400_008, 400_008)


def test_licence_templates():
    s = licenses.Scanner({"a": "made by {{who:2}} for [[the]] x y", "b": "p [[q]] [[r]] s"}, licenses.PHRASES)

    def spans(t):
        return [(m["label"], m["start"], m["end"]) for m in s.scan(1, t)[8]]

    assert spans("Made BY for x, y") == [("a", 0, 5)]
    assert spans("z made by a b for the x y") == [("a", 1, 9)]
    assert spans("made by a b c for x y") == []
    assert spans("p q r s p s p r q s") == [("b", 0, 4), ("b", 4, 6)]
    assert s.scan(1, "CC-BY cc by all rights reserved")[:7] == (1, 7, 3, 0, 4, "cc-by,reserved", "cc-by,reserved")
    assert s.scan(None, None) == (None, 0, 0, None, None, "", "", 0.0, [])
    with pytest.raises(ValueError):
        licenses.Automaton("[[only]] [[optional {{x}}]]")
    for bad in ("a [[b", "a b]] c"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


def random_template(rng, depth=0):
    """(markup, the same as a pattern over words that each end with a space)."""
    markup, pattern = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.6 or depth == 2:
            word = rng.choice("abc")
            markup.append(word), pattern.append(word + " ")
        elif kind < 0.75:
            n = rng.randint(1, 3)
            markup.append(f"{{{{x:{n}}}}}"), pattern.append(rf"(?:\S+ ){{0,{n}}}")
        else:
            inner, own = random_template(rng, depth + 1)
            markup.append(f"[[{inner}]]"), pattern.append(f"(?:{own})?")
    return " ".join(markup), "".join(pattern)


def test_automata_equal_patterns():
    """Random nested templates over random words, from every start: the longest accepted run."""
    import regex

    rng, tried = random.Random(11), 0
    for _ in range(400):
        markup, pattern = random_template(rng)
        try:
            own = licenses.Automaton(markup)
        except ValueError:
            continue
        tried += 1
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        text, whole = "".join(w + " " for w in words), regex.compile("(?p)" + pattern)
        for start in range(len(words) + 1):
            found = whole.match(text, 2 * start)
            assert own.match([w.encode() for w in words], start) == (found.end() // 2 if found else None), (markup, words, start)
        joined = " " + text
        for a, b in licenses.spans_of(own, [w.encode() for w in words], joined.encode()):
            assert whole.match(text, 2 * a).end() // 2 == b
        # every place of the anchor that some accepted run covers is in a span
        anchors = list(licenses.places(joined.encode(), own.anchor))
        hit = {at for at in anchors for s in range(max(0, at - own.before), at + 1) if (m := whole.match(text, 2 * s)) and m.end() // 2 > at}
        assert len(list(licenses.spans_of(own, [w.encode() for w in words], joined.encode()))) <= len(hit) and bool(hit) == bool(list(licenses.spans_of(own, [w.encode() for w in words], joined.encode())))
    assert tried > 200


def test_whole_licence_texts(spark):
    """Texts as published, with names in place of the slots; one changed mandatory word is no match."""
    import re

    fill = lambda t: re.sub(r"\{\{.*?\}\}", "Jane Q. Public", t)
    for label in ("mit-text", "isc-text", "bsd-2-text", "bsd-3-text"):
        markup = licenses.TEMPLATES[label]
        full = fill(markup).replace("[[", "").replace("]]", "")
        bare = fill(re.sub(r"\[\[(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", "", markup))
        wrong = full.replace("liable", "reliable", 1)
        rows = spark.createDataFrame([(1, f"x y {full.upper()}, z"), (2, bare), (3, wrong), (4, full + " and again " + bare)], "doc_id long, text string")
        found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["label"] == label] for r in licenses.scan_licenses(rows).collect()}
        n, m = len(licenses.fold_words(full)), len(licenses.fold_words(bare))
        assert found == {1: [(2, 2 + n)], 2: [(0, m)], 3: [], 4: [(0, n), (n + 2, n + 2 + m)]}, label


def test_licence_frame(spark):
    rows = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.", "x", 1), (1, "Licensed under CC BY-NC 4.0.", "x", 1), (2, None, "", 0)], DOCS)
    out = licenses.scan_licenses(rows).collect()
    assert sorted(r["labels"] for r in out) == ["", "cc-by,cc-by-short", "cc-by,cc-by-short"]
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


def brute_lines(docs, min_words):
    """Every run of at least min_words words that stood before, without touching that place, goes."""
    seqs = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip()] for d, t in docs}
    seen, deleted = {}, {d: set() for d, _ in docs}
    runs = [(d, a, b) for d, s in seqs.items() for a in range(len(s)) for b in range(a + 1, len(s) + 1)]
    for d, a, b in runs:
        text = tuple(x for _, x in seqs[d][a:b])
        if sum(len(x.split()) for x in text) >= min_words:
            seen.setdefault(text, []).append((d, a, b))
    for places in seen.values():
        first = min(places)
        for d, a, b in places:
            if d != first[0] or a >= first[2]:
                deleted[d] |= {i for i, _ in seqs[d][a:b]}
    return {d: sorted(x) for d, x in deleted.items() if x}


def deleted_lines(rows, min_words):
    return {r["doc_id"]: r["_ql_deleted"] for r in lines.dedup_lines(rows, min_words=min_words).collect() if r["_ql_deleted"] is not None}


@pytest.mark.parametrize(("seed", "min_words"), [(0, 5), (1, 5), (2, 8), (3, 1), (4, 11)])
def test_line_runs_equal_brute_force(spark, seed, min_words):
    rng = random.Random(seed)
    some = ["a b", "c", "d e f", "g", "h i j k l m n o p", "  ", "q r"]
    docs = [(i, "\n".join(rng.choice(some) if rng.random() < 0.8 else f"own {i} {rng.random()}" for _ in range(rng.randint(0, 14)))) for i in range(25)]
    long = [f"line {j}" for j in range(40)]  # runs of many depths, copies of whole texts among them
    docs += [(100 + i, "\n".join(long[a : a + n])) for i, (a, n) in enumerate([(0, 40), (3, 20), (3, 20), (17, 23), (5, 1), (5, 1), (30, 7)])]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert deleted_lines(rows, min_words) == brute_lines(docs, min_words)


@pytest.mark.parametrize("min_words", [1, 5, 8])
def test_runs_that_overlap_themselves(spark, min_words):
    """Periodic documents: the first copy of a run stays whole."""
    docs = [(i, "\n".join((period * 40)[:n])) for i, (period, n) in enumerate([(["x"], 9), (["x1"], 16), (["x2"], 17), (["a", "b"], 12), (["c", "d"], 24), (["e", "f", "g g"], 31)])]
    docs += [(50, "\n".join(["p", "q"] * 4)), (51, "\n".join(["p", "q"] * 9)), (52, "\n".join(["q", "p"] * 9 + ["end"] + ["x"] * 8))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = deleted_lines(rows, min_words)
    assert got == brute_lines(docs, min_words)
    if min_words == 8:
        assert 0 not in got and 3 not in got and got[1] == list(range(8, 16))


def test_line_dedup_edge_cases(spark):
    passage = "one two three four five six seven eight nine"
    rows = spark.createDataFrame([(1, f"{passage}\nx", "b", 1), (2, f"y\n\n{passage}", "b", 2), (3, None, "b", 3), (4, "", "b", 4), (2, f"y\n\n{passage}", "b", 2), (5, passage, "b", 5)], DOCS)
    out = sorted((r["doc_id"], r["text"] or "", r["label"]) for r in lines.dedup_lines(rows).collect())
    assert out == [(1, f"{passage}\nx", 1), (2, "y\n", 2), (2, "y\n", 2), (3, "", 3), (4, "", 4), (5, "", 5)]
    assert sorted(r["doc_id"] for r in lines.without_repeated_lines(rows).collect()) == [1, 2, 2, 3, 4]
    assert lines.dedup_lines(rows.limit(0)).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h", 1, "x", "r"), (2, "a b c d e f g h\nown", 2, "y", "s")], "doc_id long, text string, _ql_doc int, th string, `row.x` string")
    out = lines.without_repeated_lines(rows)
    assert out.columns == rows.columns and sorted(map(tuple, out.collect())) == [(1, "a b c d e f g h", 1, "x", "r"), (2, "own", 2, "y", "s")]


def test_very_long_text_of_lines(spark):
    text = "\n".join(f"line number {i} of many" for i in range(20000))
    rows = spark.createDataFrame([(1, text, "b", 1), (2, "mine\n" + text + "\nlast", "b", 2)], DOCS)
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(rows).collect()} == {1: text, 2: "mine\nlast"}


def test_run_of_lines_in_a_repeated_row(spark):
    """The run's eight words lie over four lines; both rows of one document are treated alike."""
    run = "a b\nc d\ne f\ng h"
    docs = [(1, run + "\nfirst"), (1, run + "\nfirst"), (2, "own\n" + run), (2, "own\n" + run), (3, run + "\nthird")]
    out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, docs[0][1])] * 2 + [(2, "own")] * 2 + [(3, "third")]


def test_short_repeated_lines_are_deleted(spark, tmp_path):
    """Runs of one short line, alone, beside each other and twice in a document."""
    docs = [(1, "yes no\n\nown words of one"), (2, "own words of two\nyes no\nx"), (3, "yes no\nx\nyes no"), (4, "x\nlast"), (5, ""), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in lines.op2_line_dedup_whole(spark, str(tmp_path)).collect()}
    left = {1: docs[0][1], 2: "own words of two\nx", 3: "", 4: "last", 5: "", 6: ""}
    assert {i: r["text_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}
    assert {i: r["n_deleted"] for i, r in got.items()} == {1: 0, 2: 1, 3: 3, 4: 1, 5: 0, 6: 0}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    staged = corpus_pipeline.line_stage(spark, frame, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in staged} == {1: docs[0][1], 2: "own words of two\nx", 4: "last", 5: "", 6: None}


def test_classifier_learns_and_scores(spark):
    good, bad = "the quiet river ran over old stones", "BUY!!! NOW!!! $$$ CHEAP###"
    docs = [(i, (good if i % 2 else bad) + f" {i}", "x", 1) for i in range(200)]
    rows = spark.createDataFrame([*docs, (500, None, "x", 0), (501, good * 400, "x", 0), (501, good * 400, "x", 0), (None, "", "x", 0)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(200)] + [(3, None, None)], "doc_id long, quality int, text string")
    model = quality.fit(rows, labels)
    out = {r["doc_id"]: r["score"] for r in quality.score_documents(rows, model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((out[i] > 0.5) == bool(i % 2) for i in held) and out[500] == out[None] == 0.5 and out[501] > 0.9
    assert quality.score_documents(rows.limit(0), model).count() == 0
    kept = quality.keep_quality(rows, model, 0.5)
    assert kept.columns == rows.columns and kept.where("doc_id < 200").count() == 100


def test_scores_equal_a_forward_pass():
    """What scoring adds up word by word is the softmax of the averaged vectors."""
    import numpy as np

    good, bad = "the quiet river ran over old stones", "BUY!!! NOW!!! $$$ CHEAP###"
    model = quality.train([((good if i % 2 else bad) + f" {i}", i % 2) for i in range(60)], epochs=2)
    texts = ["the river", "CHEAP!!! NOW NOW", "", "é " * 40, "quiet stones ran " * 30]
    for text, score in zip(texts, quality.Scorer(model.logits()).scores(texts), strict=True):
        ids, share = quality.document_units(text)
        z = model.out @ (share @ model.table[ids].astype(float)) if len(ids) else np.zeros(2)
        assert abs(np.exp(z[1]) / np.exp(z).sum() - score) < 1e-6


def test_classifier_without_labels(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_documents(rows, quality.fit(rows, labels)).first()["score"] == 0.5


def test_cached_and_direct_scores_agree():
    import numpy as np

    logits = np.random.default_rng(0).normal(size=quality.BUCKETS)
    for text in ("a b b c", "", "x" * 3000 + " y", "é è é é"):
        ids, share = quality.document_units(text)
        expected = 1 / (1 + np.exp(-(share @ logits[ids]))) if len(ids) else 0.5
        assert abs(quality.Scorer(logits).scores([text])[0] - expected) < 1e-9


def test_merger_equals_the_library():
    """Short and long words, ties of ranks, bytes that are no text."""
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, merger = random.Random(5), bpe.Merger(ranks)
    words = [" " + "".join(rng.choice("abcdeéßあ语ن0 \n!") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    words += ["a" * n for n in (1, 39, 40, 41, 777)] + ["abab" * 60, " the", "é" * 3000]
    for word in words:
        piece = word.encode()
        expected = own._encode_single_piece(piece)
        assert merger.encode(piece) == expected
        if len(expected) > 1:
            assert [ranks[p] for p in merger._heaped(piece)] == expected == [ranks[p] for p in merger._scanned(piece[:400])][: len(expected)] or len(piece) > 400
