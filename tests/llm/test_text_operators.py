import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import SCHEMA, edited, odd, prose, rows, table
from tidemark.llm import _common as C
from tidemark.llm import fingerprints, langid, licenses, packing, sentencepieces, toxicity

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abet hnd.,\n▁é漢😀<s>0x1\t\x00'\"")), max_size=60))
def test_encoding_equals_the_library(text):
    c, sp = sentencepieces.codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = sp.encode(text)
    assert c.encode(text) == ids and c.decode([*ids, c.end]) == sp.decode([*ids, c.end])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 260), max_size=12))
def test_decoding_any_ids_equals_the_library(ids):
    assert sentencepieces.codec(MODEL).decode(ids) == sentencepiece.SentencePieceProcessor(model_file=MODEL).decode(ids)


def test_sentencepiece_digests(spark, library):
    out = {r.doc_id: r for r in sentencepieces.round_trip_digests(table(spark), MODEL).collect()}
    for r in rows():
        ids = [*library.encode(r[1] or ""), library.eos_id()]
        assert (out[r[0]].n_tokens, out[r[0]].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert out[r[0]].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepieces.round_trip_digests(odd(spark), MODEL).count() == 5
    both = sentencepieces.decode(sentencepieces.encode(table(spark).select("doc_id", "text"), MODEL), MODEL).where("decoded <> replace(text, '▁', ' ')")
    assert both.count() == 0


def test_fingerprints(spark):
    out = {r.doc_id: r for r in fingerprints.edited_likeness(table(spark)).collect()}
    data = rows()
    assert len(out) == len(data)
    for k, r in enumerate(data):
        text, following = r[1] or "", data[(k + 1) % len(data)][1] or ""
        cut = len(text) // 4
        assert out[r[0]].n_chars == len(text)
        assert out[r[0]].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
        assert 0 <= out[r[0]].near_edited <= 1
    assert out[0].fingerprint == out[1].fingerprint and out[0].near_next == 1.0
    assert fingerprints.edited_likeness(odd(spark)).count() == 5
    assert fingerprints.edited_likeness(table(spark, [])).count() == 0
    one = fingerprints.edited_likeness(table(spark, [(3, "a b c d", None, None, None)])).first()
    assert one.near_next == 1.0


def test_fingerprint_collisions_estimate_the_generalised_jaccard():
    x = prose(5, 3000, 20)
    y = edited(x, 6, 300)

    def weights(t):
        w = t.split(" ")
        out = {}
        for pair in zip(w, w[1:], strict=False):
            out[pair] = out.get(pair, 0) + 1
        return out

    a, b = weights(x), weights(y)
    exact = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    f, g = fingerprints.fingerprints(pa.array([x, y]), 512)
    assert fingerprints.likeness(f, g) == pytest.approx(exact, abs=0.09)


def test_fingerprints_of_unrelated_texts_differ_whatever_their_length():
    rng = np.random.default_rng(4)
    for n in (50, 2000, 100_000):
        x, y = (" ".join(f"{c}{v}" for v in rng.integers(0, 10**9, n)) for c in "xy")
        f, g, h = fingerprints.fingerprints(pa.array([x, y, x]), 512)
        assert fingerprints.likeness(f, g) < 0.02 and (f == h).all()


def test_collisions_equal_the_generalised_jaccard_on_average():
    errors = []
    for seed in range(12):
        x = prose(seed, 1500, 8)
        y = edited(x, seed, 60 + 50 * seed).replace("z", "a")
        a, b = ({} for _ in "ab")
        for out, t in ((a, x), (b, y)):
            w = t.split(" ")
            for pair in zip(w, w[1:], strict=False):
                out[pair] = out.get(pair, 0) + 1
        exact = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        f, g = fingerprints.fingerprints(pa.array([x, y]), 2048)
        errors.append(fingerprints.likeness(f, g) - exact)
    assert abs(np.mean(errors)) < 0.015 and max(map(abs, errors)) < 0.05


def test_a_text_has_one_fingerprint_whatever_stands_beside_it():
    many = [t for t in (r[1] for r in rows()) if t]
    together = fingerprints.fingerprints(pa.array(many))
    for i, t in enumerate(many):
        assert (fingerprints.fingerprints(pa.array([t]))[0] == together[i]).all()


def test_near_edited_and_near_next_follow_the_texts(spark):
    data = [(i, prose(300 + i, 400, 10**6), None, None, None) for i in range(6)] + [(9, prose(305, 400, 10**6), None, None, None)]
    out = {r.doc_id: r for r in fingerprints.edited_likeness(table(spark, data)).collect()}
    assert out[5].near_next == 1.0 and all(out[i].near_next < 0.1 for i in range(5))
    # three of four quarters are shared: about 300 of 500 pairs
    assert all(0.35 < r.near_edited < 0.85 for i, r in out.items() if i != 5) and out[5].near_edited > 0.35


def test_packing(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    data = [*rows(), (900, "a<|endoftext|>b", None, None, None)]
    df = table(spark, data)
    pieces = packing.packed(df, with_ids=True)
    out = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.doc_id, r.start)):
        out.setdefault(r.doc_id, []).append(r)
    for r in data:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in out[r[0]]:
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    by_sequence = {}
    for ps in out.values():
        for p in ps:
            by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    total = sum(x[0].doc_tokens for x in out.values())
    assert sorted(by_sequence) == list(range(-(-total // 1024)))
    for k, spans in by_sequence.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 1024 or k == max(by_sequence)
    full = packing.sequences(pieces).collect()
    assert {len(r.ids) for r in full if r.n_tokens == 1024} == {1024} and all(len(r.ids) in (1024, r.n_tokens) for r in full)
    assert packing.packed(table(spark, [])).count() == 0 and packing.packed(odd(spark)).count() == 5


def test_language_identification(spark):
    def text(lang, seed):
        rng = np.random.default_rng(seed)
        parts = {"x": ["the", "ing", "tion", "er", "and"], "y": ["ción", "que", "los", "ado", "ñ"], "z": ["sch", "ung", "keit", "ich", "ä"]}[lang]
        return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(40))

    data = [(i, text("xyz"[i % 3], i), "xyz"[i % 3], None, None) for i in range(240)] + [(900, None, "x", None, None), (901, "123 ...", "x", None, None), (902, "", None, None, None)]
    df = table(spark, data)
    model = langid.train(df, ~langid.held_out(4, 2))
    out = langid.predict(df.withColumn("held", langid.held_out(4, 2)), model).collect()
    held = [r for r in out if r.held and r.doc_id < 900]
    assert len(held) > 30 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected for r in held)
    assert {(r.lang_pred, r.rejected) for r in out if r.doc_id >= 900} == {("und", True)}
    nothing = langid.train(table(spark, []), langid.held_out(4, 2))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(odd(spark), model).count() == 5


def test_unlearned_languages_and_junk_are_rejected_and_short_texts_stay():
    parts = {"x": ["the", "ing", "tion", "er", "and"], "y": ["ción", "que", "los", "ado", "ñ"], "z": ["sch", "ung", "keit", "ich", "ä"]}
    rng = np.random.default_rng(5)

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(n))

    sample = [(text(k, int(rng.integers(3, 120))), k) for k in parts for _ in range(200)]
    model = langid.fit([t for t, _ in sample], [k for _, k in sample])

    def accepted(texts):
        v = langid.vectors(pa.array(texts), model.idf)
        cosine = v @ model.centroids.T
        best = cosine.argmax(axis=1)
        return cosine.max(axis=1) >= model.reached(model.of[best], (v > 0).sum(axis=1))

    letters = "abcdefghijklmnopqrstuvwxyz"
    other = ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق."]
    junk = ["".join(rng.choice(list(alphabet), n)) for n in (40, 600, 3000) for alphabet in (letters, letters + "    ", letters + letters.upper() + "0123456789+/")]
    assert not accepted(other + junk).any()
    assert accepted([text(k, n) for k in parts for n in (2, 3, 5, 8) for _ in range(25)]).mean() >= 0.97


def test_toxicity(spark):
    data = [(i, prose(i, 60) + (" you idiot moron " if i % 4 == 0 else " ") + prose(i + 1000, 30), None, None, None) for i in range(300)]
    df = table(spark, data)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5000, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, ~langid.held_out(5, 0))
    out = toxicity.score(df.withColumn("held", langid.held_out(5, 0)), model).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in out if r.held)
    flat = toxicity.train(df, labels.where("toxic = 0"), ~langid.held_out(5, 0))
    assert {r.predicted for r in toxicity.score(df, flat).collect()} == {0}
    assert toxicity.score(odd(spark), model).count() == 5 and toxicity.score(table(spark, []), model).count() == 0


PHRASES = ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl"))


def test_licenses(spark):
    data = [*rows(), (500, "MIT LICENSE mit license general public\tlicense", None, None, None), (501, "éapache license apache license apachelicense", None, None, None), (502, "SPDX-License-Identifier: Apache-2.0\nRedistribution and use in source and binary forms", None, None, None), (503, "Kmit license", None, None, None)]
    out = {r.doc_id: r for r in licenses.scan(table(spark, data)).collect()}
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for r in data:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(low))
        hits = sorted((k, label) for words, label in PHRASES for k in range(len(w)) if w[k : k + len(words)] == words)
        o = out[r[0]]
        assert (o.n_words, o.n_base, o.first_word, o.last_word) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert o.base_labels == ",".join(sorted({label for _, label in hits})) and 0 <= o.score <= 1
        assert set(filter(None, o.base_labels.split(","))) <= set(o.labels.split(","))
    assert "apache-2.0" in out[502].labels and "bsd" in out[502].labels and out[0].labels == ""
    # a notice with its version contains the bare name, which goes
    kept = licenses.scan(table(spark, [(1, "licensed under the apache license version 2.0", None, None, None)])).first()
    assert [d.label for d in kept.detections] == ["apache-2.0"]
    assert licenses.scan(odd(spark)).count() == 5 and licenses.scan(table(spark, [])).count() == 0
    assert len(licenses.RULES) > 300 and SCHEMA


def expanded(pattern, rng):
    """A random text of words that a rule's pattern matches."""
    def walk(items):
        out = ""
        for op, x in items:
            op = str(op)
            if op == "LITERAL":
                out += chr(x)
            elif op == "BRANCH":
                out += walk(rng.choice(x[1]))
            elif op == "SUBPATTERN":
                out += walk(x[-1])
            elif op == "MAX_REPEAT":
                out += walk(x[2]) * rng.randint(x[0], min(int(x[1]), x[0] + 1))
            elif op == "IN":
                kind, value = rng.choice(x)
                out += chr(value) if str(kind) == "LITERAL" else "7"
            else:
                assert op == "ASSERT_NOT"
        return out

    return walk(re._parser.parse(pattern))


def test_a_license_keyword_stands_in_all_that_its_rule_matches():
    rng = random.Random(4)
    for r in licenses.RULES:
        for _ in range(100):
            line = f" {expanded(r.pattern, rng)} "
            assert f" {r.keyword}{' ' * (r.keyword in licenses._WHOLE)}" in line, (r, line)
            assert re.search(licenses.ANY_KEYWORD, line), (r, line)


def test_licenses_by_names_without_their_familys_keyword(spark):
    cases = [("under the PSF license 2.0", "psf-2.0"), ("ASL 2.0", "apache-2.0"), ("Berkeley Software Distribution license", "bsd"), ("responsible AI license", "rail"), ("CC Zero 1.0", "cc0-1.0"), ("CCBY-SA 4.0", "cc-by-sa-4.0"), ("MIT X11 license", "mit"), ("MPLv2.0", "mpl-2.0"), ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", "boost")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    out = {r.doc_id: r.labels.split(",") for r in licenses.scan(df).collect()}
    assert all(label in out[i] for i, (_, label) in enumerate(cases)), out


def test_packing_hands_python_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with C.small_batches(spark, 7):
        assert max(r.n for r in spark.range(0, 30, 1, 1).mapInArrow(sizes, "n long").collect()) == 7
    assert spark.conf.get(name) == before
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(1500)], "doc_id long, text string").coalesce(1)
    pieces = packing.packed(docs)
    assert "MapInArrow" not in pieces._jdf.queryExecution().toString()  # no pass is left to the caller's batches
    assert pieces.select("doc_id").distinct().count() == 1500 and spark.conf.get(name) == before
