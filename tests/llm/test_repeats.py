import numpy as np
import pytest

from tests.llm.fixtures import edited, odd, prose, rows, table
from tidemark.llm import audio, induced_sort, line_dedup, suffix_dedup
from tidemark.llm import _common as C


def brute_lines(data):
    """Texts without the lines that match an earlier one, by comparing with all of them."""
    seen, out = [], {}
    for doc, text in data:
        kept = []
        for line in (text or "").split("\n"):
            w = [x for x in line.lower().split(" ") if x]
            s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            if not s or not any(4 * len(s & t) >= 3 * len(s | t) for t in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[doc] = None if text is None else "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark):
    data = [(r[0], r[1]) for r in rows()]
    out = line_dedup.dedup_lines(table(spark), count="gone").collect()
    assert {r.doc_id: r.text for r in out} == brute_lines(data)
    assert {r.gone for r in out if r.text is None} == {0}


def test_lines_of_odd_rows(spark):
    out = line_dedup.dedup_lines(odd(spark)).collect()
    assert len(out) == 5 and sorted(str(r.text) for r in out) == ["None", "None"] + ["same text of some words here"] * 3
    assert line_dedup.dedup_lines(table(spark, [])).collect() == []


def test_lines_of_any_place_and_size_equal_brute_force(spark):
    """Places and sizes that fit the number of a filed row, and those beside it; copies and near copies across both."""
    base, many, long = prose(5, 60), "\n".join(f"a{i} b{i}" for i in range(8190)), prose(6, 4200, 10**6)
    ids = [-(2**63), -7, 0, 3, 2**28 - 1, 2**28, 2**40, 2**63 - 1]
    data = [(d, "\n".join([edited(base, d % 97, k), base, prose(d % 89, 30), long if k % 2 else edited(long, k, 9)])) for k, d in enumerate(ids)]
    data += [(50, f"{many}\n{edited(base, 1, 1)}\n{prose(8, 30)}\n{edited(prose(8, 30), 2, 1)}\n{base}"), (51, edited(prose(8, 30), 3, 1))]
    out = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.text for r in out} == brute_lines_by_words(sorted(data))


def brute_lines_by_words(data):
    """As brute_lines, by comparing only lines that share a token."""
    by, sets, out = {}, [], {}
    for doc, text in data:
        kept = []
        for line in text.split("\n"):
            w = line.lower().split()
            s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            if not any(4 * len(s & sets[k]) >= 3 * len(s | sets[k]) for k in {k for x in s for k in by.get(x, ())}):
                kept.append(line)
            for x in s:
                by.setdefault(x, []).append(len(sets))
            sets.append(s)
        out[doc] = "\n".join(kept)
    return out


def test_counted_hashes_are_the_filed_ones(spark):
    lines = line_dedup._lines(table(spark).where("text is not null")).select("line")
    one = sorted(r.h for r in line_dedup._each_hash(lines).collect())
    assert one == sorted(h for r in lines.select(line_dedup._hashes(C.F.col("line")).alias("h")).collect() for h in r.h)


def test_lines_are_filed_once_and_only_asked_lines_are_shuffled(spark, monkeypatch):
    copied = [prose(700 + i, 30) for i in range(40)]
    near = [(500, prose(9, 40)), (501, edited(prose(9, 40), 1, 1))]
    data = [(i, f"{copied[i % 40]}\n{prose(100 + i, 30)}") for i in range(400)] + near
    saved, plans, save = {}, {}, C.Workspace.save

    def spy(self, df, name):
        out = save(self, df, name)
        plans[name], saved[name] = df._jdf.queryExecution().optimizedPlan().toString().split("\n"), {tuple(r) for r in out.select("doc_id", "pos").collect()} if {"doc_id", "pos"} <= set(out.columns) else None
        return out

    monkeypatch.setattr(C.Workspace, "save", spy)
    out = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"), count="gone")
    assert sum(r.gone for r in out.collect()) == 361
    assert saved["files"] == {(i, 0) for i in range(40)} | {(i, 1) for i in range(400)} | {(500, 0), (501, 0)}  # no copies
    assert not [x for x in plans["files"] if "Filter" in x and "transform(" in x]  # tokens are built once
    assert {(500, 0), (501, 0)} <= saved["near-tokens"] and any("words" in x for x in plans["near-tokens"])  # by a bitmap


@pytest.mark.parametrize("seed", range(60))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 90)), 0).astype(np.int32)
    if seed % 3 == 0:
        t = np.append(np.tile(t[:-1][:4], 15), 0).astype(np.int32)
    for memory in (32, 1 << 20):
        got = np.concatenate(list(induced_sort.suffixes(t, int(t.max()) + 1, memory))).tolist()
        assert got == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute_repeats(data, width=suffix_dedup.WIDTH):
    seen = {}
    for _, text in data:
        b = (text or "").encode()
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for doc, text in data:
        b = (text or "").encode()
        cut = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                cut[i : i + width] = True
        kept = bytes(x for x, c in zip(b, cut, strict=False) if not c)
        out.append((doc, len(b), int(cut.sum()), int((cut[:-1] & ~np.concatenate(([False], cut[:-2]))).sum()) if len(b) else 0, kept))
    return out


def test_repeats_equal_brute_force(spark):
    data = [(r[0], r[1]) for r in rows() if r[1] is None or len(r[1]) < 20_000]
    kept = table(spark, [r for r in rows() if r[1] is None or len(r[1]) < 20_000])
    out = suffix_dedup.remove_repeats(kept).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted(brute_repeats(data))


def periodic(seed):
    """A text that repeats a unit of 2 to 420 characters between other characters, every second one barely."""
    rng = np.random.default_rng(seed)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    unit = letters(2 + seed % 419)
    size = len(unit) + 400 + int(rng.integers(1, 40)) if seed % 2 else int(rng.integers(401, 1200))
    return letters(int(rng.integers(0, 400))) + (unit * (1300 // len(unit) + 2))[:size] + letters(int(rng.integers(0, 400)))


def test_repeats_of_periodic_texts_equal_brute_force(spark):
    data = [(i, periodic(i)) for i in range(1500)] + [(2000, prose(90, 9000) + periodic(7) * 3 + prose(91, 9000))]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(8)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted(brute_repeats(data))


def test_places_of_a_key_are_counted_without_a_bound():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 9, 500).astype(np.uint64)
    lo = rng.integers(0, 400, 80)
    hi, wanted = lo + rng.integers(0, 150, 80), rng.integers(0, 9, 80).astype(np.uint64)
    exact = [int((g[a:b] == v).sum()) for v, a, b in zip(wanted, lo, hi, strict=True)]
    assert suffix_dedup._places_within(g, wanted, lo, hi).tolist() == exact


def test_repeats_of_odd_rows(spark):
    df = odd(spark).withColumn("text", C.F.repeat("text", 40))
    out = suffix_dedup.remove_repeats(df, as_text=True).collect()
    assert len(out) == 5 and {r.kept for r in out} == {""}
    assert suffix_dedup.remove_repeats(table(spark, [])).collect() == []


def sound(seed, notes=40):
    rng = np.random.default_rng(seed)
    t = np.arange(audio.HOP) / audio.RATE
    return (np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in rng.integers(0, 24, notes)]) * 9000).astype("<i2")


def test_audio_alignment(spark):
    whole, rng = sound(1, 60), np.random.default_rng(0)
    noisy = (whole + rng.normal(0, 150, len(whole))).astype("<i2")
    late = whole[10 * audio.HOP :]
    offset, error = audio.align(audio.fingerprint(whole), audio.fingerprint(late))
    assert offset == 10 and error < 0.02
    assert audio.align(audio.fingerprint(whole), audio.fingerprint(sound(2, 60)))[1] > audio.ERROR
    clips = [(0, whole), (1, noisy), (2, late), (3, sound(3)), (4, whole), (5, None), (6, whole[:100]), (None, whole)]
    media = spark.createDataFrame([(i, None if s is None else bytearray(s.tobytes())) for i, s in clips], "id long, samples binary")
    out = {r.id: r for r in audio.search(audio.fingerprints(media, "id"), "id", C.F.col("id") < 4).collect()}
    assert len(out) == 8 and out[4].class_id == out[0].class_id == 0 and out[4].match_id is None
    assert out[0].match_id in (1, 2) and out[2].match_id == 0 and out[2].match_offset == -10 and out[3].match_id is None
    assert out[5].class_id is None and out[6].n_frames == 0
    assert audio.search(audio.fingerprints(media.limit(0), "id"), "id", C.F.col("id") < 4).count() == 0


def test_components(spark):
    ws = C.Workspace(spark, "test")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    out = {r.id: r.component for r in C.connected_components(ws, edges).collect()}
    assert out == {i: 0 for i in range(41)} | {i: 90 for i in (90, 95, 100)}


def test_components_of_long_chains(spark):
    n = 400
    shuffled = np.random.default_rng(3).permutation(n).tolist()
    chains = [shuffled, [0, *range(n - 1, 0, -1)], list(range(n - 1, -1, -1)), list(range(n))]
    links = [(1000 * k + a, 1000 * k + b) for k, c in enumerate(chains) for a, b in zip(c, c[1:], strict=False)]
    links += [(4999, 4000 + i) for i in range(n)]
    edges = spark.createDataFrame(links, "a long, b long")
    out = {r.id: r.component for r in C.connected_components(C.Workspace(spark, "test"), edges).collect()}
    assert out == {1000 * k + i: 1000 * k for k in range(5) for i in range(n)} | {4999: 4000}


def test_files_have_no_sketches_and_mark_their_later_lines(spark, monkeypatch):
    """Lines whose number fits, and others, in one file; lines that share no token lead and follow nothing."""
    files, seen = line_dedup._files, []

    def kept(*args):
        out = files(*args)
        seen.extend(out.collect())
        return out

    monkeypatch.setattr(line_dedup, "_files", kept)
    data = [(1, prose(21, 60)), (2**40, prose(22, 60)), (2**40 + 1, prose(23, 60)), (3, f"{prose(24, 60)}\n{edited(prose(23, 60), 1, 1)}")]
    data += [(2**41, prose(25, 60)), (2**41 + 1, edited(prose(25, 60), 1, 1))]  # none fits
    out = line_dedup.removed_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {tuple(r) for r in out} == {(2**40 + 1, 0), (2**41 + 1, 0)}
    assert not any("sketch" in r for r in seen)
    shared = {(r.doc_id, r.pos) for r in seen if r.lead is not None and r.lead.doc_id == 3 and r.lead.pos == 1}
    assert shared == {(3, 1), (2**40 + 1, 0)}
    assert {(r.doc_id, r.pos) for r in seen if r.later} == {(2**40 + 1, 0), (2**41, 0), (2**41 + 1, 0)}
