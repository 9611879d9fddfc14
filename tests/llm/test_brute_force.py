"""The registered queries that SQL cannot express, and the pipeline's stages, against plain recomputation."""

import io
import math
import random
import re
import tracemalloc
import wave
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import kneserney, langid, licenses, media, mixing, queries

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def clashing(spark, rows, kinds):
    """A table with columns that are named like the operators' own."""
    named = "__source string, __gone string, __text string, __at int, __id int, salt int, n int, v int, key int"
    return spark.createDataFrame([(*r, *["x"] * 3, *[1] * 6) for r in rows], f"{kinds}, {named}")


def test_op6_features_and_wav_bytes(spark, documents):
    got = {r.doc_id: r for r in queries.queries()["op6_media_columns"](spark, SF).collect()}
    assert len(got) == len(documents)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(576) / 575)
    for r in documents:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, len(payload), "NONE", ""))
            w.writeframes(payload)
        g = got[r.doc_id]
        import hashlib

        assert (g.n_bytes, g.payload_bytes, g.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert g.payload_sha256 == hashlib.sha256(payload).hexdigest() and g.media_sha256 == hashlib.sha256(out.getvalue()).hexdigest() and g.media_bytes == len(out.getvalue())
        pairs = [x.split(":") for x in g.feature.split(" ")]
        frames = {}
        for t, code in ((int(t), int(c)) for t, c in pairs):
            low, high, apart = code >> 16, (code >> 4) & 0xFFF, code & 15
            for at, bin_, a, b in ((t, low, 1, 72), (t + apart, high, 72, 289)):
                if at not in frames:
                    x = np.frombuffer(payload, np.uint8)[288 * at : 288 * at + 576].astype(float) - 128
                    frames[at] = np.abs(np.fft.fft(x * window))[:289] ** 2
                p = frames[at]
                assert a <= bin_ < b and p[bin_] >= p[a:b].max() * (1 - 1e-4)  # float32 against float64
        n = (len(payload) - 576) // 288 + 1
        assert len(pairs) == (1 if n == 1 else (n - 1) + max(n - 2, 0))


def test_op6_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "a" * 3_000_000), (None, "x")]
    table = clashing(spark, rows, "doc_id int, text string").withColumn("codes", F.lit(1))
    out = media.features(media.store(table)).collect()
    assert sorted((r.n_bytes, len(r.payload)) for r in out) == [(0, 576)] * 3 + [(1, 576), (3_000_000, 576 * 5209)]
    assert media.features(media.store(table.limit(0))).count() == 0


def kneser_ney(texts, order=2):
    """Base and model score of a text by the formulas, from dictionaries."""
    padded = lambda t: ["<s>"] * (order - 1) + words((t or "").translate(FOLD)) + ["</s>"]
    grams = lambda x: [tuple(x[i - order + 1 : i + 1]) for i in range(order - 1, len(x))]
    raw = [g for t in texts for g in grams(padded(t))]
    counts = {order: Counter(raw)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    uni = Counter(g[-1] for g in raw)
    after = defaultdict(list)
    for k in range(2, order + 1):
        for g, n in counts[k].items():
            after[g[:-1]].append(n)

    def discounts(values):
        n = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        if not all(n[:3]):
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    d = {k: discounts(c.values()) for k, c in counts.items()}
    total, types, v_ = sum(uni.values()), sum(counts[1].values()), len(uni)
    rest = sum(d[1][min(n, 3)] for n in counts[1].values()) / types / (v_ + 1)

    def p(gram):
        n = counts[len(gram)][gram]
        if len(gram) == 1:
            return max(n - d[1][min(n, 3)], 0) / types + rest
        of = d[len(gram)]
        held = sum(after[gram[:-1]])
        gamma = sum(of[min(c, 3)] for c in after[gram[:-1]]) / held if held else 1.0
        return (max(n - of[min(n, 3)], 0) / held if n else 0) + gamma * p(gram[1:])

    def score(text):
        own = grams(padded(text))
        base = sum(math.log10((uni[g[-1]] + 0.1) / (total + 0.1 * (v_ + 1))) for g in own)
        return len(own), sum(uni[g[-1]] > 0 for g in own), base, sum(math.log10(p(g)) for g in own)

    return total, score


def test_op8_scores(spark, documents):
    out_of = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    total, score = kneser_ney([r.text for r in documents if not out_of(r.doc_id)])
    got = {r.doc_id: r for r in queries.queries()["op8_lm_scoring"](spark, SF).collect()}
    assert len(got) == len(documents)
    for r in documents:
        n, known, base, own = score(r.text)
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (out_of(r.doc_id), n, known, total)
        assert math.isclose(g.base_score, base, rel_tol=1e-9) and math.isclose(g.score, own, rel_tol=1e-9)


def test_op8_edges_and_hot_contexts(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(x for _ in range(r.randint(1, 40)) for x in ("the", f"w{r.randrange(200)}")) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, None), (5, "")]
    table = clashing(spark, rows, "doc_id int, text string").withColumn("score", F.lit("x")).repartition(5)
    model = kneserney.train(table, parts=5)
    assert any(model.hot) and model.parts == 5
    total, score = kneser_ney([t for _, t in rows])
    got = sorted((x.n_tokens, round(x.score, 6)) for x in kneserney.score(table, model).collect())
    assert model.tokens == total and got == sorted((score(t)[0], round(score(t)[3], 6)) for _, t in rows)
    assert kneserney.score(table.limit(0), model).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_op8_higher_orders(spark, documents, order):
    r = random.Random(3)
    some = [x.text for x in documents[:60]]
    rows = [(t,) for t in some + some[:3] + [" ".join(f"w{r.randrange(4)}" for _ in range(r.randint(0, 30))) for _ in range(300)] + [None, "", "One two"]]
    table = spark.createDataFrame(rows, "text string").repartition(4)
    model = kneserney.train(table, parts=3, order=order)
    _, score = kneser_ney([t for (t,) in rows], order)
    seen = rows + [("never seen words here",), ("w1 w2 unseen w1 w2 w3",)]
    got = kneserney.score(spark.createDataFrame(seen, "text string"), model).collect()
    assert len(model.discounts) == order - 1 and len(got) == len(seen)
    for g in got:
        n, known, base, own = score(g.text)
        assert (g.n_tokens, g.n_known) == (n, known)
        assert math.isclose(g.base_score, base, rel_tol=1e-9) and math.isclose(g.score, own, rel_tol=1e-9)


def test_op8_order_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        kneserney.train(spark.createDataFrame([("a",)], "text string"), order=1)


def test_op10_names_languages_it_did_not_see(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.queries()["op10_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held == [r for r in got if r.held_out] and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", lang[r.doc_id].text or ""))
    asked = [r for r in held if lang[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id].lang for r in asked) >= 0.97 * len(asked) > 0


def test_op10_edges(spark):
    rows = [(i % 7 if i % 2 else None, t, g) for i in range(60) for t, g in (("the house and the garden of the town", "en"), ("das haus und der garten in der stadt", "de"))]
    table = clashing(spark, rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(3))
    model = langid.learn(table, per_language=5)
    again = langid.learn(table.repartition(7), per_language=5)
    assert model.languages == again.languages and np.array_equal(model.centroids, again.centroids)
    got = langid.identify(table, model).collect()
    assert len(got) == 120 and all(r.lang_pred == r.lang for r in got)
    assert langid.identify(table.limit(0), model).count() == 0


def cosine(terms_a, terms_b, idf):
    a, b = ({t: (1 + math.log(n)) * idf(t) for t, n in Counter(x).items()} for x in (terms_a, terms_b))
    return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def test_op9_scores_are_cosines_and_folders_inherit(spark, documents):
    """Every own score is recomputed from all texts; inheritance by walking up from each path."""
    got = {r.doc_id: r for r in queries.queries()["op9_license_scan"](spark, SF).collect()}
    split = {r.doc_id: licenses.terms(r.text or "") for r in documents}
    df = Counter(t for x in split.values() for t in set(x))
    idf = lambda t: 1 + math.log((len(documents) + 1) / (df[t] + 1))
    folder = Path(licenses.__file__).parent / "licence_texts"
    heads = [(name, licenses.terms(text), licenses.terms(marks[0])) for name, text, marks in licenses.TEMPLATES] + [(name, licenses.terms(t), licenses.terms(t)) for name, t in licenses.TITLES]
    whole = [(name, licenses.terms(text or (folder / f"{name}.txt").read_text())) for name, text, _ in licenses.TEXTS]
    for i, g in got.items():
        best = 0.0
        for name, own, phrase in heads:
            off = next(k for k in range(len(own)) if own[k : k + len(phrase)] == phrase)
            for at in range(len(split[i])):
                if name == g.own_license and split[i][at : at + len(phrase)] == phrase:
                    best = max(best, cosine(split[i][max(at - off, 0) : at - off + len(own)], own, idf))
        for name, own in whole:
            if name == g.own_license and g.path.endswith("/LICENSE"):
                best = max(best, cosine(split[i], own, idf))
        if g.own_license:
            assert math.isclose(g.own_score, best, abs_tol=1e-9) and best >= 0.7
    given = {}
    for g in got.values():
        if g.path.endswith("/LICENSE") and g.own_license:
            place = g.path.rsplit("/", 1)[0]
            given[place] = max(given.get(place, (0, "")), (g.own_score, g.own_license))
    for g in got.values():
        place = g.path
        while place and g.own_license is None:
            place = place.rsplit("/", 1)[0] if "/" in place else ""
            if place in given:
                break
        want = (g.own_license, None) if g.own_license else (given[place][1], place) if place in given else (None, None)
        assert (g.license, g.inherited_from) == want


def test_mix_in_order_is_the_mix(spark):
    docs = spark.createDataFrame([(i // 2, "ab"[i % 5 % 2], "w " * (i % 9)) for i in range(200)] + [(1, "a", "x y")] * 3 + [(None, None, "z")] * 2, "doc_id long, source string, text string")
    plan = mixing.schedule(docs, "doc_id", "source", "text").collect()
    order = mixing.mix_in_order(docs).collect()
    assert [r.finish for r in order] == sorted(r.finish for r in order)
    assert len(order) == sum(r.copies for r in plan) and sum(r["rows"] for r in plan) == docs.count()
    taken, budget = sum(r.copies * r["rows"] * r["size"] for r in plan), 1.5 * sum(r["rows"] * r["size"] for r in plan)
    assert budget - 60 <= taken <= budget
    each = Counter((r.doc_id, r.source, r.text) for r in mixing.mix(docs).collect())
    assert sum(len(words(t)) * n for (_, _, t), n in each.items()) == taken


def test_stages_hold_on_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names, no rows."""
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()
    rows = [tuple(r) for r in base] + [(None, "the house and the garden", None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "word " * 200_000, "en", None, 1), *[tuple(base[0])] * 3]
    table = clashing(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (table, table.limit(0)):
        held = {r.doc_id for r in data.collect()}
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, data, SF)
            assert (out.columns == data.columns) if k < 4 else (set(data.columns) <= set(out.columns))
            found = out.collect()
            assert {r.doc_id for r in found} <= held and (bool(found) == bool(held))


def test_op8_tasks_hold_pairs_once_and_sum_slices(tmp_path, monkeypatch):
    """A merge works on slices of its pairs, in bytes a pair; blocks are dealt in small rows; one slice or many, the same result."""
    rng = np.random.default_rng(8)
    n = 1_200_000
    contexts, words = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (200_000, 50_000))
    u, v = contexts[rng.integers(0, len(contexts), n)], words[rng.integers(0, len(words), n)]
    blocks = []
    for a in range(0, n, 100_000):
        pairs = kneserney._summed(u[a : a + 100_000], v[a : a + 100_000], np.ones(100_000, np.int64), np.zeros((100_000, 0), np.uint64))
        blocks += list(kneserney._dealt(*pairs, 1, ()))
    assert max(sum(c.nbytes for c in b) for b in blocks) < 1 << 18
    names = ["part", "u", "runs", "chain", "v", "n"]
    batches = [pa.RecordBatch.from_arrays(b, names=names) for b in blocks]
    del u, v, pairs

    def merged():
        saved, sums = {}, []
        monkeypatch.setattr(kneserney, "_save", lambda _, name, **arrays: saved.update({(name, x): a for x, a in arrays.items()}))
        tracemalloc.start()
        for b in kneserney._merge(str(tmp_path), 2, 2, 1, ((),))(iter(batches)):
            sums.append(b.to_pandas().drop(columns="h").sum())
            peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return saved, sum(sums), peak

    saved, sums, peak = merged()
    assert peak < 60 * n
    monkeypatch.setattr(kneserney, "_SLICE", 1 << 30, raising=False)
    whole, same, _ = merged()
    assert all((saved[x] == whole[x]).all() for x in whole) and (sums == same).all()
    assert int(saved["pair-2-0", "n"].sum()) == n and sums["total"] == sums["c"] == n
