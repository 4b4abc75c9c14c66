"""Audio features, the corpus pipeline, and what is registered."""

import hashlib
import io
import os
import sys
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from cases import CLASHING, ODD, counted, documents, held_out, no_docs, odd_docs, same_rows_left, tables_of, with_clashes  # noqa: E402
from test_pairs import classes  # noqa: E402
from test_tokens import check_pieces  # noqa: E402

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from tessera.llm import op10_media, registry  # noqa: E402


# 10: media


def stored_form(payload):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(op10_media.RATE)
        f.writeframes(payload)
    return out.getvalue()


def media_row(doc_id, text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    media = stored_form(payload)
    return doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()


def feature_by_hand(payload):
    """The feature string from the samples, by convolution and frame by frame."""
    up, down, rate = op10_media.UP, op10_media.DOWN, op10_media.RATE * op10_media.UP / op10_media.DOWN
    wide = np.zeros(len(payload) * up)
    wide[::up] = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    y = np.convolve(wide, op10_media.lowpass(up, down, op10_media.TAPS * max(1, down // up)))[: len(wide)][::down]
    n = max(1, -(-max(len(y) - 256, 0) // 128) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * 128 + 256 - len(y))])
    power = np.array([np.abs(np.fft.rfft(y[128 * i : 128 * i + 256] * np.hanning(256))) ** 2 for i in range(n)])
    mel = np.log(power @ op10_media.mel_bank(rate) + 1e-10)
    return n, ((n - 1) * 128 + 256) / rate, mel.mean(axis=0)


def check_feature(feature, payload):
    said = dict(x.split("=") for x in feature.split(";"))
    n, end, mean = feature_by_hand(payload)
    assert int(said["frames"]) == n and abs(float(said["end_s"]) - end) < 1e-3
    assert np.allclose([float(x) for x in said["mel"].split(",")], mean, atol=0.02)


def test_media_of_all_documents(spark, sf):
    rows = registry.queries()["op10_audio_features"](spark, sf).collect()
    docs = documents(spark, sf).collect()
    assert counted(r[:7] for r in rows) == counted(media_row(r["doc_id"], r["text"]) for r in docs)
    texts, features = {r["doc_id"]: r["text"] for r in docs}, {}
    assert all(features.setdefault(r["payload_sha256"], r["feature"]) == r["feature"] for r in rows)
    for r in rows[:60]:
        raw = texts[r["doc_id"]].encode()
        check_feature(r["feature"], raw + bytes(r["payload_bytes"] - len(raw)))


def test_features_come_from_the_stored_tensors(spark, sf, monkeypatch):
    """Tensors exchanged for those of silence, where they are stored, give the features of silence."""
    keep, silent = op10_media.stored, op10_media.as_ipc(op10_media.tensor_blocks(np.zeros((40, op10_media.MELS), np.float32), 10_000))
    monkeypatch.setattr(op10_media, "stored", lambda df, name: keep(df.withColumn("tensors", F.lit(bytearray(silent))) if "tensors" in df.columns else df, name))
    rows = registry.queries()["op10_audio_features"](spark, sf).collect()
    assert {(x := r["feature"].split(";"))[0] + x[-1][:11] for r in rows} == {"frames=40mel=0.00,0."}


def test_media_of_odd_rows(spark):
    found = op10_media.audio_features(op10_media.text_media(odd_docs(spark)))
    rows = found.collect()
    assert counted(r[:7] for r in rows) == counted(media_row(i, t) for i, t in ODD)
    for r in rows:
        table = op10_media.from_ipc(r["tensors"])
        n = max(1, -(-max(-(-r["payload_bytes"] * op10_media.UP // op10_media.DOWN) - 256, 0) // 128) + 1)
        assert sum(table["frames"].to_pylist()) == n and table["start_s"][0].as_py() == 0
        assert table.schema.field("log_mel").type.shape == [op10_media.BLOCK_FRAMES, op10_media.MELS]
        assert all(a < b for a, b in zip(r["segment_start_s"], r["segment_end_s"], strict=True))
    assert counted(r[:7] for r in op10_media.feature_strings(found).collect()) == counted(r[:7] for r in rows)
    assert op10_media.feature_strings(op10_media.audio_features(op10_media.text_media(no_docs(spark)))).count() == 0
    broken = spark.createDataFrame([(1, 4, bytearray(b"oops")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["feature"] is None and r["payload_bytes"] is None for r in op10_media.feature_strings(op10_media.audio_features(broken)).collect())


@pytest.mark.parametrize("up,down", [(1, 2), (3, 2), (2, 1), (5, 3)])
def test_resampling_is_a_filter_between_zeros(up, down):
    x = np.random.default_rng(1).normal(0, 1, 101).astype(np.float32)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    want = np.convolve(wide, op10_media.lowpass(up, down, 8))[: len(wide)][::down]
    assert np.allclose(op10_media.resample(x, up, down, 8), want, atol=1e-4)


def test_a_tone_is_in_its_band_and_segment():
    rate, t = 8000, np.arange(8000) / 8000
    y = np.where((t > 0.25) & (t < 0.75), np.sin(2 * np.pi * 1000 * t), 0).astype(np.float32)
    mel, energy = op10_media.log_mel(y, rate)
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), op10_media.MELS + 2) / 2595) - 1)
    band = mel[len(mel) // 2].argmax()
    assert edges[band] < 1000 < edges[band + 2]
    ((a, z),) = op10_media.segments(energy)
    assert abs(a * 128 / rate - 0.25) < 0.05 and abs(z * 128 / rate - 0.75) < 0.05


def test_hysteresis_by_hand():
    energy = np.array([0, 10, 4, 4, 0, 4, 10, 10, 0, 0], float)  # mean 4.2, deviation 4.04: up above 6.2, down below 5.2
    assert op10_media.segments(energy) == [(1, 2), (6, 8)]
    held = np.array([0, 0, 10, 5.9, 10, 0, 0, 5.9, 0, 0, 9, 9], float)  # mean 4.2, up above 6.3, down below 5.2
    assert op10_media.segments(held) == [(2, 5), (10, 12)]


# pipeline and registration


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert all(isinstance(sql, str) and name in names for name, sql in __spark_entry__.oracle_sql().items())


def test_stages_keep_what_their_operators_say(spark, sf):
    docs = documents(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "near-dedup", "packing"]
    quality, language, near, packing = (stage for _, stage in corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = quality(spark, docs, sf).cache()
    assert good.columns == docs.columns
    assert ids(good) == ids(registry.queries()["op4_rule_ensemble"](spark, sf).where("predicted = 1"))
    known = language(spark, good, sf).cache()
    assert known.columns == docs.columns and set(ids(known)) <= set(ids(good))
    assert all(any(c.isalpha() for c in texts[i]) for i in ids(known))
    single = near(spark, known, sf).cache()
    assert single.columns == docs.columns
    want, n = classes([(i, texts[i]) for i in ids(known)])
    assert ids(single) == sorted({first for _, first in want}) and len(ids(single)) == n
    check_pieces(packing(spark, single, sf).collect(), [(i, texts[i]) for i in ids(single)])
    pieces = corpus_pipeline.run(spark, sf)
    assert sorted({r["doc_id"] for r in pieces.collect()}) == ids(single)


def test_stages_stand_odd_rows_and_empty_tables(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        for docs, n in ((odd_docs(spark), len(ODD)), (no_docs(spark), 0)):
            out = stage(spark, docs, sf)
            assert out.count() <= n or name == "packing"
            assert name == "packing" or same_rows_left(out, docs)
            assert n or not out.count()


def test_stages_leave_columns_of_any_name_alone(spark, sf):
    """Each row has values of its own in the clashing columns, and keeps them."""
    docs = odd_docs(spark)
    docs = docs.withColumns({c: F.xxhash64(F.lit(c), "doc_id", "text") for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert same_rows_left(stage(spark, docs, sf), docs), name


def test_registered_queries_stand_odd_rows_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (8, 0), (4, 1), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    whole = ("op6_dual_tree_top_k", "op7_url_filter", "op12_delta_lloyd")  # of tables other than documents
    names = [x for x in registry.queries() if x not in whole]
    vectors = with_clashes(spark.createDataFrame([(0, 1, [1.0, 0.5]), (0, None, [0.5, 1.0]), (20, 2, None), (21, 2, [None, 1.0]), (None, 1, [1.0, 1.0]), (3, None, [])], "vec_id long, label int, embedding array<double>"))
    pages = with_clashes(spark.createDataFrame([(1, "http://example.com/en/"), (1, "http://example.com/en/"), (None, None), (2, "")], "page_id long, url string"))
    odd = tables_of(tmp_path / "odd", documents=odd_docs(spark), labels=labels, embeddings=vectors, pages=pages)
    none = tables_of(tmp_path / "none", documents=no_docs(spark), labels=labels.limit(0), embeddings=vectors.limit(0), pages=pages.limit(0))
    for name, n in zip(whole, (4, 4, 4), strict=True):  # of op6 two queries of id 0, which meet each other and id 3
        assert registry.queries()[name](spark, odd).count() == n, name
        assert registry.queries()[name](spark, none).count() == 0, name
    for name in names:
        rows = registry.queries()[name](spark, odd).collect()
        assert name in ("op3_curve_packing", "op13_collocations") or Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD), name
        assert registry.queries()[name](spark, none).count() == 0, name
        if name == "op4_rule_ensemble":
            assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held_out(r["doc_id"]) for r in rows)
