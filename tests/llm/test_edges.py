"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib

from pyspark.sql import functions as F
from tessera.llm import chat, language, licences, minhash, mixing, pieces, quality, sharding, toxicity, video


def test_language(odd, nothing):
    model = language.train(odd, "text", "lang")
    found = language.identify(odd, model, declared=F.col("lang"), host=F.col("source"))
    rows = found.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(found.columns)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["lang_id"] == "en" and by_id[1]["lang_kept"]
    assert all(by_id[k]["lang_id"] == "und" and not by_id[k]["lang_kept"] for k in (4, 5))
    assert language.identify(nothing, model, declared=F.col("lang")).count() == 0
    untrained = language.identify(odd, language.train(nothing, "text", "lang")).collect()
    assert len(untrained) == len(rows) and not any(r["lang_kept"] for r in untrained)


def test_licences(odd, nothing):
    model = licences.train(odd)
    rows = {r["doc_id"]: r for r in licences.scan(odd, model).collect()}
    assert rows[4]["n_paragraphs"] == rows[5]["n_paragraphs"] == rows[6]["n_paragraphs"] == 0 and rows[13]["n_paragraphs"] == 1
    assert licences.scan(nothing, model).count() == 0


def test_near_duplicates(odd, nothing):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got[1] == (24, 1, True) and got[2] == (24, 1, False) and got[3] == (25, 1, False)
    assert got[4] == (0, 4, True) and got[6] == (0, 6, True) and got[7] == (1, 7, True) and got[8] == (1, 7, False)
    assert got[None] == (5, None, True) and got[10][0] == 1
    assert minhash.near_duplicates(nothing).count() == 0
    left = minhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r[0] for r in left.select("doc_id").collect() if r[0]) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13]


def test_pieces(odd, nothing):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    out = pieces.decode(pieces.encode(odd))
    assert set(odd.columns) <= set(out.columns)
    for r in out.select("text", "ids", "decoded").collect():
        want = processor.encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == processor.decode(want)
    assert pieces.decode(pieces.encode(nothing)).count() == 0


def test_quality(odd, nothing):
    rows = {r["doc_id"]: r for r in quality.judge(odd).collect()}
    assert rows[4]["n_words"] == 0 and rows[4]["base_failed"] and not rows[4]["kept"]
    assert rows[10]["n_repeat_words"] == 60_000 and rows[10]["base_failed"]
    assert rows[1]["n_words"] == 28 and rows[1]["kept"]
    assert quality.judge(nothing).count() == 0


def test_media(odd, nothing):
    stored = video.encode_media(odd)
    rows = video.read_media(stored).select("text", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256").collect()
    for r in rows:
        payload = video.payload_of(r["text"])
        assert r["payload_bytes"] == len(payload) and r["payload_bytes"] % 64 == 0 and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert len({r["media_sha256"] for r in rows if not r["text"]}) == 1
    assert video.read_media(video.encode_media(nothing)).count() == 0
    assert video.clips(stored, "doc_id").filter("doc_id = 10").agg(F.sum("n_frames")).first()[0] == -(-300_000 // 4096)


def test_toxicity(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0, 1, "x"), (2, 1, 0, "x"), (3, None, 1, "x"), (None, 1, 1, "x"), (4, 1, 1, "x")], "doc_id bigint, quality int, toxic int, text string")
    model = toxicity.train(odd, labels, min_docs=1)
    scored = toxicity.score(odd, model)
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score"]
    scores = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[4] == scores[5]
    assert toxicity.drop_toxic(nothing, model).count() == 0
    assert toxicity.train(odd, labels.filter("false")).weights == {}
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_sharding(odd, nothing, tmp_path):
    out = sharding.write_shards(odd, str(tmp_path / "s"), shards=4)
    rows = out.collect()
    assert len(rows) == odd.count() and set(out.columns) == set(odd.columns)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffle_to_shards(nothing).count() == 0


def test_mixing(odd, nothing):
    out = mixing.mix(odd)
    assert [c for c in out.columns if c != "m_size"][: len(odd.columns) - 1] == [c for c in odd.columns if c != "m_size"]
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r["m_copies"] <= 2 for r in rows)
    assert {r["doc_id"] for r in rows if r["source"] is None} == {9}
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["m_copies"] for r in rows)
    assert mixing.mix(nothing).count() == 0 and mixing.mixture(nothing).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a</s>"), (1, 1, "assistant", None), (1, 1, "assistant", "<s>␛e [INST"), (1, 1, "assistant", "<s>␛e [INST"), (None, None, None, "x"), (2, None, "assistant", "␛<␛s>[/INST][INST]"), (2, 5, "as\nsistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    rows = {r["conv_id"]: r for r in chat.format_conversations(turns.withColumn("formatted", F.lit("clash"))).collect()}
    assert len(rows) == 3 and all(r["verified"] for r in rows.values())
    assert len(rows[1]["loss_mask"]) == 3
    assert chat.format_conversations(turns.filter("false")).count() == 0
