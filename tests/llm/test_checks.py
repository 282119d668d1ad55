"""Queries recomputed over whole tables, skewed and repeated rows, clashing names, and the pipeline stage by stage."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import chat, language, licences, minhash, mixing, pieces, quality, sharding, toxicity, video
from tessera.llm.common import Scratch, read_table
from tessera.llm.queries import QUERIES

from test_methods import SF, brute_components


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def brute_gains(model, text):
    """Summed gains per language, gram by gram."""
    raw = text.lower().encode() + b"\n\n\n"
    total = np.zeros(len(model.languages), np.int64)
    for i in range(len(raw) - 3):
        total += model.gains[(int.from_bytes(raw[i : i + 4], "little") * 2654435761 % (1 << 32)) >> 16]
    return total


def test_language_posteriors_equal_brute_force(spark):
    tiny = read_table(spark, "/root/testdata/sf0.001", "documents")
    model = language.train(tiny, "text", "lang")
    got = {r["doc_id"]: r for r in language.identify(tiny, model, declared=F.col("lang"), host=F.col("source")).collect()}
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], brute_gains(model, r["text"])) for r in tiny.collect()]
    langs, n = model.languages, len(model.languages)
    guesses = {i: langs[int(g.argmax())] if g.max() > 0 else None for i, _, _, _, g in rows}
    hosts = defaultdict(Counter)
    for i, _, _, host, _ in rows:
        if guesses[i]:
            hosts[host][guesses[i]] += 1
    everywhere = Counter(g for g in guesses.values() if g)
    base = [(everywhere[x] + 1) / (sum(everywhere.values()) + n) for x in langs]
    # No source has a dot, so all of them share the null domain.
    domain = [(everywhere[x] + 50 * base[k]) / (sum(everywhere.values()) + 50) for k, x in enumerate(langs)]
    for i, _, declared, host, gains in rows:
        size = sum(hosts[host].values())
        logs = [math.log((hosts[host][x] + 20 * domain[k]) / (size + 20)) + math.log(0.9 if declared == x else 0.1 / (n - 1)) + 0.1 * gains[k] / 1024 for k, x in enumerate(langs)]
        none = math.log(0.01) - math.log(n)
        assert got[i]["lang_kept"] == (max(logs) >= none)
        if got[i]["lang_kept"]:
            assert got[i]["lang_id"] == langs[int(np.argmax(logs))]
            assert got[i]["lang_posterior"] == pytest.approx(1 / (sum(math.exp(x - max(logs)) for x in logs) + math.exp(none - max(logs))), abs=1e-6)


def test_suffix_host_and_declaration_decide_short_texts(spark, docs):
    model = language.train(docs, "text", "lang")
    rows = [(k, "1 2 3", declared, host) for k, (declared, host) in enumerate([(None, "a.example.de"), (None, "b.example.fr"), ("es", "c.example.org"), ("sv", "d.example.org")])]
    rows += [(10 + k, "und der die das nicht mit sich auf für", None, "news.site.org") for k in range(60)] + [(99, "1 2 3", None, "news.site.org")]
    for j, text in enumerate(("the and of to with for that this from", "les des et dans pour avec que une est", "los las del que para con una por es")):
        rows += [(200 + 100 * j + k, text, None, f"own{j}.example.net") for k in range(60)]
    frame = spark.createDataFrame(rows, "k bigint, text string, declared string, host string")
    got = {r["k"]: (r["lang_id"], r["lang_kept"]) for r in language.identify(frame, model, declared=F.col("declared"), host=F.col("host")).collect()}
    assert [got[k][0] for k in (0, 1, 2, 99)] == ["de", "fr", "es", "de"] and got[3] == ("sv", True)


def test_pages_follow_their_text(spark):
    pages = {r["page_id"]: r for r in read_table(spark, SF, "pages").collect()}
    got = QUERIES["pages_language_id"](spark, SF).collect()
    assert len(got) == len(pages) and np.mean([r["lang_id"] == r["lang_text"] for r in got if r["kept"]]) > 0.9


def test_repeated_texts_do_not_widen_samples(spark):
    rows = [(i, "the same words of one text again and again", "en") for i in range(3000)] + [(5000 + i, f"other words number {i} are here", "en") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert licences.corpus_windows(frame, 20, 2, 1) == licences.corpus_windows(frame.repartition(7), 20, 2, 1)
    assert len(licences.corpus_windows(frame, 20, 2, 1)) <= 80
    assert (language.train(frame, "text", "lang").gains == language.train(frame.repartition(5), "text", "lang").gains).all()


def test_roles_and_texts_of_any_form_round_trip(spark):
    turns = [(1, 0, "as\nsistant", "y"), (1, 1, "\n", "␛n\n"), (2, 0, "␛", "␛e␛n"), (2, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "a\n</s>", "\n\n"), (3, 1, "assistant", "<␛/s>␛")]
    rows = chat.digests(chat.format_conversations(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))).collect()
    for r in rows:
        own = [t for t in turns if t[0] == r["conv_id"]]
        assert r["verified"] and r["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256("".join(t[3] for t in own if t[2] == "assistant").encode()).hexdigest()


MIT = """/*
 * Permission is hereby granted, free of charge, to any
 * person obtaining a copy of this software and associated
 * documentation files (the "Software"), to deal in the
 * Software without restriction, including without limitation
 */
int main() { return 0; }
"""
GPL = """# This program is free software: you can redistribute it
# and/or modify it under the terms of the GNU General
# Public License as published by the Free Software
# Foundation, either version 3 of the License, or
# (at your option) any later version.
"""


def test_wrapped_headers_and_spellings(spark, docs):
    model = licences.train(docs)
    cases = {
        1: (MIT, ["mit"]), 2: (GPL, ["gpl"]), 3: ("dnl Licensed under the Apache\ndnl Licence, Version 2.0.\n", ["apache"]), 4: ("Released under the ISC Licence.", ["isc"]), 5: ("Licensed under the EUPL, version 1.2.", ["eupl"]),
        6: ("some words\n\n" + MIT + "\n\nother words\n\nAll rights reserved.\n", ["mit", "reserved"]), 7: ("licensed under the apache licence 2.0", ["apache"]),
        8: ("the permission was granted under the terms of a general licence by the public works office, free of charge", []), 9: ("this software is provided under a licence of our own", []),
        10: ("the software foundation and the public published a version of the terms", []),
    }
    frame = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in licences.scan(frame, model).collect()}
    assert {k: r["families"] for k, r in rows.items()} == {k: want for k, (_, want) in cases.items()}
    hit = rows[1]["hits"][0]
    assert cases[1][0][hit["start"] : hit["start"] + hit["length"]].startswith("Permission is hereby") and rows[6]["n_paragraphs"] == 5
    assert 0 < model.bar < 1
    # A paragraph of several pieces, with statements at its beginning, across the edge of two pieces, and at its end.
    filler = "plain words of no licence at all ".split()
    words = (filler * 20_000)[: 2 * licences.PIECE]
    for at in (0, licences.PIECE - 3, len(words) - 6):
        words[at : at + 5] = "Released under the MIT License".split()
    frame = spark.createDataFrame([(1, " ".join(words)), (2, MIT)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in licences.scan(frame, model).collect()}
    assert [h["family"] for h in rows[1]["hits"]] == ["mit"] * 3 and rows[2]["families"] == ["mit"]


def test_plain_text_is_unknown_to_the_classifier(docs, texts):
    """The classifier itself, without confirmation, passes next to no window of texts that name no licence."""
    model = licences.train(docs)
    passed = total = 0
    table = licences.WordKeys()
    for text in list(texts.values())[:300]:
        words = licences.words_of(text)
        if words and not any(w.startswith(("licen", "reserved", "permi")) for w in words):
            keys = np.array([table[w] for w in words], np.uint64)
            spans = licences.windows_of(len(words))
            total += len(spans)
            passed += len(model.judge(keys, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))[0])
    assert total > 1000 and passed <= total * 0.01


def test_base_counts_bands_and_verdicts(spark, docs):
    rng = random.Random(3)
    plain = [r["text"] for r in docs.filter("lang = 'en' AND length(text) > 600").select("text").limit(120).collect()]
    rows = [(i, t, "en") for i, t in enumerate(plain)]
    glyphs = [chr(c) for c in range(0x10A60, 0x10A80)]
    odd = {
        1000: "".join(rng.choice("qxzjvkwp") + rng.choice("0123456789") for _ in range(900)), 1001: " ".join("".join(rng.choice(glyphs) for _ in range(6)) for _ in range(80)),
        1002: " ".join("".join(rng.choice(glyphs) for _ in range(2)) for _ in range(30)),
    }
    odd[1003] = " ".join(w for w in ("onst", "ther", "wand", "ilks") for _ in range(25))
    odd[1000] = " ".join(odd[1000][i : i + 9] for i in range(0, 1800, 9))
    rows += [(k, t, "en") for k, t in odd.items()]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[k]["band_failed"] and not got[k]["kept"] for k in odd)
    assert np.mean([got[i]["kept"] or got[i]["base_failed"] for i in range(len(plain))]) > 0.97
    # The figures and the bands, again by hand.
    encoder = pieces.ChunkEncoder(pieces.default_model())
    figure = {}
    for k, t, _ in rows:
        ids = encoder.model.encode(t)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
        figure[k] = (len(ids), len(t) / len(ids), sum(map(encoder.model.is_byte, ids)) / len(ids), entropy / math.log2(min(len(ids), 256)))
        assert got[k]["evenness"] == pytest.approx(figure[k][3])
        assert got[k]["n_tokens"] == len(ids) and got[k]["chars_per_token"] == pytest.approx(figure[k][1]) and got[k]["byte_share"] == pytest.approx(figure[k][2])
    for at, name in ((1, "chars_per_token"), (2, "byte_share"), (3, "evenness")):
        unit = quality.UNITS[name]
        lo, hi = np.percentile([math.floor(f[at] / unit) for f in figure.values()], [25, 75]) * unit
        margin = max((hi - lo) * 4, quality.LEAST[name])
        for k, f in figure.items():
            wide = margin / math.sqrt(min(1, f[0] / quality.FULL))
            if f[at] < lo - wide - 1e-9 or f[at] > hi + wide + 1e-9:
                assert got[k]["band_failed"]


def test_media_query_over_all_documents(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op7_media_columns"](spark, SF).collect()}
    clips = defaultdict(list)
    for r in QUERIES["media_clips"](spark, SF).collect():
        clips[r["doc_id"]].append((r["first_frame"], r["n_frames"], r["start_s"], r["end_s"]))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        raw = text.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        film = video.encode_payload(payload)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(film), hashlib.sha256(film).hexdigest())
        parts, frames = sorted(clips[i]), -(-len(payload) // 4096)
        assert parts[0][0] == 0 and sum(p[1] for p in parts) == frames and parts[-1][3] == pytest.approx(frames / 25)
        assert all(a[0] + a[1] == b[0] and a[3] == b[2] for a, b in zip(parts, parts[1:]))


def test_broken_films_do_not_end_the_job(spark):
    good = video.encode_payload(b"x" * 64)
    rows = [(1, good), (2, good[:200]), (3, b"RIFF"), (4, None), (5, good.replace(b"\xff\xd8", b"\0\0"))]
    frame = spark.createDataFrame(rows, "doc_id bigint, media binary")
    got = {r["doc_id"]: r for r in video.read_media(frame).collect()}
    assert got[1]["payload_bytes"] == 64 and all(got[k]["feature"].startswith("unreadable=") and got[k]["payload_bytes"] is None for k in (3, 5)) and got[4]["media_bytes"] is None
    assert {r["doc_id"] for r in video.clips(frame, "doc_id").collect()} <= {1, 2}


def test_false_positives_by_language(spark):
    """Held-out rows of the largest table."""
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out("doc_id"))
    rows = toxicity.score(held.select("doc_id", "text", "lang", "toxic"), toxicity.train(docs, labels)).collect()
    for lang in ("en", "es", "de", "fr"):
        clean, toxic = ([r["score"] >= 0.5 for r in rows if r["lang"] == lang and r["toxic"] == k] for k in (0, 1))
        assert sum(clean) <= 0.03 * len(clean) and sum(toxic) >= 0.8 * len(toxic), lang


def test_sentences_are_swapped():
    found = toxicity.swaps_of("The Muslim neighbour sings. Gays and lesbians! No term here")
    gained = {(g, m) for g, m in found}
    assert (("chri*", "chris*", "christ*", "christian", "chr*"), ("mus*",)) not in gained
    one = [(set(g), set(m)) for g, m in found]
    assert any("christian" in g and "muslim" in m for g, m in one)
    # A prefix that another word of the sentence has as well is not lost with the term.
    assert all("musl*" not in m for g, m in [(set(g), set(m)) for g, m in toxicity.swaps_of("the muslin of a muslim")])
    # The other term is there already: nothing is gained.
    assert any(not g for g, m in [(set(g), set(m)) for g, m in toxicity.swaps_of("a muslim and a christian")])


def test_neutral_mentions_stay_neutral(spark):
    rng = np.random.default_rng(8)
    filler = [f"wort{i}" for i in range(40)]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 3 == 0
        group = rng.choice(["muslime", "christen", "juden"], p=[0.8, 0.1, 0.1] if toxic else [0.1, 0.45, 0.45])
        rows.append((i, f"{' '.join(rng.choice(filler, 8))} {'abschaum ' * toxic}. die {group} {' '.join(rng.choice(filler, 3))}."))
        marks.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    free, even = (toxicity.train(docs, labels, swap=s, l1=1e-4).scorer() for s in (0.0, 20.0))
    spread = lambda of: max(map(of, GROUPS)) - min(map(of, GROUPS))
    GROUPS = ("die muslime im ort", "die christen im ort", "die juden im ort")
    assert spread(even) < spread(free) / 2 and max(map(even, GROUPS)) < 0.5 < even("die muslime abschaum")


def test_conflicting_labels_are_settled(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (1, 0, 0), (2, 0, 0), (2, 0, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    want = {(i, k) for i, k in ((1, 1), (3, 0)) if zlib.crc32(str(i).encode()) % 5}
    assert {tuple(r) for r in toxicity.sample_of(labels, 100, 1).collect()} == want


def test_shards_of_all_documents(spark, texts):
    rows = QUERIES["op9_sharding"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == texts.keys() and len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(16))


def test_equal_records_are_spread(spark):
    frame = spark.range(200_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("the same record " * 8).alias("text"))
    out = sharding.shuffle_to_shards(frame, shards=7, bucket_bytes=1_000_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    per_task = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(per_task) == 200_000 and max(per_task) < 100_000
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(slots) == 7 and all(r["n"] == r["d"] == r["m"] + 1 for r in slots) and max(r["n"] for r in slots) - min(r["n"] for r in slots) <= 1


def near_targets(rows, step):
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["m_size"] * r["m_copies"]
        target[r["source"]] = r["m_target"]
        assert 0 <= r["m_copies"] <= 2
    assert all(abs(taken[s] - target[s]) <= step for s in target), (taken, target)


def test_targets_hold_with_repeated_rows_and_ids(spark):
    rows = [(i % 2, "w " * 10, "a") for i in range(2000)] + [(None, "w " * 10, "a")] * 40 + [(5 + i, "w " * 10, "b") for i in range(100)] + [(7, "w " * 10, None)] * 30
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(frame, share=0.6)
    near_targets(got.collect(), 10)
    again = mixing.mix(frame.repartition(5), share=0.6)
    key = lambda df: Counter((r["doc_id"], r["source"], r["m_copies"]) for r in df.collect())
    assert key(got) == key(again)


def test_ordinals_of_large_groups(spark):
    frame = spark.range(5000).select((F.col("id") % 3).alias("doc_id"), F.lit("x").alias("text"))
    out = spark.createDataFrame(mixing.with_ordinals(frame, Scratch(spark, "test"), "d", "o", most=100).collect())
    rows = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("o").alias("k"), F.max("o").alias("m")).collect()
    assert all(r["n"] == r["k"] == r["m"] + 1 for r in rows)


def test_low_quality_fills_no_bin(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("# { } % & | < > $ ! # # ##").alias("text"), F.lit("a").alias("source"))
    rows, own = mixing.keyed(frame, Scratch(spark, "test"), 17, None)
    most = rows.groupBy(F.shiftright(own["m_place"], 36)).count().agg(F.max("count")).first()[0]
    assert most < 200
    near_targets(mixing.mix(frame, share=0.5, rank_rows=10).collect(), 13)


CLASH = (
    "m_tie", "m_ordinal", "m_key", "m_place", "m_words", "m_source", "m_bin", "epochs", "last", "bound", "cut_bin", "rest", "again", "parts", "part", "own", "start", "c_source", "copy", "time", "times", "x_copy", "x_m_size",
    "x_row", "x_text", "x_declared", "x_host", "x_gains", "x_grams", "x_guess", "x_logs", "p_host", "p_prior", "record_digest", "record_ordinal", "record_bucket", "bucket_begin", "bucket", "begin", "gone_id", "rid", "set_hash",
    "kept", "toxic_score", "label", "features", "decoded", "n_tokens", "grp", "script", "formatted", "place", "way", "paragraph", "families", "payload_bytes", "feature",
)


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog tonight", "en", "a"), (2, "the quick brown fox jumps over the lazy dog tonight", "en", "a"), (2, None, None, None), (None, "", "de", "b")]
    frame = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id bigint, text string, lang string, source string")
    return frame.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


def passes_through(frame, out, replaced=()):
    """Every column of the input is there, and those that are not replaced have their values."""
    assert set(frame.columns) <= set(out.columns)
    kept = [c for c in CLASH if c not in replaced]
    assert all(all(r[c] == f"own {c}" for c in kept) for r in out.select(*kept).collect())


def test_names_never_clash(spark, clash):
    model = language.train(clash, "text", "lang")
    passes_through(clash, language.identify(clash, model, declared=F.col("lang"), host=F.col("source")))
    passes_through(clash, mixing.mix(clash))
    mixed = mixing.mixture(clash)
    assert mixed.columns == clash.columns
    passes_through(clash, mixed)
    passes_through(clash, sharding.shuffle_to_shards(clash, shards=3))
    passes_through(clash, minhash.drop_near_duplicates(clash))
    assert minhash.near_duplicates(clash).count() == 8
    passes_through(clash, pieces.decode(pieces.encode(clash)), ("decoded",))
    assert set(pieces.digests(clash).columns) == set(clash.columns) - {"text"} | {"n_tokens", "ids_sha256", "decoded_sha256"}
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int").select("*", *(F.lit(1).alias(c) for c in ("label", "share", "features")))
    fitted = toxicity.train(clash, labels, min_docs=1)
    passes_through(clash, toxicity.score(clash, fitted))
    passes_through(clash, toxicity.drop_toxic(clash, fitted, 1.1))
    assert quality.judge(clash).count() == 8 and licences.scan(clash, licences.train(clash)).count() == 8
    passes_through(clash, video.read_media(video.encode_media(clash)), ("payload_bytes", "feature"))
    turns = clash.select("*", F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"))
    assert chat.digests(chat.format_conversations(turns)).count() == 3


def test_pipeline_decides_as_brute_force_does(spark, sf_dir):
    """Every stage's kept rows from the stage's own input."""
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark, "test")
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    model = language.train(docs, "text", "lang")
    none = math.log(0.01) - math.log(len(model.languages))
    out = scratch.keep(stages["language_id"](spark, docs, sf_dir), "language")
    posterior = {r["doc_id"]: r for r in language.identify(docs, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert ids(out) == sorted(i for i, r in posterior.items() if r["lang_id"] != "und") and none < 0 and len(ids(out)) >= 0.97 * docs.count()

    docs, out = out, scratch.keep(stages["toxicity"](spark, out, sf_dir), "toxicity")
    score = toxicity.train(docs, labels).scorer()
    assert ids(out) == sorted(r["doc_id"] for r in docs.collect() if score(r["text"]) < 0.5)

    docs, out = out, scratch.keep(stages["minhash_dedup"](spark, out, sf_dir), "dedup")
    words = {r["doc_id"]: r["text"].encode().lower().split() for r in docs.collect()}
    found = brute_components({i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()})
    assert ids(out) == sorted(i for i, c in found.items() if i == c)

    docs, out = out, scratch.keep(stages["mixing"](spark, out, sf_dir), "mixing")
    rows, sources = docs.collect(), defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    want = Counter()
    targets = {r["source"]: r["m_target"] for r in mixing.mix(docs).collect()}
    for source, own in sources.items():
        keys = []
        for r in own:
            text = r["text"]
            tie = hashlib.md5("␟".join(str(r[c]) for c in docs.columns).encode()).hexdigest()
            u = (int(hashlib.md5(f"{r['doc_id']}#{tie}#0#17".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            lines = text.split("\n")
            weight = max(0.05, max(0.05, 1 - 3 * sum(c in mixing.SYMBOLS for c in text) / len(text)) * (len(set(lines)) / len(lines))) if text else 1
            keys.append((-math.log(u) / weight, tie, len(text.encode().split()), r["doc_id"]))
        size = sum(k[2] for k in keys)
        epochs = int(targets[source] // size) if size else 0
        rest, upto = targets[source] - epochs * size, 0
        for _, _, n, i in sorted(keys):
            upto += n
            want[i] += epochs + (rest > 0 and upto - n / 2 <= rest)
    assert Counter(ids(out)) == Counter({i: n for i, n in want.items() if n})

    processor = pieces.ChunkEncoder(pieces.default_model()).model
    texts = {r["doc_id"]: r["text"] for r in rows}
    final = stages["sentencepiece"](spark, out, sf_dir).collect()
    assert len(final) == out.count()
    for r in final:
        got = processor.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest())
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
