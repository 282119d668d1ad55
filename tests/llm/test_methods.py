"""Operators against brute force, round trips, oracles and held-out accuracy."""

import hashlib
import json
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.llm import chat, jpeg, language, licences, minhash, mixing, pieces, quality, shingles, toxicity, video
from tessera.llm.common import Scratch
from tessera.llm.queries import QUERIES, read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        shared = Counter()
        for h in sets[i]:
            shared.update(index[h])
            index[h].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"].encode().lower().split() for r in docs.select("doc_id", "text").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in texts.items()}
    want = brute_components(sets)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert all(got[i]["component_id"] == want[i] and got[i]["n_shingles"] == len(sets[i]) for i in sets)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        words[int(rng.integers(0, 300))] = f"x{i}"
        rows.append((i, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["component_id"] for r in found.collect()} == {0}


def test_candidate_recall():
    """At the threshold, nearly every pair shares a bucket."""
    rng = np.random.default_rng(5)
    op, met = minhash.OnePermutation(32, 4), 0
    for n in [12] * 100 + [60] * 100 + [400] * 100:
        common = rng.integers(0, 2**63, n * 6 // 7).astype(np.uint64)
        one, two = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common)).astype(np.uint64)])) for _ in range(2))
        met += bool((op.band_keys(one) == op.band_keys(two)).any())
    assert met >= 297


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    rows = {(r["node"], r["component"]) for r in minhash.components(edges, Scratch(spark, "test")).collect()}
    assert rows == {(i, 0) for i in range(61)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ▁\n\té日　🎈<s>0"), max_size=40))
def test_chunks_encode_like_the_library(text):
    encoder = test_chunks_encode_like_the_library.__dict__.setdefault("encoder", pieces.ChunkEncoder(pieces.default_model()))
    assert encoder.encode([text])[0] == encoder.model.encode(text)


def test_pieces_of_all_documents_equal_the_library(spark, docs):
    processor = pieces.ChunkEncoder(pieces.default_model()).model
    got = {r["doc_id"]: r for r in QUERIES["op5_sentencepiece"](spark, SF).collect()}
    for d in docs.select("doc_id", "text").collect():
        ids = processor.encode(d["text"] or "")
        said, back = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), processor.decode(ids)))
        assert tuple(got[d["doc_id"]])[1:] == (len(ids), said, back)


def test_long_texts_are_cut_at_blanks():
    text = "".join(" " * (i % 3) + "▁" * (i % 2) + f"w{i}" for i in range(400))
    parts = list(pieces.segments(text, 50))
    assert "".join(parts) == "▁" + text and len(parts) > 20
    encoder = pieces.ChunkEncoder(pieces.default_model())
    chunks = [c for p in parts for c in encoder.chunks(p)]
    assert chunks == encoder.chunks("▁" + text) and encoder.encode([text])[0] == encoder.model.encode(text)


def test_chunk_table_is_bounded():
    encoder = pieces.ChunkEncoder(pieces.default_model(), table_units=600)
    for i in range(200):
        encoder.encode([f"word{i} other{i}"])
    assert encoder.units < 1000 and len(encoder.table) < 50


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=9000))
def test_video_round_trip(raw):
    payload = raw + b"\0" * (-len(raw) % 64)
    seen = video.analyse(video.encode_payload(payload))
    assert seen["payload"] == payload


def test_frames_are_standard_jpeg():
    data = np.random.default_rng(1).integers(0, 256, 64 * 6).astype(np.uint8)
    frame = jpeg.Frame(jpeg.encode_bytes(data))
    assert (jpeg.decode_first(frame) == frame.luma()).all() and (frame.luma()[::8, ::8].ravel() == data).all()


def test_decoder_reads_ordinary_frames():
    from tessera.sources.jpeg import jpeg as encode

    y, x = np.mgrid[0:40, 0:52]
    grey = (100 + 60 * np.sin(x / 9) + 40 * np.cos(y / 7)).clip(0, 255).astype(np.uint8)[:, :, None]
    colour = np.concatenate([grey, 255 - grey, grey // 2], axis=2)
    luma = colour @ np.array([0.299, 0.587, 0.114])
    assert np.abs(jpeg.Frame(encode(grey)).luma()[:40, :52].astype(int) - grey[:, :, 0]).max() <= 3
    assert np.abs(jpeg.Frame(encode(colour)).luma()[:40, :52] - luma).max() <= 3


def test_shots_follow_histograms():
    still, other = np.eye(32)[3] * 100, np.eye(32)[20] * 100
    begins, _ = video.shots_of(np.array([still] * 10 + [other] * 10 + [still] * 5))
    assert begins == [0, 10, 20]
    samples = [jpeg.encode_bytes(np.full(4096, v, np.uint8)) for v in [10] * 5 + [200] * 5]
    assert video.analyse(video.write_avi(samples, 512, 512))["begins"] == [0, 5]


def test_counts_of_quality_rules(docs):
    rows = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for d in docs.select("doc_id", "text").collect():
        words = d["text"].encode().split()
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in d["text"].split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = rows[d["doc_id"]]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(len(w.decode()) for w in words) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in d["text"])
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_language_is_right(docs):
    model = language.train(docs, "text", "lang")
    rows = language.identify(docs, model, declared=F.col("lang"), host=F.col("source")).filter("lang_kept").collect()
    blind = language.identify(docs, model).filter("lang_kept").collect()
    assert len(rows) > 985 and np.mean([r["lang_id"] == r["lang"] for r in rows]) > 0.99 and np.mean([r["lang_id"] == r["lang"] for r in blind]) > 0.98


def test_host_priors_are_hierarchical(spark):
    counts = spark.createDataFrame([("a.x.com", "en", 90), ("b.x.com", "de", 10), ("c.org", "de", 5)], "x_host string, x_guess string, count long")
    rows = {r[0]: r[1] for r in language.host_priors(counts, ["de", "en"], [0.2, 0.8], 10.0, 20.0).collect()}
    domain = (10 + 20 * 0.2) / (100 + 20)
    assert rows["a.x.com"][0] == pytest.approx((0 + 10 * domain) / (90 + 10)) and rows["c.org"][0] == pytest.approx((5 + 10 * ((5 + 20 * 0.2) / 25)) / 15)


def test_page_evidence(spark):
    html = spark.createDataFrame([('<!DOCTYPE html><html class="x" lang="DE-at"><p>', "HTTP://u:p@Www.Site.example.DE:80/x?y#z")], "html string, url string")
    row = html.select(language.markup_language(F.col("html")), language.host_of(F.col("url")), language.registered_domain(language.host_of(F.col("url")))).first()
    assert tuple(row) == ("de", "www.site.example.de", "example.de")


def test_toxic_held_out(spark, docs):
    labels = read_table(spark, SF, "labels")
    model = toxicity.train(docs, labels, min_docs=3)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out("doc_id")).filter("lang = 'en'").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]) > 0.9


def test_counterfactual_penalty_evens_identity_terms(spark):
    rng = np.random.default_rng(2)
    filler = [f"word{i}" for i in range(40)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = list(rng.choice(filler, 12)) + (["scumbag"] if toxic else [])
        words += ["muslim"] if rng.random() < (0.6 if toxic else 0.1) else ["christian"] if rng.random() < 0.3 else []
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")

    def gap(swap):
        of = toxicity.train(docs, labels, swap=swap, l1=0.0).scorer()
        return abs(of("a muslim neighbour") - of("a christian neighbour")), of("you scumbag")

    free, _ = gap(0.0)
    even, toxic = gap(5.0)
    assert even < free and even < 0.05 and toxic > 0.5


def test_training_ignores_held_out_rows(spark, docs):
    labels = read_table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_licences_are_found(spark, docs):
    model = licences.train(docs)
    rows = {r["doc_id"]: r for r in licences.scan(docs, model).collect()}
    plain = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "reserved", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    for d in docs.select("doc_id", "text").collect():
        want = sorted({f for line, f in plain.items() if line in d["text"].split("\n")})
        assert rows[d["doc_id"]]["families"] == want
        for hit in rows[d["doc_id"]]["hits"]:
            assert plain[d["text"][hit["start"] : hit["start"] + hit["length"]] + "."] == hit["family"]
    assert model.predict("this software is provided under a licence of our own") is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<s>", ""]), st.text(alphabet=st.sampled_from("<s>/[]INST␛e \nxé🎈"), max_size=30)), min_size=1, max_size=6))
def test_chat_round_trip(spark, turns):
    frame = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    row = chat.digests(chat.format_conversations(frame)).first()
    assert row["verified"] and row["n_turns"] == len(turns)
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_loss_mask_points_at_the_text(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "🎈ok</s>"), (1, 2, "assistant", "bye")], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(frame).first()
    assert [row["formatted"][m["start"] : m["start"] + m["length"]] for m in row["loss_mask"]] == ["🎈ok<␛/s>", "bye"]


def test_targets_fill_like_water(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 400, "d": 0}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"), 1.5, 2.0).collect()
    got = {r["source"]: r["target"] for r in rows}
    order = sorted((k for k in sizes if k), key=str) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    budget, want, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        level = (budget - sum(want.values())) / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] >= 2 * sizes[k]}
        if not full:
            break
        want |= {k: 2.0 * sizes[k] for k in full}
        open_ -= full
    want |= {k: level * weight[k] for k in open_}
    assert all(got[k] == pytest.approx(want[k]) for k in sizes)


def test_mixture_comes_near_its_targets(docs):
    rows = mixing.mix(docs).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["m_size"] * r["m_copies"]
        target[r["source"]] = r["m_target"]
        largest[r["source"]] = max(largest[r["source"]], r["m_size"])
        assert r["m_copies"] <= 2
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_better_documents_are_sampled_more(spark):
    rows = [(i, "good words here now" if i % 2 else "bad # % & ! words", "a") for i in range(4000)] + [(10_000 + i, "x " * 60, "b") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, share=0.6).filter("source = 'a'").collect()
    taken = Counter(r["doc_id"] % 2 for r in out if r["m_copies"])
    assert taken[1] > taken[0] > 0


def test_sharding_is_repeatable(spark, docs):
    q = QUERIES["op9_sharding"]
    one, two = (sorted(map(tuple, q(spark, SF).select("doc_id", "shard", "slot").collect())) for _ in range(2))
    assert one == two and [x[0] for x in sorted(one, key=lambda r: r[1:])] != sorted(x[0] for x in one)


def test_pipeline_stages(spark, sf_dir):
    from tessera.llm.common import written

    docs = read_table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs, written(stage(spark, docs, sf_dir), "test-pipeline")
        assert out.columns == before.columns, name
        ids = {r[0] for r in before.select("doc_id").collect()}
        assert {r[0] for r in out.select("doc_id").collect()} <= ids and out.count() > 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_pipeline_handles_odd_rows(spark, odd, nothing, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, nothing):
            out = stage(spark, table, sf_dir)
            assert out.count() <= 2 * table.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns


def test_full_results_are_json(spark, sf_dir):
    rows = QUERIES["op3_license_scan"](spark, sf_dir).collect()
    assert all(isinstance(json.loads(r["hits"]), list) for r in rows)


def test_windows_and_words():
    hashes = shingles.WordHashes()
    assert quality.repeated_words(b"a b c d e f g h a b c d e f g h".split(), hashes) == 16
    assert quality.repeated_words(b"a b c d e f g h".split(), hashes) == 0
    assert len(shingles.shingle_set("A a b", hashes)) == 1


def test_pairs_hidden_in_boilerplate_equal_brute_force(spark):
    """Hundreds of texts about 0.70 to each other hide near-copy pairs of 0.76 and 0.80."""
    rng = np.random.default_rng(9)
    shared = [f"w{i}" for i in range(254)]
    rows = []
    for i in range(400):
        own = [f"x{i}_{k}" for k in range(54)]
        if i % 8 == 1:
            own = texts[-1][: int(rng.integers(14, 24))] + own
            own = own[:54]
        texts = [own] if i % 8 == 0 else [*texts, own]
        rows.append((i, " ".join(shared + own)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = brute_components(sets)
    assert 30 <= sum(want[i] != i for i in want) <= 60 and max(Counter(want.values()).values()) == 2
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block=16).collect()}
    assert got == want


def test_blocks_of_dissimilar_crowds_equal_brute_force(spark):
    """Many texts share a long passage and are mostly unlike enough to stay apart; blocks are smaller than the crowd."""
    rng = np.random.default_rng(12)
    blocks = [[f"b{k}_{j}" for j in range(8)] for k in range(60)]
    rows = [(i, " ".join(w for k, b in enumerate(blocks) for w in (b if rng.random() < 0.8 else []))) for i in range(1200)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = brute_components(sets)
    assert 800 < len(set(want.values())) < 1100
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block=100).collect()}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_large_components_are_cut_and_never_meet_themselves(spark):
    rows = [("k", i, 7 if i < 50 else 8 if i < 75 else 100 + i % 9, 0, 10, True) for i in range(100)] + [("one", i, 7, 0, 10, True) for i in range(60)]
    frame = spark.createDataFrame(rows, "key string, rid bigint, comp bigint, place bigint, n bigint, short boolean")
    dealt = minhash.dealt_blocks(frame, 10).collect()
    blocks, groups = {}, {}
    for r in dealt:
        assert r["key"] == "k"
        blocks.setdefault(r["own"], set()).add((r["rid"], r["comp"]))
        groups.setdefault((min(r["own"], r["other"]), max(r["own"], r["other"])), set()).add(r["rid"])
    assert sum(map(len, blocks.values())) == 100
    comps = {rid: comp for _, rid, comp, *_ in rows[:100]}
    apart = {(a, b) for a in range(100) for b in range(a) if comps[a] != comps[b]}
    met = {(a, b) for g in groups.values() for a in g for b in g if a > b}
    assert apart <= met and not any(comps[min(g)] == comps[x] for (i, j), g in groups.items() if i != j for x in g if len({comps[y] for y in g}) == 1)


def test_rows_of_a_repeated_id_follow_their_own_text(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, one), (1, two), (2, two + " more"), (3, one), (4, "else")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 36, 1), (4, 1, 4)]


def test_prefixes_miss_no_pair():
    """Sets of unlike sizes at the threshold share a key, and the smaller one may need it."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, m = sorted(int(x) for x in rng.integers(1, 400, 2))
        inter = min(n, -(-75 * (n + m) // 175))
        if 100 * inter < 75 * (n + m - inter):
            continue
        both = rng.integers(0, 2**63, n + m - inter).astype(np.uint64)
        one, two, counts = np.sort(both[:n]), np.sort(both[n - inter :]), rng.integers(2, 9, minhash.COUNT_BINS)
        (a, _, short), (b, _, _) = (minhash.prefix(x, counts, 75) for x in (one, two))
        assert len(np.intersect1d(a[short], b))


def test_licences_inside_long_paragraphs(spark, docs):
    rng, rows, want = np.random.default_rng(6), [], {}
    for family, templates in licences.TEMPLATES.items():
        for template in templates[:1]:
            for n in (30, 100, 1000):
                words = [f"plain{i}" for i in rng.integers(0, 500, n)]
                rows.append((len(rows), " ".join([*words[: n // 2], template, *words[n // 2 :]])))
                want[rows[-1][0]] = family
    frame = spark.createDataFrame([*rows, (len(rows), " ".join(words))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["families"] for r in licences.scan(frame, licences.train(docs)).collect()}
    assert got.pop(len(rows)) == [] and {i: f for i, f in got.items() if f != [want[i]]} == {}
