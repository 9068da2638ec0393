"""The training-data operators against brute force, round trips and held-out accuracy, and their odd cases."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfield.llm import additive_ann, components, ctw, mixing, ogg_media, part_codes, quality, sentencepiece_fst, set_join, sharding, token_files, toxicity, url_filter, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m_size long, score string"
ODD = [(None, None), (1, ""), (2, " \t\n"), (3, "one two"), (3, "one two"), (4, "ONE two"), (5, "w " * 20000), (6, "x" * 100_000), (7, "a b c d e f▁ é 😀"), (8, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s" if i else None, 1, 7, "x") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


def test_odd_rows_and_empty_tables(odd, empty, labels):
    runs = [
        sentencepiece_fst.round_trip, sharding.shard, ogg_media.stored_texts, lambda d: toxicity.classify(d, labels), lambda d: quality.classify(d, labels),
        lambda d: ctw.score_held_out(d, depth=2), set_join.join, lambda d: mixing.mix(d, ["doc_id"]),
    ]
    for run in runs:
        assert run(odd).count() == len(ODD)
        assert run(empty).count() == 0
    assert set_join.one_of_each(odd).count() == len(ODD) - 2
    assert mixing.mixed_documents(empty).count() == 0


def test_sentencepiece_equals_the_library():
    import sentencepiece

    lib, own, rnd = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL), sentencepiece_fst.Transducer(sentencepiece_fst.compile_model()), random.Random(4)
    for _ in range(4000):
        t = "".join(rnd.choice("abcdeth ion  \n\té你😀ßing.,123ABC<>{}\\_=-") for _ in range(rnd.randint(0, 40)))
        ids = own.encode(t)
        assert ids.tolist() == lib.encode(t) and own.decode(ids) == t


def unigram_model(path):
    """A small model with byte fallback, its pieces and scores made up."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m, kind = pb.ModelProto(), pb.ModelProto.SentencePiece
    add = lambda piece, score, t: m.pieces.add(piece=piece, score=score, type=t)
    for piece, t in (("<unk>", kind.UNKNOWN), ("<s>", kind.CONTROL), ("</s>", kind.CONTROL)):
        add(piece, 0.0, t)
    for b in range(256):
        add(f"<0x{b:02X}>", 0.0, kind.BYTE)
    rnd = random.Random(12)
    words = {"\u2581", *"abcdeo", "\u2581a", "\u2581b", "ab", "abc", "bcd", "\u2581ab", "cde", "de", "ea", "\u2581deco", "co"}  # no two orders of the same pieces, whose equal sums the library tells apart by rounding
    for w in sorted(words):
        add(w, -rnd.uniform(1, 9), kind.NORMAL)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = m.trainer_spec.UNIGRAM, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    m.normalizer_spec.name = "identity"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_equals_the_library(tmp_path):
    import sentencepiece

    model = unigram_model(tmp_path / "u.model")
    lib, own, rnd = sentencepiece.SentencePieceProcessor(model_file=model), sentencepiece_fst.Transducer(sentencepiece_fst.compile_model(model)), random.Random(5)
    for _ in range(3000):
        t = "".join(rnd.choice("abcdeo aabbcc  \né😀x") for _ in range(rnd.randint(0, 30)))
        ids = own.encode(t)
        assert ids.tolist() == lib.encode(t) and own.decode(ids) == t


def test_sentencepiece_odd_rows(spark, odd):
    got = sentencepiece_fst.round_trip(odd).collect()
    assert all((r.n_ids == 0 and r.lossless) for r in got if r.doc_id in (None, 1, 8)) and len({tuple(r.ids) for r in got if r.doc_id == 3}) == 1
    assert all(r.lossless == (r.doc_id != 7) for r in got) and all(r.n_ids == len(r.ids) for r in got)
    clash = sentencepiece_fst.encode(odd.withColumn("ids", F.lit("mine")), "ids").where("doc_id = 3").first()
    assert list(clash.ids) == list(next(r.ids for r in got if r.doc_id == 3))


def test_shards_are_minimax(spark):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 90) if i % 3 else "same", 0) for i in range(300)], "doc_id long, text string, n int")
    p = sharding.shard(docs, shards=5).toPandas()
    groups = p.groupby("text_md5")["size"].sum().sort_index().tolist()
    def feasible(c):
        used, room = 1, c
        for g in groups:
            if g > c:
                return False
            if g > room:
                used, room = used + 1, c
            room -= g
        return used <= 5
    assert p.groupby("shard")["size"].sum().max() == next(c for c in range(sum(groups) + 1) if feasible(c))
    assert p.groupby("text_md5").shard.nunique().max() == 1
    for _, s in p.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))


def test_url_rules(spark):
    urls = [None, "nothing", "http://A.net/x", "https://www.example.net/en/1?q#f", "http://example.net/de/", "http://example.com/de/1", "http://w.org/fr/", "http://org?x"]
    p = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [p[i].rule for i in range(8)] == [None, None, "net/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None]
    assert (p[2].host, p[2].path, p[3].path, p[7].host, p[0].host) == ("a.net", "/x", "/en/1", "org", "")


def test_url_models_read_the_path(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeiourstln") for _ in range(6))
    urls = [f"https://{word()}.org/{rnd.choice(['garden', 'history', 'recipes'])}/{word()}?page={rnd.randint(1, 9)}" for _ in range(200)]
    urls += [f"https://{word()}.org/{rnd.choice(['casino/slots', 'viagra-bonus', 'poker/bet'])}/{word()}?page={rnd.randint(1, 9)}" for _ in range(200)]
    ask = ["https://host.org/garden/solar", "https://host.org/casino/solar", "https://host.org/x?go=viagra-bonus", "https://host.org/history/nails"]
    pages = spark.createDataFrame(list(enumerate(ask + urls)), "page_id long, url string")
    bad, known = F.col("url").rlike("casino|viagra|poker"), F.col("page_id") >= len(ask)
    p = {r.page_id: r for r in url_filter.judge(pages, accepted=known & ~bad, rejected=known & bad).collect()}
    assert [p[i].verdict for i in range(4)] == ["allow", "block", "block", "allow"] and all(p[i].rule is None for i in range(4))


def test_url_probabilities_by_brute_force():
    texts, order = [b"abab", b"abc", b"ba"], 2
    m = url_filter.Markov(order).fit(texts)
    def p(context, c):
        here = Counter(t[i] for t in (b"\n" + x + b"\n" for x in texts) for i in range(1, len(t)) if t[:i].endswith(context) and i >= len(context))
        lower = p(context[1:], c) if context else 1 / 256
        return (here[c] + len(here) * lower) / (sum(here.values()) + len(here)) if here else lower
    for context in (b"", b"a", b"ab", b"zz", b"\nb"):
        assert sum(m.p(context, c) for c in range(256)) == pytest.approx(1)
        assert all(m.p(context, c) == pytest.approx(p(context, c)) for c in b"abc\nx")
    want = sum(math.log(p(t[max(0, i - order) : i], t[i])) for t in [b"\nabz\n"] for i in range(1, len(t)))
    assert m.log_likelihood(b"abz") == pytest.approx(want)


def test_url_threshold_by_brute_force():
    rnd = random.Random(8)
    scores = [(rnd.gauss(b, 0.8), b) for b in (False, True) for _ in range(60)]
    cost = lambda at, care: sum(s <= at for s, b in scores if b) / 60 + care * sum(s > at for s, b in scores if not b) / 60
    for care in (1.0, 4.0):
        assert cost(url_filter.threshold(scores, care), care) == pytest.approx(min(cost(s, care) for s, _ in scores))


def test_url_models_on_held_out_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hits = pages.select("url", url_filter.host().alias("host"), url_filter.path().alias("path")).withColumn("hit", url_filter.rule())
    found = url_filter.fit(hits, F.col("hit.action") == "allow", F.col("hit.action") == "block")
    assert sum((s > found.most) == bad for s, bad in found.out_of_fold) >= 0.9 * len(found.out_of_fold)


def test_url_models_count_every_labelled_url(spark):
    rnd = random.Random(4)
    urls = [f"https://{rnd.choice('abc')}{rnd.randint(0, 60)}.org/{rnd.choice(['good', 'gut', 'bad', 'bäd'])}{rnd.randint(0, 99)}/" for _ in range(5000)] + ["", None, "x", "HTTP://A.org/Bad"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad, known = F.col("url").contains("b") & F.col("url").contains("d"), F.col("page_id") % 8 > 0
    got = {r.page_id: r for r in url_filter.judge(pages, accepted=known & ~bad, rejected=known & bad, order=3).collect()}
    label = {}
    for i, u in enumerate(urls):
        t = (u or "").lower()
        if t and i % 8:
            label[t] = label.get(t, False) or ("b" in u and "d" in u)
    fold = {t: zlib.crc32(t.partition("://")[2].split("/")[0].encode()) % 4 for t in label}
    models = lambda k: [url_filter.Markov(3).fit(t.encode() for t, b in label.items() if b == bad and fold[t] != k) for bad in (False, True)]
    without = [models(k) for k in range(4)]
    out = [(url_filter.ratio(*without[fold[t]], t.encode()), b) for t, b in label.items()]
    most, whole = url_filter.threshold(out, 4.0), models(None)
    want = {t: url_filter.ratio(*whole, t.encode()) for t in {(u or "").lower() for u in urls}}
    assert len(label) > 4000 and len(got) == len(urls)  # more than a sample of 2000 for each class
    for i, u in enumerate(urls):
        s = want[(u or "").lower()]
        assert got[i].score == pytest.approx(s, abs=1e-6) and (got[i].verdict == ("block" if u and s > most else "allow") or abs(s - most) < 1e-6)


def plain_checksum(data):
    """The Ogg checksum bit by bit: polynomial 0x04C11DB7 from 0, highest bit first."""
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
    return c


def plain_page(flags, granule, serial, sequence, lacing, body):
    head = b"OggS" + bytes([0, flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + sequence.to_bytes(4, "little")
    rest = bytes([len(lacing), *lacing]) + body
    return head + plain_checksum(head + bytes(4) + rest).to_bytes(4, "little") + rest


def test_ogg_reads_pages_written_by_hand(spark):
    a, b, c = b"A" * 300, b"B" * 255, b"C" * 10
    data = plain_page(2, 0, 7, 0, [4], b"head") + plain_page(2, 5, 9, 0, [3], b"two")
    data += plain_page(0, -1, 7, 1, [255], a[:255]) + plain_page(1, 565, 7, 2, [45, 255, 0, 10], a[255:] + b + c)
    pages, lost = ogg_media.read_pages(data)
    assert lost == 0 and [p.sequence for p in pages] == [0, 0, 1, 2] and all(ogg_media.page_checksum(x) == plain_checksum(x) for x in (b"", b"abc", data))
    streams = ogg_media.demultiplex(pages)
    assert [p.data for p in streams[7]] == [b"head", a, b, c] and [p.data for p in streams[9]] == [b"two"]
    got = ogg_media.packets(spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray())], "k long, media binary"), "k", rate=10).collect()
    assert {(r.serial, r.packet): (r.granule, r.seconds) for r in got} == {(7, 0): (0, 0.0), (7, 1): (None, 30.0), (7, 2): (None, 55.5), (7, 3): (565, 56.5), (9, 0): (5, 0.5)}
    broken = ogg_media.demultiplex([p for p in pages if p.sequence != 1])[7]
    assert [p.whole for p in broken] == [True, False, True, True] and ogg_media.ends(broken) == [0, 300, 555, 565]


def test_ogg_survives_damage():
    payload = bytes(range(256)) * 300
    media = ogg_media.store(payload)
    back, about = ogg_media.load(media)
    assert back == payload and about["whole"] and about["seconds"] == len(payload) / ogg_media.RATE
    bad = bytearray(media)
    bad[len(bad) // 2] ^= 1
    pages, lost = ogg_media.read_pages(b"junk" + bytes(bad))
    assert lost > 4 and len(pages) == about["pages"] - 1


def test_tree_probabilities_by_brute_force(spark):
    texts, depth = ["abab abba", "ba ab", "abb a"], 2
    data, grams = [ctw.canonical(t) for t in texts], Counter()
    for t in data:
        b = b"\n" * depth + t
        grams.update(b[i : i + depth + 1] for i in range(len(t)))
    lg = math.lgamma
    pe = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    def counts(ctx, i, top):
        n = [0, 0]
        for g, k in grams.items():
            if g[:-1].endswith(ctx) and g[-1] >> (8 - i) == top:
                n[g[-1] >> (7 - i) & 1] += k
        return n
    def lw(ctx, i, top):
        own = pe(*counts(ctx, i, top))
        kids = [bytes([c]) + ctx for c in range(256) if sum(counts(bytes([c]) + ctx, i, top))] if len(ctx) < depth else []
        return math.log((math.exp(own) + math.exp(sum(lw(k, i, top) for k in kids))) / 2) if kids else own
    def p1(ctx, full, i, top):
        a, b = counts(ctx, i, top)
        own = (b + 0.5) / (a + b + 1)
        if len(ctx) == depth:
            return own
        w = math.exp(pe(a, b) - math.log(2) - lw(ctx, i, top))
        k = full[depth - len(ctx) - 1 :]
        return w * own + (1 - w) * (p1(k, full, i, top) if sum(counts(k, i, top)) else 0.5)
    want = 0.0
    b = b"\n" * depth + data[0]
    for j in range(len(data[0])):
        for i in range(8):
            c = b[j + depth]
            p = p1(b"", b[j : j + depth], i, c >> (8 - i))
            want += math.log10(p if c >> (7 - i) & 1 else 1 - p)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(docs, depth=depth).collect()}
    assert got[0].score == pytest.approx(want, abs=1e-4)
    words = Counter(w for t in data for w in [*t.split(), b"\n"])
    n, v = sum(words.values()), len(words)
    assert got[0].base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in [*data[0].split(), b"\n"]))
    assert (got[0].n_tokens, got[0].n_known, got[0].train_tokens) == (3, 3, n)


def test_scoring_uses_six_bytes_of_context(spark):
    docs = spark.createDataFrame([(i, ("qabcde1 " if i % 2 else "rabcde2 ") * 20) for i in range(40)], "doc_id long, text string")
    total = lambda **o: sum(r.score for r in ctw.score(docs, **o).collect())
    assert total() == pytest.approx(total(depth=6)) and total() > total(depth=5) + 10


def test_rare_contexts_keep_their_estimates(spark):
    rows = [(i, "common filler words " * 4000) for i in range(40)] + [(100 + i, "zq7 wxv9k jjhpq") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, cold, flat = ({r.doc_id: r.score for r in ctw.score(docs, **o).collect()} for o in ({"depth": 3}, {"depth": 3, "hot_grams": 2}, {"depth": 1}))
    assert got[100] > flat[100] + 1 and all(cold[i] == pytest.approx(got[i], rel=1e-5) for i in got)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for f, y, least in ((toxicity.classify, "toxic", 0.9), (quality.classify, "quality", 0.95)):
        p = f(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
        assert (p.predicted == p[y]).mean() >= least


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16))
    v[100:140] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, [1.0])]
    p = additive_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), books=4).toPandas()
    cos = (v / np.linalg.norm(v, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T
    assert p[p.query_id == 0].sort_values("rank").vec_id.tolist() == [100, 101, 102, 103, 104]
    hits = 0
    for q in range(0, 600, 50):
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-round(cos[q, i], 12), i))[:5]
        hits += len(set(best) & set(p[p.query_id == q].vec_id))
    assert hits >= 0.9 * 60 and set(p.query_id) == set(range(0, 600, 50))


def test_nearest_does_not_depend_on_arrow_batches():
    from types import SimpleNamespace as Held

    import pyarrow as pa

    v = np.random.default_rng(6).normal(size=(2500, 16))
    model = additive_ann.fit(v / np.linalg.norm(v, axis=1)[:, None], 2, words=16)
    codes, norms = model.encode(v / np.linalg.norm(v, axis=1)[:, None])
    ids = np.arange(len(v))
    index = pa.record_batch({"uid": ids, "vec_id": ids, "v": pa.array(v.tolist()), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "norm": norms.astype(float)})
    search = additive_ann._searcher(Held(value=model), Held(value=(ids[:20], ids[:20], v[:20])), 5, 8)
    found = [[b.to_pydict() for b in search(index.slice(i, size) for i in range(0, len(v), size))] for size in (77, 1000, 2500)]
    assert found[0] == found[1] == found[2]


def test_mix_meets_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 4 else None) for i in range(2000)], "doc_id long, text string, source string")
    p = mixing.mix(docs, ["doc_id", "source"]).toPandas()
    assert (p.m_taken <= 2 * p.m_size).all() and abs(p.m_taken.sum() - 1.5 * p.m_size.sum()) < 40
    for _, s in p.groupby("source", dropna=False):
        assert abs(s.m_taken.sum() - s.m_target.iloc[0]) <= 8
    assert p.sort_values("doc_id").m_taken.tolist() == mixing.mix(docs, ["doc_id"]).toPandas().sort_values("doc_id").m_taken.tolist()


def test_mix_of_repeated_rows(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 240 + ["c"] * 240)] + [(1000, "w " * 10, "b")] * 240
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    p = mixing.mix(docs, ["doc_id", "source"]).toPandas()
    assert len(p) == 720 and (p.m_taken <= 2 * p.m_size).all()
    for _, s in p.groupby("source"):
        assert abs(s.m_taken.sum() - s.m_target.iloc[0]) <= 10
    again = mixing.mix(docs.repartition(3), ["doc_id", "source"]).toPandas()
    assert sorted(zip(p.doc_id, p.m_taken)) == sorted(zip(again.doc_id, again.m_taken))
    n = mixing.mixed_documents(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert n == {d: k // 10 for d, k in p.groupby("doc_id").m_taken.sum().items() if k}


def test_join_by_brute_force(spark):
    rnd = random.Random(9)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 90))] for _ in range(12)]
    texts = []
    for i in range(260):
        w = list(base[i % 12] if i < 160 else base[0])
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 9999)}"
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    place = list(range(len(texts)))
    def find(i):
        while place[i] != i:
            i = place[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                place[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for o in ({"large": 20}, {"large": 10**9, "block": 7, "hot_entries": 9}):  # the second: no large families, all but short lists dealt
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.join(docs, **o).collect()}
        assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert set_join.one_of_each(docs, large=20).count() == len({find(i) for i in range(len(sets))})


def test_values_of_odd_rows(spark, odd, empty, labels):
    by = lambda df: {(r.doc_id, i): r for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)))}
    shards = by(sharding.shard(odd))
    assert sorted(r["size"] for r in shards.values()) == sorted(len((t or "").encode()) + 1 for _, t in ODD) and {r.shard for k, r in shards.items() if k[0] in (None, 1, 8)}.__len__() == 1
    n = {}
    for r in set_join.join(odd).collect():
        n.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert n == {None: {(0, None)}, 1: {(0, 1)}, 2: {(0, 2)}, 3: {(1, 3)}, 4: {(1, 3)}, 5: {(1, 5)}, 6: {(1, 6)}, 7: {(4, 7)}, 8: {(0, 8)}}
    for f in (toxicity.classify, quality.classify):
        scores = {}
        for r in f(odd, labels).collect():
            scores.setdefault(r.doc_id, set()).add(r.score)
        assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in scores.values()) and scores[None] == scores[1] == scores[8]
    lm = by(ctw.score_held_out(odd, depth=2))
    assert {r.n_tokens for k, r in lm.items() if k[0] in (None, 1, 2, 8)} == {1} and {r.n_tokens for k, r in lm.items() if k[0] == 5} == {20001}
    assert all(r.score < 0 and r.base_score < 0 for r in lm.values()) and len({r.score for k, r in lm.items() if k[0] in (3, 4)}) == 1
    mix = by(mixing.mix(odd, ["doc_id"]))
    assert all(r.m_taken == 0 for k, r in mix.items() if k[0] in (None, 1, 2, 8)) and all(r.m_taken in (0, r.m_size, 2 * r.m_size) for r in mix.values())
    media = by(ogg_media.stored_texts(odd, keep_media=True))
    assert all((r.n_bytes, r.payload_bytes) == (0, 64) and r.media == media[(1, 1)].media for k, r in media.items() if k[0] in (None, 1, 8))
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert additive_ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    clash = spark.createDataFrame([(1, "https://a.net/x", "h", "r", 1.0)] * 2, "page_id long, url string, host string, rule string, score double")
    assert [(r.host, r.rule, r.verdict) for r in url_filter.judge(clash).collect()] == [("a.net", "net/", "block")] * 2


def test_mix_by_brute_force(spark):
    rnd = random.Random(21)
    docs = spark.createDataFrame([(i, "w " * rnd.randint(0, 30) + "#$" * rnd.randint(0, 2), rnd.choice(["a", "b", "c", "d", None])) for i in range(900)], "doc_id long, text string, source string")
    keyed = docs.select("doc_id", "source", mixing.n_words().alias("n"), mixing.exponential_key(mixing.quality_weight(), 17).alias("key")).toPandas()
    names = [*sorted(s for s in keyed.source.unique() if s is not None), None]
    size = {s: int(keyed[keyed.source.isna() if s is None else keyed.source == s].n.sum()) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    want = {}
    for s in names:
        rows = keyed[keyed.source.isna() if s is None else keyed.source == s].sort_values(["key", "doc_id"])
        epochs = int(target[s] // size[s])
        ahead = 0
        for r in rows.itertuples():
            want[r.doc_id] = r.n * (epochs + (ahead + r.n / 2 <= target[s] - epochs * size[s]))
            ahead += r.n
    for o in ({}, {"bucket_rows": 3}):
        got = mixing.mix(docs, ["doc_id", "source"], **o).toPandas()
        assert got.set_index("doc_id").m_taken.to_dict() == want
        assert all(abs(t - target[None if s is None or s != s else s]) < 1e-6 for s, t in zip(got.source, got.m_target))
    taken = mixing.mixed_documents(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    n = keyed.set_index("doc_id").n.to_dict()
    assert taken == {d: w // n[d] for d, w in want.items() if w}


def test_discriminant_by_brute_force():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(200, 4)), rng.normal(size=(150, 4)) @ np.diag([1, 2, 0.5, 1]) + 1])
    y = np.repeat([0, 1], [200, 150])
    model = quality.fit(x, y, shrinkage=0.2)
    turn = np.concatenate([np.arange(200), np.arange(150)])
    own = turn % 4 != 3
    z = lambda a: np.clip((a - x[own].mean(0)) / (x[own].std(0) + 1e-6), -8, 8)
    logs = []
    for k in (0, 1):
        part = z(x)[own & (y == k)]
        cov = np.cov(part.T, bias=True)
        cov = 0.8 * cov + 0.2 * (np.trace(cov) / 4 + 1e-3) * np.eye(4)
        d = z(x) - part.mean(0)
        logs.append(-0.5 * np.einsum("ni,ni->n", d, np.linalg.solve(cov, d.T).T) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(x), logs[1] - logs[0]) and ((model.score(x) > 0.5) == y).mean() > 0.8


def test_savings_by_brute_force():
    import zstandard

    ordinary, toxic = b" the cat sat on a mat and looked at the sun " * 9, b" wretchedly awful "
    parameters = zstandard.ZstdCompressionParameters(**toxicity._PARAMETERS)
    def length(content, w):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress(w))
    text = "The cat looked wretchedly awful " * 3 + "and sat on a mat " * 9
    saved = [length(ordinary, w) - length(toxic + ordinary, w) for w in toxicity.windows(text)]
    assert toxicity.Savings(ordinary, toxic).features(text) == (max(saved), pytest.approx(sum(x for x in saved if x > 0) / (1 + len(saved)) ** 0.5))
    assert max(saved) > 5 and b"".join(w[1:-1].replace(b" ", b"") for w in toxicity.windows(text)) == text.lower().replace(" ", "").encode()


def test_sample_counts_documents_that_exist(spark):
    from wayfield.llm import common

    docs = spark.createDataFrame([(i, f"text {i}", 0) for i in range(0, 60, 2)] + [(4, "text 4", 1), (6, "other", 0)], "doc_id long, text string, x int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, y int")
    rows, shift = common.labelled_sample(docs, labels, "y", 4, 5, 1 << 30)
    assert Counter(r.y for r in rows) == {0: 5, 1: 5} and all(r.x == "other" or int(r.x.split()[1]) % 2 == 0 for r in rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    n = Counter(int(i % 4 == 0) for i in range(0, 60, 2) if not held(i)) + Counter([0] * (not held(6)))
    assert shift == pytest.approx(math.log(n[1] / n[0]))
    few, _ = common.labelled_sample(docs, labels, "y", 4, 5, 14)
    assert Counter(r.y for r in few)[0] <= 3 and Counter(r.y for r in few)[1] >= 1


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 3), (7, 8), (2, 2)], "u long, v long")
    assert {r.node: r.root for r in components.components(links).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_components_of_a_hot_star(spark):
    links = spark.range(1, 6000).selectExpr("id AS u", "id % 3 * 0 AS v").unionByName(spark.createDataFrame([(7000, 7001), (7001, 5999)], "u long, v long"))
    roots = components.components(links)
    assert roots.count() == 6002 and roots.agg(F.max("root")).first()[0] == 0


def test_overlaps_are_derived_right():
    rng = np.random.default_rng(4)
    common = np.arange(300, dtype=np.uint64) * np.uint64(7)
    sets = [np.unique(np.concatenate([rng.choice(common, 280, replace=False), rng.integers(10**6, 10**6 + 60, 12).astype(np.uint64)])) for _ in range(30)] + [np.empty(0, np.uint64)]
    for left, right in ((np.arange(12), np.arange(12, 31)), (np.arange(31), np.arange(31))):
        got = set_join.overlaps(sets, left, right, columns=64)
        assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]


def test_one_of_each_keeps_clashing_names(spark):
    rows = [(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (3, "", "z"), (None, "q r s t u", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string")
    for c in ("t", "row", "words", "w_digest", "root", "component_id", "one"):
        docs = docs.withColumn(c, F.concat(F.lit(c), "d"))
    got = {(r.doc_id, r.d, r.t, r.w_digest) for r in set_join.one_of_each(docs).collect()}
    assert got == {(1, "y", "ty", "w_digesty"), (3, "z", "tz", "w_digestz"), (None, "n", "tn", "w_digestn")}


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit("mine"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for stage, classify, keeps in ((P.drop_toxic, toxicity.classify, lambda s: s < 0.3), (P.keep_good, quality.classify, lambda s: s >= 0.7)):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and ids(out) == sorted(r.doc_id for r in classify(docs, labels).collect() if keeps(r.score)) and {r.score for r in out.collect()} == {"mine"}
    found = set_join.join(docs).collect()
    assert ids(P.one_of_each_group(spark, docs, DATA)) == sorted(r.doc_id for r in found if r.n_shingles == 0 or r.doc_id == r.component_id)
    mix = {r.doc_id: r.m_taken // max(1, r.m_size) for r in mixing.mix(docs, ["doc_id"]).collect()}
    assert ids(P.mix_sources(spark, docs, DATA)) == sorted(d for d, k in mix.items() for _ in range(k))
    ids_of = {r.doc_id: list(r.ids) for r in sentencepiece_fst.round_trip(docs).collect()}
    assert {r.doc_id: list(r.ids) for r in P.encode(spark, docs, DATA).collect()} == ids_of


def test_pipeline_of_odd_rows(spark, odd, empty):
    import corpus_pipeline as P

    for _, stage in P.STAGES[:-1]:
        assert stage(spark, empty, DATA).count() == 0 and stage(spark, odd, DATA).columns == odd.columns
    assert P.encode(spark, odd, DATA).columns == [*odd.columns, "ids"]


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    assert 0 < out.count() and out.where(F.size("ids") == 0).count() == 0


def read_ids(spark, docs, path, **options):
    token_files.write(docs, str(path), **options)
    return sorted(((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read(spark, str(path)).collect()))


def test_token_files_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    lib, rnd = Tokenizer.from_file(token_files.tokenizer_path()), random.Random(31)
    texts = ["".join(rnd.choice("ab c  d\t\n'stre.,12é日 😀 \x1c\xa0　<|endoftext|>") for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + [t for _, t in ODD]
    ids = [rnd.choice([None, *range(1200)]) for _ in texts]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, start string").repartition(5)
    got = read_ids(spark, docs, tmp_path / "a")
    assert [g[1] for g in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for start, _, n, x in got:
        assert start == at and len(x) == n and x[-1] == 0
        at += n
    want = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in zip(ids, texts))
    assert sorted((str(g[1]), g[3]) for g in got) == want
    flat = [i for g in got for i in g[3]]
    for a, n in ((0, 1), (100, 257), (at - 70, 999), (5, at)):
        parts = sorted(token_files.spans(spark, str(tmp_path / "a"), a, n).collect())
        assert [i for p in parts for i in p.ids] == flat[a : a + n]


def test_pieces_meet_the_library_in_few_texts():
    class Counted:
        def __init__(self, lib):
            self.lib, self.texts = lib, 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.lib.encode_batch_fast(texts, **options)

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abdehinrsté日'1\n") for _ in range(rnd.randint(1, 7)))
    texts = [" ".join(word() + rnd.choice(["", ".", "###", "%&*!", "'s", ".\nA", "-x", "|>", "<|endoftext|>", "  ", " \t", "\u0120"]) for _ in range(40)) for _ in range(200)]
    e = token_files.Encoder(token_files.tokenizer_path())
    lib, e.lib, e.merger = e.lib, Counted(e.lib), Counted(e.merger)
    ids, n = e.encode(pa.array(texts), 0)
    assert e.by_words and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert len(e.known) > 2000 and e.lib.texts + e.merger.texts < 2000  # before, a text a piece: more than 3000; what is left are pieces with blanks of their own, and beginnings of texts
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_words_meet_the_library_once_and_letters_the_model_alone():
    class Counted:
        def __init__(self, lib):
            self.lib, self.size = lib, 0

        def encode_batch_fast(self, texts, **options):
            self.size += sum(map(len, texts))
            return self.lib.encode_batch_fast(texts, **options)

    rnd = random.Random(6)
    words = ["".join(rnd.choice("éèstraçÀn") for _ in range(8)) for _ in range(80)]
    texts = ["Dix " + " ".join(f"{a}.\n{b}" for b in words) for a in words]
    e = token_files.Encoder(token_files.tokenizer_path())
    lib, e.lib, e.merger = e.lib, Counted(e.lib), Counted(e.merger)
    ids, n = e.encode(pa.array(texts), 0)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert e.lib.size < 100 and e.merger.size < 5000  # before, each pair of words met the library: 121,840 letters


def test_a_workers_table_keeps_what_occurs_again():
    e = token_files.Encoder(token_files.tokenizer_path(), most=40, few=10, longest=20)
    word = lambda i: "x" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10]
    some = lambda a, b, k=1: "First " + " ".join([word(i) for i in range(a, b)] * k + ["long" * 9])
    sizes = []
    for t in (some(0, 30), some(30, 60), some(0, 30, 2), some(0, 30), some(60, 90, 2), some(90, 100, 2)):
        ids, n = e.encode(pa.array([t, t]) if t == some(60, 90, 2) else pa.array([t]), 0)
        assert ids[: n[0]].tolist() == [*e.lib.encode(t, add_special_tokens=False).ids, 0]
        sizes.append(len(e.known))
    assert sizes == [10, 10, 30, 30, 40, 10] and max(map(len, e.known.to_pylist())) < 20


def test_pieces_of_tokenizers_whose_merges_cross_words(tmp_path):
    from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

    b, nl = token_files.BLANK, token_files.LINE
    texts = ["b ab ba a\nb a b", "ab\nab ab\nba", "a a a a", "", "ab"]
    for more, added in ([("a", b), ("a" + b, "b")], []), ([(nl, "b"), (b, "a")], []), ([("b", "a")], [AddedToken("ba")]), ([("a", "b")], []):
        vocab = {t: i for i, t in enumerate(["<end>", *token_files.BYTES, *(x + y for x, y in more)])}
        t = Tokenizer(models.BPE(vocab, more))
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        t.add_tokens(added)
        t.save(str(tmp_path / "t.json"))
        e = token_files.Encoder(str(tmp_path / "t.json"))
        ids, n = e.encode(pa.array(texts), 0)
        assert e.by_words and e.merges_words == (more == [("a", "b")])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]


def test_token_files_of_odd_rows(spark, odd, empty, tmp_path):
    got = read_ids(spark, odd, tmp_path / "a")
    assert len(got) == len(ODD) and got[0][1] is None and [g[2] for g in got if g[1] in (None, 1, 8)] == [1, 1, 1] and got == read_ids(spark, odd.repartition(3), tmp_path / "b")
    assert read_ids(spark, empty, tmp_path / "c") == []


def test_code_lengths_are_the_best_under_their_limit():
    import heapq

    def huffman(n):
        heap = [(k, i, [i]) for i, k in enumerate(n)]
        heapq.heapify(heap)
        length, at = [0] * len(n), len(n)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for i in x + y:
                length[i] += 1
            heapq.heappush(heap, (a + b, at, x + y))
            at += 1
        return length

    rnd = random.Random(8)
    for size in (2, 3, 7, 40, 300):
        n = np.array([1 + int(rnd.paretovariate(0.5)) % 10**6 for _ in range(size)])
        free = np.array(huffman(n.tolist()))
        assert (token_files.code_lengths(n, 40).astype(int) * n).sum() == (free * n).sum()
        tight = token_files.code_lengths(n, max(1, (size - 1).bit_length())).astype(int)
        assert tight.max() <= max(1, (size - 1).bit_length()) and (2.0**-tight).sum() == 1
    best = min(sum(a * b for a, b in zip((9, 5, 2, 1), k)) for k in np.ndindex(4, 4, 4, 4) if all(k) and sum(2.0**-x for x in k) <= 1 and max(k) <= 2)
    assert (token_files.code_lengths(np.array([9, 5, 2, 1]), 2) * np.array([9, 5, 2, 1])).sum() == best
    for n in ([], [0, 0], [0, 7]):
        c = token_files.Code(token_files.code_lengths(np.array(n, np.int64), 5))
        ids = np.array([1] * 300 if n == [0, 7] else [], np.int64)
        assert (c.decode(c.encode(ids)) == ids).all()


def test_blocks_decode_by_checkpoint():
    rnd = np.random.default_rng(4)
    ids = np.minimum(rnd.geometric(0.01, 5000), 900)
    c = token_files.Code(token_files.code_lengths(np.bincount(ids), 12))
    block = c.encode(ids)
    bits = "".join(format(int(c.codes[i]), f"0{c.lengths[i]}b") for i in ids)
    words = np.frombuffer(block, ">u4", -1, 8 + 4 * 40)
    assert "".join(format(w, "032b") for w in words)[: len(bits)] == bits and (np.frombuffer(block, "<u4", 2) == [5000, token_files.CHECKPOINT]).all()
    for a, b in ((0, None), (0, 1), (127, 129), (128, 256), (4990, 9999), (700, 700)):
        assert (c.decode(block, a, b) == ids[a:b]).all()


def brute_codes(v, label, parts=8, entries=16, rounds=6):
    """Part codes by plain loops over exact integers; v: vec_id -> list of floats."""
    ids = sorted(v)
    x = {i: [math.floor(4096 * c) for c in v[i]] for i in ids}
    d = len(x[ids[0]]) // parts
    cut = lambda i, p: x[i][p * d : p * d + d]
    books = [[cut(i, p) for i in ids[:entries]] for p in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda i, p: min(range(len(books[p])), key=lambda e: (far(cut(i, p), books[p][e]), e))
    for _ in range(rounds):
        at = {(i, p): near(i, p) for i in ids for p in range(parts)}
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(i, p) for i in ids if at[i, p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    error = {i: sum(far(cut(i, p), books[p][near(i, p)]) for p in range(parts)) for i in ids}
    total = Counter()
    for i in ids:
        total[label[i]] += error[i]
    import hashlib

    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: ("".join(f"{near(i, p):02x}" for p in range(parts)), error[i], total[label[i]], sha) for i in ids}


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def test_part_codes_by_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.25, rnd.uniform(-1, 1)]) for _ in range(16)], rnd.choice([None, 1, 2]), "x") for i in range(3, 160)]
    bad = [(1, None, 1, "x"), (2, [0.0] * 15 + [float("nan")], 1, "x"), (0, [0.0] * 15 + [None], None, "x"), (200, [], 1, "x"), (201, [float("inf")] * 16, 1, "x")]
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in part_codes.encode(spark.createDataFrame(rows + bad, VECTORS)).collect()}
    assert got == brute_codes({r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows})
    few = [(5, [0.5] * 16, None, "x"), (4, [0.5] * 16, None, "x"), (9, [0.25] * 16, 1, "x")]
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in part_codes.encode(spark.createDataFrame(few, VECTORS)).collect()}
    assert got == brute_codes({r[0]: r[1] for r in few}, {r[0]: r[2] for r in few}) and got[5][0] == "00" * 8
    assert part_codes.encode(spark.createDataFrame(few * 5, VECTORS)).count() == 15  # repeated rows
    assert part_codes.encode(spark.createDataFrame(bad, VECTORS)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        part_codes.encode(spark.createDataFrame([(1, [1e9] * 16, 1, "x")], VECTORS)).count()


def test_trees_keep_lower_indexes_on_ties():
    rnd = np.random.default_rng(6)
    for k, d in ((1, 2), (5, 1), (16, 2), (40, 3)):
        points, q = rnd.integers(0, 4, (k, d)), rnd.integers(-1, 5, (300, d))
        far = ((q[:, None, :] - points) ** 2).sum(2)
        which, best = part_codes.nearest(part_codes.build(points), points, q)
        assert (which == far.argmin(1)).all() and (best == far.min(1)).all()
    assert [s.stop - s.start for s in part_codes.cuts(10, 4)] == [3, 3, 2, 2]


def test_whitening_by_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(0, 1, (400, 12)) @ rnd.normal(0, 1, (12, 12)) / 4
    rows = [(i, v.astype(np.float32).tolist(), 1, "x") for i, v in enumerate(x)] + [(None, [1.0] * 12, 1, "x"), (7, None, 1, "x"), (8, [float("inf")] * 12, 1, "x"), (9, [0.5] * 3, 1, "x")]
    p = whitening.whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    y = np.floor(1024 * np.array([r[1] for r in rows[:401]], np.float64)).astype(np.int64) + 100_000
    n, c = len(y), y * len(y) - y.sum(0)
    e, u = np.linalg.eigh((c / n).T @ (c / n) / n)
    want = (c / n) @ u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    assert len(p) == 401 * 8 and p.n.unique().tolist() == [401] and p.identity_error.max() < 1e-9
    for k in range(8):
        mine = p[(p.component == k + 1) & p.vec_id.notna()].sort_values("vec_id")
        sign = np.sign(mine.whitened.iloc[0] * want[0, k])
        assert np.abs(mine.whitened.to_numpy() - sign * want[:400, k]).max() < 1e-8 and abs(mine.explained.iloc[0] - e[::-1][k] / e.sum()) < 1e-12
        assert mine.deviation.astype(object).tolist() == [int((r.astype(object) ** 2).sum()) for r in c[:400]]
    one = [(1, [0.5, 0.25], 1, "x")]
    assert whitening.whiten(spark.createDataFrame(one * 3, VECTORS)).count() == 0  # no variance
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    line = [(i, [i / 64, 0.5], 1, "x") for i in range(9)]
    assert [r.component for r in whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()] == [1] * 9  # one direction alone


def test_deviations_beyond_64_bits_are_exact(spark):
    row = spark.createDataFrame([([1_500_000_000_000, -4],)], "y array<long>")
    assert [int(row.select(whitening.deviation(F.col("y"), f).alias("d")).first().d) for f in (False,)] == [1_500_000_000_000**2 + 16]
    assert int(spark.createDataFrame([([3, -4],)], "y array<long>").select(whitening.deviation(F.col("y"), True).alias("d")).first().d) == 25
