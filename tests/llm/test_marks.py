import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpus_pipeline import STAGES, run
from twinleaf.llm.components import connected_components
from twinleaf.llm.langid import FILTERS, WIDTHS, WINDOW, ByteConvNet, identify, train, windows_of
from twinleaf.llm.phrases import LEVEL, compare_with_next, fingerprint_documents, likeness, parse, sketches
from twinleaf.llm.quality import judge
from twinleaf.llm.sharding import permuted, shard_documents
from twinleaf.llm.simhash import near_duplicates, simhash

from .data import awkward, documents, empty, texts
from .test_likeness import survivors

SPACE = " \t\n\x0b\x0c\r"


def walked(x, n, seed=42, rounds=8):
    a = int(np.sqrt(n - 1)) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in range(rounds):
            key = (seed * 1_000_003 + (i + 1) * 1_640_531_527) % 2147483647

            def mixed(v, k=key):
                y = (v * 48271 + k) % 2147483647
                return (y * 69621 + (y >> 16)) % 2147483647

            if i % 2 == 0:
                left = (left + mixed(right)) % a
            else:
                right = (right + mixed(left)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 257])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).orderBy("id").select(permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    if n > 1:
        assert got == [walked(i, n) for i in range(n)]


@pytest.mark.parametrize("make", [documents, awkward, empty])
def test_sharding(spark, make):
    docs = make(spark)
    rows = docs.select("doc_id", "text").collect()
    got = shard_documents(docs, 7).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        p = walked(r["row_number"], len(got)) if len(got) > 1 else 0
        assert (r["shard"], r["slot"]) == (p % 7, p // 7)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if slots:
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shard_documents(docs, 7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(5)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 40)], "random": [(r.randrange(60), r.randrange(60)) for _ in range(40)], "none": []}[kind]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(60, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}


def plain_simhash(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


@pytest.mark.parametrize("make", [documents, awkward, empty])
def test_near_duplicates(spark, make):
    docs = make(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_simhash(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    roots = components(len(rows), edges)
    least = {}
    for (i, _), root in zip(rows, roots):
        least[root] = min([x for x in (i, least.get(root)) if x is not None], default=None)
    want = sorted((str(i), f, str(least[root])) for (i, _), f, root in zip(rows, fps, roots))
    got = sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component_id"])) for r in near_duplicates(docs).collect())
    assert got == want


def test_links_at_every_distance(spark):
    from twinleaf.llm.simhash import links

    r = random.Random(9)
    fps = set()
    for _ in range(30):
        base = r.getrandbits(64)
        fps.add(base)
        for distance in (1, 2, 3, 4):
            x = base
            for bit in r.sample(range(64), distance):
                x ^= 1 << bit
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    found = links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)


def test_balls_never_go_through_the_driver(spark):
    """The table of fingerprints is small enough to broadcast, its balls of 131 rows each aren't."""
    from twinleaf.llm.simhash import links

    fps = spark.range(1000).withColumnRenamed("id", "fp")
    plan = links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_simhash_of_nothing():
    assert simhash(None) == simhash("") == simhash(" \n") == 0


SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and then some more words follow here ", "de": "der schnelle braune fuchs springt über den faulen hund und weitere wörter folgen ", "fr": "le renard brun saute par-dessus le chien paresseux et d'autres mots suivent après "}


def speech(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        lang = r.choice(list(SAMPLES))
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(r.choice(words) for _ in range(r.choice([5, 40, 300]))), lang, "s", 0))
    return rows


def test_language(spark):
    rows = speech(500, 1)
    docs = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "", "de", "s", 0), (902, "123 !!", "fr", "s", 0), (903, "²½", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    net = train(docs)
    assert net.classes == sorted(SAMPLES)
    got = {r["row"]["doc_id"]: r for r in identify(docs, net).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 903))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # a text counts to its end
    half = SAMPLES["fr"] * 40
    mixed = spark.createDataFrame([(1, SAMPLES["en"] * 10 + half, None)], "doc_id long, text string, lang string")
    assert identify(mixed, net).first()["lang_pred"] == "fr"


def test_language_reads_nothing_but_text(spark):
    docs = spark.createDataFrame(speech(300, 2), "doc_id long, text string, lang string, source string, n_chars long")
    net = train(docs)
    shuffled = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'xx' AS lang", "'other' AS source")
    a = sorted((r["row"]["doc_id"] - 1000, r["lang_pred"], r["score"]) for r in identify(shuffled, net, keep=["doc_id"]).collect())
    b = sorted((r["row"]["doc_id"], r["lang_pred"], r["score"]) for r in identify(docs, net).collect())
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])


def test_language_without_labels(spark):
    assert train(empty(spark)) is None
    assert identify(empty(spark), None).collect() == []
    assert {r["lang_pred"] for r in identify(awkward(spark), None).collect()} == {"und"}


def test_sketches_depend_on_the_text_alone():
    many = [t or "" for t in texts(80)]
    together = sketches(many)
    for i, t in enumerate(many):
        assert (sketches([t])[0] == together[i]).all()


def test_likeness_follows_shared_text():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    body = " ".join(words)
    moved, other = "some other beginning " + body, " ".join(reversed(words))
    near, far = likeness(sketches([body] * 2), sketches([moved, other]))
    assert near > 0.9 and far < 0.3


@pytest.mark.parametrize("make", [documents, awkward, empty])
def test_phrases_of_documents(spark, make):
    docs = make(spark)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t, 42)) - (1 << 64) * (h >> 63)
    rows = sorted(((i, t or "") for i, t in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1])))
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in compare_with_next(docs).collect()}
    want = set()
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        key = (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        want.add(key)
        if key in got:
            r = got[key]
            own, changed, after = sketches([t, edited, following])[:, None]
            assert r["fingerprint"] == own.tobytes().hex() and r["edited_fingerprint"] == changed.tobytes().hex()
            assert abs(r["near_edited"] - likeness(own, changed)[0]) < 1e-12
    assert set(got) == want
    assert fingerprint_documents(docs).count() == len(rows)


def plain_quality(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("make", [documents, awkward, empty])
def test_quality_counts(spark, make):
    docs = make(spark)
    repeated = spark.createDataFrame([(500, "a b c d e f g h i j k l m n o p. " * 3, "en", "s", 1), (501, "w " * 40, "en", "s", 1), (502, "one two three four five six seven eight nine\n" * 2, "en", "s", 1)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(repeated) if docs.columns[-1] == "n_chars" else docs
    want = sorted((str(i), *plain_quality(t)) for i, t in docs.select("doc_id", "text").collect())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = judge(docs, keep=["doc_id"]).collect()
    assert sorted((str(r["row"]["doc_id"]), *(r[n] for n in names)) for r in got) == want
    assert sorted(map(str, judge(docs, keep=["doc_id"], only_kept=True).collect())) == sorted(str(r) for r in got if r["kept"])
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_verdict(spark):
    good = "This is a plain sentence with enough words to be kept by every single rule. And it goes on for a while longer."
    cases = {1: good, 2: good + "\nHome | About | Contact | Help", 3: "\n".join(f"menu entry {i} without an end" for i in range(9)), 4: good + "\nAccept cookies to use this site.", 5: "a### b$$$ c%%% " * 10 + "."}
    cases[6] = "«Ein Zitat», sagte sie, «und noch eines», und die Rede ging weiter. " + good + " The word copyright stands in a long line."
    cases[7] = good + "\nAlle Rechte vorbehalten."
    got = {r["row"]["doc_id"]: r for r in judge(spark.createDataFrame(list(cases.items()), "doc_id long, text string"), keep=["doc_id"]).collect()}
    assert {i: r["kept"] for i, r in got.items()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True}
    assert got[2]["cleaned_text"] == good == got[4]["cleaned_text"] == got[7]["cleaned_text"]
    assert got[6]["cleaned_text"] == cases[6]


def test_pipeline_by_stages(spark, tmp_path):
    rows = speech(160, 6)
    rows = [(i, t[0].upper() + t[1:] + ".", lang, s, len(t) + 1) for i, t, lang, s, _ in rows]
    rows += [(1000 + i, rows[5][1], "en", "s", 1) for i in range(3)] + [(2000, None, "en", "s", 0), (2001, "12 34", None, "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for _, stage in STAGES[:-1]:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
        assert seen[-1].columns == docs.columns and seen[-1].dtypes == docs.dtypes
    text = {r["doc_id"]: r["text"] for r in seen[1].collect()}
    assert 2000 not in text and 2001 not in text and len(text) >= 160
    kept = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert set(kept) == {i for i, t in text.items() if not plain_quality(t)[5]}
    want = sorted(i for i, _ in survivors(list(kept.items())))
    assert sorted(r["doc_id"] for r in seen[3].collect()) == want
    packed = run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(want)


CLASHING = ("score", "lang_pred", "row", "kept", "n_words", "_w", "cleaned_text", "h", "root", "component_h", "text_hash", "a.b")


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_take_awkward_tables(spark, make):
    docs = make(spark)
    for name in CLASHING:
        docs = docs.withColumn(name, docs["source"]) if name not in docs.columns else docs
    extra = spark.createDataFrame([(i, " ".join(f"word{k}x{i}" for k in range(40)) + ".", "en", "s", 9) for i in (6, 6, 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in [c for c in docs.columns if c not in extra.columns]:
        extra = extra.withColumn(name, extra["source"])
    docs = docs.union(extra.select(*[f"`{c}`" for c in docs.columns])) if make is awkward else docs
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        rows = kept.collect()
        assert all(r["score"] == r["source"] for r in rows) and bool(rows) == (make is awkward), name
    assert bool(STAGES[-1][1](spark, docs, "").collect()) == (make is awkward)


# ---- the network and the parser against plain versions -------------------------------------------


def small_net(seed=3):
    net, r = ByteConvNet(["a", "b", "c"], seed), np.random.default_rng(seed)
    for k in ("b2", "b3", "b4", "out_b"):
        net.p[k] = r.normal(0, 0.1, net.p[k].shape)
    return net


def plain_forward(net, window):
    """Class probabilities of one window, filter by filter and place by place."""
    pooled = []
    for w in WIDTHS:
        for f in range(FILTERS):
            best = -np.inf
            for at in range(len(window) - w + 1):
                z = net.p[f"b{w}"][f] + sum(float(net.p["emb"][window[at + k]] @ net.p[f"w{w}"][k][:, f]) for k in range(w))
                best = max(best, z)
            pooled.append(max(best, 0.0))
    s = np.array(pooled) @ net.p["out"] + net.p["out_b"]
    s = np.exp(s - s.max())
    return s / s.sum()


def test_network_by_plain_convolution():
    net, r = small_net(), np.random.default_rng(1)
    windows = np.concatenate([r.integers(0, 256, (3, WINDOW)).astype(np.uint8), windows_of(b"ab" * 9), windows_of("déjà vu ".encode() * 90)])
    got = net.predict(net.tables(), windows)
    assert np.allclose(got, [plain_forward(net, w) for w in windows], atol=1e-5)


def test_gradient_by_differences():
    net, r = small_net(), np.random.default_rng(2)
    x, y = r.integers(0, 256, (4, 24)).astype(np.uint8), np.array([0, 2, 1, 2])
    loss = lambda: -np.mean([np.log(plain_forward(net, w)[label]) for w, label in zip(x, y)])
    g = net._gradient(x, y)
    for name, values in net.p.items():
        places = [tuple(r.integers(0, n) for n in values.shape) for _ in range(4)]
        if name == "emb":
            places = [(int(x[0, 3]), 1), (int(x[2, 9]), 5), (int(x[3, 20]), 0)]
        for at in places:
            old, step = values[at], 1e-5
            values[at] = old + step
            up = loss()
            values[at] = old - step
            down = loss()
            values[at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 1e-6, (name, at)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1300])
def test_windows_hold_all_bytes(n):
    data = bytes(i % 251 for i in range(n))
    w = windows_of(data)
    assert w.shape == (max(1, -(-n // WINDOW)), WINDOW) and w.tobytes()[:n] == data


def test_score_of_a_document_is_the_weighted_mean_of_its_windows(spark):
    net = small_net()
    texts_ = ["abc", "déjà " * 300, "x" * 512, "yz" * 700]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    for r in identify(docs, net).collect():
        raw = texts_[r["row"]["doc_id"]].encode()
        ws = windows_of(raw)
        weights = np.array([min(WINDOW, len(raw) - WINDOW * k) for k in range(len(ws))], float)
        mean = weights @ np.array([plain_forward(net, w) for w in ws]) / weights.sum()
        assert r["lang_pred"] == net.classes[int(mean.argmax())] and abs(r["score"] - mean.max()) < 1e-5


M64 = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_parse(symbols):
    """One level, symbol by symbol: (name, place of the first symbol) of each phrase."""
    runs = []
    for i, x in enumerate(symbols):
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1, i])
    merged = [x if n == 1 else plain_mix(x ^ (n * 0x9E3779B97F4A7C15 & M64)) for x, n, _ in runs]
    labels = merged
    for _ in range(4):
        tossed = []
        for i, x in enumerate(labels):
            diff = x ^ labels[i - 1] if i else 1
            low = (diff & -diff).bit_length() - 1
            tossed.append(2 * low + (x >> low & 1))
        labels = tossed
    starts = [i for i in range(len(merged)) if i == 0 or (0 < i < len(merged) - 1 and labels[i - 1] < labels[i] > labels[i + 1])]
    out = []
    for a, b in zip(starts, [*starts[1:], len(merged)]):
        total = sum(plain_mix((merged[k] + (k - a) * 0xD6E8FEB86659FD93) & M64) for k in range(a, b))
        out.append((plain_mix((total + b - a) & M64), runs[a][2]))
    return out


def plain_sketch(text):
    best, symbols, level = {}, [ord(c) for c in text], 0
    while symbols:
        names = [n for n, _ in plain_parse(symbols)]
        level += 1
        if level >= LEVEL or len(names) == 1:
            for n in names:
                key = plain_mix(n ^ 0x2545F4914F6CDD1D)
                best[key >> 58] = min(best.get(key >> 58, M64), key & 0xFFFFFFFFFFFF)
        if len(names) == 1:
            break
        symbols = names
    return [(best[k] & 0xFFFF) | 1 if k in best else 0 for k in range(64)]


def test_fingerprints_by_a_plain_parser():
    many = [t or "" for t in texts(70)] + ["aaaa", "abababab" * 20, "\\U0001f600é" * 9, "x"]
    assert sketches(many).tolist() == [plain_sketch(t) for t in many]


@pytest.mark.parametrize("level, margin", [(1, 16), (2, 90)])
def test_equal_substrings_have_equal_phrases_inside(level, margin):
    r = random.Random(7)
    shared = "".join(r.choice("abcdefgh ") for _ in range(500))
    inside = []
    for offset in range(0, 60):
        text = "".join(r.choice("ijklmn ") for _ in range(offset)) + shared + "".join(r.choice("abij ") for _ in range(r.randrange(80)))
        symbols, places = [ord(c) for c in text], list(range(len(text)))
        for _ in range(level):
            found = plain_parse(symbols)
            symbols, places = [n for n, _ in found], [places[i] for _, i in found]
        inside.append({(n, p - offset) for n, p in zip(symbols, places) if margin <= p - offset < 500 - margin})
        one = np.array([ord(c) for c in text], np.uint64)
        first = np.zeros(1, np.int64)
        for _ in range(level):
            one, first = parse(one, first)
        assert one.tolist() == symbols
    assert len(inside[0]) > 20 and all(x == inside[0] for x in inside)
