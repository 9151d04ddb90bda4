"""Near-duplicates by likeness of shingles, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import near_dedup
from twinleaf.llm import likeness as likeness_module
from twinleaf.llm import simhash as simhash_module
from twinleaf.llm.likeness import Bands, components_of, likeness, near_texts, shingle_set, text_hash
from twinleaf.llm.simhash import simhash

from .data import SCHEMA, awkward, documents, empty


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups(texts):
    """Sets of texts that links of likeness 0.8 reach; texts without repeats."""
    sets, seen, out = [plain_shingles(t) for t in texts], set(), []
    for i in range(len(texts)):
        todo, group = [i], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                group.add(x)
                todo += [y for y in range(len(texts)) if 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y])]
        if group:
            out.append({texts[x] for x in group})
    return out


def near_copies(n_groups=12, size=4, words=120, changes=2, seed=4):
    """Texts and copies with some words changed, as (doc_id, text)."""
    r, rows = random.Random(seed), []
    for _ in range(n_groups):
        base = ["".join(r.choices("abcdefghij", k=6)) for _ in range(words)]
        for k in range(size):
            copy = list(base)
            for at in r.sample(range(words), k and (changes if isinstance(changes, int) else r.choice(changes))):
                copy[at] = "".join(r.choices("klmnop", k=6))
            rows.append((len(rows), " ".join(copy)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def survivors(rows):
    """(doc_id, text) of the rows that stay: of each group of texts the one with the smallest id, None last."""
    least = {}
    for i, t in rows:
        key = (i is None, i or 0)
        least[t or ""] = min(least.get(t or "", key), key)
    out = []
    for g in groups(list(least)):
        first = min(least[t] for t in g)
        out.append((None if first[0] else first[1], {t for t in g if least[t] == first}))
    return out


def check(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got, want = kept.select("doc_id", "text").collect(), survivors(rows)
    assert len(got) == len(want)
    for r in got:
        assert any(r["doc_id"] == i and (r["text"] or "") in ts for i, ts in want), r
    return got


def test_near_copies_beyond_three_bits(spark):
    rows = near_copies()
    fps = [simhash(t) for _, t in rows]
    assert any((fps[0] ^ fps[i]).bit_count() > 3 for i in range(1, 4))
    assert len(check(spark, frame(spark, rows))) < len(rows)


def test_a_large_group_is_one(spark):
    rows = near_copies(2, 150)
    assert sorted(r["doc_id"] for r in check(spark, frame(spark, rows))) == [0, 150]


@pytest.mark.parametrize("make", [documents, awkward, empty])
def test_documents(spark, make):
    check(spark, make(spark))


def test_different_texts_under_one_id_stay(spark):
    a, b, c = (t for _, t in near_copies(3, 1))
    for rows in ([(1, a), (5, a), (5, b)], [(5, b), (5, a), (1, a)], [(5, a), (5, b), (1, a), (None, b), (None, c), (None, c)]):
        got = sorted(((r["doc_id"], r["text"]) for r in check(spark, frame(spark, rows))), key=str)
        assert got == sorted({(1, a), (5, b)} | ({(None, c)} if len(rows) > 3 else set()), key=str)


def test_equal_ids_and_texts_are_told_apart_by_their_other_columns(spark):
    rows = [(1, "some text", "en", "b", 9), (1, "some text", "en", "a", 9), (1, "some text", "en", "a", 9)]
    kept = [near_dedup(spark, spark.createDataFrame(x, SCHEMA), "").collect() for x in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 1


@pytest.mark.parametrize("small", [1, 3, 64])
def test_all_levels_find_the_same_components(spark, small):
    """Copies with up to 15 changed words: many pairs are just below 0.8, so stars leave much open."""
    texts = [t for _, t in near_copies(3, 60, changes=(1, 3, 6, 9, 12, 15))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(text_hash(F.col("text")).alias("h"), "text")
    names = {r["h"]: r["text"] for r in df.collect()}
    roots = {r["node"]: r["root"] for r in components_of(df, small=small).collect()}
    found = {}
    for h, t in names.items():
        found.setdefault(roots.get(h, h), set()).add(t)
    want = groups(texts)
    assert 3 < len(want) < len(texts)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want))


def test_bitmaps_leave_near_pairs_and_few_others(spark):
    """A group whose texts are mostly below 0.8 to each other: no near pair goes, hardly any other stays."""
    texts = sorted({t for _, t in near_copies(1, 120, changes=(1, 3, 6, 9))} | {t for _, t in near_copies(1, 12, words=900, changes=30)} | {"a b c d e", "a b c d f"})
    sets = [shingle_set(t) for t in texts]
    near = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if a < b and likeness(sets[a], sets[b]) >= 0.8}
    members = spark.createDataFrame([(i, 0, len(s), likeness_module.bitmap(s), 0, i, -1) for i, s in enumerate(sets)], "h long, fp long, size long, bits array<long>, key long, root long, main long")
    left = {(r["a"], r["b"]) for r in likeness_module._open(members).collect()}
    assert near and near <= left
    short = {(a, b) for a, b in left if max(len(sets[a]), len(sets[b])) < 200}
    assert len(short) < 1.5 * len(near) < len(texts) * len(texts) / 4


def test_later_levels_compare_no_linked_texts_and_carry_no_bitmap_under_each_key(spark, monkeypatch):
    """From the second level on, no compared pair lies in a component that is known, and bitmaps allow each."""
    texts = sorted({t for _, t in near_copies(1, 150, changes=(1, 3, 6, 9, 12))})
    sets = [shingle_set(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "h long, text string")
    near, members, asked, columns = likeness_module._near, likeness_module._members, [], set()

    def counted(pairs, of):
        asked.append([(r["a"], r["b"]) for r in pairs.collect()])
        return near(pairs, of)

    def seen(keyed):
        found = members(keyed)
        columns.update(found.columns)
        return found

    monkeypatch.setattr(likeness_module, "_near", counted)
    monkeypatch.setattr(likeness_module, "_members", seen)
    components_of(df, small=3).count()
    assert columns == {"h", "fp", "key", "n"}
    root = list(range(len(texts)))
    for k, pairs in enumerate(asked):
        if k > 1:  # 0 and 1: the first level
            assert all(root[a] != root[b] for a, b in pairs)
            held = [(set(sets[a].tolist()), set(sets[b].tolist())) for a, b in pairs]
            assert all(len({x % 1024 for x in one} - {x % 1024 for x in two}) <= len(one) - 8 / 18 * (len(one) + len(two)) + 1e-6 for one, two in held)
        for a, b in pairs:
            if likeness(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                root = [root[a] if x == root[b] else x for x in root]
    assert len(asked) > 3 and 1 < len(set(root)) < len(texts)


def test_keys_and_texts_meet_once_on_later_levels(spark, monkeypatch):
    r = random.Random(5)
    keys = {h: r.sample(range(25), 4) for h in range(60)}
    root = {h: h if h % 3 else min(h, 9 * (h // 20)) for h in keys}
    links = [(h, root[h]) for h in keys if root[h] != h]
    met = {h: sum(h in pair for pair in links) for h in keys}
    want = set()
    for key in range(25):
        under = [h for h in keys if key in keys[h]]
        if len({root[h] for h in under}) > 1:
            main = max({root[h] for h in under}, key=lambda x: (sum(root[h] == x for h in under), x))
            star = max((met[h], h) for h in under if root[h] == main)[1]
            want |= {(h, -h, key, len(under), root[h], main, star) for h in under}
    keyed = spark.createDataFrame([(h, -h, ks) for h, ks in keys.items()], "h long, fp long, keys array<long>")
    roots = spark.createDataFrame([(h, x) for h, x in root.items() if x != h or h in root.values() and met[h]], "node long, root long")
    got = likeness_module._parted_at_once(keyed, roots, spark.createDataFrame(links, "a long, b long"))
    assert {tuple(x) for x in got.select("h", "fp", "key", "n", "root", "main", "star").collect()} == want and len(want) > 50

    members, calls = likeness_module._members, []
    monkeypatch.setattr(likeness_module, "_members", lambda keyed: calls.append(1) or members(keyed))
    texts = [t for _, t in near_copies(1, 40, changes=(1, 6, 12))]
    components_of(spark.createDataFrame(list(enumerate(texts)), "h long, text string"), small=1).count()
    assert len(calls) == 1


@pytest.mark.parametrize("changes, small, levels", [((1,) * 9 + (4,), 64, 1), ((1, 4), 4, 2)])
def test_keys_with_few_texts_outside_their_main_component_list_no_more_keys(spark, monkeypatch, changes, small, levels):
    """One large group and some texts just below 0.8 to it: the keys are large, but what is outside is soon compared."""
    texts = sorted({t for _, t in near_copies(1, 150, changes=changes)})
    keyed, parted, listed, sizes = likeness_module._keyed, likeness_module._parted, [], []

    def counted(todo, rows, bands):
        listed.append(todo.count())
        return keyed(todo, rows, bands)

    def seen(members, roots):
        found = parted(members, roots)
        for key, under in {k: [r for r in rows if r["key"] == k] for rows in [found.collect()] for k in {r["key"] for r in rows}}.items():
            outside = sum(r["root"] != r["main"] for r in under)
            assert {(r["n"], r["outside"]) for r in under} == {(len(under), outside)} and outside, key
            sizes.append(len(under))
        return found

    monkeypatch.setattr(likeness_module, "_keyed", counted)
    monkeypatch.setattr(likeness_module, "_parted", seen)
    found = {}
    for r in components_of(spark.createDataFrame(list(enumerate(texts)), "h long, text string"), small=small).collect():
        found.setdefault(r["root"], set()).add(texts[r["node"]])
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups(texts) if len(g) > 1)
    assert max(sizes) > 64 and len(listed) == levels and len(texts) > 100


def test_balls_find_what_keys_miss(spark):
    """One key of 400 least values parts all different sets, so only balls link these texts."""
    texts = [t for _, t in near_copies(4, 4, words=500, changes=1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h long, text string")
    sets, fps = [shingle_set(t) for t in texts], [simhash(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3 and likeness(sets[i], sets[j]) >= 0.8]
    roots = {r["node"]: r["root"] for r in components_of(df, levels=((400, 1),)).collect()}
    assert len(pairs) > 4 and all(roots[i] == roots[j] for i, j in pairs)
    assert all(i // 4 == root // 4 for i, root in roots.items())


def test_likeness_of_sets():
    r = random.Random(3)
    for _ in range(200):
        a, b = ({r.randrange(30) for _ in range(r.randrange(1, 20))} for _ in range(2))
        assert likeness(*(np.array(sorted(x), np.uint64) for x in (a, b))) == len(a & b) / len(a | b)


def test_keys_meet_as_often_as_they_should():
    """Texts of likeness 0.8 nearly always share a key on each level, texts of 0.2 hardly ever."""
    r = random.Random(1)
    for rows, bands in ((4, 20), (8, 64)):
        level, near, far = Bands(rows, bands), 0, 0
        for _ in range(60):
            base = [r.getrandbits(64) for _ in range(180)]
            keys = [set(zip(range(bands), level.keys(np.array(x, np.uint64)))) for x in (base, base[:160] + [r.getrandbits(64) for _ in range(20)], base[:60] + [r.getrandbits(64) for _ in range(120)])]
            near, far = near + bool(keys[0] & keys[1]), far + bool(keys[0] & keys[2])
        assert near >= 59 and far <= 12


def test_shingles_of_long_texts_come_in_parts(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000)) + "\n" + "x" * 5000 + " end here"
    whole = [shingle_set(text).tolist(), simhash(text), simhash(text, 1)]
    monkeypatch.setattr(simhash_module, "PART", 50)
    assert [shingle_set(text).tolist(), simhash(text), simhash(text, 1)] == whole
    assert len(list(simhash_module.shingle_hashes(text, 5))) > 100


def test_groups_have_the_ids_of_their_rows(spark):
    docs = documents(spark)
    rows, found = near_texts(docs)
    assert found.count() == rows.count() == len({t or "" for (t,) in docs.select("text").collect()})
