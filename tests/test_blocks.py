import hashlib
import random

import pytest

from twinleaf.operators import blocks, chunks

SAMPLE = """---
title: A Book
source_sha256: abc
extraction_warnings:
  - one
  - two: with colon
---

# The Book

- [One](#one)
- [Two](#two)

# Chapter 1: Start Here!

First paragraph
on two lines.

![alt](images/a.png)

- item one
- item two

> quoted

```python
x = 1

y = 2
```
glued after the fence

# Chapter 1: Start Here!

First paragraph
on two lines.

First   paragraph on two lines.

| a | b |

***

1) numbered
"""


def parse(spark, text, levels=(1,)):
    df = blocks.parse_markdown(spark.createDataFrame([("bk", text)], "book string, src string"), levels)
    return df.orderBy("seq").collect()


def test_sample(spark):
    rows = parse(spark, SAMPLE)
    assert [r["kind"] for r in rows] == "heading toc heading para image list quote code para heading para para table rule list".split()
    assert rows[0]["chapter"] == "the-book" and rows[2]["chapter"] == "chapter-1-start-here" and rows[9]["chapter"] == "chapter-1-start-here-2"
    assert rows[7]["text"] == "```python\nx = 1\n\ny = 2\n```" and rows[8]["text"] == "glued after the fence"
    assert all(bool(r["id"]) == (r["kind"] in blocks.TRANSLATABLE) for r in rows)
    ids = [r["id"] for r in rows if r["id"]]
    assert len(set(ids)) == len(ids)
    want = hashlib.sha256("bk\x00chapter-1-start-here\x00First paragraph on two lines.".encode()).hexdigest()[:8]
    assert rows[3]["id"] == f"bk/chapter-1-start-here/§{want}"


def test_frontmatter(spark):
    split = blocks.split_frontmatter(spark.createDataFrame([("a", SAMPLE), ("b", "no --- here"), ("c", "--- open")], "book string, src string"))
    meta = {r["book"]: r["meta"] for r in blocks.frontmatter(split).collect()}
    assert meta == {"a": {"title": ["A Book"], "source_sha256": ["abc"], "extraction_warnings": ["one", "two: with colon"]}}


def test_ids_are_stable(spark):
    one, two = parse(spark, "# C\n\nsome  text"), parse(spark, "intro\n\n# C\n\nsome\ntext")
    assert one[1]["id"] == two[2]["id"]
    assert parse(spark, "# C\n\nother text")[1]["id"] != one[1]["id"]


@pytest.mark.parametrize(
    "line, kind",
    [
        ("#no space", "para"), ("####### seven", "para"), ("  ## indented", "heading"), ("---", "rule"), ("- - -", "rule"), ("_ _", "para"), ("-not a list", "para"),
        ("12. yes", "list"), ("  > deep", "quote"), ("[a](#b)", "toc"), ("[a](b)", "para"), ("!image", "para"), ("![x](y)", "image"), ("```", "code"), (" | a |", "table"),
    ],
)
def test_kinds(spark, line, kind):
    assert [r["kind"] for r in parse(spark, line)] == [kind]


def test_edges(spark):
    assert parse(spark, "") == [] and parse(spark, " \n\n") == []
    assert [r["text"] for r in parse(spark, "```\nopen\n\nfence")] == ["```\nopen\n\nfence"]
    assert parse(spark, "a")[0]["chapter"] == "front"
    assert [r["chapter"] for r in parse(spark, "# ﬁx\n\n## Two\n\nx", (1, 2))] == ["fix", "two", "two"]
    assert parse(spark, "# !!!")[0]["chapter"] == "untitled"
    with pytest.raises(ValueError):
        parse(spark, "a", (0,))


def test_select_chapters(spark):
    df = blocks.parse_markdown(spark.createDataFrame([("b", SAMPLE)], "book string, src string"))
    assert {r["chapter"] for r in blocks.select_chapters(df, ["the-book"]).collect()} == {"the-book"}
    with pytest.raises(ValueError, match="the-book"):
        blocks.select_chapters(df, ["nope"])


def plain_pack(rows, target=1500, most=1800, tokens=8192, least=600):
    """rows: (words, heading level or 0) -> chunk numbers."""
    out, no, words, held, text = [], 0, 0, 0, False
    estimate = lambda w, n: int(w * 1.8) + 40 * n
    for w, level in rows:
        if w > most or estimate(w, 1) > tokens:
            no += 1
            out.append(no)
            words = held = 0
            text = False
            continue
        if held and ((level == 2 and text and words >= least) or words + w > target or estimate(words + w, held + 1) > tokens):
            words = held = 0
            text = False
        if not held:
            no += 1
        out.append(no)
        words, held, text = words + w, held + 1, text or not level
    return out


def test_packing_by_brute_force(spark):
    r = random.Random(2)
    rows, want = [], {}
    for c in range(60):
        items = [(r.choice([1, 5, 100, 400, 700, 1500, 1501, 1800, 1801, 2500]), r.choice([0, 0, 0, 1, 2])) for _ in range(r.randrange(1, 25))]
        want[f"b{c}"] = plain_pack(items)
        rows += [(f"b{c}", i, "heading" if level else "para", level, "w " * w, "ch", f"b{c}/{i}") for i, (w, level) in enumerate(items)]
    df = spark.createDataFrame(rows, "book string, seq long, kind string, level int, text string, chapter string, id string")
    got = {}
    for x in chunks.pack(df).orderBy("book", "seq").collect():
        got.setdefault(x["book"], []).append(x["chunk_no"])
    assert got == want


def test_chunks(spark):
    text = "# One\n\n" + "\n\n".join(f"{'w ' * 400}{i}" for i in range(8)) + "\n\n# Two\n\nlast"
    df = blocks.parse_markdown(spark.createDataFrame([("b", text)], "book string, src string"))
    got = chunks.chunk_document(df, target_words=1000).orderBy("first_seq").collect()
    assert [x["chunk_id"] for x in got] == ["one/c01", "one/c02", "one/c03", "one/c04", "two/c01"]
    ids = [b["id"] for x in got for b in x["blocks"]]
    assert ids == [r["id"] for r in df.orderBy("seq").collect()]
    assert [len(x["prev_context"]) for x in got] == [0, 2, 2, 2, 0] and [len(x["next_context"]) for x in got] == [1, 1, 1, 0, 0]
    assert got[1]["prev_context"][-1]["id"] == got[0]["blocks"][-1]["id"] and got[0]["next_context"][0]["id"] == got[1]["blocks"][0]["id"]
    s = chunks.summarize(chunks.chunk_document(df, target_words=1000)).first()
    assert s["chunks"] == 5 and s["words"] == sum(x["word_count"] for x in got) and s["oversized"] == 0
    plan = chunks.chunk_plan_hash(chunks.chunk_document(df, target_words=1000)).first()["chunk_plan"]
    import json

    payload = [{"id": x["chunk_id"], "block_ids": [b["id"] for b in x["blocks"]]} for x in got]
    assert plan == hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:16]
