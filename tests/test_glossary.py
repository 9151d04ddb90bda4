import hashlib
import json

import pytest

from twinleaf.operators import glossary
from twinleaf.sources import files


def frame(spark, *rows):
    return files.senses_frame(spark, list(rows))


def sense(id, surface, zh, **more):
    return {"id": id, "surface": surface, "zh": zh, "status": "approved", **more}


def test_merge(spark):
    g = frame(spark, sense("a", "job", "甲"), sense("b", "push", "乙"))
    d = frame(spark, sense("a", "job", "丙", decision="why"), sense("c", "pull", "丁"))
    b = frame(spark, sense("a", "job", "戊", decision="more"), sense("b", "push", "乙"))
    got = {r["id"]: r for r in glossary.merge_layers(g, d, b).collect()}
    assert (got["a"]["zh"], got["a"]["layer"], got["a"]["overrides"]) == ("戊", "book", ["甲", "丙"])
    assert (got["b"]["layer"], got["b"]["overrides"]) == ("book", []) and got["c"]["layer"] == "domain"
    with pytest.raises(glossary.OverrideWithoutReason, match="a: layer domain"):
        glossary.merge_layers(g, frame(spark, sense("a", "job", "别")), b)


def test_freeze(spark):
    rows = [sense("b", "x", "一", author="A"), sense("a", "y", "二", surface_aliases=["z", "q"]), sense("c", "w", "三", status="candidate"), sense("d", "v", "四", author="B")]
    one, two = glossary.freeze(frame(spark, *rows)).collect(), glossary.freeze(frame(spark, *reversed(rows))).collect()
    assert [r["id"] for r in one] == ["a", "b", "d"] and one == two
    keys = ["id", "surface", "zh", "parent", "author", "first_use", "status"]
    payload = [{**{k: r[k] for k in keys}, **{k: sorted(r[k]) for k in ("surface_aliases", "aliases_zh", "forbidden_zh")}} for r in one]
    blob = json.dumps(payload, ensure_ascii=False, sort_keys=True)
    assert one[0]["version"] == hashlib.sha256(blob.encode()).hexdigest()[:16]
    assert [r["id"] for r in glossary.freeze(frame(spark, *rows), authors=["A"]).collect()] == ["a", "b"]
    changed = [dict(r, definition_zh="说明", evidence=["e"]) for r in rows]
    assert glossary.freeze(frame(spark, *changed)).first()["version"] == one[0]["version"]


@pytest.mark.parametrize("limit", [200, 0])
def test_hits(spark, limit):
    senses = frame(
        spark, sense("job", "job", "任务"), sense("fire", "fire", "解雇"), sense("lemon", "lemon", "柠檬"), sense("jtbd", "jobs to be done", "待办", surface_aliases=["JTBD"]),
        sense("cand", "text", "文", status="candidate"), sense("cpp", "c++ tool", "工具"),
    )
    texts = spark.createDataFrame(
        [(1, "Jobless people"), (2, "Two JOBS here"), (3, "a forest fire"), (4, "They fired him, firing squads"), (5, "Lemon V8 and lemons"), (6, "jobs  to\nbe done text"), (7, "jtbd"), (8, "JTBD!"), (9, "on fire"), (10, "Lemon V8")],
        "n int, text string",
    )
    got = {}
    for r in glossary.hits(texts, senses, ["n"], broadcast_limit=limit).collect():
        got.setdefault(r["n"], []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {2: ["job"], 4: ["fire"], 5: ["lemon"], 6: ["job", "jtbd"], 8: ["jtbd"]}


@pytest.mark.parametrize("limit", [200, 0])
def test_forms_without_words_hit_alike(spark, limit):
    senses = frame(spark, sense("at", "@@", "符"), sense("dash", "— x", "线"), sense("plus", "C++ tool", "具"))
    texts = spark.createDataFrame([(1, "a@@b"), (2, "@@"), (3, "a — x"), (4, "a— xes"), (5, "a c++ tools"), (6, "none")], "n int, text string")
    assert sorted((r["n"], r["id"]) for r in glossary.hits(texts, senses, ["n"], broadcast_limit=limit).collect()) == [(1, "at"), (4, "dash"), (5, "plus")]


def test_forms_and_json(spark):
    s = frame(spark, sense("a", " job ", "任务", surface_aliases=["", "job", "gig"], first_use=""))
    assert s.select(glossary.source_forms(s["surface"], s["surface_aliases"])).first()[0] == ["job", "gig"]
    assert s.select(glossary.display_first_use(s["first_use"], s["zh"], s["surface"])).first()[0] == "任务（ job ）"
    text = glossary.to_json(s).first()["json"]
    assert "parent" not in json.loads(text)
    assert glossary.from_json(glossary.to_json(s)).collect() == s.collect()
    assert glossary.by_id(s, "a")["zh"] == "任务" and glossary.for_surface(s, "JOB").count() == 1
    with pytest.raises(KeyError):
        glossary.by_id(s, "x")


def test_layers_and_snapshot(spark, tmp_path):
    (tmp_path / "domains").mkdir()
    (tmp_path / "global.yaml").write_text("senses:\n- {id: a, surface: x, zh: 一, status: approved, aliases_zh: 单}\n- not a sense\n", encoding="utf-8")
    (tmp_path / "domains" / "d.yaml").write_text("- {id: b, surface: y, zh: 二, status: approved}\n", encoding="utf-8")
    merged = glossary.merge_layers(*files.read_layers(spark, tmp_path, "d", "none"))
    frozen = glossary.freeze(merged, "d")
    version = files.write_snapshot(frozen, tmp_path / "s.yaml", "d")
    again = files.read_snapshot(spark, tmp_path / "s.yaml")
    assert again.first()["version"] == version and [r["id"] for r in again.collect()] == ["a", "b"]
    assert glossary.freeze(again.drop("version", "domain"), "d").first()["version"] == version
