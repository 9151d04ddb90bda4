import json

import pytest

from twinleaf import cli, scaffold
from twinleaf.plans import build
from twinleaf.sources import files, journal, model
from twinleaf.streaming import journal_stream

BOOK = "# Chapter 1\n\nHello world.\n\n# Chapter 2\n\nSecond text here.\n"
PROVIDER = model.Provider("https://api.example.com/v1/", "secret-key-123456", model="m", concurrency=1, max_retries=2, backoff=0)


def reply(zh):
    """A transport that answers every paragraph; zh: function of the source."""

    def transport(url, headers, body, timeout):
        asked = json.loads(body["messages"][-1]["content"])["paragraphs"]
        text = json.dumps({"translations": [{"id": p["id"], "zh": zh(p["en"])} for p in asked]}, ensure_ascii=False)
        return 200, {"content": [{"type": "text", "text": f"Sure:\n```json\n{text}\n```"}], "usage": {"cost": 0.01}}

    return transport


def good(en):
    return {"# Chapter 1": "# 第一章", "# Chapter 2": "第2章"}.get(en, "译文")


def fail(*_):
    raise AssertionError("no call is needed")


def test_build_resume_review(spark, tmp_path):
    source = tmp_path / "my-book.md"
    source.write_text(BOOK, encoding="utf-8")
    args = (spark, str(source), tmp_path / "build", PROVIDER, "style")
    bad = build.build_book(*args, transport=reply(lambda en: "Ж" if "Hello" in en else good(en)))
    assert bad.done == 2 and bad.errors == 1 and not bad.ok and not (bad.folder / "chapters").exists()
    assert bad.book == "mb" and abs(bad.cost - 0.02) < 1e-9

    chunk = json.loads((bad.folder / "chunks.jsonl").read_text(encoding="utf-8").splitlines()[0])
    before = (bad.folder / "translations.jsonl").read_bytes()
    patch = tmp_path / "review.json"
    for wrong in ({"chunks": []}, {"chunks": [{"chunk_id": "nope", "translations": {"a": "b"}}]}, {"chunks": [{"chunk_id": chunk["chunk_id"], "translations": {"other": "b"}}]}, {"chunks": [{"chunk_id": chunk["chunk_id"], "translations": {chunk["block_ids"][1]: "Ж"}}]}):
        patch.write_text(json.dumps(wrong), encoding="utf-8")
        with pytest.raises(build.ReviewRejected):
            build.apply_review(spark, bad.folder, patch)
    assert (bad.folder / "translations.jsonl").read_bytes() == before
    patch.write_text(json.dumps({"reviewer": "r", "chunks": [{"chunk_id": chunk["chunk_id"], "translations": {chunk["block_ids"][1]: "你好，世界。"}}]}), encoding="utf-8")
    assert build.apply_review(spark, bad.folder, patch) == 1

    done = build.build_book(*args, transport=fail)
    assert done.ok and (done.folder / "chapters" / "chapter-1.md").read_text(encoding="utf-8") == "# 第一章 · Chapter 1\n\n> Hello world.\n\n你好，世界。\n"
    with pytest.raises(journal.StaleBuildError, match="style_version"):
        build.build_book(*args[:4], "another style", transport=fail)
    with build.exclusive(tmp_path / "build"), pytest.raises(build.BuildRunning):
        build.build_book(*args, transport=fail)
    assert build.inspect_book(spark, str(source))["chunks"] == 2

    made = spark.createDataFrame([("chapter-1", 1, "# 第一章 · Chapter 1\n"), ("b/x", 2, "no title\n")], "chapter string, first_seq long, markdown string")
    fine = spark.createDataFrame([("a", True)], "chapter string, ok boolean")
    target = files.publish(made, fine, tmp_path / "vault", "Bo/ok", "Title", {"k": "v"})
    assert sorted(p.name for p in target.iterdir()) == ["00 索引.md", "01 第一章.md", "02 B-x.md"] and target.name == "Bo-ok"
    assert "- [[01 第一章|第一章]]" in (target / "00 索引.md").read_text(encoding="utf-8")
    with pytest.raises(FileExistsError):
        files.publish(made, fine, tmp_path / "vault", "Bo/ok", "Title")
    with pytest.raises(files.PublicationBlocked):
        files.publish(made, spark.createDataFrame([("a", False)], "chapter string, ok boolean"), tmp_path / "vault", "x", "Title")


class Client:
    """Translates without a provider; refuses chunks of a chapter."""

    def __init__(self, refuse=""):
        self.refuse = refuse

    def translate_chunk(self, payload):
        if payload["chunk_id"].startswith(self.refuse or "-"):
            raise OSError("refused")
        return {"translations": {p["id"]: good(p["en"]) for p in payload["paragraphs"]}, "usage": {"cost": 0.5}}


def test_a_client_translates_instead_of_the_provider(spark, tmp_path):
    source = tmp_path / "b.md"
    source.write_text(BOOK, encoding="utf-8")
    args = (spark, str(source), tmp_path / "out", PROVIDER, "s")
    first = build.build_book(*args, client=Client("chapter-2"), transport=fail)
    assert first.done == 1 and not first.ok
    assert "refused" in json.loads((first.folder / "state.json").read_text(encoding="utf-8"))["chunks"]["chapter-2/c01"]["error"]
    done = build.build_book(*args, client=Client("chapter-1"), transport=fail)
    assert done.ok and abs(done.cost - 1.0) < 1e-9


def test_finished_chunks_survive_a_crash(spark, tmp_path, monkeypatch):
    source = tmp_path / "b.md"
    source.write_text(BOOK, encoding="utf-8")
    args = (spark, str(source), tmp_path / "out", PROVIDER, "s")
    append, calls = files.append_records, []

    def crash_at_the_second(path, rows):
        calls.append(len(rows))
        if len(calls) == 2:
            raise KeyboardInterrupt
        append(path, rows)

    monkeypatch.setattr(files, "append_records", crash_at_the_second)
    with pytest.raises(KeyboardInterrupt):
        build.build_book(*args, client=Client())
    monkeypatch.setattr(files, "append_records", append)
    assert calls == [1, 1]
    assert build.build_book(*args, client=Client("chapter-1")).ok  # chapter 1 is in the journal and isn't asked for again


@pytest.mark.parametrize("line", ["{no json", "[1]", '{"chunk_id": "c"}', '{"chunk_id": "", "block_ids": ["a"]}'])
def test_manifests_are_checked(tmp_path, line):
    path = tmp_path / "chunks.jsonl"
    path.write_text('{"chunk_id": "a", "block_ids": ["x"]}\n\n' + line + "\n", encoding="utf-8")
    with pytest.raises(build.ReviewRejected, match="chunks.jsonl:3"):
        build.read_manifest(path)


def test_connections_stay_open():
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            seen.append(self.client_address)
            body = self.rfile.read(int(self.headers["content-length"]))
            reply = body if len(seen) != 2 else b"no json"
            self.send_response(200 if len(seen) != 3 else 429)
            self.send_header("content-length", str(len(reply)))
            self.end_headers()
            self.wfile.write(reply)
            if len(seen) == 3:
                self.close_connection = True  # without saying so

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/v1/messages?x=1"
        got = [model.http_transport(url, {"content-type": "application/json"}, {"n": i}, 5) for i in range(4)]
        assert got == [(200, {"n": 0}), (200, {"_raw": "no json"}), (429, {"n": 2}), (200, {"n": 3})]
        assert len(set(seen[:3])) == 1 and seen[3] != seen[0]
    finally:
        server.shutdown()


def test_failed_calls_are_kept_apart(spark, tmp_path):
    source = tmp_path / "b.md"
    source.write_text(BOOK, encoding="utf-8")

    def half(url, headers, body, timeout):
        return (429, {"_raw": "slow"}) if "Hello" in body["messages"][-1]["content"] else reply(good)(url, headers, body, timeout)

    first = build.build_book(spark, str(source), tmp_path / "out", PROVIDER, "s", transport=half)
    assert first.done == 1 and not first.ok
    state = json.loads((first.folder / "state.json").read_text(encoding="utf-8"))["chunks"]
    assert sorted(v["status"] for v in state.values()) == ["done", "failed"] and any("429" in v["error"] for v in state.values())
    assert build.build_book(spark, str(source), tmp_path / "out", PROVIDER, "s", transport=reply(good)).ok


@pytest.mark.parametrize(
    "script, want",
    [
        ([(200, '{"translations":[{"id":"a","zh":"甲"}]}')], (1, [], [])),
        ([(429, ""), (200, 'ok {"translations":[{"id":"a","zh":"甲"},{"id":"b","zh":""}]} done')], (2, [], ["b"])),
        ([(502, ""), (200, '{"translations":[{"id":"a","zh":"说"引号"话"}]}')], (2, [], [])),
        ([(403, None), (200, '{"translations":[]}')], (2, ["a"], [])),
        ([(200, "no json"), (200, "still none")], model.TransientError),
        ([(400, "bad")], model.PermanentError),
        ([(403, "denied")], model.PermanentError),
    ],
)
def test_calls(script, want):
    steps = iter(script)

    def transport(*_):
        status, text = next(steps)
        if status == 200:
            return 200, {"choices": [{"message": {"content": text}}]}
        return status, {"_raw": ""} if text is None else {"error": {"message": text}}

    provider = model.Provider("http://x", "k", protocol="openai", max_retries=2, backoff=0)
    if isinstance(want, type):
        with pytest.raises(want):
            model.call(provider, {}, "c", ["a"], transport)
    else:
        got = model.call(provider, {}, "c", ["a"], transport)
        assert (got["attempts"], got["missing"], got["extra"]) == want


def test_provider():
    assert PROVIDER.endpoint() == "https://api.example.com/v1/messages" and PROVIDER.masked_key() == "secret…3456"
    assert "secret" not in repr(PROVIDER) and "Authorization" in PROVIDER.headers()


def test_journal(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    records = [{"chunk_id": "c1", "translations": {"a": "1", "b": "2"}, "usage": {"cost": "0.5"}, "attempts": 1}, {"chunk_id": "c1", "translations": {"a": "3"}, "usage": {"cost": "x"}, "attempts": 2}, {"chunk_id": "c2", "translations": {"d": "4"}, "usage": {}, "attempts": 1}]
    path.write_text(json.dumps(records[0]), encoding="utf-8")
    files.append_records(path, records[1:])
    last = journal.last_records(journal.read_journal(spark, str(path)))
    assert {r["block_id"]: r["zh"] for r in journal.translations(last).collect()} == {"a": "3", "d": "4"}
    assert journal.total_cost(last).first()["cost"] == 0.0
    plan = spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["d"]), ("c3", ["e"])], "chunk_id string, block_ids array<string>")
    state = journal.new_state(plan).withColumn("status", model.F.when(model.F.col("chunk_id") == "c1", "done").otherwise("pending"))
    got = {r["chunk_id"]: r["status"] for r in journal.reconcile(state, last).collect()}
    assert got == {"c1": "failed", "c2": "done", "c3": "pending"}
    for broken in ("{not json\n", '{"translations": {}}\n'):
        path.write_text(broken, encoding="utf-8")
        with pytest.raises(Exception, match="j.jsonl:1"):
            journal.read_journal(spark, str(path)).collect()


@pytest.mark.parametrize("compact", [1, 2, 20])
def test_stream_equals_batch(spark, tmp_path, compact):
    schema = "chunk_id string, line_no long, status string"
    rows = [(f"c{i % 5}", i, f"s{i}") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert journal_stream.read_view(spark, f"{tmp_path}/view", schema).collect() == []
    q = journal_stream.run_view(stream, f"{tmp_path}/view", f"{tmp_path}/cp", compact=compact)
    q.awaitTermination(120)
    got = sorted(map(tuple, journal_stream.read_view(spark, f"{tmp_path}/view", schema).select("chunk_id", "line_no", "status").collect()))
    bases, batches = (sorted(int(p.name[2:]) for p in (tmp_path / "view" / x).glob("n=*")) for x in ("base", "batch"))
    assert len(bases) <= 2 and (not bases or min(batches, default=99) > bases[0])
    assert got == sorted(map(tuple, journal.last_records(spark.createDataFrame(rows, schema)).collect()))


def test_annotations(spark, tmp_path):
    path = tmp_path / "a.yaml"
    path.write_text("annotations:\n  ./img/a.png:\n    figure: F\n    summary_zh: 意\n    labels:\n    - {en: E, zh: 中}\n", encoding="utf-8")
    assert files.read_annotations(spark, path).first()["path"] == "img/a.png"
    with pytest.raises(ValueError, match="twice"):
        files.read_annotations(spark, path, path)
    for text in ("x: 1", "annotations:\n  ../a.png: {figure: F}", "annotations:\n  a.png: {figure: F, summary_zh: s, labels: []}", "annotations:\n  a.png: {figure: F, summary_zh: s, labels: [{en: E, zh: z}], confidence: 5}"):
        path.write_text(text, encoding="utf-8")
        with pytest.raises(ValueError):
            files.read_annotations(spark, path)


def test_project(tmp_path, capsys):
    assert cli.main(["init", str(tmp_path / "p")]) == 0 and cli.main(["init", str(tmp_path / "p")]) == 2
    assert cli.main(["doctor", "--project-root", str(tmp_path / "p")]) == 2
    (tmp_path / "p" / ".env").write_text("TRANSLATE_BASE_URL=u\nTRANSLATE_API_KEY='topsecret'\nTRANSLATE_MODEL=m\n", encoding="utf-8")
    assert cli.main(["doctor", "--project-root", str(tmp_path / "p")]) == 0
    assert "topsecret" not in capsys.readouterr().out
    assert len(scaffold.doctor(tmp_path / "p")) == 12
