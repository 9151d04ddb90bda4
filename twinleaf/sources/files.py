"""Files on both ends: Markdown books, curated YAML, configuration, and atomic writes.

Books and journals are read by Spark. Glossary layers and annotations are small files that people
edit; the driver reads them into DataFrames with fixed schemas.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, safe_component
from ..operators.glossary import ARRAYS, SENSE, complete

ANNOTATION = "path string, figure string, summary_zh string, labels array<struct<en:string,zh:string>>, confidence string, note_zh string"
#: How sure a transcription may be.
CONFIDENCE = ("高", "中", "低")


class PublicationBlocked(RuntimeError):
    """A check has failed or the target isn't safe; nothing is written."""


def book_slug(path: str) -> str:
    """First letters of the first three words of a file's stem."""
    found = [w[0] for w in re.split(r"[-_\s]+", PurePosixPath(path).stem)[:3] if w]
    return "".join(found).lower() or "book"


def slug_column(path: Column) -> Column:
    """book_slug of a column."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+\\z", ""), "/"), -1)
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")
    first = F.filter(F.slice(F.split(stem, rf"(?:[-_]|{WS})+"), 1, 3), lambda w: w != "")
    slug = F.lower(F.array_join(F.transform(first, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(slug == "", F.lit("book")).otherwise(slug)


def read_markdown(spark, path: str, book: str | None = None) -> DataFrame:
    """book, src, source_sha256 of Markdown files, each read whole and once."""
    raw = spark.read.format("binaryFile").load(path)
    slug = F.lit(book) if book is not None else slug_column(F.url_decode("path"))
    return raw.select(slug.alias("book"), F.decode("content", "UTF-8").alias("src"), F.sha2("content", 256).alias("source_sha256"))


def _yaml(path: Path):
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8")) if path.exists() else None


def senses_frame(spark, rows: list[dict]) -> DataFrame:
    """Senses from dictionaries: unknown keys are ignored, single values become lists where lists
    belong, everything else a string."""
    names = [x.split(" ")[0] for x in SENSE.split(", ")]

    def value(d: dict, name: str):
        v = d.get(name)
        if name in ARRAYS:
            return [str(x) for x in v] if isinstance(v, (list, tuple)) else [] if v is None else [str(v)]
        return None if v is None else str(v)

    return complete(spark.createDataFrame([tuple(value(d, n) for n in names) for d in rows], SENSE))


def read_layer(spark, path) -> DataFrame:
    """A layer with seq: a list of senses, or a mapping with one; a missing or empty file has none."""
    data = _yaml(Path(path)) or []
    rows = data.get("senses") or [] if isinstance(data, dict) else data
    rows = [d for d in rows if isinstance(d, dict)]
    frame = senses_frame(spark, rows)
    order = spark.createDataFrame([(str(d["id"]), i) for i, d in enumerate(rows)], "id string, seq long")
    return frame.join(order.groupBy("id").agg(F.min("seq").alias("seq")), "id") if rows else frame.withColumn("seq", F.lit(0).cast("long"))


def read_layers(spark, root, domain: str, book: str) -> list[DataFrame]:
    """The global, domain and book layers of a glossary folder."""
    root = Path(root)
    return [read_layer(spark, p) for p in (root / "global.yaml", root / "domains" / f"{domain}.yaml", root / "books" / f"{book}.yaml")]


def write_snapshot(frozen: DataFrame, path, domain: str = "", authors: list[str] | None = None) -> str:
    """A frozen glossary as YAML, keys in order, empty fields left out; returns its version."""
    import yaml

    rows = [r.asDict() for r in frozen.toLocalIterator()]
    names = [x.split(" ")[0] for x in SENSE.split(", ")]
    version = rows[0]["version"] if rows else ""
    data = {"version": version, "domain": domain, "senses": [{n: r[n] for n in names if r[n]} for r in rows]} | ({"authors": list(authors)} if authors else {})
    head = f"# Frozen glossary; do not edit.\n# version {version}\n# Change the layers and freeze again.\n"
    write_atomic(path, head + yaml.safe_dump(data, allow_unicode=True, sort_keys=False))
    return version


def read_snapshot(spark, path) -> DataFrame:
    """Senses of a snapshot with version and domain."""
    data = _yaml(Path(path)) or {}
    frame = senses_frame(spark, data.get("senses") or [])
    return frame.withColumn("version", F.lit(str(data.get("version", "")))).withColumn("domain", F.lit(str(data.get("domain", ""))))


def safe_relative(path: str) -> str:
    """A relative path with slashes that stays in its folder, or ValueError."""
    parts = PurePosixPath(path.replace("\\", "/"))
    clean = parts.as_posix().lstrip("./")
    if parts.is_absolute() or ".." in parts.parts or not clean:
        raise ValueError(f"not a safe relative path: {path!r}")
    return clean


def read_annotations(spark, *paths) -> DataFrame:
    """Annotations of images from YAML files; anything missing, empty, unknown or repeated is an
    error that names the path."""
    rows: dict[str, tuple] = {}
    for source in paths:
        data = _yaml(Path(source)) or {}
        if not isinstance(data, dict) or not isinstance(data.get("annotations"), dict):
            raise ValueError(f"{source}: no annotations")
        for raw, item in data["annotations"].items():
            path = safe_relative(str(raw))
            item = item if isinstance(item, dict) else {}
            text = lambda d, k, default="": str(d.get(k, default)).strip()
            labels = [(text(x, "en"), text(x, "zh")) for x in item.get("labels") or [] if isinstance(x, dict)]
            if not text(item, "figure") or not text(item, "summary_zh") or not labels or len(labels) != len(item["labels"]):
                raise ValueError(f"{path}: figure, summary_zh and labels are needed")
            if any(not en or not zh for en, zh in labels) or text(item, "confidence", "高") not in CONFIDENCE:
                raise ValueError(f"{path}: a label or the confidence is wrong")
            if path in rows:
                raise ValueError(f"{path}: annotated twice")
            rows[path] = (path, text(item, "figure"), text(item, "summary_zh"), labels, text(item, "confidence", "高"), text(item, "note_zh"))
    return spark.createDataFrame(list(rows.values()), ANNOTATION)


def read_env(path) -> dict[str, str]:
    """KEY=value lines; blanks, comments and other lines are skipped, quotes stripped."""
    path = Path(path)
    lines = path.read_text(encoding="utf-8").splitlines() if path.is_file() else []
    pairs = (x.partition("=") for x in map(str.strip, lines) if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


def write_atomic(path, text: str | bytes) -> None:
    """Write beside the target, flush to disk, and put it in place in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f"{path.name}.{uuid.uuid4().hex}.tmp")
    with beside.open("wb") as f:
        f.write(text.encode() if isinstance(text, str) else text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def append_records(path, records: list[dict]) -> None:
    """Append JSON lines all together or not at all; a missing newline at the end is made up for."""
    if not records:
        return
    path = Path(path)
    old = path.read_bytes() if path.exists() else b""
    old += b"\n" if old and not old.endswith(b"\n") else b""
    write_atomic(path, old + "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records).encode())


def publication(chapters: DataFrame, title: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """n, file, markdown: numbered chapter files in the order of first_seq, and the index as number 0."""
    from pyspark.sql import Window

    head = F.split(F.regexp_extract("markdown", r"(?m)^#\s+(.+?)\s*$", 1), " · ")
    plain = safe_component(F.initcap(F.replace(F.col("chapter"), F.lit("-"), F.lit(" "))), F.lit("章节"))
    named = F.when(F.get(head, F.lit(0)) == "", plain).otherwise(safe_component(F.trim(F.get(head, F.lit(0))), safe_component(F.col("chapter"), F.lit("章节"))))
    n = F.row_number().over(Window.orderBy("first_seq"))  # chapters of one book
    files = chapters.select(n.alias("n"), named.alias("title"), "markdown").withColumn("stem", F.format_string("%02d %s", "n", "title"))
    links = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "stem", "title"))), lambda x: F.concat(F.lit("- [["), x["stem"], F.lit("|"), x["title"], F.lit("]]"))), "\n")
    facts = "".join(f"\n- **{k}**：{v}" for k, v in (metadata or {}).items())
    index = files.agg(F.concat(F.lit(f"# {title}\n\n## 章节\n\n"), links, F.lit(f"\n\n## 构建信息\n{facts}" if facts else ""), F.lit("\n")).alias("markdown"))
    return files.select("n", F.concat("stem", F.lit(".md")).alias("file"), "markdown").unionByName(index.select(F.lit(0).alias("n"), F.lit("00 索引.md").alias("file"), "markdown"))


def publish(chapters: DataFrame, reports: DataFrame, root, folder: str, title: str, metadata: dict[str, str] | None = None, images=None) -> Path:
    """Write a book's files to a new folder in one step.

    Blocked if any report isn't ok or there is no chapter; an existing folder is never touched."""
    if bad := [r[0] for r in reports.where("NOT ok").select("chapter").take(20)]:
        raise PublicationBlocked("checks have failed: " + ", ".join(map(str, bad)))
    if not chapters.take(1):
        raise PublicationBlocked("there is no chapter")
    spark = chapters.sparkSession
    name = spark.range(1).select(safe_component(F.lit(folder), F.lit("译本"))).first()[0]
    target = Path(root).resolve() / name
    if target.exists():
        raise FileExistsError(target)
    staging = target.with_name(f".{name}-{uuid.uuid4().hex}.tmp")
    try:
        staging.mkdir(parents=True)
        for r in publication(chapters, title, metadata).toLocalIterator():  # one chapter at a time
            (staging / r["file"]).write_text(r["markdown"], encoding="utf-8", newline="\n")
        if images is not None and Path(images).exists():
            shutil.copytree(images, staging / "images")
        os.replace(staging, target)
    except Exception:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return target
