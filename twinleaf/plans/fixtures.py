"""More registered queries: rules and builders that the given tables hold no text for.

Both engines make the same Chinese and Markdown out of the tables by rule, case by case; the operator
finds what it finds, and the SQL says what each case must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerals import short_column
from ..operators import artifact, assemble, blocks, chunks, glossary, mining, rules
from ..sources import journal


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(cases: Column, *texts) -> Column:
    """The text of a case number."""
    out = F.lit(None).cast("string")
    for i, t in reversed(list(enumerate(texts))):
        out = F.when(cases == i, t if isinstance(t, Column) else F.lit(t)).otherwise(out)
    return out


def _s(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def number_conversions(spark, sf_dir):
    """Numbers that a translation keeps in another form, and some that it loses, over orders."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    n, k, h = F.col("n"), F.col("n") % 100, F.col("n") % 12 + 1
    cn = short_column(k)
    text = _case(n % 8, _s("Chapter ", k), _s("Chapter ", k), _s(k, " percent of it"), _s(n, "0000 people"), _s("at ", h, ":00 we left"), _s(n, " million and ", n, " million"), "open 24/7 at 7", _s("as of 2013.", h, " it was"))
    zh = _case(n % 8, _s("第", cn, "章"), _s("第", cn, "章"), _s("百分之", cn), _s(n, " 万人"), _s(h, " 点我们走了"), _s(n, "00 万"), "全天候", _s("2013 年注 ", h))
    pairs = o.select(n.cast("string").alias("id"), F.when(n % 8 == 0, "heading").otherwise("para").alias("kind"), text.alias("text"), zh.alias("zh"))
    return rules.pair_findings(pairs).select("id", "rule", "detail")


def marks_and_lists(spark, sf_dir):
    """Footnotes, links, list items and mixed terms that translations keep or lose, over orders."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    n = F.col("n")
    text = _case(n % 7, _s("a note [", n, "] here"), _s("a note [", n, "] here"), _s("see [x](http://a/b", n, ")"), _s("see [x](http://a/b", n, ")"), "- a\n- b", "- a\n- b", "the theory")
    zh = _case(n % 7, _s("一个注 [", n, "]"), "一个注", _s("见 http://a/b", n), "见", "- 甲\n- 乙", "- 甲", "中文（Customer 任务 Theory）")
    pairs = o.select(n.cast("string").alias("id"), F.when((n % 7).isin(4, 5), "list").otherwise("para").alias("kind"), text.alias("text"), zh.alias("zh"))
    found = rules.pair_findings(pairs)
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("id_sum"), F.min("detail").alias("least"))


#: surface, a text in which it is no use of the term, and one in which it is.
SENSE_TEXTS = [
    ("fire", "a forest fire on fire", "they fire people"),
    ("job", "Steve Jobs took a new job", "hire a job to do"),
    ("disruptive innovation", "[1.](#n1) *On disruptive innovation*", "a disruptive innovation"),
    ("hire", "hire an accountant", "customers hire it"),
    ("progress", "technological progress", "make progress"),
    ("push", "push it up", "a push of forces"),
    ("pull", "pull it down", "the pull and habit"),
    ("struggle", "they struggle with it", "a struggle of habits"),
    ("lemon", "a Lemon V8 can", "two lemons"),
    ("jobs to be done", "the Jobs to be Done Handbook", "all jobs to be done"),
    ("customer", "Customer Case Research says", "a customer says"),
    ("customer jobs", "Putting Customer Jobs to Work", "all customer jobs"),
    ("needs", "he needs it", "unmet needs grow"),
    ("jtbd play", "JTBD plays a part", "one jtbd play"),
]


def sense_exceptions(spark, sf_dir):
    """Uses of terms with exceptions: each surface with both of its texts, once for each region."""
    said = spark.createDataFrame([(s, u, t) for s, a, b in SENSE_TEXTS for u, t in ((0, a), (1, b))], "surface string, used int, text string")
    regions = _table(spark, sf_dir, "region").select("r_regionkey")
    texts = said.crossJoin(F.broadcast(regions))  # a fixed list of texts
    pairs = texts.select(F.concat_ws("/", F.col("r_regionkey").cast("string"), "surface", F.col("used").cast("string")).alias("id"), F.lit("para").alias("kind"), "text", F.lit("没有").alias("zh"), "surface")
    out = None
    for surface, _, _ in SENSE_TEXTS:  # a glossary of one term each, so that terms within terms don't meet
        senses = spark.createDataFrame([("t", surface, "译", "approved")], "id string, surface string, zh string, status string")
        found = rules.glossary_findings(pairs.where(F.col("surface") == surface), senses).select("block_id", "rule", "detail")
        out = found if out is None else out.unionByName(found)
    return out


def _chapters(spark, sf_dir):
    """Conversations as chapters of a heading and a paragraph, with translations by case."""
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    name = F.col("conv_id").cast("string")
    head = c.select(F.lit("b").alias("book"), name.alias("chapter"), F.lit(1).cast("long").alias("seq"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), _s("# Part ", name).alias("text"), _s("h", name).alias("id"))
    body = c.select(F.lit("b").alias("book"), name.alias("chapter"), F.lit(2).cast("long").alias("seq"), F.lit("para").alias("kind"), F.lit(0).alias("level"), "text", _s("p", name).alias("id"))
    case = F.col("conv_id") % 10
    heads = c.select(_s("h", name).alias("block_id"), _s("第 ", name, " 部").alias("zh"))
    said = c.where(case != 9).select(_s("p", name).alias("block_id"), F.when(case == 7, "譯文體").when(case == 8, "Ж").otherwise("译文").alias("zh"))
    return head.unionByName(body), heads.unionByName(said)


def artifact_rules(spark, sf_dir):
    """All checks of assembled chapters, each spoilt in its own way or left whole."""
    b, said = _chapters(spark, sf_dir)
    made = assemble.assemble(b, said)
    case, md = F.col("chapter").cast("long") % 10, F.col("markdown")
    spoilt = F.when(case == 1, F.replace(md, F.lit("译文"), F.lit("> 译文"))).when(case == 2, F.replace(md, F.lit("译文"), F.lit("")))
    for i, line in {3: "# only english", 4: "# a [b](c) · d", 5: "# # 中 · x", 6: "!Image"}.items():
        spoilt = spoilt.when(case == i, F.concat(md, F.lit(f"\n{line}\n")))
    found = artifact.verify_artifacts(b, said, made.withColumn("markdown", spoilt.otherwise(md)))
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("chapter").cast("long")).alias("chapter_sum"), F.max("block_id").alias("last_block"))


def heuristic_splits(spark, sf_dir):
    """Words whose translations fall into two camps, over orders: a third speak of progress in two ways."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    n = F.col("n")
    text = F.when(n % 3 == 0, "steady progress").otherwise("nothing here")
    zh = F.when(n % 3 != 0, "完全无关").when(n % 6 == 0, "取得进展").otherwise("取得进步")
    aligned = o.select(n.alias("idx"), text.alias("text"), zh.alias("zh"))
    found = mining.translation_splits(aligned, spark.createDataFrame([], "form string"))
    shown = F.array_join(F.transform("variants", lambda x: F.concat_ws(":", x["token"], x["n"].cast("string"))), " ")
    return found.select("surface", "source_blocks", "covered", shown.alias("variants"), F.array_join("examples", " ").alias("examples"))


def _nation_senses(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    return glossary.complete(
        n.select(
            F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("surface"), _s("译", F.col("n_nationkey")).alias("zh"),
            F.array(_s(" ", F.lower("n_name"), " "), F.lit(""), F.col("n_name")).alias("surface_aliases"), F.when(F.col("n_nationkey") % 3 == 0, _s("用", F.col("n_name"))).otherwise("").alias("first_use"),
            _s("a", F.col("n_regionkey")).alias("author"), F.array(F.lit("旧")).alias("forbidden_zh"), F.when(F.col("n_nationkey") % 4 == 0, "candidate").otherwise("approved").alias("status"),
        )
    )


def sense_json(spark, sf_dir):
    """Nations as senses, written as JSON without empty fields and read back."""
    rows = glossary.to_json(_nation_senses(spark, sf_dir))
    back = glossary.from_json(rows)
    return rows.join(back.select("id", "surface", "status"), "id").select("id", "json", "surface", "status")


def first_uses(spark, sf_dir):
    return _nation_senses(spark, sf_dir).select("id", glossary.display_first_use(F.col("first_use"), F.col("zh"), F.col("surface")).alias("shown"), F.array_join(glossary.source_forms(F.col("surface"), F.col("surface_aliases")), "|").alias("forms"))


def known_forms(spark, sf_dir):
    return glossary.known_forms(_nation_senses(spark, sf_dir)).select("form", F.array_join("renderings", "|").alias("renderings"))


def author_glossary(spark, sf_dir):
    """The frozen glossary of two authors, by id."""
    return glossary.freeze(_nation_senses(spark, sf_dir), "geo", ["a1", "a2"]).select("id", "surface", "author", "domain")


def image_targets(spark, sf_dir):
    """Paths of images in pages of five kinds; those that leave their folder have none."""
    p = _table(spark, sf_dir, "pages").select("page_id")
    i = F.col("page_id")
    text = _case(i % 6, _s("![a](./img/", i, ".png)"), _s('x ![a b](<img//', i, '.png> "t")'), _s("![](../", i, ".png)"), _s("![](/abs/", i, ".png)"), _s("![](a\\b\\", i, ".png 'u')"), "no image")
    return p.select("page_id", assemble.image_target(text).alias("path"))


def heading_lines(spark, sf_dir):
    """Headings in both languages, with copied marks, links and chapter numbers."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    n, k = F.col("n"), F.col("n") % 110
    text = _case(n % 3, _s("## Chapter ", k, " [Go](#x", k, ")"), _s("# Part ", k), _s("### End ", k))
    zh = _case(n % 3, _s("# 第", k, "章 [走](#x) ![i](a.png)"), _s("  部 ", k, "  "), "")
    return o.select(n.alias("n"), assemble.heading_line(F.length(F.regexp_extract(text, "^#+", 0)), text, zh).alias("line"))


def selected_chapters(spark, sf_dir):
    """Blocks of two chapters out of conversations as chapters."""
    b, _ = _chapters(spark, sf_dir)
    return blocks.select_chapters(b, ["1", "3"]).select("chapter", "id", "kind")


def latest_translations(spark, sf_dir):
    """Of records of several chunks that hold the same block the latest counts: events by user and kind."""
    e = _table(spark, sf_dir, "events")
    log = e.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("chunk_id"), F.create_map(F.col("user_id").cast("string"), F.concat_ws("#", "event_type", F.col("event_id").cast("string"))).alias("translations"), F.col("event_id").alias("line_no"))
    return journal.translations(journal.last_records(log)).select("block_id", "zh")


def pending_chunks(spark, sf_dir):
    """Chunks of a fresh plan (orders) that the journal (events) hasn't completed."""
    o, e = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "events")
    plan = o.select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.array(F.lit("a")).alias("block_ids"))
    log = e.where("event_type != 'error'").select(F.col("user_id").cast("string").alias("chunk_id"), F.create_map(F.lit("a"), F.lit("z")).alias("translations"), F.lit(1).alias("attempts"), F.create_map().cast("map<string,string>").alias("usage"), F.col("event_id").alias("line_no"))
    state = journal.reconcile(journal.new_state(plan), journal.last_records(log))
    return journal.pending(state).select("chunk_id", "status")


def report_pages(spark, sf_dir):
    """Report pages of customers by nation: a finding for each customer in debt."""
    c = _table(spark, sf_dir, "customer")
    chapter = F.col("c_nationkey").cast("string").alias("chapter")
    found = c.where("c_acctbal < 0").select(chapter, F.col("c_custkey").alias("n"), F.col("c_custkey").cast("string").alias("block_id"), F.lit("debt").alias("rule"), F.lit("a|b\nc").alias("detail"), F.when(F.col("c_custkey") % 2 == 0, "error").otherwise("warning").alias("severity"))
    pages = rules.report_markdown(found, c.select(chapter))
    return pages.select("chapter", "markdown")


def context_turns(spark, sf_dir):
    """Words of conversations as chunks of one turn: oversized ones stand alone and warn."""
    c = _table(spark, sf_dir, "conversations")
    ids = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    b = c.select(F.col("conv_id").cast("string").alias("book"), F.lit("c").alias("chapter"), F.col("turn").cast("long").alias("seq"), F.lit("para").alias("kind"), F.lit(0).alias("level"), "text", ids.alias("id"))
    made = chunks.chunk_document(b, target_words=10, max_words=20)
    return made.groupBy("oversized").agg(F.count("*").alias("chunks"), F.sum("word_count").cast("long").alias("words"), F.sum(F.size("warnings")).cast("long").alias("warnings"))


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    found = (
        number_conversions, marks_and_lists, sense_exceptions, artifact_rules, heuristic_splits, sense_json, first_uses, known_forms, author_glossary,
        image_targets, heading_lines, selected_chapters, latest_translations, pending_chunks, report_pages, context_turns,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL."""
    digits = "'零一二三四五六七八九'"
    tens = f"CASE WHEN k < 20 THEN '' ELSE substr({digits}, k // 10 + 1, 1) END || '十' || CASE WHEN k % 10 = 0 THEN '' ELSE substr({digits}, k % 10 + 1, 1) END"
    texts = ", ".join(f"('{s}', '译')" for s, _, _ in SENSE_TEXTS)
    nations = """n AS (SELECT n_nationkey::VARCHAR AS id, n_name AS surface, '译' || n_nationkey AS zh, lower(n_name) AS low, CASE WHEN n_nationkey % 3 = 0 THEN '用' || n_name ELSE '' END AS first_use,
  'a' || n_regionkey AS author, CASE WHEN n_nationkey % 4 = 0 THEN 'candidate' ELSE 'approved' END AS status FROM nation)"""
    return {
        "number_conversions": """SELECT o_orderkey::VARCHAR AS id, 'numbers' AS rule, CASE o_orderkey % 8 WHEN 1 THEN (o_orderkey % 100)::VARCHAR WHEN 5 THEN o_orderkey::VARCHAR ELSE '7' END AS detail
FROM orders WHERE o_orderkey % 8 IN (1, 5, 6)""",
        "marks_and_lists": """WITH o AS (SELECT o_orderkey AS n, o_orderkey % 7 AS c FROM orders),
f AS (SELECT 'numbers' AS rule, n, n::VARCHAR AS detail FROM o WHERE c = 1 UNION ALL SELECT 'markup', n, '[' || n || ']' FROM o WHERE c = 1 UNION ALL SELECT 'markup', n, 'http://a/b' || n FROM o WHERE c = 3
  UNION ALL SELECT 'structure', n, '2 items, 1 in the translation' FROM o WHERE c = 5 UNION ALL SELECT 'mixed_script_term', n, 'Customer 任务 Theory' FROM o WHERE c = 6)
SELECT rule, count(*) AS n, sum(n)::BIGINT AS id_sum, min(detail) AS least FROM f GROUP BY rule""",
        "sense_exceptions": f"SELECT r_regionkey || '/' || s || '/1' AS block_id, 'glossary' AS rule, s || ' → ' || z AS detail FROM region, (VALUES {texts}) AS v(s, z)",
        "artifact_rules": """WITH c AS (SELECT DISTINCT conv_id FROM conversations), r(k, rule, block) AS (VALUES (1, 'artifact.translation_quote', true), (2, 'artifact.pairing', true), (3, 'artifact.heading', false),
  (4, 'artifact.heading_link', false), (5, 'artifact.heading', false), (5, 'artifact.heading_prefix', false), (6, 'artifact.malformed_image', false), (7, 'artifact.traditional', true), (8, 'artifact.foreign_script', true), (9, 'artifact.missing', false))
SELECT rule, count(*) AS n, sum(conv_id)::BIGINT AS chapter_sum, max(CASE WHEN block THEN 'p' || conv_id ELSE '' END) AS last_block FROM c JOIN r ON conv_id % 10 = k GROUP BY rule""",
        "heuristic_splits": """WITH o AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey % 3 = 0), v AS (SELECT CASE WHEN n % 6 = 0 THEN '进展' ELSE '进步' END AS token, count(*) AS n FROM o GROUP BY 1)
SELECT s AS surface, (SELECT count(*) FROM o) AS source_blocks, (SELECT count(*) FROM o) AS covered, string_agg(token || ':' || v.n, ' ' ORDER BY v.n DESC, token) AS variants, string_agg('取得' || token, ' ' ORDER BY v.n DESC, token) AS examples
FROM v, (VALUES ('steady'), ('progress')) AS w(s) GROUP BY s HAVING count(*) = 2 AND (SELECT count(*) FROM o) >= 12""",
        "sense_json": f"""WITH {nations} SELECT id, '{{"id":"' || id || '","surface":"' || surface || '","zh":"' || zh || '","surface_aliases":[" ' || low || ' ","","' || surface || '"],"author":"' || author || '"'
  || CASE WHEN first_use = '' THEN '' ELSE ',"first_use":"' || first_use || '"' END || ',"forbidden_zh":["旧"],"status":"' || status || '"}}' AS json, surface, status FROM n""",
        "first_uses": f"WITH {nations} SELECT id, CASE WHEN first_use <> '' THEN first_use ELSE zh || '（' || surface || '）' END AS shown, surface || '|' || low AS forms FROM n",
        "known_forms": f"WITH {nations} SELECT low AS form, zh || '|旧' AS renderings FROM n",
        "author_glossary": f"WITH {nations} SELECT id, surface, author, 'geo' AS domain FROM n WHERE status = 'approved' AND author IN ('a1', 'a2')",
        "image_targets": """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'img/' || page_id || '.png' WHEN 1 THEN 'img/' || page_id || '.png' WHEN 4 THEN 'a/b/' || page_id || '.png' END AS path FROM pages""",
        "heading_lines": f"""WITH o AS (SELECT o_orderkey AS n, o_orderkey % 3 AS c, o_orderkey % 110 AS k FROM orders),
z AS (SELECT *, CASE WHEN k BETWEEN 1 AND 9 THEN substr({digits}, k + 1, 1) ELSE {tens} END AS cn FROM o)
SELECT n, CASE c WHEN 0 THEN '## ' || CASE WHEN k BETWEEN 1 AND 99 THEN '第' || cn || '章 走' ELSE '第' || k || '章 走' END || ' · Chapter ' || k || ' Go' WHEN 1 THEN '# 部 ' || k || ' · Part ' || k ELSE '### End ' || k END AS line FROM z""",
        "selected_chapters": """SELECT DISTINCT conv_id::VARCHAR AS chapter, p || conv_id AS id, kind FROM conversations, (VALUES ('h', 'heading'), ('p', 'para')) AS v(p, kind) WHERE conv_id IN (1, 3)""",
        "latest_translations": "SELECT user_id::VARCHAR AS block_id, arg_max(event_type || '#' || event_id, event_id) AS zh FROM events GROUP BY user_id",
        "pending_chunks": "SELECT o_orderkey::VARCHAR AS chunk_id, 'pending' AS status FROM orders WHERE o_orderkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error' AND user_id IS NOT NULL)",
        "report_pages": """WITH f AS (SELECT c_nationkey, c_custkey, c_custkey % 2 = 0 AS e FROM customer WHERE c_acctbal < 0), n AS (SELECT DISTINCT c_nationkey FROM customer),
g AS (SELECT n.c_nationkey, count(c_custkey) FILTER (e) AS errors, count(c_custkey) FILTER (NOT e) AS warnings, string_agg('| ' || CASE WHEN e THEN 'error' ELSE 'warning' END || ' | debt | `' || c_custkey || '` | a\\|b c |', chr(10) ORDER BY c_custkey) AS rows
  FROM n LEFT JOIN f ON f.c_nationkey = n.c_nationkey GROUP BY n.c_nationkey)
SELECT c_nationkey::VARCHAR AS chapter, '# 校验报告 · ' || c_nationkey || chr(10) || chr(10) || '状态：**' || CASE WHEN errors = 0 THEN '通过' ELSE '未通过' END || '** · 错误 ' || errors || ' · 警告 ' || warnings || chr(10) || chr(10)
  || coalesce('| 严重度 | 规则 | 段落 | 详情 |' || chr(10) || '|---|---|---|---|' || chr(10) || rows, '未发现问题。') || chr(10) AS markdown FROM g""",
        "context_turns": """WITH RECURSIVE x AS (SELECT conv_id, len(list_filter(string_split_regex(text, '\\s+'), lambda y: y <> '')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r(conv_id, rn, no, cw, n) AS (SELECT conv_id, rn, 1, CASE WHEN w > 20 THEN 0 ELSE w END, CASE WHEN w > 20 THEN 0 ELSE 1 END FROM x WHERE rn = 1 UNION ALL
  SELECT x.conv_id, x.rn, CASE WHEN x.w > 20 OR r.n = 0 OR r.cw + x.w > 10 THEN r.no + 1 ELSE r.no END, CASE WHEN x.w > 20 THEN 0 WHEN r.n = 0 OR r.cw + x.w > 10 THEN x.w ELSE r.cw + x.w END,
    CASE WHEN x.w > 20 THEN 0 WHEN r.n = 0 OR r.cw + x.w > 10 THEN 1 ELSE r.n + 1 END FROM r JOIN x ON x.conv_id = r.conv_id AND x.rn = r.rn + 1),
m AS (SELECT x.conv_id, no, sum(x.w) AS w, bool_or(x.w > 20) AS big FROM r JOIN x ON x.conv_id = r.conv_id AND x.rn = r.rn GROUP BY x.conv_id, no)
SELECT big AS oversized, count(*) AS chunks, sum(w)::BIGINT AS words, count(*) FILTER (big) AS warnings FROM m GROUP BY big""",
    }
