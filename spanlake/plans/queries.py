"""Named queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.functions.patterns import CATEGORIES, MODEL_TYPES, PATTERNS, re2
from spanlake.operators import detect as D
from spanlake.operators import geometry as G
from spanlake.operators import merge as M
from spanlake.operators import model as L
from spanlake.operators import pages as P
from spanlake.operators import redact as R
from spanlake.operators import report as S
from spanlake.operators import review as V
from spanlake.operators import verify as Y


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(_docs(spark, sf_dir))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.explode_entities(_found(spark, sf_dir), "doc_id")


# ---- SQL of detection -------------------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches_sql(index: int, source: str, key: str, text: str) -> str:
    category, flags, pattern = PATTERNS[index]
    p = _quoted(re2(pattern, flags))
    return f"""
SELECT {key}, CAST(start_pos AS INTEGER) AS start_pos, {index} AS pattern, CAST(start_pos + length(hit) AS INTEGER) AS end_pos, '{category}' AS category, hit AS text FROM (
  SELECT {key}, i, hits[i] AS hit,
         list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start_pos
  FROM (SELECT {key}, gaps, hits, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT {key}, string_split_regex({text}, {p}) AS gaps, regexp_extract_all({text}, {p}) AS hits FROM {source} WHERE {text} IS NOT NULL AND regexp_matches({text}, {p}))))"""


def candidates_sql(source: str, key: str, text: str) -> str:
    return "\nUNION ALL".join(_matches_sql(i, source, key, text) for i in range(len(PATTERNS)))


def entities_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Common tables `cand` and `ent`; ent has one row for each entity."""
    return f"""cand AS ({candidates_sql(source, key, text)}),
kept AS (
  SELECT {key}, list_reduce(list({{'start_pos': start_pos, 'pattern': pattern, 'end_pos': end_pos, 'category': category, 'text': text}} ORDER BY start_pos, pattern),
    lambda acc, x: CASE WHEN x.start_pos[1] >= acc.end_pos[-1] THEN {{'start_pos': list_concat(acc.start_pos, x.start_pos), 'pattern': list_concat(acc.pattern, x.pattern), 'end_pos': list_concat(acc.end_pos, x.end_pos), 'category': list_concat(acc.category, x.category), 'text': list_concat(acc.text, x.text)}} ELSE acc END) AS k
  FROM (SELECT {key}, [start_pos] AS start_pos, [pattern] AS pattern, [end_pos] AS end_pos, [category] AS category, [text] AS text FROM cand)
  GROUP BY {key}),
ent AS (SELECT {key}, unnest(k.start_pos) AS start_pos, unnest(k.end_pos) AS end_pos, unnest(k.category) AS category, unnest(k.text) AS text, unnest(range(0, len(k.text))) AS ord FROM kept)"""


ENT = "WITH " + entities_sql()
#: Which entities reviewers turned down, in queries that need some: those whose start is divisible by three.
REJECT = "start_pos % 3 = 0"


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).withColumn("accepted", F.col("start_pos") % 3 != 0)


# ---- queries ----------------------------------------------------------------------------------------------------


def pii_counts_by_category(spark, sf_dir):
    return _long(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


def pii_entities(spark, sf_dir):
    return _long(spark, sf_dir).select("doc_id", "start_pos", "end_pos", "category", "text")


def pii_candidates_raw(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(D.candidates(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.start_pos", "e.pattern", "e.end_pos", "e.category", "e.text")


def pii_entities_html(spark, sf_dir):
    pages = D.detect(_table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return D.explode_entities(pages, "page_id").select("page_id", "start_pos", "end_pos", "category", "text")


def pii_entities_conversations(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")
    return D.explode_entities(D.detect(rows), "turn_id").groupBy("category").agg(F.count("*").alias("n"))


def redact_text(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", R.redact(F.col("text"), R.accepted(F.transform("entities", lambda e: e.withField("accepted", F.lit(True))))).alias("redacted"))


def redact_blocks(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", R.redact(F.col("text"), F.col("entities"), "blocks", "compat").alias("redacted"))


def redact_lengths(spark, sf_dir):
    rows = _found(spark, sf_dir).select("doc_id", F.length("text").alias("before"), F.length(R.redact(F.col("text"), F.col("entities"))).alias("after"))
    return rows.select("doc_id", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))


def category_rules_applied(spark, sf_dir):
    rules = F.create_map(F.lit("PHONE"), F.lit(False), F.lit("EMAIL"), F.lit(True))
    return _found(spark, sf_dir).select("doc_id", F.size(R.accepted(F.col("entities"), rules)).cast("long").alias("n_redacted"))


def text_segments(spark, sf_dir):
    # The outer form, as in explode_entities(): a filter on entities would detect them again.
    parts = F.when(F.size("entities") > 0, R.segments(F.col("text"), F.col("entities")))
    rows = _found(spark, sf_dir).select("doc_id", F.posexplode_outer(parts).alias("idx", "s")).where("s is not null")
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "s.text", "s.category")


def report_summary(spark, sf_dir):
    return S.summary(_reviewed(spark, sf_dir))


def report_by_category(spark, sf_dir):
    return S.by_category(_reviewed(spark, sf_dir))


def report_items(spark, sf_dir):
    return S.items(_reviewed(spark, sf_dir), ["doc_id"])


def entity_groups(spark, sf_dir):
    g = S.groups(_reviewed(spark, sf_dir), ["doc_id"])
    return g.withColumn("ids", F.array_join("ids", ","))


def category_groups(spark, sf_dir):
    return S.category_groups(_reviewed(spark, sf_dir), ["doc_id"])


def report_text(spark, sf_dir):
    """Kept with doc_id and the rendered text, at a fixed clock."""
    return S.render(_reviewed(spark, sf_dir), "doc_id", F.lit("2024-01-01 00:00:00"))


def review_log_final_state(spark, sf_dir):
    ents = _long(spark, sf_dir)
    log = ents.where("start_pos % 2 = 0").select("doc_id", "entity_id", F.lit(1).alias("seq"), F.lit(False).alias("accepted"))
    log = log.unionByName(ents.where("start_pos % 4 = 0").select("doc_id", "entity_id", F.lit(2).alias("seq"), F.lit(True).alias("accepted")))
    return V.final_state(ents, log).select("doc_id", "entity_id", "accepted")


def merge_regex_ner(spark, sf_dir):
    """Pattern entities joined by model spans: the first ten characters of every text, and each third pattern span again."""
    model = F.concat(
        F.array(F.struct(F.lit(0).alias("start_pos"), F.least(F.lit(10), F.length("text")).cast("int").alias("end_pos"), F.lit("PERSON").alias("category"), F.substring("text", 1, 10).alias("text"))),
        F.transform(F.filter("entities", lambda e: e["start_pos"] % 3 == 0), lambda e: F.struct(e["start_pos"].alias("start_pos"), e["end_pos"].alias("end_pos"), F.lit("PERSON").alias("category"), e["text"].alias("text"))),
    )
    rows = _found(spark, sf_dir).where("text is not null").select("doc_id", F.explode_outer(M.merge(F.col("entities"), model)).alias("e"))
    return rows.select("doc_id", "e.start_pos", "e.end_pos", "e.category", "e.source")


def leak_scan(spark, sf_dir):
    """Texts without the accepted entities, searched for all that were found (strings of four characters or more)."""
    strings = F.filter(F.transform("entities", lambda e: e["text"]), lambda t: F.length(t) >= 4)
    gone = F.filter("entities", lambda e: e["start_pos"] % 3 != 0)
    rows = _found(spark, sf_dir).select("doc_id", F.explode_outer(Y.leaks(R.redact(F.col("text"), gone).cast("binary"), strings)).alias("l"))
    return rows.where("l is not null").select("doc_id", "l.text", F.col("l.byte_offset").cast("long").alias("byte_offset"))


def chunk_offsets(spark, sf_dir):
    rows = L.chunks(_docs(spark, sf_dir))
    return rows.select("doc_id", F.col("idx").cast("long").alias("chunk_idx"), F.col("offset").cast("long").alias("offset"), F.length("chunk").cast("long").alias("len"))


def llm_type_map(spark, sf_dir):
    kinds = [*MODEL_TYPES, " person ", "email_address", "UNKNOWN", "Phone"]
    rows = spark.createDataFrame([(k,) for k in kinds], "type string")
    return rows.withColumn("category", T.model_category(F.col("type"))).where("category is not null")


RESPONSES = [
    (1, '[{"type":"PERSON","text":"Ann Lee"},{"type":"DATE","text":"x"}]'),
    (2, '```json\n[{"type":"EMAIL","text":"a@b.co"},]\n```'),
    (3, '<think>hm [1]</think>[{"type":"ADDRESS","text":"1 Main St"}, 7, {"type":"PERSON","text":5}, {"text":"no type"}]'),
    (4, "nothing here"),
    (5, '[{"type":"PERSON","text":"cut of'),
    (6, 'Sure: [{"type":"WEIRD","text":"some"}] done'),
]


def llm_parse(spark, sf_dir):
    rows = spark.createDataFrame(RESPONSES, "id int, raw string")
    return rows.select("id", F.explode(L.parse_response(F.col("raw"))).alias("e")).select("id", "e.type", "e.text")


def model_entities(spark, sf_dir):
    """Chunks answered by a stand-in model that names the first two words of each chunk, located in the whole text."""
    return L.detect(_docs(spark, sf_dir), L.FirstWords(2)).select("doc_id", "start_pos", "end_pos", "category", "text", "confidence")


ITEMS = "(VALUES (1,0,0,'Hello',10.0,700.0,12.0,30.0,false),(1,0,1,'World',45.0,700.0,12.0,30.0,true),(1,0,2,'next line',10.0,680.0,12.0,54.0,false),(1,0,3,'far',90.0,680.0,12.0,18.0,false),(1,1,0,'a',10.0,700.0,12.0,6.0,false),(1,1,1,'b',16.5,700.0,12.0,6.0,false),(1,1,2,'c',23.0,700.0,12.0,6.0,false),(2,0,0,'  ',10.0,700.0,0.0,6.0,false)) AS t(doc_id,page_index,item_idx,str,x,y,font_h,width,has_eol)"


def page_texts(spark, sf_dir):
    pages = P.page_text(spark.sql(f"SELECT * FROM {ITEMS}"), ["doc_id", "page_index"])
    return P.page_offsets(pages).select("doc_id", "page_index", "text", F.col("text_start").cast("long").alias("text_start"), F.col("text_end").cast("long").alias("text_end"))


def page_quality(spark, sf_dir):
    """Documents as pages of 612 by 792 points whose items are their words."""
    items = _docs(spark, sf_dir).select("doc_id", F.split("text", " ").alias("strs"))
    q = P.page_quality(F.col("strs"), F.lit(612.0), F.lit(792.0))
    return items.select("doc_id", q.alias("q")).select("doc_id", F.col("q.score").alias("score"), F.col("q.needs_vision").alias("needs_vision"), F.col("q.reason").alias("reason"))


def document_quality(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES (1, 0, 0.5D, false), (1, 1, 0.28D, true), (1, 2, 1.0D, false), (2, 0, 0.91D, false) AS t(doc_id, page_index, score, needs_vision)")
    return P.document_quality(rows)


def entity_page_overlap(spark, sf_dir):
    """Entities on pages of 1,000 characters."""
    pages = _docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / 1000) - 1).cast("int"))).alias("page_index"))
    pages = pages.select("doc_id", "page_index", (F.col("page_index") * 1000).alias("text_start"), ((F.col("page_index") + 1) * 1000).alias("text_end"))
    on = P.entities_on_pages(_long(spark, sf_dir), pages)
    return on.groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))


PAIRS = [("bhuiyan", "bhuicyan"), ("smith", "smith"), ("jon", "john"), ("abc", "xyzw"), ("elizabeth", "elisabet"), ("", "ab")]


def fuzzy_word_match(spark, sf_dir):
    rows = spark.createDataFrame(PAIRS, "word string, other string")
    d = F.levenshtein("word", "other")
    return rows.select("word", "other", d.cast("long").alias("dist"), (d <= L.word_limit(F.col("other"), 0.25)).alias("near"))


BOXES = [(1, 10.0, 5.0, 20.0, 10.0), (1, 31.0, 6.0, 10.0, 12.0), (1, 60.0, 5.0, 5.0, 10.0), (1, 0.0, 40.0, 9.0, 10.0), (2, 1.0, 1.0, 4.0, 4.0), (2, 3.0, 1.0, 1.0, 4.0), (2, 7.0, 1.0, 1.0, 2.0)]


def merge_boxes(spark, sf_dir):
    rows = spark.createDataFrame(BOXES, "id int, x double, y double, width double, height double")
    rows = rows.groupBy("id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("boxes"))
    return rows.select("id", F.explode(G.merge_boxes(F.col("boxes"))).alias("b")).select("id", "b.x", "b.y", "b.width", "b.height")


SPACED = ["C U S T O M E R", "P A G E 1", "A B C", "x A B C D", "A B C Dx", "see D A T E and N A M E S", None]


def spaced_caps_repair(spark, sf_dir):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SPACED)], "id int, text string")
    return rows.select("id", T.repair_spaced_capitals(F.col("text")).alias("repaired"))


LITERALS = [
    "SSN 123-45-6789 and 123 45 6789, 123456789.",
    "Card 4111-1111-1111-1111 or 4111 1111 1111 1111",
    "a@b.com, user+tag@domain.org; .x@y.co 2024-03-15.x@y.co",
    "(555) 123-4567 +1-555-123-4567 555.123.4567 12345-123-4567",
    "01/15/1990 2024-3-05 03-15-90 13/01/2020",
    "January 2, 2026; 15 dec 2024, Sept 3 2020",
    "10 Main St. next 5 days on the way, 4821 NW Evergreen Boulevard; P.O. Box 77 po box 5",
    "",
    "nothing to see",
]


def pii_literal_all_patterns(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(LITERALS)), "id int, text string")
    return D.explode_entities(D.detect(rows), "id").select("id", "start_pos", "end_pos", "category", "text")


def labels_and_names(spark, sf_dir):
    cats = spark.createDataFrame([(c,) for c, _ in CATEGORIES] + [("OTHER",)], "category string").select(F.lit("label").alias("kind"), F.col("category").alias("given"), T.category_label(F.col("category")).alias("got"))
    files = spark.createDataFrame([("a.pdf",), ("b.PDF",), ("c.txt",)], "f string")
    names = [files.select(F.lit(k).alias("kind"), F.col("f").alias("given"), T.output_name(F.col("f"), k).alias("got")) for k in ("pdf", "text", "report")]
    times = spark.createDataFrame([(0.4,), (99.2,), (100.0,), (1549.0,)], "ms double").select(F.lit("time").alias("kind"), F.format_string("%.1f", "ms").alias("given"), T.duration(F.col("ms")).alias("got"))
    out = cats
    for x in [*names, times]:
        out = out.unionByName(x)
    return out


QUERIES = {f.__name__: f for f in (
    pii_counts_by_category, pii_entities, pii_candidates_raw, pii_entities_html, pii_entities_conversations, redact_text, redact_blocks, redact_lengths,
    category_rules_applied, text_segments, report_summary, report_by_category, report_items, entity_groups, category_groups, report_text, review_log_final_state,
    merge_regex_ner, leak_scan, chunk_offsets, llm_type_map, llm_parse, model_entities, page_texts, page_quality, document_quality, entity_page_overlap,
    fuzzy_word_match, merge_boxes, spaced_caps_repair, pii_literal_all_patterns, labels_and_names,
)}

_REVIEWED = "rev AS (SELECT *, NOT (" + REJECT + ") AS accepted, concat_ws('-', doc_id, start_pos, end_pos, category) AS entity_id, trim(lower(text)) AS k FROM ent)"
_REDACTED = """red AS (
  SELECT d.doc_id, CASE WHEN e.s IS NULL THEN d.text ELSE
    array_to_string(list_transform(range(1, len(e.s) + 1), lambda i: substr(d.text, CASE WHEN i = 1 THEN 1 ELSE e.f[i - 1] + 1 END, e.s[i] - CASE WHEN i = 1 THEN 0 ELSE e.f[i - 1] END) || {mark}), '') || substr(d.text, e.f[-1] + 1) END AS redacted, d.text
  FROM documents d LEFT JOIN (SELECT doc_id, list(start_pos ORDER BY ord) AS s, list(end_pos ORDER BY ord) AS f, list(text ORDER BY ord) AS t FROM ent {where} GROUP BY doc_id) e USING (doc_id))"""
_VALUES = lambda rows: "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"

ORACLES = {
    "pii_counts_by_category": f"{ENT} SELECT category, CAST(count(*) AS BIGINT) AS n FROM ent GROUP BY category",
    "pii_entities": f"{ENT} SELECT doc_id, start_pos, end_pos, category, text FROM ent",
    "pii_candidates_raw": candidates_sql("documents", "doc_id", "text"),
    "pii_entities_html": "WITH " + entities_sql("pages", "page_id", "html") + " SELECT page_id, start_pos, end_pos, category, text FROM ent",
    "pii_entities_conversations": "WITH conv AS (SELECT concat_ws('-', conv_id, turn) AS turn_id, text FROM conversations), " + entities_sql("conv", "turn_id", "text") + " SELECT category, CAST(count(*) AS BIGINT) AS n FROM ent GROUP BY category",
    "redact_text": f"{ENT}, {_REDACTED.format(mark=_quoted('[REDACTED]'), where='')} SELECT doc_id, redacted FROM red",
    "redact_blocks": f"{ENT}, {_REDACTED.format(mark='repeat(chr(9608), length(e.t[i]))', where='')} SELECT doc_id, redacted FROM red",
    "redact_lengths": f"{ENT}, {_REDACTED.format(mark=_quoted('[REDACTED]'), where='')} SELECT doc_id, CAST(length(text) AS BIGINT) AS before, CAST(length(redacted) AS BIGINT) AS after FROM red",
    "category_rules_applied": f"{ENT} SELECT d.doc_id, CAST(count(ent.doc_id) FILTER (ent.category <> 'PHONE') AS BIGINT) AS n_redacted FROM documents d LEFT JOIN ent USING (doc_id) GROUP BY d.doc_id",
    "text_segments": f"""{ENT}, b AS (SELECT doc_id, start_pos, end_pos, category, lag(end_pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY ord) AS prev_end, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS back FROM ent),
seg AS (SELECT doc_id, prev_end AS a, start_pos AS z, NULL AS category FROM b WHERE start_pos > prev_end UNION ALL SELECT doc_id, start_pos, end_pos, category FROM b
  UNION ALL SELECT doc_id, end_pos, length(text), NULL FROM b JOIN documents USING (doc_id) WHERE back = 1 AND end_pos < length(text))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS BIGINT) AS idx, substr(text, a + 1, z - a) AS text, category FROM seg JOIN documents USING (doc_id)""",
    "report_summary": f"{ENT}, {_REVIEWED} SELECT CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (accepted) AS BIGINT) AS redacted, CAST(count(*) FILTER (NOT accepted) AS BIGINT) AS kept, CAST(count(*) FILTER (accepted) AS BIGINT) AS by_regex, CAST(0 AS BIGINT) AS by_model FROM rev",
    "report_by_category": f"{ENT}, {_REVIEWED} SELECT category, CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (accepted) AS BIGINT) AS redacted FROM rev GROUP BY category",
    "report_items": f"{ENT}, {_REVIEWED} SELECT doc_id, category, accepted, k AS item, min_by(text, ord) AS text, CAST(count(*) AS BIGINT) AS n FROM rev GROUP BY doc_id, category, accepted, k",
    "entity_groups": f"{ENT}, {_REVIEWED} SELECT doc_id, category, k AS item, min_by(text, ord) AS text, string_agg(entity_id, ',' ORDER BY ord) AS ids, bool_and(accepted) AS all_accepted, bool_and(NOT accepted) AS none_accepted, min_by(entity_id, ord) AS first_id, CAST(1.0 AS DOUBLE) AS confidence FROM rev GROUP BY doc_id, category, k",
    "category_groups": f"{ENT}, {_REVIEWED} SELECT doc_id, category, CAST(count(DISTINCT k) AS BIGINT) AS n_unique, CAST(count(*) AS BIGINT) AS n_total, CASE WHEN bool_and(accepted) THEN 'all' WHEN bool_and(NOT accepted) THEN 'none' ELSE 'mixed' END AS state FROM rev GROUP BY doc_id, category",
    "review_log_final_state": f"{ENT}, {_REVIEWED} SELECT doc_id, entity_id, start_pos % 2 <> 0 OR start_pos % 4 = 0 AS accepted FROM rev",
    "merge_regex_ner": f"{ENT} SELECT doc_id, start_pos, end_pos, category, 'regex' AS source FROM ent UNION ALL SELECT doc_id, 0, CAST(least(10, length(text)) AS INTEGER), 'PERSON', 'ner' FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ent WHERE ent.doc_id = d.doc_id AND start_pos = 0 AND end_pos = least(10, length(d.text)))",
    "leak_scan": f"{ENT}, {_REDACTED.format(mark=_quoted('[REDACTED]'), where='WHERE start_pos % 3 <> 0')}, needle AS (SELECT doc_id, lower(text) AS l, min_by(text, ord) AS text FROM ent WHERE length(text) >= 4 GROUP BY doc_id, lower(text)) SELECT doc_id, needle.text, CAST(octet_length(encode(substr(redacted, 1, CASE WHEN strpos(redacted, needle.text) > 0 THEN strpos(redacted, needle.text) ELSE strpos(lower(redacted), l) END - 1))) AS BIGINT) AS byte_offset FROM red JOIN needle USING (doc_id) WHERE strpos(redacted, needle.text) > 0 OR strpos(lower(redacted), l) > 0",
    "llm_type_map": "SELECT type, category FROM " + _VALUES([(k, v) for k, v in MODEL_TYPES.items()] + [(" person ", "PERSON"), ("email_address", "EMAIL"), ("Phone", "PHONE")]) + " AS t(type, category)",
    "llm_parse": "SELECT id, type, text FROM " + _VALUES([(1, "PERSON", "Ann Lee"), (2, "EMAIL", "a@b.co"), (3, "ADDRESS", "1 Main St"), (6, "WEIRD", "some")]) + " AS t(id, type, text)",
    "page_quality": """WITH i AS (SELECT doc_id, string_split(text, ' ') AS strs FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, coalesce(list_sum(list_transform(strs, lambda s: length(trim(s, E' \\t\\n\\r')))), 0) AS chars, len(list_filter(strs, lambda s: length(trim(s, E' \\t\\n\\r')) = 1)) AS singles, len(list_filter(strs, lambda s: length(trim(s, E' \\t\\n\\r')) > 0)) AS filled FROM i),
r AS (SELECT doc_id, chars, filled, singles / nullif(filled, 0) AS ratio, chars / (CAST(612 AS DOUBLE) * 792 / 1000) AS density FROM c),
s AS (SELECT doc_id, chars, filled, ratio, density, greatest(0, least(1, 1 - (ratio - CAST(0.2 AS DOUBLE)) / CAST(0.4 AS DOUBLE))) * CAST(0.6 AS DOUBLE) + greatest(0, least(1, (density - CAST(0.5 AS DOUBLE)) / CAST(2.5 AS DOUBLE))) * CAST(0.4 AS DOUBLE) AS score FROM r)
SELECT doc_id, CASE WHEN chars = 0 THEN CAST(0 AS DOUBLE) ELSE floor(score * 100 + 0.5) / 100 END AS score, chars = 0 OR score < CAST(0.3 AS DOUBLE) AS needs_vision,
  CASE WHEN chars = 0 THEN 'No readable text' WHEN score >= CAST(0.3 AS DOUBLE) THEN NULL WHEN ratio > 0.6 THEN 'Many single-character items (' || CAST(floor(ratio * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) || '%)' WHEN density < 0.5 THEN 'Sparse text, mostly images' ELSE printf('Poor text (score %.2f)', score) END AS reason FROM s""",
    "document_quality": "SELECT doc_id, score, needs_vision, pages FROM (VALUES (1, CAST(0.59 AS DOUBLE), true, '1'), (2, CAST(0.91 AS DOUBLE), false, '')) AS t(doc_id, score, needs_vision, pages)",
    "entity_page_overlap": f"{ENT}, page AS (SELECT doc_id, CAST(unnest(range(0, GREATEST(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS INTEGER) AS page_index FROM documents) SELECT doc_id, page_index, CAST(count(*) AS BIGINT) AS n FROM ent JOIN page USING (doc_id) WHERE start_pos < (page_index + 1) * 1000 AND end_pos > page_index * 1000 GROUP BY doc_id, page_index",
    "fuzzy_word_match": "SELECT word, other, CAST(levenshtein(word, other) AS BIGINT) AS dist, levenshtein(word, other) <= greatest(2, CAST(ceil(length(other) * 0.25) AS BIGINT)) AS near FROM " + _VALUES(PAIRS) + " AS t(word, other)",
    "pii_literal_all_patterns": "WITH lit AS (SELECT id, text FROM " + _VALUES(list(enumerate(LITERALS))) + " AS t(id, text)), " + entities_sql("lit", "id", "text") + " SELECT id, start_pos, end_pos, category, text FROM ent",
    "labels_and_names": "SELECT kind, given, got FROM " + _VALUES([("label", c, n) for c, n in CATEGORIES] + [("label", "OTHER", "OTHER"), ("pdf", "a.pdf", "a_redacted.pdf"), ("pdf", "b.PDF", "b_redacted.pdf"), ("pdf", "c.txt", "c.txt"), ("text", "a.pdf", "a_redacted.txt"), ("text", "b.PDF", "b_redacted.txt"), ("text", "c.txt", "c.txt"), ("report", "a.pdf", "a_redaction_report.txt"), ("report", "b.PDF", "b_redaction_report.txt"), ("report", "c.txt", "c.txt"), ("time", "0.4", "0ms"), ("time", "99.2", "99ms"), ("time", "100.0", "0.1s"), ("time", "1549.0", "1.5s")]) + " AS t(kind, given, got)",
    "chunk_offsets": r"""WITH RECURSIVE walk AS (
  SELECT doc_id, text, -1 AS chunk_idx, 0 AS pos, 0 AS len, 0 AS nxt, false AS done FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, chunk_idx + 1, nxt, CASE WHEN last THEN n - nxt ELSE brk END, nxt + greatest(brk - 200, brk // 2), last FROM (
    SELECT *, CASE WHEN p1 > 750 THEN p1 WHEN p2 > 750 THEN p2 ELSE 1500 END AS brk FROM (
      SELECT doc_id, text, chunk_idx, nxt, n, last, length(regexp_extract(w, '(?s)^.*[\n.!?]')) AS p1, length(regexp_extract(w, '(?s)^.* ')) AS p2
      FROM (SELECT doc_id, text, chunk_idx, nxt, length(text) AS n, nxt + 1500 >= length(text) AS last, substr(text, nxt + 1, 1500) AS w FROM walk WHERE NOT done))))
SELECT doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, CAST(pos AS BIGINT) AS "offset", CAST(len AS BIGINT) AS len FROM walk WHERE chunk_idx >= 0""",
}
