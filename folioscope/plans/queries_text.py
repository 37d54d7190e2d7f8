"""Queries of scans, filters, text functions and chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as fx
from folioscope.operators import chunking, retrieval, sync
from folioscope.plans.tables import NOTES, notes, table
from folioscope.sources import vault

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flat(array) -> F.Column:
    return F.array_join(array, "|")


@query("SELECT user_id, min(epoch_us(ts)) AS modified_us FROM events GROUP BY user_id")
def sources_min_mtime(spark, d):
    own = table(spark, d, "events").select(F.col("user_id").alias("source_path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("modified_at"))
    return sync.stored_sources(own).select(F.col("source_path").alias("user_id"), F.col("modified_at").alias("modified_us"))


@query("SELECT DISTINCT source FROM documents WHERE lang = 'de' ORDER BY source")
def distinct_sources_by_name(spark, d):
    return retrieval.sources_named(table(spark, d, "documents"), "de", "lang", "source").orderBy("source")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def ids_lookup_semi(spark, d):
    ids = table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))
    return retrieval.with_ids(table(spark, d, "documents"), ids, "doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def path_prefix_filter(spark, d):
    return table(spark, d, "documents").where(retrieval.under_path(F.col("source"), "src1")).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE source LIKE 'src_2%'")
def path_like_filter(spark, d):
    return table(spark, d, "documents").where(retrieval.under_path(F.col("source"), "src_2", like=True)).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE list_has_all([lang, source], ['en', 'src3'])")
def tags_all_filter(spark, d):
    own = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return own.where(retrieval.has_all_tags(F.col("tags"), ["en", "src3"])).select("doc_id")


@query(f"WITH {NOTES} SELECT doc_id, source_path FROM notes WHERE list_has_all(tags, ['fr']) AND starts_with(source_path, 'src7/')")
def tags_and_path_filter(spark, d):
    return retrieval.scoped(notes(spark, d), ["fr"], "src7/").select("doc_id", "source_path")


#: Folders in front of paths, by doc_id; SQL that both engines read.
_PATH = "CASE doc_id % 8 WHEN 0 THEN '.git/' WHEN 1 THEN 'project/.git/' WHEN 2 THEN '.' WHEN 3 THEN 'a/.hid/' WHEN 4 THEN 'node_modules/p/' WHEN 5 THEN 'notes/.trash/' WHEN 6 THEN 'x/__pycache__/' ELSE '' END || source_path"


@query(rf"WITH {NOTES} SELECT doc_id, path, NOT regexp_matches(path, '\.git/|\.obsidian/|\.trash/|node_modules/|__pycache__/|\.vault_db/|^\..*') AS allowed FROM (SELECT doc_id, {_PATH} AS path FROM notes)")
def skip_pattern_filter(spark, d):
    rows = notes(spark, d).select("doc_id", F.expr(_PATH).alias("path"))
    return rows.select("doc_id", "path", vault.allowed(F.col("path")).alias("allowed"))


@query(f"WITH {NOTES} SELECT DISTINCT split_part(substr(source_path, 6), '/', 1) || '/' AS entry FROM notes WHERE starts_with(source_path, 'src1/')")
def list_folder(spark, d):
    return vault.folder(notes(spark, d), "src1")


@query(f"WITH {NOTES} SELECT DISTINCT regexp_replace(substr(source_path, 9), '\\.md$', '') AS entry FROM notes WHERE starts_with(source_path, 'src1/en/')")
def list_folder_notes(spark, d):
    return vault.folder(notes(spark, d), "src1/en")


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) || CASE WHEN len(string_split(text, chr(10))) > 4 THEN chr(10) ELSE '' END AS lines FROM documents")
def line_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.line_slice("text", 1, 3).alias("lines"))


@query(rf"WITH {NOTES} SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '{fx.WIKILINK}', 1), lambda x: trim(x) <> ''))), '|') AS links FROM notes")
def wikilinks_extract(spark, d):
    return notes(spark, d).select("doc_id", flat(fx.wikilinks("content")).alias("links"))


@query(rf"WITH {NOTES} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '{fx.HASHTAG}', 1))), '|') AS tags FROM notes")
def hashtags_extract(spark, d):
    return notes(spark, d).select("doc_id", flat(fx.hashtags("content")).alias("tags"))


@query(f"WITH {NOTES} SELECT doc_id, md5(source_path) AS note_id, regexp_extract(source_path, '([^/]+?)(?:\\.md)?$', 1) AS stem FROM notes")
def doc_id_md5(spark, d):
    return notes(spark, d).select("doc_id", fx.note_id("source_path").alias("note_id"), fx.stem("source_path").alias("stem"))


@query("SELECT conv_id, turn, regexp_replace('d_' || conv_id || '_' || turn, '_[^_]*$', '') AS document_id FROM conversations")
def chunk_doc_id(spark, d):
    own = table(spark, d, "conversations")
    return own.select("conv_id", "turn", fx.note_id_of_chunk(F.concat(F.lit("d_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))).alias("document_id"))


_SECTIONS = f"""WITH {NOTES}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS n FROM notes),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{fx.HEADER}') AND n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(min(n) AS INTEGER) AS first_line, string_agg(line, chr(10) ORDER BY n) AS text FROM m GROUP BY doc_id, section"""


@query(_SECTIONS)
def header_sections(spark, d):
    return chunking.header_sections(notes(spark, d), "doc_id")


_PARAGRAPHS = f"""WITH {NOTES}, p AS (SELECT doc_id, unnest(string_split(content, chr(10) || chr(10))) AS text, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) - 1 AS part FROM notes)
SELECT doc_id, CAST(part AS INTEGER) AS part, text, CAST(coalesce(sum(length(text) - length(replace(text, chr(10), '')) + 2) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p"""


@query(_PARAGRAPHS)
def paragraph_split(spark, d):
    return chunking.paragraphs(notes(spark, d), "doc_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM l""")
def line_offsets(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    own = chunking.lines(table(spark, d, "documents"), "doc_id", "text")
    return own.select("doc_id", "line_no", F.coalesce(F.sum(F.length("line") + 1).over(by), F.lit(0)).alias("start_char"))


@query(f"""WITH RECURSIVE {NOTES}, c AS (
  SELECT doc_id, text, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, -1 AS n FROM notes
  UNION ALL SELECT doc_id, text, stop, CASE WHEN stop + 300 >= length(text) THEN length(text)
    WHEN strpos(reverse(substr(text, stop + 2, 299)), ' ') > 0 THEN stop + 1 + 299 - strpos(reverse(substr(text, stop + 2, 299)), ' ') ELSE stop + 300 END, n + 1 FROM c WHERE stop < length(text)),
k AS (SELECT *, substr(text, start + 1, stop - start) AS piece FROM c WHERE n >= 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS position, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS content FROM k WHERE regexp_matches(piece, '\\S')""")
def fixed_chunks(spark, d):
    own = notes(spark, d).select("doc_id", F.col("text").alias("content"))
    return chunking.chunks(own, "fixed", size=300).select("doc_id", "position", "content")


@query()
def semantic_chunks(spark, d):
    return chunking.chunks(notes(spark, d).select("doc_id", "content"), "semantic")


@query(rf"""WITH {NOTES}, l AS (SELECT doc_id, source_path, tags, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS position FROM notes)
SELECT doc_id, CAST(position AS INTEGER) AS position, md5(source_path) || '_' || position AS id,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '{fx.WIKILINK}', 1), lambda x: trim(x) <> ''))), '|') AS links,
  array_to_string(list_sort(list_distinct(list_concat(tags, regexp_extract_all(content, '{fx.HASHTAG}', 1)))), '|') AS all_tags FROM l""")
def chunk_build(spark, d):
    own = notes(spark, d).select("doc_id", "source_path", "tags", F.posexplode(F.split("content", "\n")).alias("position", "content"))
    built = chunking.build(own.withColumnRenamed("tags", "note_tags"), F.col("source_path"), F.col("note_tags"))
    return built.select("doc_id", "position", "id", flat(F.col("outgoing_links")).alias("links"), flat(F.col("tags")).alias("all_tags"))


#: What a model might answer, by doc_id; SQL that both engines read.
_NL = "chr(10)"
_HYDE = f"""CASE doc_id % 7 WHEN 0 THEN 'Here is a passage:' || {_NL} || text WHEN 1 THEN '```text' || {_NL} || text || {_NL} || '```' WHEN 2 THEN 'Certainly! ' || text
  WHEN 3 THEN 'plain `code` and ``` loose ' || text WHEN 4 THEN {_NL} || 'This is it' || {_NL} || 'snippet: x' || {_NL} || text WHEN 5 THEN '  sure, here you are' || {_NL} || 'absolutely, ' || text || ' ' ELSE text END"""
_OPENINGS, _REMARKS = ("|".join(x).replace("'", "''") for x in (fx.OPENINGS, fx.REMARKS))
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH t AS (SELECT doc_id, {_STRIPPED.format(_HYDE)} AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(x, '(?im)^(?:{_OPENINGS})\b.*?\n', '', 'g') AS x FROM t), b AS (SELECT doc_id, {_STRIPPED.format(rf"regexp_replace(x, '(?im)^(?:{_REMARKS})[.,!:\s]*', '', 'g')")} AS x FROM a),
c AS (SELECT doc_id, {_STRIPPED.format(f"CASE WHEN regexp_matches(x, '{fx.FENCE}') THEN regexp_extract(x, '{fx.FENCE}', 1) ELSE replace(x, '```', '') END")} AS x FROM b)
SELECT doc_id, CASE WHEN len(regexp_split_to_array(x, '\s+')) > 120 THEN array_to_string(list_slice(regexp_split_to_array(x, '\s+'), 1, 120), ' ') ELSE x END AS cleaned FROM c""")
def hyde_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.clean_generated(F.expr(_HYDE)).alias("cleaned"))


_TAGS = "'#' || lang || ', ' || source || chr(10) || ' ##t' || doc_id % 9 || ' ,,' || substring(text, 1, 20)"


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace({_TAGS}, chr(10), ','), ','), lambda x: regexp_replace(trim(x), '^#+', '')), lambda x: trim(x) <> ''), '|') AS tags FROM documents""")
def tag_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", flat(fx.parse_tags(F.expr(_TAGS))).alias("tags"))


@query(rf"WITH {NOTES} SELECT doc_id, regexp_replace(content, '(?i)\[\[N7(\|[^\]]+)?\]\]', '[[moved\1]]', 'g') AS content FROM notes WHERE regexp_matches(content, '(?i)\[\[N7(\|[^\]]+)?\]\]')")
def rename_wikilinks(spark, d):
    own = notes(spark, d)
    after = fx.renamed_links("content", "N7", "moved")
    return own.withColumn("after", after).where("after <> content").select("doc_id", F.col("after").alias("content"))


@query("SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS short FROM documents")
def truncate_marker(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.truncated("text", 150).alias("short"))


@query("SELECT lang, count(*) AS files, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY md5(CAST(doc_id AS VARCHAR))) FILTER (WHERE n <= 3) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS n FROM documents) GROUP BY lang")
def folder_sample(spark, d):
    """Three notes of each folder by the order of their hashes."""
    return vault.samples(table(spark, d, "documents"), "lang", "doc_id", 3).select("lang", "files", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'click'")
def json_items_parse(spark, d):
    own = table(spark, d, "events").where("event_type = 'click'")
    return own.select("event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"))


@query("SELECT doc_id, length(text) + 2 * (len(string_split(text, chr(10))) - 1) - (len(string_split(text, chr(10))) - 1) AS joined_length FROM documents")
def joined_lengths(spark, d):
    parts = F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long"))
    return table(spark, d, "documents").select("doc_id", fx.joined_length(parts).cast("long").alias("joined_length"))


_MODEL = """CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '[{"text": "' || lang || '"}, {"text": "' || source || '"}]' WHEN 2 THEN '[{"text": null}, {"text": "x' || doc_id || '"}]' ELSE '' END"""


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN lang || source WHEN 2 THEN 'x' || doc_id ELSE '' END AS answer FROM documents")
def model_text_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.model_text(F.expr(_MODEL)).alias("answer"))
