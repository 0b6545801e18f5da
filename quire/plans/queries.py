"""Every operator applied to a binding, and SQL for the same rows written from the operator's meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import constants as C
from quire.functions import text as T
from quire.operators import cleaning, compare, draw, estimate, place, provider, run, sections, verify
from quire.plans import bindings as B
from quire.plans.bindings import sql_lines, sql_norm, sql_strip, sql_words
from quire.sources import files
from quire.sources.store import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Notes a page that the queries ask for.
QPP = 1


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def flat(flags: str = "validation_flags"):
    return F.array_join(flags, ",").alias(flags)


# ---- paths and text

PATHS = "paths AS (SELECT page_id, 'out/' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' || page_id || ['.PDF', '.epub', '.txt', '.docx', ''][page_id % 5 + 1] AS path FROM pages)"


def _paths(spark, d):
    ext = F.element_at(F.array(*map(F.lit, [".PDF", ".epub", ".txt", ".docx", ""])), (F.col("page_id") % 5 + 1).cast("int"))
    return B.table(spark, d, "pages").select("page_id", F.concat(F.lit("out/"), F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit("/"), F.col("page_id").cast("string"), ext).alias("path"))


@query("detect_format", f"WITH {PATHS} SELECT page_id, CASE WHEN e IN ('.pdf', '.epub', '.mobi', '.txt', '.azw', '.azw3') THEN e END AS format FROM (SELECT page_id, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS e FROM paths)")
def detect_format(spark, d):
    return _paths(spark, d).select("page_id", files.detect_format(F.col("path")).alias("format"))


STEM = "regexp_replace(split_part(path, '/', -1), '([^.])\\.[^.]*$', '\\1')"


@query("book_stem", f"WITH {PATHS} SELECT page_id, {STEM} AS stem FROM paths")
def book_stem(spark, d):
    return _paths(spark, d).select("page_id", T.book_stem("path").alias("stem"))


@query("output_paths", f"""WITH {PATHS}, s AS (SELECT page_id, regexp_replace(path, '[^/]*$', '') AS root, {STEM} AS stem, lpad((page_id % 30)::VARCHAR, 2, '0') AS ch FROM paths)
SELECT page_id, root || stem || '_notes/json/' || stem || '_ch' || ch || '.json' AS chapter_json, root || stem || '_notes/csv/' || stem || '_ch' || ch || '.csv' AS chapter_csv,
  root || stem || '_notes/' || stem || '_master.json' AS master_json, root || stem || '_notes/' || stem || '_master.csv' AS master_csv,
  root || stem || '_notes/' || stem || '_highlighted.pdf' AS highlighted, root || stem || '_notes/logs/' || stem || '_ch' || ch || '_failed_2.txt' AS failed FROM s""")
def output_paths(spark, d):
    return _paths(spark, d).select("page_id", files.output_paths(F.col("path"), F.col("page_id") % 30, F.lit(2)).alias("o")).select("page_id", "o.*")


def _documents(spark, d):
    return B.table(spark, d, "documents")


@query("clean_text", f"SELECT doc_id, {sql_strip("regexp_replace(replace(text, '.', chr(10) || chr(10) || chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS clean FROM documents")
def clean_text(spark, d):
    return _documents(spark, d).select("doc_id", T.clean_text(F.replace("text", F.lit("."), F.lit("\n\n\n"))).alias("clean"))


@query("normalize_whitespace", f"SELECT doc_id, {sql_norm('text')} AS plain FROM documents")
def normalize_whitespace(spark, d):
    return _documents(spark, d).select("doc_id", T.normalize_whitespace("text").alias("plain"))


@query("normalize_quote", f"SELECT doc_id, replace(lower({sql_norm('text')}), 'ß', 'ss') AS quote FROM documents")
def normalize_quote(spark, d):
    return _documents(spark, d).select("doc_id", T.normalize_quote("text").alias("quote"))


@query("tokenize", f"SELECT doc_id, ({sql_words('text')})::INTEGER AS n, md5({sql_norm('text')}) AS words FROM documents")
def tokenize(spark, d):
    return _documents(spark, d).select("doc_id", F.size(T.tokenize("text")).alias("n"), F.md5(F.array_join(T.tokenize("text"), " ")).alias("words"))


@query("preview", "SELECT doc_id, CASE WHEN length(text) <= 72 THEN text ELSE text[:69] || '...' END AS short, CASE WHEN length(text) <= 28 THEN text ELSE text[:25] || '...' END AS title FROM documents")
def preview(spark, d):
    return _documents(spark, d).select("doc_id", T.preview("text").alias("short"), T.preview("text", 28).alias("title"))


@query("field_key", "SELECT doc_id, replace(replace(replace(lower(text[:60]), 'ß', 'ss'), ' ', ''), '_', '') AS k FROM documents")
def field_key(spark, d):
    return _documents(spark, d).select("doc_id", T.field_key(F.substring("text", 1, 60)).alias("k"))


@query("field_key_whole", "SELECT doc_id, replace(replace(replace(lower(text), 'ß', 'ss'), ' ', ''), '_', '') AS k FROM documents")
def field_key_whole(spark, d):
    return _documents(spark, d).select("doc_id", T.field_key("text").alias("k"))


ODD = "'“' || replace(replace(text[:40], 'e', '’'), 'fi', 'ﬁ') || '— ' || chr(160) || '” '"


def _variants_sql() -> str:
    some = [f"[q, {sql_strip('q')}, {sql_norm('q')}]"]
    for sign, plain in C.SUBSTITUTIONS:
        quoted = plain.replace("'", "''")
        new = f"replace(q, '{sign}', '{quoted}')"
        some.append(f"CASE WHEN contains(q, '{sign}') THEN [{new}, {sql_norm(new)}] ELSE [] END")
    return f"list_filter(flatten([{', '.join(some)}]), lambda x: x <> '')"


@query("quote_variants", f"WITH q AS (SELECT doc_id, {ODD} AS q FROM documents), v AS (SELECT doc_id, {_variants_sql()} AS v FROM q), u AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY doc_id, x) SELECT doc_id, string_agg(x, '|' ORDER BY i) AS variants, count(*)::INTEGER AS n FROM f GROUP BY doc_id")
def quote_variants(spark, d):
    changed = F.replace(F.replace(F.substring("text", 1, 40), F.lit("e"), F.lit("’")), F.lit("fi"), F.lit("ﬁ"))
    quote = F.concat(F.lit("“"), changed, F.lit("—  ” "))
    found = _documents(spark, d).select("doc_id", T.quote_variants(quote).alias("v"))
    return found.select("doc_id", F.array_join("v", "|").alias("variants"), F.size("v").alias("n"))


ODD_WHOLE = ODD.replace("text[:40]", "text")


@query("quote_variants_whole", f"WITH q AS (SELECT doc_id, {ODD_WHOLE} AS q FROM documents), v AS (SELECT doc_id, {_variants_sql()} AS v FROM q), u AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY doc_id, x) SELECT doc_id, md5(string_agg(x, '|' ORDER BY i)) AS variants, count(*)::INTEGER AS n FROM f GROUP BY doc_id")
def quote_variants_whole(spark, d):
    changed = F.replace(F.replace("text", F.lit("e"), F.lit("’")), F.lit("fi"), F.lit("ﬁ"))
    quote = F.concat(F.lit("“"), changed, F.lit("— \u00a0” "))
    found = _documents(spark, d).select("doc_id", T.quote_variants(quote).alias("v"))
    return found.select("doc_id", F.md5(F.array_join("v", "|")).alias("variants"), F.size("v").alias("n"))


COLORS = "colors AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '255, 235, 59' WHEN 1 THEN '1,0.92,0.23' WHEN 2 THEN '1,2' WHEN 3 THEN 'a,b,c' WHEN 4 THEN '300,1,1' ELSE '0.5, 0, ' || event_id % 7 END AS c FROM events)"


@query("parse_color", f"""WITH {COLORS}, p AS (SELECT event_id, list_transform(string_split(c, ','), lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS p FROM colors),
s AS (SELECT event_id, len(p) AS n, len(list_filter(p, lambda x: x IS NULL)) AS bad, CASE WHEN len(list_filter(p, lambda x: x > 1)) > 0 THEN list_transform(p, lambda x: x / 255) ELSE p END AS p FROM p)
SELECT event_id, round(p[1], 6) AS r, round(p[2], 6) AS g, round(p[3], 6) AS b FROM (SELECT event_id, CASE WHEN n = 3 AND bad = 0 AND len(list_filter(p, lambda x: x < 0 OR x > 1)) = 0 THEN p END AS p FROM s)""")
def parse_color(spark, d):
    e = F.col("event_id")
    text = F.when(e % 6 == 0, "255, 235, 59").when(e % 6 == 1, "1,0.92,0.23").when(e % 6 == 2, "1,2").when(e % 6 == 3, "a,b,c").when(e % 6 == 4, "300,1,1").otherwise(F.concat(F.lit("0.5, 0, "), (e % 7).cast("string")))
    rgb = B.table(spark, d, "events").select("event_id", T.parse_color(text).alias("p"))
    return rgb.select("event_id", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate("rgb")])


@query("coerce_page", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN (event_id % 1000)::INTEGER END AS page FROM events")
def coerce_page(spark, d):
    e = F.col("event_id")
    n = (e % 1000).cast("string")
    raw = F.when(e % 5 == 0, n).when(e % 5 == 1, F.concat(F.lit(" "), n, F.lit("\n"))).when(e % 5 == 2, F.concat(F.lit("0"), n)).when(e % 5 == 3, F.concat(n, F.lit("x"))).otherwise(F.lit(""))
    return B.table(spark, d, "events").select("event_id", T.coerce_page(raw).alias("page"))


# ---- pages, headers and footers

REPEATING = f"""held AS (SELECT book, page, list_filter(list_transform({sql_lines('text')}, lambda x: {sql_norm('x')}), lambda x: x <> '') AS h FROM doc),
ends AS (SELECT book, 'head' AS place, unnest(h[:2]) AS line FROM held UNION ALL SELECT book, 'foot', unnest(h[greatest(len(h) - 1, 1):]) FROM held),
doc_books AS (SELECT book, count(*) AS n FROM doc GROUP BY book),
repeating AS (SELECT DISTINCT book, line FROM (SELECT book, place, line, count(*) AS c FROM ends GROUP BY ALL) JOIN doc_books USING (book) WHERE n >= 2 AND c >= greatest(2, floor(n * 0.30::DOUBLE)) AND length(line) >= 3)"""


@query("scan_pages", f"WITH {B.CONV} SELECT book, page, CASE WHEN {sql_strip('raw')} = '' THEN '[NO TEXT FOUND]' ELSE {sql_strip("regexp_replace(raw, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} END AS text FROM (SELECT book, page, CASE WHEN (book + page) % 7 = 0 THEN ' ' || chr(10) ELSE replace(text, chr(10), chr(10) || chr(10) || chr(10)) END AS raw FROM conv)")
def scan_pages(spark, d):
    raw = F.when((F.col("book") + F.col("page")) % 7 == 0, " \n").otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n\n")))
    return cleaning.scan_pages(B.conv_pages(spark, d).select("book", "page", raw.alias("raw_text"))).select("book", "page", "text")


@query("repeating_lines", f"WITH {B.DOC}, {REPEATING} SELECT book, line FROM repeating")
def repeating_lines(spark, d):
    return cleaning.repeating_lines(B.doc_pages(spark, d))


@query("strip_headers_footers", f"""WITH {B.DOC}, {REPEATING}, one AS (SELECT book, page, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT book, page, {sql_lines('text')} AS l FROM doc WHERE book IN (SELECT book FROM repeating))),
left_over AS (SELECT book, page, string_agg(line, chr(10) ORDER BY i) AS t FROM one o WHERE NOT EXISTS (SELECT 1 FROM repeating r WHERE r.book = o.book AND r.line = {sql_norm('o.line')}) GROUP BY book, page)
SELECT d.book, d.page, CASE WHEN d.book IN (SELECT book FROM repeating) THEN {sql_strip("regexp_replace(coalesce(t, ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} ELSE {sql_strip('d.text')} END AS stripped FROM doc d LEFT JOIN left_over USING (book, page)""")
def strip_headers_footers(spark, d):
    return cleaning.strip_headers_footers(B.doc_pages(spark, d)).select("book", "page", "stripped")


def _conv_numbered(spark, d):
    pages = B.conv_pages(spark, d)
    return pages, B.conv_sections(pages).withColumnRenamed("chapter_number", "number").withColumn("title", F.lit("All"))


@query("chapter_text", f"WITH {B.CONV} SELECT book, 1::BIGINT AS number, count(*) AS n_pages, sum(length(text))::BIGINT AS chars, md5(string_agg('=== PAGE ' || page || ' ===' || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY page)) AS text FROM conv GROUP BY book")
def chapter_text(spark, d):
    return cleaning.chapter_text(*_conv_numbered(spark, d)).withColumn("text", F.md5("text"))


@query("chapter_char_count", f"WITH {B.CONV} SELECT book, sum(length(text))::BIGINT AS chars FROM conv GROUP BY book")
def chapter_char_count(spark, d):
    return cleaning.chapter_text(*_conv_numbered(spark, d)).select("book", "chars")


@query("chapter_page_count", f"WITH {B.CONV} SELECT book, end_page - start_page + 1 AS pages FROM conv_sec")
def chapter_page_count(spark, d):
    return _conv_numbered(spark, d)[1].select("book", (F.col("end_page") - F.col("start_page") + 1).alias("pages"))


@query("get_page_text", f"WITH {B.CONV} SELECT c.book, c.page + 2 AS page, coalesce(n.text, '') AS text FROM conv c LEFT JOIN conv n ON n.book = c.book AND n.page = c.page + 2")
def get_page_text(spark, d):
    pages = B.conv_pages(spark, d)
    return sections.get_page_text(pages.select("book", (F.col("page") + 2).alias("page")), pages)


# ---- sections

CHAPTER_SQL = f"list_filter(list_transform({sql_lines('text')}, lambda x: {sql_strip('x')}), lambda x: x <> '' AND length(x) <= 80 AND regexp_matches(x, '(?i)^((chapter|part)\\s+[\\pL\\pN_]+|([0-9]+\\.\\s*)?chapter\\s+[0-9]+)'))[1]"
ARTICLE_SQL = f"""list_filter(list_filter(list_transform({sql_lines('text')}, lambda x: {sql_strip('x')}), lambda x: x <> '')[:6], lambda x: length(x) <= 80 AND (
  regexp_full_match(x, '(?i)([0-9]+(\\.[0-9]+)*\\.?\\s+)?({'|'.join(C.SECTION_NAMES)})') OR
  (length(x) >= 8 AND {sql_words('x')} <= 8 AND regexp_full_match(x, '[0-9]+(\\.[0-9]+){{0,3}}\\.?\\s+[A-Z][A-Za-z0-9][A-Za-z0-9,''’\\- ]{{1,70}}'))))[1]"""


@query("heading_regex", f"WITH {B.HEAD} SELECT book, page, {CHAPTER_SQL} AS title FROM head")
def heading_regex(spark, d):
    return B.head_pages(spark, d).select("book", "page", sections.heading_regex("text").alias("title"))


@query("heading_article", f"WITH {B.HEAD} SELECT book, page, {ARTICLE_SQL} AS title FROM head")
def heading_article(spark, d):
    return B.head_pages(spark, d).select("book", "page", sections.heading_article("text").alias("title"))


LAYOUT = f"layout AS (SELECT book, page, arg_min(line, block_ix) AS title FROM (SELECT book, page, block_ix, {sql_strip('line')} AS line FROM blocks WHERE 60 + 16 * block_ix < 0.35 * 792 AND block_ix = 0) WHERE line <> '' AND {sql_words('line')} <= 8 AND NOT regexp_matches(line, '[.!?,;:]') GROUP BY ALL)"


@query("heading_layout", f"WITH {B.HEAD}, {B.BLOCKS}, {LAYOUT} SELECT book, page, title FROM layout")
def heading_layout(spark, d):
    return sections.heading_layout(B.blocks(spark, d))


def _sections_sql(name: str, starts: str) -> str:
    """starts: rows (book, ix, title, page)."""
    return f"""{name}_once AS (SELECT book, title, page FROM ({starts}) QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY ix) = 1),
{name} AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY page) AS number, title, page AS start_page, coalesce(lead(page) OVER (PARTITION BY book ORDER BY page) - 1, total_pages) AS end_page FROM {name}_once JOIN src_books USING (book))"""


TOC_SEC = _sections_sql("sec_toc", f"SELECT book, toc_ix AS ix, {sql_strip('title')} AS title, page FROM toc WHERE {sql_strip('title')} <> '' AND page >= 1")
LAYOUT_SEC = _sections_sql("sec_layout", "SELECT book, page AS ix, title, page FROM layout")
REGEX_SEC = _sections_sql("sec_regex", f"SELECT * FROM (SELECT book, page AS ix, {CHAPTER_SQL} AS title, page FROM head) WHERE title IS NOT NULL")
ARTICLE_SEC = _sections_sql("sec_article", f"SELECT * FROM (SELECT book, page AS ix, {ARTICLE_SQL} AS title, page FROM head) WHERE title IS NOT NULL")
SEC = "book, number, title, start_page, end_page"


def _src_books(spark, d):
    return B.src_books(spark, d)


@query("scan_toc", f"WITH {B.SRC}, {B.TOC} SELECT book, toc_ix, {sql_strip('title')} AS title, page FROM toc WHERE {sql_strip('title')} <> '' AND page >= 1")
def scan_toc(spark, d):
    return sections.scan_toc(B.toc(spark, d)).select("book", "toc_ix", "title", "page")


@query("sections_toc", f"WITH {B.SRC}, {B.TOC}, {TOC_SEC} SELECT {SEC} FROM sec_toc")
def sections_toc(spark, d):
    return sections.sections_toc(B.toc(spark, d), _src_books(spark, d))


@query("sections_layout", f"WITH {B.HEAD}, {B.BLOCKS}, {LAYOUT}, {LAYOUT_SEC} SELECT {SEC} FROM sec_layout")
def sections_layout(spark, d):
    return sections.sections_layout(B.blocks(spark, d), _src_books(spark, d))


@query("sections_regex", f"WITH {B.HEAD}, {REGEX_SEC} SELECT {SEC} FROM sec_regex")
def sections_regex(spark, d):
    return sections.sections_regex(B.head_pages(spark, d), _src_books(spark, d))


@query("sections_article", f"WITH {B.HEAD}, {ARTICLE_SEC} SELECT {SEC} FROM sec_article")
def sections_article(spark, d):
    return sections.sections_article(B.head_pages(spark, d), _src_books(spark, d))


@query("sections_from_starts", f"WITH {B.SRC}, {_sections_sql('sec', "SELECT book, page AS ix, 'Page ' || page AS title, (page // 3) * 3 + 1 AS page FROM src WHERE page % 2 = 0")} SELECT {SEC} FROM sec")
def sections_from_starts(spark, d):
    pages = B.src_pages(spark, d)
    starts = pages.filter("page % 2 = 0").select("book", F.col("page").alias("ix"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title"), (F.floor(F.col("page") / 3) * 3 + 1).alias("page"))
    return sections.sections_from_starts(starts, B.src_books(spark, d))


@query("sections_from_all_starts", f"WITH {B.SRC}, {_sections_sql('sec', "SELECT book, page AS ix, 'Page ' || page AS title, (page // 3) * 3 + 1 AS page FROM src")} SELECT {SEC} FROM sec")
def sections_from_all_starts(spark, d):
    pages = B.src_pages(spark, d)
    starts = pages.select("book", F.col("page").alias("ix"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title"), (F.floor(F.col("page") / 3) * 3 + 1).alias("page"))
    return sections.sections_from_starts(starts, B.src_books(spark, d))


FRONT_SQL = f"({sql_words('text')} < 150 OR regexp_matches(lower(text), '{'|'.join(C.FRONT_MATTER)}'))"
STARTS = f"starts AS (SELECT b.book, coalesce(p, 1) AS content_start FROM src_books b LEFT JOIN (SELECT book, min(page) AS p FROM head WHERE page <= 25 AND NOT {FRONT_SQL} GROUP BY book) USING (book))"


@query("front_matter_page", f"WITH {B.SRC} SELECT book, page, {FRONT_SQL} AS is_front FROM src")
def front_matter_page(spark, d):
    return B.src_pages(spark, d).select("book", "page", sections.front_matter_page("text").alias("is_front"))


@query("content_start", f"WITH {B.HEAD}, {STARTS} SELECT book, content_start::BIGINT AS content_start FROM starts")
def content_start(spark, d):
    return sections.content_start(B.head_pages(spark, d), B.src_books(spark, d))


def _excluded_sql(name: str, source: str) -> str:
    return f"""{name}_moved AS (SELECT s.*, greatest(start_page, content_start) AS first, lead(greatest(start_page, content_start)) OVER (PARTITION BY book ORDER BY number) AS next FROM {source} s JOIN starts USING (book) WHERE greatest(start_page, content_start) <= end_page),
{name}_cut AS (SELECT book, number, title, first, CASE WHEN end_page >= next THEN next - 1 ELSE end_page END AS last FROM {name}_moved),
{name} AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY number) AS number, title, first AS start_page, last AS end_page FROM {name}_cut WHERE first <= last)"""


@query("exclude_front_matter", f"WITH {B.HEAD}, {B.TOC}, {TOC_SEC}, {STARTS}, {_excluded_sql('ex', 'sec_toc')} SELECT {SEC} FROM ex")
def exclude_front_matter(spark, d):
    pages, books = B.head_pages(spark, d), B.src_books(spark, d)
    return sections.exclude_front_matter(sections.sections_toc(B.toc(spark, d), books), sections.content_start(pages, books))


@query("fallback_section", f"WITH {B.HEAD}, {STARTS} SELECT book, 1::BIGINT AS number, 'Full document' AS title, content_start AS start_page, total_pages AS end_page FROM starts JOIN src_books USING (book)")
def fallback_section(spark, d):
    pages, books = B.head_pages(spark, d), B.src_books(spark, d)
    return sections.fallback_section(books, sections.content_start(pages, books))


CASCADE = f"""{LAYOUT}, {TOC_SEC}, {LAYOUT_SEC}, {REGEX_SEC}, {ARTICLE_SEC}, {STARTS},
every AS (SELECT *, 0 AS turn FROM sec_toc UNION ALL SELECT *, 1 FROM sec_layout UNION ALL SELECT *, 2 FROM sec_regex UNION ALL SELECT *, 3 FROM sec_article),
best AS (SELECT book, min(turn) AS turn FROM (SELECT book, turn FROM every GROUP BY ALL HAVING count(*) >= 2) GROUP BY book),
picked AS (SELECT e.* FROM every e JOIN best USING (book, turn)), trimmable AS (SELECT * FROM picked WHERE turn < 3), {_excluded_sql('trimmed', 'trimmable')},
found AS (SELECT {SEC}, ['toc', 'layout', 'regex'][turn + 1] AS detection_method FROM trimmed JOIN best USING (book) UNION ALL SELECT {SEC}, 'article_headings' FROM picked WHERE turn = 3)"""


@query("detect_sections", f"WITH {B.HEAD}, {B.TOC}, {B.BLOCKS}, {CASCADE} SELECT * FROM found UNION ALL SELECT book, 1, 'Full document', content_start, total_pages, 'fallback' FROM src_books JOIN starts USING (book) WHERE book NOT IN (SELECT book FROM found)")
def detect_sections(spark, d):
    pages = settled(B.head_pages(spark, d), "pages")  # five methods read them
    return sections.detect_sections(B.src_books(spark, d), pages, B.toc(spark, d), B.blocks(spark, d, pages))


@query("join_pages_sections", f"WITH {B.SRC}, {B.TOC}, {TOC_SEC} SELECT p.book, p.page, s.number FROM src p JOIN sec_toc s ON p.book = s.book AND p.page BETWEEN s.start_page AND s.end_page")
def join_pages_sections(spark, d):
    pages = B.src_pages(spark, d)
    return sections.join_pages_sections(pages, sections.sections_toc(B.toc(spark, d), B.src_books(spark, d))).select("book", "page", "number")


# ---- selection, estimates, chunks

SEL_TEXTS = ["1", "1-3", "2, 4", "1 - 2, 9", "3-1", " ", "5 7 2"]
SEL_NUMBERS = [[1], [1, 2, 3], [2, 4], [1, 2, 9], None, None, [2, 5, 7]]
_sql_sel = "[" + ", ".join("NULL" if x is None else str(x) for x in SEL_NUMBERS) + "]"
SELECTED = f"selected AS (SELECT book, unnest({_sql_sel}[ordinal % 7 + 1]) AS number FROM src_ord)"


def _selections(spark, d):
    books = B.ordinals(_src_books(spark, d))
    text = F.element_at(F.array(*map(F.lit, SEL_TEXTS)), (F.col("ordinal") % 7 + 1).cast("int"))
    return books.select("book", estimate.parse_selection(text).alias("s")).select("book", "s.numbers", "s.error")


def _selected(spark, d):
    return _selections(spark, d).select("book", F.explode("numbers").alias("number")).withColumn("number", F.col("number").cast("long"))


def _toc_sections(spark, d):
    return sections.sections_toc(B.toc(spark, d), _src_books(spark, d))


@query("parse_selection", f"WITH {B.SRC} SELECT book, array_to_string({_sql_sel}[ordinal % 7 + 1], ',') AS numbers, CASE ordinal % 7 WHEN 4 THEN 'reversed' WHEN 5 THEN 'empty' END AS error FROM src_ord")
def parse_selection(spark, d):
    return _selections(spark, d).select("book", F.when(F.col("numbers").isNotNull(), F.array_join(F.col("numbers").cast("array<string>"), ",")).alias("numbers"), "error")


@query("selection_semi_anti", f"WITH {B.SRC}, {B.TOC}, {TOC_SEC}, {SELECTED} SELECT book, number::BIGINT AS number, EXISTS (SELECT 1 FROM sec_toc s WHERE s.book = t.book AND s.number = t.number) AS is_valid FROM selected t WHERE number IS NOT NULL")
def selection_semi_anti(spark, d):
    return estimate.split_selection(_selected(spark, d), _toc_sections(spark, d))


@query("join_selection", f"WITH {B.SRC}, {B.TOC}, {TOC_SEC}, {SELECTED} SELECT s.book, s.number, title, start_page, end_page FROM selected t JOIN sec_toc s ON s.book = t.book AND s.number = t.number")
def join_selection(spark, d):
    return _toc_sections(spark, d).join(_selected(spark, d), ["book", "number"]).select(*sections.SECTION)


INDEX = """idx AS (SELECT s.book, s.number, any_value(s.title) AS title, any_value(s.end_page - s.start_page + 1) AS pages, coalesce(sum(length(p.text)), 0)::BIGINT AS chars, coalesce(sum((length(p.text) + 3) // 4), 0)::BIGINT AS tokens
  FROM sec_toc s LEFT JOIN src p ON p.book = s.book AND p.page BETWEEN s.start_page AND s.end_page GROUP BY s.book, s.number)"""


@query("section_index", f"WITH {B.SRC}, {B.TOC}, {TOC_SEC}, {INDEX} SELECT *, trunc(greatest(pages, 1) * 2 * 110::DOUBLE * 1.35)::BIGINT AS output_low, trunc(greatest(pages, 1) * 2 * 280::DOUBLE * 1.35)::BIGINT AS output_high FROM idx")
def section_index(spark, d):
    return estimate.section_index(B.src_pages(spark, d), _toc_sections(spark, d), 2, "high")


@query("selection_cost", f"""WITH {B.SRC}, {B.TOC}, {TOC_SEC}, {SELECTED}, {INDEX},
own AS (SELECT i.book, sum(tokens)::BIGINT AS input_tokens, sum(pages)::BIGINT AS pages FROM idx i JOIN (SELECT DISTINCT * FROM selected) t ON t.book = i.book AND t.number = i.number GROUP BY i.book),
sized AS (SELECT *, trunc(greatest(pages, 1) * 3 * 110::DOUBLE)::BIGINT AS output_low, trunc(greatest(pages, 1) * 3 * 280::DOUBLE)::BIGINT AS output_high FROM own)
SELECT *, round(input_tokens / 1e6 * 0.4 + output_low / 1e6 * 1.2, 9) AS cost_low, round(input_tokens / 1e6 * 0.4 + output_high / 1e6 * 1.2, 9) AS cost_high, pages * 3 AS expected, round(input_tokens / 1e6 * 0.4 + output_high / 1e6 * 1.2, 9) > 0.75 AS over_budget FROM sized""")
def selection_cost(spark, d):
    return estimate.selection_cost(estimate.section_index(B.src_pages(spark, d), _toc_sections(spark, d)), _selected(spark, d), 3)


GRID = "grid AS (SELECT book, total_pages AS pages, q AS qpp, u AS quality FROM src_books, (SELECT unnest(range(1, 11)) AS q), (SELECT unnest(['low', 'medium', 'high']) AS u))"


def _grid(spark, d):
    one = _src_books(spark, d).select("book", F.col("total_pages").alias("pages"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("qpp"))
    return one.select("*", F.explode(F.array(*map(F.lit, C.QUALITY_FACTORS))).alias("quality"))


FACTOR = "CASE quality WHEN 'low' THEN 0.85::DOUBLE WHEN 'high' THEN 1.35 ELSE 1 END"


@query("estimate_output_tokens", f"WITH {B.SRC}, {GRID} SELECT book, qpp, quality, trunc(pages::DOUBLE * qpp * 110 * {FACTOR})::BIGINT AS low, trunc(pages::DOUBLE * qpp * 280 * {FACTOR})::BIGINT AS high FROM grid")
def estimate_output_tokens(spark, d):
    low, high = estimate.estimate_output_tokens(F.col("pages"), F.col("qpp"), F.col("quality"))
    return _grid(spark, d).select("book", "qpp", "quality", low.alias("low"), high.alias("high"))


@query("estimate_cost", "SELECT doc_id, round(n_chars / 1e6 * 0.4 + n_chars * 3 / 1e6 * 1.2, 9) AS cost FROM documents")
def estimate_cost(spark, d):
    return _documents(spark, d).select("doc_id", F.round(estimate.cost(F.col("n_chars"), F.col("n_chars") * 3), 9).alias("cost"))


@query("settings_grid", f"WITH {B.SRC}, {GRID} SELECT book, qpp, quality, CASE WHEN qpp <= 2 THEN 'selective' WHEN qpp <= 5 THEN 'balanced' ELSE 'dense' END AS density_tier, pages >= 100 AS skip_quality, qpp >= 3 AND quality = 'high' AS dense_high_warn, pages * qpp AS expected FROM grid")
def settings_grid(spark, d):
    """density_tier, skip_quality, dense_high_warn and expected_annotations."""
    return _grid(spark, d).select("book", "qpp", "quality", estimate.density_tier(F.col("qpp")).alias("density_tier"), estimate.skip_quality(F.col("pages")).alias("skip_quality"), estimate.dense_high_warn(F.col("qpp"), F.col("quality")).alias("dense_high_warn"), (F.col("pages") * F.col("qpp")).alias("expected"))


CHUNK = """sized AS (SELECT book, total_pages AS pages, q AS qpp, tokens FROM src_books JOIN (SELECT book, sum((length(text) + 3) // 4)::BIGINT AS tokens FROM src GROUP BY book) USING (book), (SELECT unnest([1, 2, 5, 10]) AS q)),
chunk AS (SELECT book, pages, qpp, CASE WHEN pages <= 1 THEN 1 ELSE greatest(1, least(454 // qpp, 1050000 // greatest(1, tokens // pages), pages, CASE WHEN qpp > 1 THEN 20 ELSE pages END)) END::BIGINT AS size FROM sized)"""


def _chunk_sizes(spark, d):
    pages = B.src_pages(spark, d)
    sums = pages.groupBy("book").agg(F.max("page").alias("pages"), F.sum(T.estimated_tokens("text")).alias("tokens"))
    grid = sums.select("*", F.explode(F.array(*map(F.lit, (1, 2, 5, 10)))).alias("qpp"))
    return grid.withColumn("size", estimate.chunk_size(F.col("pages"), F.col("tokens"), F.col("qpp")))


@query("chunk_size", f"WITH {B.SRC}, {CHUNK} SELECT book, qpp, size FROM chunk")
def chunk_size(spark, d):
    return _chunk_sizes(spark, d).select("book", "qpp", "size")


@query("page_chunks", f"WITH {B.SRC}, {CHUNK} SELECT book, qpp, i::INTEGER AS chunk_ix, i * size + 1 AS chunk_start, least(i * size + size, pages) AS chunk_end, CASE WHEN i > 0 THEN i * size END AS overlap_page FROM (SELECT *, unnest(range(0, (pages + size - 1) // size)) AS i FROM chunk)")
def page_chunks(spark, d):
    one = _chunk_sizes(spark, d).withColumn("start_page", F.lit(1).cast("long")).withColumn("end_page", F.col("pages"))
    return estimate.page_chunks(one).select("book", "qpp", "chunk_ix", "chunk_start", "chunk_end", "overlap_page")


@query("merge_chunks", f"WITH {B.ANN} SELECT book, seq AS was, row_number() OVER (PARTITION BY book ORDER BY page, seq // 4, seq % 4) AS seq FROM ann")
def merge_chunks(spark, d):
    rows = B.annotations(spark, d).select("book", F.lit(1).alias("number"), F.col("seq").alias("was"), "page", F.floor(F.col("seq") / 4).alias("chunk_ix"), (F.col("seq") % 4).alias("chunk_seq"))
    return estimate.merge_chunks(rows).select("book", "was", "seq")


@query("doc_frame", f"""WITH {B.SRC}, t AS (SELECT book, page, (length('=== PAGE ' || page || ' ===' || chr(10) || text || chr(10)) + 3) // 4 AS tokens FROM src WHERE page <= 8 AND {sql_strip('text')} NOT IN ('', '[NO TEXT FOUND]')),
r AS (SELECT book, page, tokens, (sum(tokens) OVER (PARTITION BY book ORDER BY page))::BIGINT + 100 AS running FROM t) SELECT book, page, tokens, running FROM r WHERE running <= 1500""")
def doc_frame(spark, d):
    return estimate.doc_frame(B.src_pages(spark, d)).select("book", "page", "tokens", "running")


@query("usage_rollup", "WITH u AS (SELECT source AS book, sum(n_chars // 4)::BIGINT AS prompt_tokens, sum(n_chars // 40)::BIGINT AS completion_tokens FROM documents GROUP BY source) SELECT *, prompt_tokens + completion_tokens AS total_tokens, round(prompt_tokens / 1e6 * 0.4 + completion_tokens / 1e6 * 1.2, 9) AS cost FROM u")
def usage_rollup(spark, d):
    return estimate.usage_rollup(_documents(spark, d).select(F.col("source").alias("book"), F.floor(F.col("n_chars") / 4).alias("prompt_tokens"), F.floor(F.col("n_chars") / 40).alias("completion_tokens")))


# ---- quotes, density, types

HIT = f"(q.book_text <> '' AND (contains(p.text, q.book_text) OR contains({sql_norm('p.text')}, {sql_norm('q.book_text')})))"


@query("quote_in_text", f"WITH {B.ANN} SELECT q.book, q.seq, q.book_text <> '' AND (q.book_text = '[UNKNOWN]' OR {HIT}) AS is_in FROM ann q JOIN conv p ON p.book = q.book AND p.page = q.page")
def quote_in_text(spark, d):
    both = B.annotations(spark, d).join(B.conv_pages(spark, d), ["book", "page"])
    return both.select("book", "seq", T.quote_in_text("book_text", "text").alias("is_in"))


def _bench(spark, d):
    items = B.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return items.crossJoin(F.broadcast(_src_books(spark, d).select("book")))


@query("find_quote_page", f"WITH {B.SRC}, items AS (SELECT item_id, text AS quote, book FROM benchmark, src_books), hits AS (SELECT i.item_id, i.book, min(page) AS page FROM items i JOIN src p ON p.book = i.book AND i.quote <> '' AND (contains(p.text, i.quote) OR contains({sql_norm('p.text')}, {sql_norm('i.quote')})) GROUP BY ALL) SELECT i.item_id, i.book, h.page AS found_page FROM items i LEFT JOIN hits h USING (item_id, book)")
def find_quote_page(spark, d):
    return verify.find_quote_page(_bench(spark, d), B.src_pages(spark, d)).select("item_id", "book", "found_page")


NOTE = sql_strip("annotation")
GENERIC = " OR ".join(f"starts_with(lower({NOTE}), '{p}')" for p in C.GENERIC_PREFIXES)
NOTE_FLAGS = f"""CASE WHEN {NOTE} = '' THEN ['empty_annotation'] WHEN {NOTE} = '[UNKNOWN]' THEN [] ELSE
  (CASE WHEN {sql_words(NOTE)} < 3 THEN ['short_annotation'] ELSE [] END) || (CASE WHEN {sql_words(NOTE)} > 140 THEN ['long_annotation'] ELSE [] END) || (CASE WHEN {GENERIC} THEN ['generic_phrasing'] ELSE [] END) END"""


@query("note_flags", f"WITH {B.ANN} SELECT book, seq, array_to_string({NOTE_FLAGS}, ',') AS flags FROM ann")
def note_flags(spark, d):
    return B.annotations(spark, d).select("book", "seq", F.array_join(verify.add_flags(verify.no_flags(), *verify.note_flags(F.col("annotation"))), ",").alias("flags"))


def _status_sql(name: str, source: str) -> str:
    key = sql_norm("book_text")
    return f"""{name} AS (SELECT *, CASE WHEN page IS NULL THEN 'invalid' WHEN NOT page BETWEEN start_page AND end_page THEN 'oor'
  WHEN {key} NOT IN ('', '[UNKNOWN]') AND row_number() OVER (PARTITION BY book, page, {key} ORDER BY seq) > 1 THEN 'duplicate' ELSE 'kept' END AS status FROM {source})"""


def _capped_sql(name: str, source: str, qpp: int) -> str:
    late = f"CASE WHEN n > {qpp} AND {sql_strip('book_text')} IN ('', '[UNKNOWN]') THEN 1 ELSE 0 END"
    return f"""{_status_sql(name + '_status', source)},
{name}_counted AS (SELECT *, count(*) FILTER (status = 'kept') OVER (PARTITION BY book, page) AS n FROM {name}_status),
{name}_ranked AS (SELECT * EXCLUDE (n), CASE WHEN status = 'kept' THEN row_number() OVER (PARTITION BY book, page, status ORDER BY {late}, seq) END AS r FROM {name}_counted),
{name} AS (SELECT * EXCLUDE (status, r), CASE WHEN r > {qpp} THEN 'trimmed' ELSE status END AS status, CASE WHEN r <= {qpp} THEN r END AS rank FROM {name}_ranked)"""


@query("dedup_quotes", f"WITH {B.ANN}, {_status_sql('s', 'ann')} SELECT book, seq, status FROM s")
def dedup_quotes(spark, d):
    return verify.density_status(B.annotations(spark, d)).select("book", "seq", "status")


@query("density_cap", f"WITH {B.ANN}, {_capped_sql('c', 'ann', QPP)} SELECT book, seq, page, status, rank::INTEGER AS rank FROM c")
def density_cap(spark, d):
    return verify.density_cap(B.annotations(spark, d), QPP).select("book", "seq", "page", "status", "rank")


@query("repair_report", f"WITH {B.ANN}, {_capped_sql('c', 'ann', QPP)} SELECT book, chapter_number, count(*) FILTER (status = 'trimmed') AS trimmed, count(*) FILTER (status = 'oor') AS dropped_oor, count(*) FILTER (status = 'invalid') AS dropped_invalid, count(*) FILTER (status = 'duplicate') AS dropped_duplicate FROM c GROUP BY ALL")
def repair_report(spark, d):
    return verify.repair_report(verify.density_cap(B.annotations(spark, d), QPP))


@query("page_note_counts", f"WITH {B.ANN} SELECT book, chapter_number, page, count(*) AS n FROM ann GROUP BY ALL")
def page_note_counts(spark, d):
    return verify.page_note_counts(B.annotations(spark, d))


@query("structure_post", f"""WITH {B.ANN}, p AS (SELECT book, chapter_number, page, start_page, end_page, count(*) AS n FROM ann GROUP BY ALL)
SELECT book, chapter_number, 'section_count' AS kind, NULL::BIGINT AS page, sum(n)::BIGINT AS n FROM p GROUP BY book, chapter_number, end_page HAVING sum(n) > end_page * 2
UNION ALL SELECT book, chapter_number, 'page_range', page, n FROM p WHERE page > end_page UNION ALL SELECT book, chapter_number, 'page_count', page, n FROM p WHERE page <= end_page AND n > 2""")
def structure_post(spark, d):
    return verify.structure_post(B.annotations(spark, d), B.conv_sections(B.conv_pages(spark, d)), 2)


def _checked_sql(name: str, source: str) -> str:
    """Needs conv; rows with seq and page inside their section or not."""
    return f"""{name}_hits AS (SELECT q.book, q.seq, p.page FROM {source} q JOIN conv p ON p.book = q.book AND p.page BETWEEN q.start_page AND q.end_page AND {HIT}),
{name}_state AS (SELECT q.*, CASE WHEN q.book_text = '[UNKNOWN]' THEN 'quote_unknown' WHEN EXISTS (SELECT 1 FROM {name}_hits h WHERE h.book = q.book AND h.seq = q.seq AND h.page = q.page) THEN ''
  WHEN f.first IS NOT NULL THEN 'page_corrected' ELSE 'quote_not_found' END AS state, f.first FROM {source} q LEFT JOIN (SELECT book, seq, min(page) AS first FROM {name}_hits GROUP BY ALL) f ON f.book = q.book AND f.seq = q.seq),
{name}_new AS (SELECT * EXCLUDE (page, book_text), CASE WHEN state = 'page_corrected' THEN first ELSE page END AS page, CASE WHEN state = 'quote_not_found' THEN '[UNKNOWN]' ELSE book_text END AS book_text FROM {name}_state),
{name} AS (SELECT book, chapter_number, seq, page, book_text, category, grounding, start_page, end_page,
  CASE WHEN {NOTE} = '' OR ({NOTE} <> '[UNKNOWN]' AND book_text = '[UNKNOWN]') THEN '[UNKNOWN]' ELSE annotation END AS annotation,
  (CASE WHEN state = '' THEN [] ELSE [state] END) || {NOTE_FLAGS} || (CASE WHEN {NOTE} NOT IN ('', '[UNKNOWN]') AND book_text = '[UNKNOWN]' THEN ['annotation_unknown'] ELSE [] END)
  || (CASE WHEN page BETWEEN start_page AND end_page THEN [] ELSE ['invalid_page'] END) AS flags FROM {name}_new)"""


@query("verify_quotes", f"WITH {B.ANN}, {_checked_sql('v', 'ann')} SELECT book, seq, page, book_text, annotation, array_to_string(flags, ',') AS validation_flags FROM v")
def verify_quotes(spark, d):
    rows = B.annotations(spark, d).withColumn("validation_flags", verify.no_flags())
    return verify.verify_quotes(rows, B.conv_pages(spark, d)).select("book", "seq", "page", "book_text", "annotation", flat())


def _typed_sql(source: str, extra: str) -> str:
    bad_c, bad_g = f"category NOT IN ({', '.join(map(repr, C.CATEGORIES))})", f"grounding NOT IN ({', '.join(map(repr, C.GROUNDINGS))})"
    return f"""SELECT {extra}, CASE WHEN {bad_c} THEN 'CONTEXT' ELSE category END AS category, CASE WHEN {bad_g} OR book_text = '[UNKNOWN]' OR annotation = '[UNKNOWN]' THEN 'uncertain' ELSE grounding END AS grounding,
  array_to_string(flags || (CASE WHEN {bad_c} THEN ['category_invalid'] ELSE [] END) || (CASE WHEN {bad_g} THEN ['grounding_invalid'] ELSE [] END), ',') AS validation_flags FROM {source}"""


@query("normalize_row", f"WITH {B.ANN}, f AS (SELECT *, []::VARCHAR[] AS flags FROM ann) {_typed_sql('f', 'book, seq')}")
def normalize_row(spark, d):
    return verify.normalize_row(B.annotations(spark, d).withColumn("validation_flags", verify.no_flags())).select("book", "seq", "category", "grounding", flat())


@query("flagged_rows", f"WITH {B.ANN}, f AS (SELECT *, []::VARCHAR[] AS flags FROM ann), t AS ({_typed_sql('f', 'book, chapter_number')}) SELECT book, chapter_number, count(*) FILTER (validation_flags <> '') AS flagged FROM t GROUP BY ALL")
def flagged_rows(spark, d):
    return verify.flagged_rows(verify.normalize_row(B.annotations(spark, d).withColumn("validation_flags", verify.no_flags())))


PIPELINE = f"""{B.ANN}, {_status_sql('s1', 'ann')}, p1 AS (SELECT * EXCLUDE (status, seq), row_number() OVER (PARTITION BY book ORDER BY page, seq) AS seq FROM s1 WHERE status = 'kept'),
{_checked_sql('v1', 'p1')}, {_capped_sql('c1', 'v1', QPP)}, p2 AS (SELECT * EXCLUDE (seq), row_number() OVER (PARTITION BY book ORDER BY page, rank) AS seq FROM c1 WHERE status = 'kept')"""


@query("validated_pipeline", f"WITH {PIPELINE} {_typed_sql('p2', 'book, seq, page, book_text, annotation')}")
def validated_pipeline(spark, d):
    out = verify.validated_pipeline(B.annotations(spark, d), B.conv_pages(spark, d), QPP)
    return out.select("book", "seq", "page", "book_text", "annotation", "category", "grounding", flat())


def _responses(spark, d):
    """B-RESP: what a model might have answered, sound or not."""
    rows = B.annotations(spark, d)
    note = F.struct("page", "book_text", "annotation", "category", "grounding")
    one = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("seq", note.alias("n")))).alias("n"), F.max("end_page").alias("end_page"))
    notes = F.to_json(F.transform("n", lambda x: x["n"]))
    lacking = F.concat(F.lit('[{"page":1,"book_text":"x","annotation":"y","category":"METHOD"},"text",'), F.substr(notes, F.lit(2)))
    kind = F.col("book") % 10
    body = F.when(kind == 2, "{}").when(kind == 3, lacking).otherwise(notes)
    title = F.when(kind == 1, "").otherwise('"chapter_title":"All",')
    return one.select("book", F.concat(F.lit('{"chapter_number":1,'), title, F.lit('"start_page":1,"end_page":'), F.col("end_page").cast("string"), F.lit(',"annotations":'), body, F.lit("}")).alias("response"))


RESP = "CASE book % 10 WHEN 1 THEN 'Missing field: chapter_title' WHEN 2 THEN 'annotations must be an array' WHEN 3 THEN 'annotations[0] missing field: grounding|annotations[1] must be an object' ELSE '' END"


@query("structure_hard", f"WITH {B.CONV} SELECT book, {RESP} AS errors FROM conv_sec")
def structure_hard(spark, d):
    return verify.structure_hard(_responses(spark, d)).select("book", F.array_join("errors", "|").alias("errors"))


@query("blocking_errors", f"WITH {B.CONV} SELECT book, book % 10 IN (1, 2, 3) AS is_blocking FROM conv_sec")
def blocking_errors(spark, d):
    return verify.structure_hard(_responses(spark, d)).select("book", verify.blocking_errors(F.col("errors")).alias("is_blocking"))


# ---- targets and exports


def _notes(spark, d):
    return B.annotations(spark, d).withColumn("chapter_title", F.lit("All")).withColumn("validation_flags", verify.no_flags())


TARGETS = "book_text <> '[UNKNOWN]' AND " + sql_strip("book_text") + " <> ''"


@query("read_targets_json", f"WITH {B.ANN}, r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY seq) - 1 AS ix FROM ann) SELECT book::VARCHAR AS source, ix::INTEGER AS ix, 1 AS chapter_number, 'All' AS chapter_title, page::INTEGER AS page, book_text, annotation, NULL::VARCHAR AS annotation_type FROM r WHERE {TARGETS}")
def read_targets_json(spark, d):
    documents = files.master_payload(_notes(spark, d)).select(F.col("book").cast("string").alias("source"), "json")
    return files.targets_from_json(documents).drop("part")


@query("read_targets_csv", f"WITH {B.ANN} SELECT book, seq, page::INTEGER AS page, book_text, annotation, CASE WHEN seq % 2 = 0 THEN category END AS annotation_type FROM ann WHERE {TARGETS}")
def read_targets_csv(spark, d):
    rows = B.annotations(spark, d).select(F.col("book"), F.col("seq"), F.col("page").cast("string").alias("Page"), F.lit("").alias("source_text"), F.col("book_text").alias("Book Text"), "annotation", F.when(F.col("seq") % 2 == 0, F.col("category")).otherwise("").alias("Category"))
    fields = {"page": "Page", "book_text": "Book Text", "annotation": "annotation", "annotation_type": "Category"}
    named = rows.select("book", "seq", *[F.coalesce(*[F.nullif(F.col(f"`{a}`"), F.lit("")) for a in files.ALIASES[k] if a in rows.columns]).alias(k) for k in fields])
    return files.row_to_target(named)


@query("export_chapter_csv", f"WITH {B.ANN} SELECT book, seq, 'f' || book || '.pdf' AS document, chapter_number AS chapter, 'All' AS chapter_title, page, category, grounding, book_text AS source_text, annotation, 'high' AS quality, '2' AS density FROM ann")
def export_chapter_csv(spark, d):
    named = _notes(spark, d).withColumn("source_filename", F.concat(F.lit("f"), F.col("book").cast("string"), F.lit(".pdf"))).withColumn("quality", F.lit("high")).withColumn("density", F.lit(2))
    return files.chapter_csv(named)


@query("export_master_csv", f"WITH {B.ANN}, r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY seq) - 1 AS ix FROM ann) SELECT book, ix::INTEGER AS ix, CASE WHEN book % 2 = 0 THEN 'f.pdf' ELSE book::VARCHAR END AS document, '1' AS chapter, 'All' AS chapter_title, page::VARCHAR AS page, category, grounding, book_text AS source_text, annotation, 'low' AS quality, '3' AS density FROM r")
def export_master_csv(spark, d):
    rows = _notes(spark, d)
    metadata = rows.select("book").distinct().select("book", F.when(F.col("book") % 2 == 0, "f.pdf").otherwise("").alias("source_filename"), F.lit("low").alias("quality"), F.lit(3).alias("density"))
    return files.master_csv(files.master_payload(rows), metadata)


@query("save_master_json", f"WITH {B.ANN} SELECT book, count(*)::INTEGER AS notes, string_agg(book_text, '|' ORDER BY seq) AS quotes FROM ann GROUP BY book")
def save_master_json(spark, d):
    payload = files.master_payload(_notes(spark, d))
    quotes = F.from_json(F.get_json_object("json", "$.chapters"), "array<struct<annotations:array<struct<book_text:string>>>>")
    return payload.select("book", F.flatten(F.transform(quotes, lambda c: F.transform(c["annotations"], lambda a: a["book_text"]))).alias("q")).select("book", F.size("q").alias("notes"), F.array_join("q", "|").alias("quotes"))


@query("read_run_quotes", f"WITH {B.ANN} SELECT page::INTEGER AS page, replace(lower({sql_norm('book_text')}), 'ß', 'ss') AS quote FROM ann WHERE {sql_norm('book_text')} NOT IN ('', '[UNKNOWN]')")
def read_run_quotes(spark, d):
    return files.run_quotes(B.annotations(spark, d).select(F.col("page").cast("string").alias("Page"), F.col("book_text").alias("Source_Text"), F.lit("other").alias("book text")))


# ---- comparison

PAIRS = "pairs AS (SELECT a.page, a.ix AS i, b.ix AS j, CASE WHEN greatest(length(a.quote), length(b.quote)) = 0 THEN 1.0 ELSE least(length(a.quote), length(b.quote)) / greatest(length(a.quote), length(b.quote))::DOUBLE END AS score FROM run_a a JOIN run_b b USING (page) WHERE contains(a.quote, b.quote) OR contains(b.quote, a.quote))"
#: One-to-one pairs: rounds of the best pair left on each page.
GREEDY = """ordered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, i, j) AS r FROM pairs),
fold AS (SELECT page, i, j, score, r, [i] AS ui, [j] AS uj, true AS taken FROM ordered WHERE r = 1
  UNION ALL SELECT o.page, o.i, o.j, o.score, o.r, CASE WHEN NOT list_contains(f.ui, o.i) AND NOT list_contains(f.uj, o.j) THEN list_append(f.ui, o.i) ELSE f.ui END,
  CASE WHEN NOT list_contains(f.ui, o.i) AND NOT list_contains(f.uj, o.j) THEN list_append(f.uj, o.j) ELSE f.uj END, NOT list_contains(f.ui, o.i) AND NOT list_contains(f.uj, o.j)
  FROM fold f JOIN ordered o ON o.page = f.page AND o.r = f.r + 1), matched AS (SELECT page, i, j, score FROM fold WHERE taken)"""
COMPARED = """na AS (SELECT page, count(*) AS n_a FROM run_a GROUP BY page), nb AS (SELECT page, count(*) AS n_b FROM run_b GROUP BY page), nm AS (SELECT page, count(*) AS matched FROM matched GROUP BY page),
c0 AS (SELECT coalesce(na.page, nb.page) AS page, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM na FULL JOIN nb ON na.page = nb.page), c1 AS (SELECT c0.*, coalesce(matched, 0) AS matched FROM c0 LEFT JOIN nm USING (page)),
compared AS (SELECT page, n_a, n_b, matched, CASE WHEN matched = 0 THEN 'NO_MATCH' WHEN matched = n_a AND matched = n_b THEN 'MATCH' ELSE 'PARTIAL' END AS status, round(CASE WHEN n_a = 0 OR n_b = 0 THEN 0 ELSE 200.0::DOUBLE * matched / (n_a + n_b) END, 6) AS similarity FROM c1)"""


@query("pair_candidates", f"WITH {B.RUNS}, {PAIRS} SELECT page, i, j, round(score, 9) AS score FROM pairs")
def pair_candidates(spark, d):
    return compare.pair_candidates(*B.runs(spark, d)).withColumn("score", F.round("score", 9))


@query("match_score")
def match_score(spark, d):
    """Rows only: difflib's ratio has no SQL."""
    return compare.pair_candidates(*B.runs(spark, d), threshold=0.8).withColumn("score", F.round("score", 9))


@query("greedy_pairing", f"WITH RECURSIVE {B.RUNS}, {PAIRS}, {GREEDY} SELECT page, i, j, round(score, 9) AS score FROM matched")
def greedy_pairing(spark, d):
    return compare.greedy_pairing(compare.pair_candidates(*B.runs(spark, d))).withColumn("score", F.round("score", 9))


def _compared(spark, d):
    a, b = B.runs(spark, d)
    return compare.compare_pages(a, b, compare.greedy_pairing(compare.pair_candidates(a, b)))


@query("compare_pages", f"WITH RECURSIVE {B.RUNS}, {PAIRS}, {GREEDY}, {COMPARED} SELECT * FROM compared")
def compare_pages(spark, d):
    return _compared(spark, d)


@query("overall_similarity", f"WITH RECURSIVE {B.RUNS}, {PAIRS}, {GREEDY}, {COMPARED} SELECT sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, sum(matched)::BIGINT AS matched, round(200.0::DOUBLE * sum(matched)::BIGINT / (sum(n_a) + sum(n_b))::BIGINT, 6) AS similarity FROM compared")
def overall_similarity(spark, d):
    return compare.overall_similarity(_compared(spark, d))


#: The reference's default: ratio of quotes that match without holding each other.
RATIO = 0.85


def _fuzzy(spark, d):
    a, b = B.runs(spark, d)
    return a, b, compare.greedy_pairing(compare.pair_candidates(a, b, threshold=RATIO))


@query("greedy_pairing_ratio")
def greedy_pairing_ratio(spark, d):
    """Rows only, like the two that follow: difflib's ratio has no SQL; tests compare them with a plain fold."""
    return _fuzzy(spark, d)[2].withColumn("score", F.round("score", 9))


@query("compare_pages_ratio")
def compare_pages_ratio(spark, d):
    return compare.compare_pages(*_fuzzy(spark, d))


@query("overall_similarity_ratio")
def overall_similarity_ratio(spark, d):
    return compare.overall_similarity(compare.compare_pages(*_fuzzy(spark, d)))


# ---- placement

TARGET = f"target AS (SELECT book * 100000 + seq AS target_id, book, page, book_text AS quote FROM ann WHERE book_text <> '[UNKNOWN]')"


@query("target_page_range", f"WITH {B.ANN}, {TARGET} SELECT target_id, CASE WHEN page BETWEEN 1 AND end_page THEN NULL ELSE 'page_out_of_range' END AS reason FROM target JOIN conv_sec USING (book)")
def target_page_range(spark, d):
    return place.target_page_range(B.targets(spark, d), B.books_of(B.conv_pages(spark, d))).select("target_id", "reason")


@query("neighbor_pages", f"WITH {B.ANN}, {TARGET} SELECT target_id, p::INTEGER AS priority, page + [0, -1, 1][p + 1] AS try_page FROM target, (SELECT unnest([0, 1, 2]) AS p)")
def neighbor_pages(spark, d):
    return place.neighbor_pages(B.targets(spark, d)).select("target_id", "priority", "try_page")


#: Runs of words without hyphens at line ends, which the bound pages do not have.
RUNS_OF_WORDS = f"""{B.ANN}, {B.WORDS.removeprefix(B.CONV + ", ")}, {TARGET},
lists AS (SELECT book, page, list({sql_norm('word')} ORDER BY ix) AS words FROM word GROUP BY ALL),
wanted AS (SELECT target_id, book, page, quote AS q, CASE WHEN {sql_norm('quote')} = '' THEN [] ELSE string_split({sql_norm('quote')}, ' ') END AS needle FROM target)"""
RUN_START = "CASE WHEN len(needle) > 0 THEN list_filter(range(0, len(words) - len(needle) + 1), lambda i: words[i + 1:i + len(needle)] = needle)[1] END"
FOUND = f"""{RUNS_OF_WORDS}, turns AS (SELECT w.*, {_variants_sql()} AS variants, turn, page + [0, -1, 1][turn + 1] AS try_page, end_page FROM wanted w JOIN conv_sec USING (book), (SELECT unnest([0, 1, 2]) AS turn) WHERE page BETWEEN 1 AND end_page),
tries AS (SELECT target_id, turn, try_page, len(needle) AS n, {RUN_START} AS start, array_to_string(needle, ' ') AS plain, array_to_string(words, ' ') AS whole, len(list_filter(variants, lambda v: contains(text, v))) > 0 AS is_held FROM turns t JOIN conv c ON c.book = t.book AND c.page = try_page LEFT JOIN lists l ON l.book = t.book AND l.page = try_page),
best AS (SELECT * EXCLUDE (start), coalesce(start, CASE WHEN n > 0 AND contains(whole, plain) THEN len(string_split(whole[:instr(whole, plain) - 1], ' ')) - 1 END) AS start, start IS NOT NULL AS is_run FROM tries WHERE is_held OR start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY turn) = 1),
placed AS (SELECT w.target_id, w.book, try_page AS found_page, CASE WHEN is_held THEN 'search_for' WHEN is_run THEN 'word_sequence' END || CASE WHEN turn > 0 THEN '_neighbor_p' || try_page ELSE '' END AS method, start::INTEGER AS start, (start + n)::INTEGER AS stop,
  CASE WHEN NOT page BETWEEN 1 AND end_page THEN 'page_out_of_range' WHEN b.target_id IS NULL THEN 'quote_not_found' END AS reason FROM wanted w JOIN conv_sec USING (book) LEFT JOIN best b USING (target_id))"""


@query("word_sequence_match", f"WITH {RUNS_OF_WORDS}, r AS (SELECT target_id, len(needle) AS n, {RUN_START} AS start FROM wanted JOIN lists USING (book, page)) SELECT target_id, start::INTEGER AS start, (start + n)::INTEGER AS stop FROM r")
def word_sequence_match(spark, d):
    """Tests compare hyphens with a plain reading of the rule."""
    wanted = B.targets(spark, d).select("target_id", "book", "page", T.tokenize("quote").alias("needle"))
    both = wanted.join(place.word_lists(B.words(spark, d)), ["book", "page"])
    return both.select("target_id", place.word_sequence_match(F.col("needle"), F.col("words")).alias("r")).select("target_id", "r.start", "r.stop")


def _found(spark, d):
    pages = B.conv_pages(spark, d)
    return place.find_quotes(B.targets(spark, d), pages, B.words(spark, d), B.books_of(pages))


@query("find_quote_rects", f"WITH {FOUND} SELECT target_id, found_page, method, start, stop, reason FROM placed")
def find_quote_rects(spark, d):
    return _found(spark, d).select("target_id", "found_page", "method", "start", "stop", "reason")


@query("highlight_report", f"WITH {FOUND} SELECT book, count(method) AS highlighted, count(reason) AS missed FROM placed GROUP BY book")
def highlight_report(spark, d):
    return place.highlight_report(_found(spark, d))


EDGE = "edge AS (SELECT book, page, coalesce(max(x1) FILTER (y1 >= 792 * 0.08::DOUBLE AND y0 <= 792 - 792 * 0.08::DOUBLE), 0) AS edge FROM conv LEFT JOIN boxes USING (book, page) GROUP BY ALL), free AS (SELECT *, greatest(0, 612 - 6 - (edge + 8)) AS free_margin FROM edge)"


@query("body_right_edge", f"WITH {B.WORDS}, {EDGE} SELECT book, page, 612.0::DOUBLE AS width, edge, free_margin FROM free")
def body_right_edge(spark, d):
    return place.body_right_edge(B.words(spark, d), B.page_sizes(spark, d))


@query("margin_band", f"WITH {B.WORDS}, {EDGE} SELECT book, page, 606.0::DOUBLE - w AS x0, 606.0::DOUBLE AS x1 FROM (SELECT book, page, CASE WHEN free_margin >= 72 THEN least(free_margin, 120) ELSE 72 END AS w FROM free)")
def margin_band(spark, d):
    edge = place.body_right_edge(B.words(spark, d), B.page_sizes(spark, d))
    return edge.select("book", "page", place.margin_band(F.col("free_margin"), F.col("width")).alias("b")).select("book", "page", "b.x0", "b.x1")


_WIDTHS = f"[{', '.join(map(str, place.HELVETICA))}]"
#: Widths of a note's words in thousandths of the font size, and what a greedy wrap of a column of 72 points makes of them.
WRAPPED = f"""notes_w AS (SELECT book, seq, list_transform(CASE WHEN {sql_norm('annotation')} = '' THEN [annotation] ELSE string_split({sql_norm('annotation')}, ' ') END,
  lambda w: list_sum(list_transform(string_split(w, ''), lambda c: CASE WHEN ascii(c) BETWEEN 32 AND 126 THEN {_WIDTHS}[ascii(c) - 31] WHEN c = '' THEN 0 ELSE 556 END))) AS ws FROM ann),
sizes AS (SELECT unnest([8.0, 7.5, 7.0, 6.5, 6.0])::DOUBLE AS size),
folded AS (SELECT book, seq, size, list_reduce(list_transform(ws, lambda w: {{'lines': 1::DOUBLE, 'at': w * size / 1000}}),
  lambda a, w: CASE WHEN a.at + 278 * size / 1000 + w.at <= 66 THEN {{'lines': a.lines, 'at': a.at + 278 * size / 1000 + w.at}} ELSE {{'lines': a.lines + 1 + greatest(0, ceil(w.at / 66) - 1), 'at': w.at}} END) AS f FROM notes_w, sizes),
heights AS (SELECT book, seq, size, f.lines * (size + 4) + 8 AS height FROM folded)"""


@query("estimate_note_height", f"WITH {B.ANN}, {WRAPPED} SELECT book, seq, round(height, 6) AS height FROM heights WHERE size = 8")
def estimate_note_height(spark, d):
    return B.annotations(spark, d).select("book", "seq", F.round(place.estimate_note_height(F.col("annotation"), F.lit(72.0), F.lit(8.0)), 6).alias("height"))


@query("note_fontsize", f"WITH {B.ANN}, {WRAPPED} SELECT book, seq, coalesce(max(size) FILTER (height + 4 <= 792 * 0.35), 6) AS size FROM heights GROUP BY book, seq")
def note_fontsize(spark, d):
    return B.annotations(spark, d).select("book", "seq", place.note_fontsize(F.col("annotation"), F.lit(72.0), F.lit(792.0)).alias("size"))


@query("merge_line_rects")
def merge_line_rects(spark, d):
    rects = B.words(spark, d).groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("r"))
    return rects.select("book", "page", F.posexplode(place.merge_line_rects(F.col("r"))).alias("ix", "m")).select("book", "page", "ix", "m.*")


@query("place_notes")
def place_notes(spark, d):
    rows = B.annotations(spark, d).filter("page <= end_page")
    size = place.estimate_note_height(F.col("annotation"), F.lit(72.0), F.lit(8.0)) + 4
    return place.place_notes(rows.select("book", "page", "seq", F.lit(534.0).alias("x0"), F.lit(606.0).alias("x1"), (72.0 + 14 * (F.col("seq") % 3)).alias("y"), size.alias("height"), F.lit(792.0).alias("page_height")))


def _marked(spark, d):
    notes = B.annotations(spark, d).select((F.col("book") * 100000 + F.col("seq")).alias("target_id"), "chapter_number", "annotation")
    pages = B.conv_pages(spark, d)
    targets = B.targets(spark, d).join(notes, "target_id")
    return draw.marked(place.find_quotes(targets, pages, B.words(spark, d), B.books_of(pages)), B.words(spark, d), B.page_sizes(spark, d))


NOTED = FOUND + f""", said AS (SELECT book * 100000 + seq AS target_id, CASE WHEN {NOTE} NOT IN ('', '[UNKNOWN]') THEN {NOTE} END AS note FROM ann),
marked AS (SELECT p.target_id, p.book, found_page, method, start, stop, coalesce(reason, CASE WHEN start IS NULL THEN 'highlight_failed' END) AS reason, CASE WHEN reason IS NULL AND start IS NOT NULL THEN note END AS note FROM placed p JOIN said USING (target_id))"""


@query("save_report", f"WITH {NOTED}, lined AS (SELECT m.*, stop - start AS rect_count FROM marked m) SELECT book, count(*) FILTER (reason IS NULL) AS highlighted_count, count(note) AS notes_count, count(reason) AS miss_count, coalesce(string_agg(method || ':' || rect_count || ':' || (note IS NOT NULL), ',' ORDER BY target_id) FILTER (reason IS NULL), '') AS hits, coalesce(string_agg(reason, ',' ORDER BY target_id) FILTER (reason IS NOT NULL), '') AS misses FROM lined GROUP BY book")
def save_report(spark, d):
    """The reports, read back from their JSON."""
    hit, miss = "array<struct<rect_count:int,method:string,note_added:string>>", "array<struct<reason:string>>"
    r = draw.report_json(_marked(spark, d)).select("book", F.from_json("json", f"highlighted_count bigint, notes_count bigint, miss_count bigint, hits {hit}, misses {miss}").alias("r")).select("book", "r.*")
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["method"], h["rect_count"].cast("string"), h["note_added"])), ",")
    return r.select("book", "highlighted_count", "notes_count", "miss_count", hits.alias("hits"), F.array_join("misses.reason", ",").alias("misses"))


@query("draw_rows")
def draw_rows(spark, d):
    """Tests compare the rows with a plain drawing of a small page."""
    rows = draw.draw_rows(_marked(spark, d), B.words(spark, d), B.page_sizes(spark, d))
    return rows.withColumn("fill", F.array_join("fill", ",")).withColumn("border", F.array_join("border", ","))


# ---- the model's boundary


#: Sections of two pages; some are not selected, some fail for good (see provider.unsteady()) and stop their book.
RUN_SEC = """sec AS (SELECT book, (page - 1) // 2 + 1 AS number, min(page) AS start_page, max(page) AS end_page FROM conv GROUP BY ALL), picked AS (SELECT * FROM sec WHERE NOT (book % 4 = 0 AND number = 3)),
stops AS (SELECT book, min(number) AS stop FROM picked WHERE (book + number) % 7 = 6 GROUP BY book), done AS (SELECT p.* FROM picked p LEFT JOIN stops USING (book) WHERE stop IS NULL OR number < stop),
told AS (SELECT c.book, d.number, c.page, string_split(""" + sql_norm("text") + """, ' ') AS w FROM conv c JOIN done d ON d.book = c.book AND c.page BETWEEN d.start_page AND d.end_page WHERE """ + sql_norm("text") + """ <> ''),
notes AS (SELECT book, number, page, array_to_string(w[:8], ' ') AS quote, CASE WHEN len(w[3:10]) > 0 AND w[3:10] <> w[:8] THEN 2 ELSE 1 END AS n FROM told)"""


def _run_inputs(spark, d):
    pages = B.conv_pages(spark, d)
    numbered = pages.select("book", (F.floor((F.col("page") - 1) / 2) + 1).alias("number"), "page")
    secs = numbered.groupBy("book", "number").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page")).withColumn("title", F.concat(F.lit("Part "), F.col("number").cast("string")))
    books = B.conv_sections(pages).select("book", F.concat(F.lit("Book "), F.col("book").cast("string")).alias("title"), F.lit("").alias("author"), F.concat(F.lit("f"), F.col("book").cast("string"), F.lit(".pdf")).alias("source_filename"))
    selected = secs.filter("not (book % 4 = 0 and number = 3)").select("book", "number")
    return pages, books, secs, selected.unionByName(books.select("book", F.lit(99).cast("long").alias("number")))


def _run(spark, d):
    return run.run_pipeline(*_run_inputs(spark, d), provider.unsteady)


@query("annotate_range", f"WITH {B.CONV}, one AS (SELECT book, 1::BIGINT AS number, string_split({sql_norm('text')}, ' ') AS w FROM conv WHERE {sql_norm('text')} <> ''), n AS (SELECT book, number, CASE WHEN len(w[3:10]) > 0 AND w[3:10] <> w[:8] THEN 2 ELSE 1 END AS n FROM one) SELECT book, number, sum(n)::INTEGER AS notes, 'completed' AS status, 1 AS attempts, 'All' AS chapter_title, s.end_page FROM n JOIN conv_sec s USING (book) GROUP BY ALL")
def annotate_range(spark, d):
    """The offline stand-in answers every book as one section; number, title and pages are put right."""
    pages, secs = _conv_numbered(spark, d)
    books = _run_inputs(spark, d)[1]
    answers = provider.annotate(run.requests(pages, books, secs, secs), provider.first_words)
    return answers.select(
        "book", "number", F.json_array_length(F.get_json_object("response", "$.annotations")).alias("notes"), "status", "attempts", F.get_json_object("response", "$.chapter_title").alias("chapter_title"), F.get_json_object("response", "$.end_page").cast("long").alias("end_page")
    )


@query("retry_loop", f"""WITH {B.CONV}, {RUN_SEC} SELECT book, number, CASE WHEN (book + number) % 7 = 6 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN (book + number) % 7 = 6 THEN 3 WHEN (book + number) % 5 = 4 THEN 2 ELSE 1 END AS attempts,
  CASE WHEN (book + number) % 7 = 6 THEN 'call failed: the answer is not an object' ELSE '' END AS errors FROM picked""")
def retry_loop(spark, d):
    pages, books, secs, selected = _run_inputs(spark, d)
    answers = provider.annotate(run.requests(pages, books, secs, secs.join(selected, ["book", "number"])), provider.unsteady)
    return answers.select("book", "number", "status", "attempts", F.array_join("errors", "|").alias("errors"))


@query("run_pipeline", f"WITH {B.CONV}, {RUN_SEC} SELECT book, number AS chapter_number, row_number() OVER (PARTITION BY book, number ORDER BY page) AS seq, page, quote AS book_text, 'The page opens with these words' AS annotation, 'CONTEXT' AS category, 'source_fact' AS grounding, CASE WHEN page % 2 = 1 THEN 'category_invalid' ELSE '' END AS validation_flags FROM notes")
def run_pipeline(spark, d):
    """The validated notes of a run with one note a page."""
    return _run(spark, d).notes.select("book", "chapter_number", "seq", "page", "book_text", "annotation", "category", "grounding", flat())


@query("run_summary", f"""WITH {B.CONV}, {RUN_SEC}, n AS (SELECT book, count(*) FILTER (page % 2 = 1) AS flagged_rows, (sum(n) - count(*))::BIGINT AS trimmed FROM notes GROUP BY book)
SELECT book, 'Book ' || book AS title, array_to_string(list_sort(list(number)), ',') AS requested, coalesce(array_to_string(list_sort(list(number) FILTER (stop IS NULL OR number < stop)), ','), '') AS completed, any_value(stop) AS chapter_failed,
  coalesce(any_value(flagged_rows), 0) AS flagged_rows, coalesce(any_value(trimmed), 0) AS trimmed FROM picked LEFT JOIN stops USING (book) LEFT JOIN n USING (book) GROUP BY book""")
def run_summary(spark, d):
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return _run(spark, d).summary.select("book", "title", listed("chapters_requested").alias("requested"), listed("chapters_completed").alias("completed"), "chapter_failed", "flagged_rows", "trimmed")


@query("run_master", f"""WITH {B.CONV}, {RUN_SEC}, c AS (SELECT d.book, d.number, d.start_page, d.end_page, count(quote) AS n, coalesce(string_agg(quote, '|' ORDER BY page), '') AS quotes FROM done d LEFT JOIN notes USING (book, number) GROUP BY ALL)
SELECT book, 'Book ' || book AS name, row_number() OVER (PARTITION BY book ORDER BY number)::INTEGER - 1 AS ix, number AS chapter_number, 'Part ' || number AS chapter_title, start_page, end_page, 'f' || book || '.pdf' AS source_filename, n::INTEGER AS n, quotes FROM c""")
def run_master(spark, d):
    """The masters' chapters, read back from their JSON."""
    note = "struct<chapter_number:bigint,chapter_title:string,start_page:bigint,end_page:bigint,source_filename:string,annotations:array<struct<book_text:string>>>"
    masters = _run(spark, d).masters()
    parts = masters.select("book", F.get_json_object("json", "$.book").alias("name"), F.posexplode(F.from_json(F.get_json_object("json", "$.chapters"), f"array<{note}>")).alias("ix", "c"))
    return parts.select("book", "name", "ix", "c.chapter_number", "c.chapter_title", "c.start_page", "c.end_page", "c.source_filename", F.size("c.annotations").alias("n"), F.array_join("c.annotations.book_text", "|").alias("quotes"))


@query("failed_responses", f"WITH {B.CONV}, {RUN_SEC} SELECT book, number AS chapter_number, unnest(CASE WHEN (book + number) % 7 = 6 THEN [1, 2, 3] WHEN (book + number) % 5 = 4 THEN [1] ELSE [] END)::INTEGER AS attempt FROM picked LEFT JOIN stops USING (book) WHERE stop IS NULL OR number <= stop")
def failed_responses(spark, d):
    return _run(spark, d).failed_responses().select("book", "chapter_number", "attempt")


# ---- single rules, each by its own name


@query("density_tier", f"WITH {B.SRC}, {GRID} SELECT DISTINCT qpp, CASE WHEN qpp <= 2 THEN 'selective' WHEN qpp <= 5 THEN 'balanced' ELSE 'dense' END AS tier FROM grid")
def density_tier(spark, d):
    return _grid(spark, d).select("qpp", estimate.density_tier(F.col("qpp")).alias("tier")).distinct()


@query("skip_quality", "SELECT conv_id AS book, (count(*) * 20)::BIGINT AS pages, count(*) * 20 >= 100 AS skip FROM conversations GROUP BY conv_id")
def skip_quality(spark, d):
    return B.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("book")).agg((F.count("*") * 20).alias("pages")).withColumn("skip", estimate.skip_quality(F.col("pages")))


@query("dense_high_warn", f"WITH {B.SRC}, {GRID} SELECT DISTINCT qpp, quality, qpp > 2 AND quality = 'high' AS warn FROM grid")
def dense_high_warn(spark, d):
    return _grid(spark, d).select("qpp", "quality", estimate.dense_high_warn(F.col("qpp"), F.col("quality")).alias("warn")).distinct()


@query("over_budget", "SELECT doc_id, round(n_chars * 100 / 1e6 * 0.4 + n_chars * 200 / 1e6 * 1.2, 9) > 0.75 AS is_over FROM documents")
def over_budget(spark, d):
    price = estimate.cost(F.col("n_chars") * 100, F.col("n_chars") * 200)
    return _documents(spark, d).select("doc_id", (F.round(price, 9) > C.BUDGET_WARNING).alias("is_over"))


@query("expected_annotations", f"WITH {B.SRC}, {GRID} SELECT DISTINCT book, qpp, pages * qpp AS expected FROM grid")
def expected_annotations(spark, d):
    return _grid(spark, d).select("book", "qpp", (F.col("pages") * F.col("qpp")).alias("expected")).distinct()


@query("quality_label", f"WITH {B.SRC}, {GRID} SELECT DISTINCT quality, upper(quality[1]) || quality[2:] AS label FROM grid")
def quality_label(spark, d):
    return _grid(spark, d).select("quality", F.initcap("quality").alias("label")).distinct()


@query("format_int", "SELECT doc_id, format('{:,}', n_chars * 1000) AS n FROM documents")
def format_int(spark, d):
    return _documents(spark, d).select("doc_id", F.format_number(F.col("n_chars") * 1000, 0).alias("n"))


@query("count_tokens", "SELECT doc_id, ((length(text) + 3) // 4)::BIGINT AS tokens FROM documents")
def count_tokens(spark, d):
    return _documents(spark, d).select("doc_id", T.estimated_tokens("text").alias("tokens"))


@query("usable_note", f"WITH {B.ANN} SELECT book, seq, CASE WHEN {NOTE} NOT IN ('', '[UNKNOWN]') THEN {NOTE} END AS note, {sql_strip('book_text')} IN ('', '[UNKNOWN]') AS is_skipped FROM ann")
def usable_note(spark, d):
    return B.annotations(spark, d).select("book", "seq", place.usable_note(F.col("annotation")).alias("note"), (~T.verified_quote("book_text")).alias("is_skipped"))


@query("row_to_target", f"WITH {B.ANN} SELECT book, seq, page::INTEGER AS page, book_text, annotation, nullif(CASE WHEN seq % 3 = 0 THEN '' ELSE category END, '') AS annotation_type FROM ann WHERE {TARGETS} AND page >= 1")
def row_to_target(spark, d):
    kind = F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("category"))
    return files.row_to_target(B.annotations(spark, d).select("book", "seq", F.col("page").cast("string").alias("page"), "book_text", "annotation", kind.alias("annotation_type")))


STATUS_GRID = "g AS (SELECT a, b, m FROM (SELECT unnest(range(0, 6)) AS a), (SELECT unnest(range(0, 6)) AS b), (SELECT unnest(range(0, 6)) AS m) WHERE m <= a AND m <= b)"


def _status_grid(spark):
    n = lambda name: spark.range(6).withColumnRenamed("id", name)  # noqa: E731  six rows each
    return n("a").crossJoin(n("b")).crossJoin(n("m")).filter("m <= a and m <= b")


@query("page_status", f"WITH {STATUS_GRID} SELECT a, b, m, CASE WHEN a + b = 0 THEN 'EMPTY' WHEN m = 0 THEN 'NO_MATCH' WHEN m = a AND m = b THEN 'MATCH' ELSE 'PARTIAL' END AS status FROM g")
def page_status(spark, d):
    return _status_grid(spark).withColumn("status", compare.page_status(F.col("m"), F.col("a"), F.col("b")))


@query("dice_percent", f"WITH {STATUS_GRID} SELECT a, b, m, round(CASE WHEN a = 0 AND b = 0 THEN 100 WHEN a = 0 OR b = 0 THEN 0 ELSE 200.0::DOUBLE * m / (a + b) END, 6) AS dice FROM g")
def dice_percent(spark, d):
    return _status_grid(spark).withColumn("dice", F.round(compare.dice_percent(F.col("m"), F.col("a"), F.col("b")), 6))


@query("retry_message", f"WITH {B.CONV} SELECT book, CASE WHEN end_page > 2 THEN 'm' || chr(10) || chr(10) || 'Correct these:' || chr(10) || array_to_string(list_transform(range(0, least(20, end_page * 4)), lambda x: '- e' || x), chr(10)) ELSE 'm' END AS message FROM conv_sec")
def retry_message(spark, d):
    sections_ = B.conv_sections(B.conv_pages(spark, d))
    errors = F.when(F.col("end_page") > 2, F.transform(F.sequence(F.lit(0).cast("long"), F.col("end_page") * 4 - 1), lambda x: F.concat(F.lit("e"), x.cast("string")))).otherwise(F.array().cast("array<string>"))
    return sections_.select("book", estimate.retry_message(F.lit("m"), errors).alias("message"))


FRAME = f"""heads AS (SELECT book, 'The document (context; not to be quoted from here)' || chr(10) || 'Title: Book ' || book || chr(10) || 'Author: unavailable' || chr(10) || 'Sections:' || chr(10) || '- 1. All (pages 1 to ' || end_page || ')' || chr(10) || chr(10) || 'Opening text:' AS head FROM conv_sec),
blocks AS (SELECT book, page, head, '=== PAGE ' || page || ' ===' || chr(10) || text || chr(10) AS block FROM conv JOIN heads USING (book) WHERE page <= 8 AND {sql_strip('text')} NOT IN ('', '[NO TEXT FOUND]')),
running AS (SELECT *, sum((length(block) + 3) // 4) OVER (PARTITION BY book ORDER BY page) + (length(head) + 3) // 4 AS used FROM blocks),
frames AS (SELECT h.book, h.head || chr(10) || coalesce(string_agg(block, chr(10) ORDER BY page), 'unavailable') AS frame FROM heads h LEFT JOIN running r ON r.book = h.book AND used <= 1500 GROUP BY h.book, h.head)"""


def _frames(spark, d):
    pages, secs = _conv_numbered(spark, d)
    return estimate.document_frame(_run_inputs(spark, d)[1], secs, pages)


@query("document_frame", f"WITH {B.CONV}, {FRAME} SELECT book, md5(frame) AS frame FROM frames")
def document_frame(spark, d):
    return _frames(spark, d).select("book", F.md5("frame").alias("frame"))


@query("user_message", f"""WITH {B.CONV}, {FRAME}
SELECT c.book, c.page AS chunk_ix, md5(frame || chr(10) || chr(10) || CASE WHEN coalesce(p.text, '') = '' THEN '' ELSE 'The page before (context; not to be quoted)' || chr(10) || chr(10) || '=== PAGE ' || p.page || ' ===' || chr(10) || chr(10) || p.text || chr(10) || chr(10) END
  || 'The pages to read; every quote is copied from one of them' || chr(10) || chr(10) || 'Section 1: All' || chr(10) || 'Pages ' || c.page || ' to ' || c.page || chr(10) || chr(10) || 'Notes a page: at most 3; quality: medium; notes in all: at most 3' || chr(10) || chr(10) || c.text) AS message
FROM conv c JOIN frames f USING (book) LEFT JOIN conv p ON p.book = c.book AND p.page = c.page - 1""")
def user_message(spark, d):
    pages = B.conv_pages(spark, d)
    before = pages.select("book", (F.col("page") + 1).alias("page"), F.col("page").alias("overlap_page"), F.col("text").alias("overlap_text"))
    page = F.col("page")
    chunks = pages.join(before, ["book", "page"], "left").select("book", F.lit(1).alias("number"), page.alias("chunk_ix"), F.lit("All").alias("title"), page.alias("chunk_start"), page.alias("chunk_end"), "overlap_page", "overlap_text", "text")
    return estimate.user_message(chunks, _frames(spark, d), 3).select("book", "chunk_ix", F.md5("message").alias("message"))


@query("first_misses", f"WITH {B.ANN}, {TARGET}, m AS (SELECT book, target_id, row_number() OVER (PARTITION BY book ORDER BY target_id) AS rank FROM target JOIN conv_sec USING (book) WHERE page > end_page) SELECT book, target_id, rank::INTEGER AS rank FROM m WHERE rank <= 10")
def first_misses(spark, d):
    ranged = place.target_page_range(B.targets(spark, d), B.books_of(B.conv_pages(spark, d)))
    return estimate.first_misses(ranged).select("book", "target_id", "rank")


@query("structure_report", f"WITH {B.CONV} SELECT count(*) AS answers, count(*) FILTER (book % 10 IN (1, 2, 3)) AS unusable FROM conv_sec")
def structure_report(spark, d):
    checked = verify.structure_hard(_responses(spark, d))
    return checked.agg(F.count("*").alias("answers"), F.count_if(verify.blocking_errors(F.col("errors"))).alias("unusable"))
