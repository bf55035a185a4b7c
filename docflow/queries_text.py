"""Queries of parsers, predicates and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.fixtures import LANGS, RE_BLANK, SEG, segments, sql_blank, sql_trim, table
from docflow.functions import text as T
from docflow.functions import values as V
from docflow.operators import chunker as C
from docflow.operators import generators as G

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


STOP = ".?!;。？！；"


def segment_sql(text: str, limit: int = 1800) -> str:
    """DuckDB expression: segments of a text."""
    parts = f"regexp_extract_all({text}, '[^{STOP}]*[{STOP}]|[^{STOP}]+')"
    cur = sql_trim("a.cur")
    s = sql_trim("x.s")
    flush = f"(a.cur <> '' AND length(a.cur) + length(x.s) > {limit})"
    pack = f"""list_reduce(list_transform({parts}, lambda s: {{'done': CAST([] AS VARCHAR[]), 'cur': '', 's': s}}),
      lambda a, x: {{'done': CASE WHEN {flush} THEN list_append(a.done, {cur}) ELSE a.done END,
        'cur': CASE WHEN {flush} OR a.cur = '' THEN {s} ELSE a.cur || ' ' || {s} END, 's': ''}}, {{'done': CAST([] AS VARCHAR[]), 'cur': '', 's': ''}})"""
    return f"CASE WHEN length({text}) <= {limit} THEN [{sql_trim(text)}] ELSE list_append(({pack}).done, {sql_trim(f'({pack}).cur')}) END"


SEGMENTS = f"parts AS (SELECT doc_id, lang, source, {segment_sql('text')} AS segs FROM documents), one AS (SELECT doc_id, lang, source, unnest(segs) AS s, generate_subscripts(segs, 1) AS i FROM parts)"


@query(f"""WITH {SEGMENTS} SELECT lang, count(DISTINCT doc_id) AS documents, count(*) AS segments, count(*) / count(DISTINCT doc_id) AS mean_segments, max(length(s)) AS longest FROM one GROUP BY lang""")
def flagship_segment_rollup(spark, d):
    """GEN-03, AGG: documents to segments to a roll-up by language."""
    per = docs(spark, d).select("lang", G.segments(F.col("text")).alias("segs"))
    per = per.select("lang", F.size("segs").alias("n"), F.array_max(F.transform("segs", F.length)).alias("longest"))
    return per.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("segments"), (F.sum("n") / F.count(F.lit(1))).alias("mean_segments"), F.max("longest").alias("longest"))


@query(f"WITH {SEGMENTS} SELECT doc_id, i AS segment_index, CAST(doc_id AS VARCHAR) || '-segment-' || i AS segment_id, s AS source_text FROM one")
def gen_03_05_segments(spark, d):
    at = docs(spark, d).select("doc_id", F.posexplode(G.segments(F.col("text"))).alias("i", "source_text"))
    return at.select("doc_id", (F.col("i") + 1).alias("segment_index"), F.concat(F.col("doc_id").cast("string"), F.lit("-segment-"), (F.col("i") + 1).cast("string")).alias("segment_id"), "source_text")


@query(f"WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^{STOP}]*[{STOP}]|[^{STOP}]+') AS s FROM documents) SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM p")
def gen_04_sentences(spark, d):
    return docs(spark, d).select("doc_id", G.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.array_max(F.transform("s", F.length)).alias("longest"))


_SPACED = "replace(text, chr(10), chr(10) || chr(10))"
_PAR = f"l AS (SELECT doc_id, unnest(string_split({_SPACED}, chr(10))) AS line, generate_subscripts(string_split({_SPACED}, chr(10)), 1) AS n FROM documents), b AS (SELECT *, sum(CASE WHEN {sql_blank('line')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l), g AS (SELECT doc_id, island, {sql_trim('string_agg(line, chr(10) ORDER BY n)')} AS text FROM b WHERE NOT ({sql_blank('line')}) GROUP BY ALL)"


@query(f"WITH {_PAR} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS paragraph, text FROM g")
def gen_01_paragraphs(spark, d):
    spaced = docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return spaced.select("doc_id", F.posexplode(G.paragraphs(F.col("text"))).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("paragraph"), "text")


@query(f"WITH {_PAR} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS paragraph, text FROM g")
def win_10_paragraph_islands(spark, d):
    return G.paragraph_islands(docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))


_MARKED = "list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 9 WHEN 0 THEN '# ' || x WHEN 1 THEN '- ' || x WHEN 2 THEN '> ' || x WHEN 3 THEN '1. ' || x WHEN 6 THEN '' WHEN 7 THEN '```' ELSE x END)"


def marked(spark, d):
    """Documents as Markdown: each line gets a mark by its number; every ninth pair of fences wraps one."""
    kind = lambda i: i % 9
    line = lambda x, i: F.when(kind(i) == 0, F.concat(F.lit("# "), x)).when(kind(i) == 1, F.concat(F.lit("- "), x)).when(kind(i) == 2, F.concat(F.lit("> "), x)).when(kind(i) == 3, F.concat(F.lit("1. "), x)).when(kind(i) == 6, F.lit("")).when(kind(i) == 7, F.lit("```")).otherwise(x)
    return docs(spark, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


_MD = f"""m AS (SELECT doc_id, {_MARKED} AS ls FROM documents), l0 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS total FROM m), l AS (SELECT * FROM l0 WHERE NOT (n = total AND line = '')),
f AS (SELECT *, CASE WHEN starts_with({sql_trim('line')}, '```') THEN 1 ELSE 0 END AS fence, sum(CASE WHEN starts_with({sql_trim('line')}, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM l),
k AS (SELECT *, CASE WHEN fence = 1 OR fences % 2 = 1 THEN 'code' WHEN {sql_blank('line')} THEN 'metadata' WHEN regexp_matches({sql_trim('line')} || ' ', '^#{{1,6}} ') AND regexp_matches(line, '^[{RE_BLANK}]*#{{1,6}} ') THEN 'heading'
  WHEN regexp_matches(line, '^[{RE_BLANK}]*([-*+]|[0-9]*\\.) ') THEN 'list_item' WHEN regexp_matches(line, '^[{RE_BLANK}]*>') THEN 'blockquote' WHEN regexp_matches({sql_trim('line')}, '^https?://[^{RE_BLANK}]*$') THEN 'url' ELSE 'paragraph' END AS kind FROM f),
g AS (SELECT *, CASE WHEN kind = 'code' THEN 'c' || ((fences + 1) // 2) WHEN kind = 'paragraph' THEN 'p' || (n - row_number() OVER (PARTITION BY doc_id, kind ORDER BY n)) ELSE 'o' || n END AS grp FROM k),
h AS (SELECT doc_id, any_value(kind) AS block_type, min(n) AS n, string_agg(line, chr(10) ORDER BY n) AS raw FROM g GROUP BY doc_id, grp)"""


@query(f"""WITH {_MD} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS block_order, block_type,
  CASE block_type WHEN 'code' THEN raw WHEN 'metadata' THEN '' WHEN 'heading' THEN {sql_trim("regexp_replace(raw, '^[" + RE_BLANK + "]*#+', '')")} WHEN 'list_item' THEN {sql_trim("regexp_replace(raw, '^[" + RE_BLANK + "]*([-*+]|[0-9]*\\.) ', '')")} WHEN 'blockquote' THEN {sql_trim("substr(" + sql_trim('raw') + ", 2)")} ELSE {sql_trim('raw')} END AS source_text,
  block_type NOT IN ('code', 'metadata', 'url') AS translate FROM h""")
def gen_02_markdown_blocks(spark, d):
    return G.parse(marked(spark, d), F.lit("markdown")).select("doc_id", "block_order", "block_type", "source_text", "translate")


@query()
def gen_06_pdf_chunks(spark, d):
    """GEN-06/07/08/11/12: prompt-sized chunks; numpy single-precision estimate, so no SQL."""
    at = docs(spark, d).select("doc_id", F.posexplode(C.chunk_column(F.col("text"), "standard")).alias("chunk_no", "chunk"))
    return at.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), "chunk")


@query()
def gen_09_retry_chunks(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(C.chunk_column(F.col("text"), "retry")).alias("chunk_no", "chunk"))


@query()
def gen_13_prepared_batch(spark, d):
    return C.prepare_batch(docs(spark, d).select("doc_id", "text"))


@query(f"""WITH r AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: '[' || i || '] ' || x) AS items FROM documents)
SELECT doc_id, CASE WHEN len(items) < 2 THEN CAST([] AS VARCHAR[]) ELSE list_transform(items, lambda x: {sql_trim('x')}) END AS items FROM r""")
def gen_10_reference_items(spark, d):
    numbered = docs(spark, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n").alias("text"))
    return numbered.select("doc_id", G.reference_items(F.col("text")).alias("items"))


_SEL = "CAST(doc_id % 5 + 1 AS VARCHAR) || '-' || CAST(doc_id % 5 + 1 + doc_id % 4 AS VARCHAR) || ', ' || CAST(doc_id % 9 + 1 AS VARCHAR) || ',3'"
_PAGES_SQL = "list_sort(list_distinct(list_concat(range(doc_id % 5 + 1, doc_id % 5 + 2 + doc_id % 4), [doc_id % 9 + 1, 3])))"


def selections(spark, d):
    n = lambda x: (x).cast("string")
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", F.concat(n(i % 5 + 1), F.lit("-"), n(i % 5 + 1 + i % 4), F.lit(", "), n(i % 9 + 1), F.lit(",3")).alias("sel"))


@query(f"SELECT doc_id, {_PAGES_SQL} AS pages FROM documents")
def gen_14_strict_selection(spark, d):
    return selections(spark, d).select("doc_id", V.selected_pages(F.col("sel"), F.lit(12)).alias("pages"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN range(1, 6) ELSE list_filter({_PAGES_SQL}, lambda p: p <= 5) END AS pages FROM documents")
def gen_15_lenient_selection(spark, d):
    sel = selections(spark, d).withColumn("sel", F.when(F.col("doc_id") % 10 == 0, "all").otherwise(F.concat("sel", F.lit(",x, 9-7"))))
    return sel.select("doc_id", V.selected_pages(F.col("sel"), F.lit(5), strict=False).alias("pages"))


@query(f"WITH p AS (SELECT doc_id, unnest({_PAGES_SQL}) AS p FROM documents), i AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM p), r AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM i GROUP BY doc_id, g) SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS selection FROM r GROUP BY doc_id")
def str_25_selection_text(spark, d):
    return selections(spark, d).select("doc_id", V.selection_text(V.selected_pages(F.col("sel"), F.lit(12))).alias("selection"))


@query("SELECT doc_id, CASE WHEN n <= 0 THEN CAST([] AS BIGINT[]) WHEN n <= 30 THEN range(1, n + 1) ELSE range(1, 11) END AS pages, n > 50 AS confirm FROM (SELECT doc_id, doc_id % 60 AS n FROM documents)")
def gen_19_default_pages(spark, d):
    n = (F.col("doc_id") % 60).cast("int")
    return docs(spark, d).select("doc_id", V.default_pages(n).alias("pages"), V.confirm_long(n).alias("confirm"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations")
def gen_20_win_03_fixed_chunks(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", G.chunks_of(F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")), 3).alias("chunk"))


@query("SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def gen_16_flattened_texts(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("xs"))
    return c.select("conv_id", F.transform("xs", lambda x: x["text"]).alias("texts"))


def _clean_sql(x: str) -> str:
    for m in ".,!?;:。，、！？；：":
        x = f"regexp_replace({x}, '[{m}]([{RE_BLANK}]*[{m}])+', '{m}', 'g')"
    return x


@query(f"SELECT doc_id, {_clean_sql('text')} AS clean FROM documents")
def str_01_clean_repeats(spark, d):
    return docs(spark, d).select("doc_id", T.clean_repeats(F.col("text")).alias("clean"))


def _unbroken(x: str) -> str:
    return f"regexp_replace({x}, '([A-Za-z])-[{RE_BLANK}]*([a-z])', '\\1\\2', 'g')"


@query("SELECT doc_id, " + sql_trim(f"regexp_replace({_unbroken(_unbroken('t'))}, '[{RE_BLANK}]+', ' ', 'g')") + " AS clean FROM (SELECT doc_id, replace(text, 'th', 'th-') AS t FROM documents)")
def str_02_unhyphenate(spark, d):
    t = docs(spark, d).select("doc_id", F.replace("text", F.lit("th"), F.lit("th-")).alias("text"))
    return t.select("doc_id", T.unhyphenate(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, CAST(ceil((1200 + 10 * b + 25 * w + 35 * (length(t) - b - w - o) + 100 * o) / 100) AS INTEGER) AS tokens FROM (SELECT doc_id, t, length(t) - length(regexp_replace(t, '[\t\n\f\r ]', '', 'g')) AS b, length(t) - length(regexp_replace(t, '[A-Za-z0-9]', '', 'g')) AS w, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS o FROM (SELECT doc_id, text AS t FROM documents))")
def str_03_token_estimate(spark, d):
    return docs(spark, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(url, '\.txt$', '') AS u FROM pages), c AS (SELECT page_id, left(trim(regexp_replace(regexp_replace(u, '[/\\:*?"<>|\x00-\x1F]', ' ', 'g'), ' +', ' ', 'g')), 80) AS s FROM t) SELECT page_id, CASE WHEN s = '' THEN 'Untitled' ELSE s END AS stem FROM c""")
def str_04_file_stem(spark, d):
    return table(spark, d, "pages").select("page_id", T.file_stem(F.col("url")).alias("stem"))


_ID = "CASE WHEN {0} = '' THEN 'item' ELSE {0} END"
_COMP = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g')"


@query("SELECT page_id, 'tr-' || " + _ID.format(_COMP.format("url")) + " || '-zh-cn' AS file_id FROM pages")
def str_05_translation_file_id(spark, d):
    return table(spark, d, "pages").select("page_id", T.translation_file_id(F.col("url"), F.lit("zh-CN")).alias("file_id"))


@query("SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS dir, 'translated-pages/' || CASE WHEN s = '' THEN 'unknown' ELSE s END || '/page-' || lpad(CAST(page_id % 9000 AS VARCHAR), 4, '0') || '.pdf' AS path, CAST(page_id % 9000 AS INTEGER) AS page FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)")
def str_06_07_08_page_paths(spark, d):
    p = table(spark, d, "pages")
    path = T.page_path(F.col("url"), F.col("page_id") % 9000)
    return p.select("page_id", T.language_dir(F.col("url")).alias("dir"), path.alias("path"), T.page_of_path(path).alias("page"))


_LANG_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + " ELSE 'English' END"


@query(f"SELECT doc_id, {_LANG_CASE.format('lang')} || ': ' || {_clean_sql('text')} || chr(10) || chr(10) || {_LANG_CASE.format(LANGS)} || ':' AS prompt, [chr(10) || chr(10) || {_LANG_CASE.format('lang')} || ':', chr(10) || chr(10) || {_LANG_CASE.format(LANGS)} || ':'] AS stops FROM documents")
def str_09_10_prompt(spark, d):
    x = docs(spark, d).withColumn("target", F.expr(LANGS))
    return x.select("doc_id", T.prompt(F.col("text"), F.col("lang"), F.col("target")).alias("prompt"), T.stop_sequences(T.language_name(F.col("lang")), T.language_name(F.col("target"))).alias("stops"))


@query(f"SELECT doc_id, {sql_trim('text')} AS answer FROM documents")
def str_11_after_role(spark, d):
    reply = F.concat(F.lit("thinking"), F.lit("\nAssistant:"), F.col("text"))
    return docs(spark, d).select("doc_id", T.after_role(reply, F.lit("Assistant")).alias("answer"))


@query("SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def str_12_last_user_message(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", T.message_text(F.col("m")).alias("text")).where("text is not null")


@query("SELECT doc_id, replace(replace(left(replace(text, 'the', '<redacted>'), 400), chr(10), '\\n'), chr(13), '\\r') AS preview FROM documents")
def str_13_preview(spark, d):
    return docs(spark, d).select("doc_id", T.preview(T.redact(F.col("text"), ["the", ""])).alias("preview"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN array_to_string(p, ' ') ELSE array_to_string(p, '') END AS joined FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS p FROM documents)")
def str_14_15_joined_chunks(spark, d):
    return docs(spark, d).select("doc_id", T.join_chunks(F.split("text", "\n"), F.expr(LANGS)).alias("joined"))


@query("SELECT page_id, f || '.' || CASE WHEN page_id % 2 = 0 THEN 'ja.bilingual' ELSE 'ja' END || '.' || CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' ELSE 'txt' END AS name, regexp_replace(trim(url), '/+$', '') || '/v1/x' AS api FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '(?i)\\.(txt|md|markdown|pdf)$', '') AS f FROM pages)")
def str_18_19_export_name(spark, d):
    i = F.col("page_id")
    fmt = F.when(i % 3 == 0, "pdf").when(i % 3 == 1, "markdown").otherwise("txt")
    return table(spark, d, "pages").select("page_id", T.export_name(F.col("url"), fmt, F.lit("ja"), F.when(i % 2 == 0, "bilingual").otherwise("translation")).alias("name"), T.url_join(F.col("url"), F.lit("/v1/x")).alias("api"))


@query("SELECT event_id, CASE WHEN event_id % 50 <= 40 THEN event_id % 50 END AS done, CASE WHEN event_id % 50 <= 40 THEN 40 END AS total, least(event_id % 140, 100) AS pct FROM events")
def str_20_progress(spark, d):
    i = F.col("event_id")
    line = F.concat((i % 140).cast("string"), F.lit("%| x | "), (i % 50).cast("string"), F.lit("/40 [00:01"))
    return table(spark, d, "events").select("event_id", T.progress_fraction(line)["done"].alias("done"), T.progress_fraction(line)["total"].alias("total"), T.percent(line).alias("pct"))


_VER = "CAST(event_id % 3 AS VARCHAR) || '.' || CAST(event_id % 11 AS VARCHAR) || '.' || CAST(event_id % 7 AS VARCHAR) || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-alpha.' || CAST(event_id % 12 AS VARCHAR) WHEN 2 THEN '-2' ELSE '-alpha' END"


@query(f"SELECT event_type, max_by(v, (event_id % 3) * 1000000 + (event_id % 11) * 10000 + (event_id % 7) * 100 + CASE event_id % 4 WHEN 0 THEN 50 WHEN 1 THEN 20 + event_id % 12 WHEN 2 THEN 1 ELSE 10 END) AS newest FROM (SELECT event_type, event_id, {_VER} AS v FROM events) GROUP BY event_type")
def str_21_srt_02_newest_version(spark, d):
    v = table(spark, d, "events").select("event_type", F.expr(_VER.replace("VARCHAR", "STRING")).alias("v"))
    return v.groupBy("event_type").agg(F.max_by("v", T.semver_key(F.col("v"))).alias("newest"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN NULL ELSE lang END AS lang FROM documents")
def str_23_optional_language(spark, d):
    i = F.col("doc_id")
    given = F.when(i % 4 == 0, " Auto ").when(i % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), F.col("lang"), F.lit("\n")))
    return docs(spark, d).select("doc_id", T.optional_language(given).alias("lang"))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def str_24_fingerprint(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("fingerprint"))


_LINE = "CASE idx % 9 WHEN 0 THEN '## ' || source_text WHEN 1 THEN '- ' || source_text WHEN 2 THEN '12. ' || source_text WHEN 3 THEN '> ' || source_text WHEN 4 THEN 'https://a.b/' || idx WHEN 5 THEN '[12] ' || left(source_text, 10) WHEN 6 THEN 'Figure ' || idx || '.' WHEN 7 THEN '$v' || idx || '$, $v2$.' ELSE source_text END"


@query(f"""WITH {SEG}, l AS (SELECT doc_id, idx, status, {_LINE} AS line FROM seg)
SELECT doc_id, idx, regexp_matches(line, '^[{RE_BLANK}]*#{{1,6}} ') AS heading, regexp_matches(line, '^[{RE_BLANK}]*([-*+]|[0-9]*\\.) ') AS item, regexp_matches(line, '^[{RE_BLANK}]*>') AS quote, regexp_matches(line, '^https?://[^{RE_BLANK}]*$') AS url,
  regexp_matches(line, '^[{RE_BLANK}]*\\[[0-9]{{1,4}}\\]') AS reference, regexp_matches(lower({sql_trim('line')}), '^(fig|fig\\.|figure|table|tab|tab\\.)[{RE_BLANK}]+[^{RE_BLANK}]*[0-9][^{RE_BLANK}]*\\.$') AS caption,
  regexp_matches({sql_trim('line')}, '^[,.;:]*\\$v[0-9]+\\$[,.;:]*([{RE_BLANK}]+[,.;:]*\\$v[0-9]+\\$[,.;:]*)*$') AS placeholder,
  length({sql_trim('line')}) <= 40 AND regexp_matches(line, '^[{RE_BLANK}]*\\[[0-9]{{1,4}}\\]') AND len(regexp_split_to_array({sql_trim('line')}, '[{RE_BLANK}]+')) <= 6 AS short_reference,
  status <> 'skipped' AND regexp_matches(line, '[^{RE_BLANK}]') AS translatable FROM l""")
def prd_01_to_09_line_kinds(spark, d):
    x = segments(spark, d).withColumn("line", F.expr(_LINE))
    c = F.col("line")
    return x.select("doc_id", "idx", T.heading(c).isNotNull().alias("heading"), T.list_item(c).isNotNull().alias("item"), T.is_quote(c).alias("quote"), T.is_url(c).alias("url"), T.is_reference(c).alias("reference"), T.is_caption_label(c).alias("caption"), T.is_placeholder_only(c).alias("placeholder"), T.is_short_reference(c).alias("short_reference"), T.is_translatable(F.col("status"), c).alias("translatable"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS safe_path, regexp_matches(s, '^[A-Za-z0-9_-]+$') AS safe_id, page_id % 4 = 3 AS stream FROM (SELECT page_id, 'job-' || page_id || CASE WHEN page_id % 5 = 0 THEN '/..' ELSE '' END AS s FROM pages)")
def prd_12_14_safe_names(spark, d):
    i = F.col("page_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("/abs/"), i.cast("string"))).when(i % 4 == 1, "a/../b").when(i % 4 == 2, F.concat(F.lit("pages/"), i.cast("string"), F.lit(".pdf"))).otherwise("..\nx\n data: {}")
    job = F.concat(F.lit("job-"), i.cast("string"), F.when(i % 5 == 0, "/..").otherwise(""))
    return table(spark, d, "pages").select("page_id", (T.is_safe_relative_path(path) & (i % 4 != 3)).alias("safe_path"), T.is_safe_id(job).alias("safe_id"), T.is_event_stream(path).alias("stream"))


@query("""SELECT event_id, least(100, CAST(floor(100.0 * (event_id % 37) / 36 + 0.5) AS INTEGER)) AS progress, floor(value * 100 + 0.5) / 100 AS rounded, greatest(1, least(CASE WHEN event_id % 13 = 0 THEN 12 ELSE event_id % 13 END, 12)) AS batch,
  CASE WHEN event_id % 3000 <= 800 THEN 16 WHEN event_id % 3000 <= 1600 THEN 8 WHEN event_id % 3000 <= 2500 THEN 6 ELSE 1 END AS cap, CASE WHEN event_id % 2 = 0 AND event_id % 60 <= 30 THEN 100 ELSE 10 END AS run_chunk, CASE WHEN event_id % 2 = 0 THEN 100 ELSE 16 END AS text_batch FROM events""")
def mth_01_to_07_numbers(spark, d):
    i = F.col("event_id")
    provider = F.when(i % 2 == 0, "lightning").otherwise("llama")
    return table(spark, d, "events").select("event_id", V.progress_percent(i % 37, F.lit(36)).alias("progress"), V.round_half_up(F.col("value"), 2).alias("rounded"), V.batch_size([4, 12, 8], i % 13).alias("batch"), V.batch_cap(16, i % 3000).alias("cap"), V.run_chunk_size(provider, i % 60).alias("run_chunk"), V.text_batch_size(provider).alias("text_batch"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 86400 * 30 THEN (s // 86400) || 'd' WHEN s // (86400 * 30) < 12 THEN (s // (86400 * 30)) || 'mo' ELSE (s // (86400 * 30) // 12) || 'y' END AS age FROM (SELECT event_id, event_id * event_id % 80000000 AS s FROM events)""")
def dat_02_relative_age(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", V.age((i * i % 80_000_000) * 1000).alias("age"))


@query("SELECT conv_id, CASE WHEN n > 1 THEN [first_text, second_text] END AS texts, CASE WHEN n = 1 THEN 'missing choice 1' END AS error FROM (SELECT conv_id, count(*) AS n, trim(min_by(text, turn)) AS first_text, trim(arg_min(text, turn) FILTER (turn > 0)) AS second_text FROM conversations GROUP BY conv_id)")
def jsn_01_choices(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("index"), F.struct(F.col("text").alias("content")).alias("message")))).alias("choices"))
    answer = F.to_json(F.struct(F.reverse("choices").alias("choices")))
    return c.select("conv_id", V.translations(answer, F.lit(2)).alias("t")).select("conv_id", "t.texts", "t.error")


@query("SELECT conv_id, trim(string_agg(text, '' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def jsn_02_stream(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))).alias("line"))
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("xs"))
    body = F.concat(F.array_join(F.transform("xs", lambda x: x["line"]), "\n\n"), F.lit("\n\ndata: [DONE]\n"))
    return c.select("conv_id", V.streamed_translations(body, F.lit(1))["texts"][0].alias("text"))


@query("SELECT event_id, CASE event_id % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE event_type END AS text, CASE event_id % 5 WHEN 1 THEN 'truncated' WHEN 2 THEN 'limit' WHEN 3 THEN 'empty' WHEN 4 THEN 'busy' END AS error FROM events")
def jsn_03_05_completion(spark, d):
    k = F.col("event_id") % 5
    body = F.when(k == 1, F.lit('{"content":"x","truncated":true}')).when(k == 2, F.lit('{"content":"x","stop_type":"limit"}')).when(k == 3, F.lit('{"content":" "}')).when(k == 4, F.lit('{"error":{"message":"busy"}}')).otherwise(F.concat(F.lit('{"content":" '), F.col("event_type"), F.lit('\\n"}')))
    return table(spark, d, "events").select("event_id", V.completion(body).alias("c")).select("event_id", "c.text", "c.error")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END AS k FROM events")
def jsn_04_loose_json(spark, d):
    raw = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("x"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(raw), "$.k", "bigint").alias("k"))


@query("SELECT doc_id, list_sort(list_distinct(list_filter([doc_id % 9, doc_id % 4, 3, 7], lambda p: p BETWEEN 1 AND 6))) AS pages, list_sort(list_distinct([3, 7, doc_id % 9])) AS added FROM documents")
def arr_01_02_page_sets(spark, d):
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", V.page_set(F.array(i % 9, i % 4, F.lit(3), F.lit(7)), F.lit(6)).alias("pages"), V.with_page(F.array(F.lit(3), F.lit(7)).cast("array<bigint>"), i % 9).alias("added"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'markdown' WHEN 2 THEN 'pdf' END AS format FROM pages")
def src_01_document_format(spark, d):
    i = F.col("page_id")
    path = F.concat(F.lit("dir.x/f"), i.cast("string"), F.when(i % 4 == 0, ".TXT").when(i % 4 == 1, ".md").when(i % 4 == 2, ".Pdf").otherwise(".doc"))
    return table(spark, d, "pages").select("page_id", T.document_format(path).alias("format"))
