"""String functions as Column expressions; all stay inside generated JVM code.

Blank means Unicode white space (the set below); lengths are code points.  Null in,
null out unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space for Java regular expressions.
BLANK = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{BLANK}]"
#: Marks whose repetition is collapsed (fixed values).
MARKS = ".,!?;:。，、！？；："
#: Marks that end a sentence-like piece (fixed values).
STOPS = ".?!;。？！；"
#: Language codes and the names used in prompts (fixed values).
LANGUAGES = {
    "en": "English",
    "zh-CN": "Chinese",
    "zh-TW": "Chinese",
    "zh": "Chinese",
    "ja": "Japanese",
    "ko": "Korean",
    "fr": "French",
    "de": "German",
    "es": "Spanish",
    "ru": "Russian",
    "pt": "Portuguese",
    "it": "Italian",
    "vi": "Vietnamese",
    "id": "Indonesian",
}


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{BLANK}]")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clean_repeats(c: Column) -> Column:
    """Runs of one and the same mark, blanks between included, become one mark."""
    return F.regexp_replace(c, rf"([{MARKS}])(?:{WS}*\1)+", "$1")


def unhyphenate(c: Column) -> Column:
    """Join words broken by a hyphen before a lower-case letter, then collapse blanks."""
    joined = F.regexp_replace(c, f"(?<=[A-Za-z])-{WS}*(?=[a-z])", "")
    return trim(F.regexp_replace(joined, f"{WS}+", " "))


def estimate_tokens(c: Column) -> Column:
    """12 + 0.1 per ASCII blank + 0.25 per ASCII letter or digit + 0.35 per other ASCII + 1 per other, rounded up."""
    blank = F.length(c) - F.length(F.regexp_replace(c, r"[\t\n\f\r ]", ""))
    word = F.length(c) - F.length(F.regexp_replace(c, "[A-Za-z0-9]", ""))
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    other = F.length(c) - blank - word - wide
    hundredths = F.lit(1200) + blank * 10 + word * 25 + other * 35 + wide * 100
    return F.ceil(hundredths / F.lit(100)).cast("int")


def file_stem(c: Column, default: str = "Untitled") -> Column:
    t = trim(F.regexp_replace(trim(c), r"(\.txt)+$", ""))
    t = F.regexp_replace(t, r'[/\\:*?"<>|\x00-\x1F\x7F-\x9F]', " ")
    t = F.left(trim(F.regexp_replace(t, f"{WS}+", " ")), F.lit(80))
    return F.when(t == "", default).otherwise(t)


def id_component(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]", "-"), "^-+|-+$", "")
    return F.when(t == "", "item").otherwise(t)


def translation_file_id(file_id: Column, lang: Column) -> Column:
    return F.concat(F.lit("tr-"), id_component(file_id), F.lit("-"), id_component(lang))


def language_dir(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(trim(c), "[^A-Za-z0-9_-]+", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.when(t == "", "unknown").otherwise(t)


def page_path(lang: Column, page: Column) -> Column:
    return F.concat(F.lit("translated-pages/"), language_dir(lang), F.lit("/"), F.format_string("page-%04d.pdf", page))


def page_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(?:^|/)page-([0-9]+)[.]pdf$", 1).try_cast("int")


def language_name(c: Column, default: str = "English") -> Column:
    out = F.lit(default)
    for code, name in LANGUAGES.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def prompt(text: Column, source: Column, target: Column) -> Column:
    return F.concat(language_name(source), F.lit(": "), clean_repeats(text), F.lit("\n\n"), language_name(target), F.lit(":"))


def stop_sequences(source: Column, target: Column) -> Column:
    return F.array(F.concat(F.lit("\n\n"), source, F.lit(":")), F.concat(F.lit("\n\n"), target, F.lit(":")))


def after_role(content: Column, role: Column) -> Column:
    """Text after the first line that begins with "role:"; all of it if there is none."""
    mark = F.concat(F.lit("\n"), role, F.lit(":"))
    at = F.position(mark, content)
    return trim(F.when(at > 0, F.substr(content, at + F.length(mark))).otherwise(content))


def preview(c: Column, size: int = 400) -> Column:
    return F.replace(F.replace(F.left(c, F.lit(size)), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def redact(c: Column, secrets: list[str], mask: str = "<redacted>") -> Column:
    for s in secrets:
        if s:
            c = F.replace(c, F.lit(s), F.lit(mask))
    return c


def is_compact(lang: Column, rule: str = "prefix") -> Column:
    """Languages written without spaces; rules: prefix (any case), exact_case, code (whole code or code-)."""
    if rule == "exact_case":
        return lang.rlike("^(zh|ja|ko)")
    if rule == "code":
        return ascii_lower(trim(lang)).rlike("^(zh|ja|ko)(-|$)")
    return ascii_lower(lang).rlike("^(zh|ja|ko)")


def join_chunks(chunks: Column, lang: Column) -> Column:
    kept = F.filter(F.transform(chunks, trim), lambda x: x != "")
    return F.when(is_compact(lang, "code"), F.array_join(kept, "")).otherwise(F.array_join(kept, " "))


def url_join(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(trim(base), "/+$", ""), F.lit("/"), F.regexp_replace(trim(path), "^/+", ""))


def progress_fraction(line: Column) -> Column:
    """(done, total) of a progress bar like 3/12 [, else null."""
    done = F.regexp_extract(line, rf"([0-9]+)/([0-9]+){WS}*\[", 1).try_cast("int")
    total = F.regexp_extract(line, rf"([0-9]+)/([0-9]+){WS}*\[", 2).try_cast("int")
    return F.when((total > 0) & (done <= total), F.struct(done.alias("done"), total.alias("total")))


def percent(line: Column) -> Column:
    n = F.regexp_extract(line, r"^[^%]*?([0-9]+)%", 1).try_cast("int")
    return F.when(n <= 255, F.least(n, F.lit(100)))


def optional_language(c: Column) -> Column:
    t = trim(c)
    return F.when((t == "") | (ascii_lower(t) == "auto"), None).otherwise(t)


def export_name(path: Column, fmt: Column, lang: Column, kind: Column) -> Column:
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?i)\.(txt|md|markdown|pdf)$", "")
    suffix = F.when(kind == "bilingual", F.concat(lang, F.lit(".bilingual"))).otherwise(lang)
    ext = F.when(fmt == "pdf", "pdf").when(fmt == "markdown", "md").otherwise("txt")
    return F.concat_ws(".", base, suffix, ext)


def document_format(path: Column) -> Column:
    """txt, markdown or pdf by extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "txt", "txt").when(ext.isin("md", "markdown"), "markdown").when(ext == "pdf", "pdf")


def semver_key(version: Column) -> Column:
    """Sortable key of a version, null if malformed: numbers, release above pre-release,
    then pre-release parts (numbers below words, shorter below longer)."""
    pattern = r"^v?([0-9]+)\.([0-9]+)\.([0-9]+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    part = [F.regexp_extract(version, pattern, i) for i in range(5)]
    pre = F.when(part[4] == "", F.array().cast("array<struct<w:int,n:bigint,s:string>>")).otherwise(
        F.transform(F.split(part[4], r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.struct(F.lit(0).alias("w"), x.try_cast("bigint").alias("n"), F.lit("").alias("s"))).otherwise(F.struct(F.lit(1).alias("w"), F.lit(0).cast("bigint").alias("n"), x.alias("s"))))
    )
    return F.when(part[0] != "", F.struct(part[1].cast("bigint").alias("major"), part[2].cast("bigint").alias("minor"), part[3].cast("bigint").alias("patch"), (part[4] == "").cast("int").alias("release"), pre.alias("pre")))


def message_text(messages: Column) -> Column:
    """Text of the last user message in array<struct<role, content>>."""
    mine = F.filter(messages, lambda m: m["role"] == "user")
    return F.when(F.size(mine) > 0, F.element_at(mine, -1)["content"])


# --- predicates ---------------------------------------------------------------


def heading(line: Column) -> Column:
    """struct(marker, text) of a Markdown heading, else null."""
    t = ltrim(line)
    return F.when(t.rlike("^#{1,6} "), F.struct(F.regexp_extract(t, "^(#{1,6}) ", 1).alias("marker"), trim(F.regexp_replace(t, "^#+", "")).alias("text")))


def list_item(line: Column) -> Column:
    t = ltrim(line)
    return F.when(t.rlike(r"^([-*+]|[0-9]*\.) "), F.struct(F.regexp_extract(t, r"^([-*+]|[0-9]*\.) ", 1).alias("marker"), trim(F.regexp_replace(t, r"^([-*+]|[0-9]*\.) ", "")).alias("text")))


def is_quote(line: Column) -> Column:
    return ltrim(line).startswith(">")


def is_url(text: Column) -> Column:
    return text.rlike(rf"^https?://[^{BLANK}]*\z")


def is_reference(text: Column) -> Column:
    return text.rlike(rf"^{WS}*\[[0-9]{{1,4}}\]")


def is_caption_label(text: Column) -> Column:
    return ascii_lower(trim(text)).rlike(rf"^(fig|fig\.|figure|table|tab|tab\.){WS}+[^{BLANK}]*[0-9][^{BLANK}]*\.\z")


def starts_with_caption(text: Column) -> Column:
    return ascii_lower(ltrim(text)).rlike(rf"^[(\[]*(fig|fig\.|figure|table|tab|tab\.)[(\[]*{WS}+[^{BLANK}]*[0-9]")


def is_placeholder_only(text: Column) -> Column:
    token = r"[,.;:，。；：]*\$v[0-9]+\$[,.;:，。；：]*"
    return trim(text).rlike(rf"^{token}({WS}+{token})*\z")


def is_short_reference(text: Column) -> Column:
    t = trim(text)
    return (F.length(t) <= 40) & is_reference(t) & (F.size(F.split(t, f"{WS}+")) <= 6)


def is_translatable(status: Column, source: Column) -> Column:
    return (status != "skipped") & ~is_blank(source)


def is_safe_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_-]+\z")


def is_safe_relative_path(c: Column) -> Column:
    return (c != "") & ~c.rlike(r"^[/\\]|^[A-Za-z]:|\\|(^|/)\.\.?(/|\z)")


def is_event_stream(c: Column) -> Column:
    return c.rlike(rf"(?m)^{WS}*data:")


def is_unscoped_page_path(path: Column) -> Column:
    """A page path from before paths had a language; false for null."""
    return F.coalesce(path.rlike(r"(?s)\Apdf-pages/page-.*\.pdf\z"), F.lit(False))


def is_trusted_language(lang: Column) -> Column:
    """Chinese of any region, whose old page files need no check."""
    return F.coalesce(ascii_lower(trim(lang)).rlike(r"\Azh(-|\z)"), F.lit(False))


#: Parts of a worker's line that tell a failed translation (fixed values).
WORKER_ERRORS = ["rwkv 翻译失败", "exceeds the available context size", "exceed_context_size_error"]
#: Stands before the last error in a worker's line, and in place of an empty one (fixed values).
LAST_ERROR, UNKNOWN_ERROR = "最后错误：", "未知错误"
#: Labels of the languages on offer (fixed values).
LABELS = {"en": "英文", "zh-CN": "简体中文"}


def is_worker_error(line: Column) -> Column:
    low, out = ascii_lower(line), F.lit(False)
    for part in WORKER_ERRORS:
        out = out | F.coalesce(low.contains(part), F.lit(False))
    return out


def last_error(line: Column) -> Column:
    """What follows the last marker; the whole line without one."""
    return trim(F.substring_index(trim(line), LAST_ERROR, -1))


def short_error(message: Column, size: int = 240) -> Column:
    """The last line, cut to size characters."""
    t = trim(message)
    return F.when(t == "", UNKNOWN_ERROR).otherwise(F.left(F.element_at(F.split(t, "\n"), -1), F.lit(size)))


def worker_language(lang: Column) -> Column:
    return F.when(lang.isin("zh-CN", "zh-TW", "zh"), "zh").otherwise(lang)


def language_label(value: Column) -> Column:
    return F.coalesce(*[F.when(value == k, v) for k, v in LABELS.items()], value)


def worker_service(provider: Column, batch: str, single: str, force_single: bool = False) -> Column:
    """Name of the service that serves a provider: only the lightning one takes batches."""
    return F.lit(single) if force_single else F.when(provider == "lightning", batch).otherwise(single)


def source_language(lang: Column, default: str = "en") -> Column:
    """lang, or the default where it is missing, empty or ``auto``."""
    return F.coalesce(F.nullif(F.nullif(lang, F.lit("")), F.lit("auto")), F.lit(default))


def stored_languages(by_job: Column, default: str = "en") -> Column:
    """map<job, struct<source, target>> with ``auto`` sources replaced; null stays null."""
    return F.transform_values(by_job, lambda _, x: F.struct(F.when(x["source"] == "auto", default).otherwise(x["source"]).alias("source"), x["target"].alias("target")))


def logged_prompt(raw: Column, text: Column, source: Column, target: Column) -> Column:
    """The prompt of a logged response if it has one that isn't blank, else the one rebuilt from the text."""
    logged = F.try_variant_get(F.try_parse_json(raw), "$.prompt", "string")
    return F.coalesce(F.when(~is_blank(logged), logged), prompt(F.coalesce(text, F.lit("")), source, target))


#: What cleaning a job folder removes (fixed values): folders, files, and JSON files by the start of their name.
ARTIFACT_FOLDERS = ("pdf-pages", "translated-pages", "pdf2zh-output", ".tmp")
ARTIFACT_FILES = ("pdf_source.json", "pdf_page_translations.json", "exports/translated.pdf")
ARTIFACT_STARTS = ("pdf_page_translations.", "pdf_pages.", "pdf_run.")


def is_translation_artifact(path: Column) -> Column:
    """Whether a path inside a job folder is a page translation's artifact or state."""
    starts = F.lit(False)
    for s in ARTIFACT_STARTS:
        starts = starts | path.startswith(s)
    state = starts & path.endswith(".json") & ~path.contains("/")
    return F.coalesce(F.substring_index(path, "/", 1).isin(*ARTIFACT_FOLDERS) | path.isin(*ARTIFACT_FILES) | state, F.lit(False))


def page_artifact_paths(lang: Column, page: Column, path: Column) -> Column:
    """Where a page's artifact may lie, newest place first: by language, in the two older layouts, as recorded if safe."""
    own = page_path(lang, page)
    name = F.substring_index(own, "/", -1)
    old = F.concat(F.lit("pdf-pages/"), language_dir(lang), F.lit("/"), name)
    return F.array_distinct(F.array_compact(F.array(own, old, F.concat(F.lit("pdf-pages/"), name), F.when(is_safe_relative_path(path), path))))


def is_compression_leftover(name: Column, lang: Column, page: Column) -> Column:
    """Whether a file name is a temporary file or backup of compressing the page."""
    start = F.concat(F.lit("."), F.substring_index(page_path(lang, page), "/", -1), F.lit("."))
    return name.startswith(start) & (name.contains(".compressing.tmp.pdf") | name.contains(".precompress.bak"))
