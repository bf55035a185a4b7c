"""Documents to blocks, lines and segments.

A document is parsed inside its own row with array functions, so no operator here
shuffles; a row fans out only at the final explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import text as T

#: Longest segment in characters.
MAX_SEGMENT = 1800
BLOCK = "struct<block_type:string,marker:string,text:string,translate:boolean>"


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no new line."""
    t = F.regexp_replace(text, "\r?\n\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(t, "\r?\n"))


def sentences(text: Column) -> Column:
    """Cut after each of the sentence marks, wherever it stands."""
    return F.regexp_extract_all(text, F.lit(f"[^{T.STOPS}]*[{T.STOPS}]|[^{T.STOPS}]+"), F.lit(0))


def segments(text: Column, limit: int = MAX_SEGMENT) -> Column:
    """The whole trimmed text if short, else sentences packed greedily in order."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        flush = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(s) > limit)
        cur = F.when(flush, "").otherwise(acc["cur"])
        done = F.when(flush, F.array_append(acc["done"], T.trim(acc["cur"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.concat(cur, F.when(cur != "", " ").otherwise(""), T.trim(s)).alias("cur"))

    def finish(acc: Column) -> Column:
        out = F.when(~T.is_blank(acc["cur"]), F.array_append(acc["done"], T.trim(acc["cur"]))).otherwise(acc["done"])
        return F.when(F.size(out) > 0, out).otherwise(F.array(T.trim(text)))

    return F.when(F.length(text) <= limit, F.array(T.trim(text))).otherwise(F.aggregate(sentences(text), start, step, finish))


def paragraphs(text: Column) -> Column:
    """Runs of non-blank lines, joined by line ends and trimmed: one split at the blank lines between them."""
    parts = F.split(F.regexp_replace(text, "\r?\n", "\n"), f"\n[{T.BLANK}]*\n")
    return F.filter(F.transform(parts, T.trim), lambda p: p != "")


def paragraph_islands(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, text: the same by gaps and islands over exploded lines."""
    at = docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no")
    at = at.withColumn("blank", T.is_blank(F.col("line"))).withColumn("island", F.sum(F.col("blank").cast("int")).over(w)).where("not blank")
    joined = at.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("xs"))
    joined = joined.select("doc_id", "island", T.trim(F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("text"))
    return joined.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("island")).alias("paragraph"), "text")


def _with(value: Column, body) -> Column:
    """body of a value that is computed once for the row, not at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def markdown_blocks(text: Column) -> Column:
    """Blocks of Markdown in order: fence, code, blank, heading, list, quote, URL, paragraph.

    Any fence line opens or closes code; code left open is closed at the end; every blank line is
    a block of its own that is not translated.  Lines are cut at every second pair of fences and,
    between them, at each line that is no paragraph's: work is linear in the lines.
    """
    none = F.lit(None).cast("string")

    def block(kind: str, marker: Column, body: Column, translate: bool) -> Column:
        return F.struct(F.lit(kind).alias("block_type"), marker.alias("marker"), body.alias("text"), F.lit(translate).alias("translate"))

    def positions(xs: Column) -> Column:
        return F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1)).otherwise(F.array().cast("array<int>"))

    def own_block(line: Column) -> Column:
        """The block of a line that stands alone; null for a line of a paragraph."""

        def kinds(t: Column) -> Column:
            head, item = T.heading(line), T.list_item(line)
            return (
                F.when(t == "", block("metadata", none, F.lit(""), False))
                .when(head.isNotNull(), block("heading", head["marker"], head["text"], True))
                .when(item.isNotNull(), block("list_item", item["marker"], item["text"], True))
                .when(T.is_quote(line), block("blockquote", none, T.trim(F.substr(t, F.lit(2))), True))
                .when(T.is_url(t), block("url", none, t, False))
            )

        return kinds(T.trim(line))

    def prose(ls: Column) -> Column:
        """Blocks of lines without fences."""

        def cut(owns: Column) -> Column:
            starts = F.filter(positions(ls), lambda i: (i == 0) | F.get(owns, i).isNotNull() | F.get(owns, i - 1).isNotNull())

            def run(s: Column, after: Column) -> Column:
                return F.coalesce(F.get(owns, s), block("paragraph", none, T.trim(F.array_join(F.slice(ls, s + 1, after - s), "\n")), True))

            return _with(starts, lambda st: F.transform(st, lambda s, j: run(s, F.coalesce(F.get(st, j + 1), F.size(ls)))))

        return _with(F.transform(ls, own_block), cut)

    def cut_code(ls: Column, fences: Column) -> Column:
        def piece(k: Column) -> Column:
            """Prose before the k-th code (0 on), then the code, if there is one."""
            opened, last = F.get(fences, 2 * k), F.coalesce(F.get(fences, 2 * k + 1), F.size(ls) - 1)
            begin = F.when(k == 0, F.lit(0)).otherwise(F.coalesce(F.get(fences, 2 * k - 1) + 1, F.size(ls)))
            code = F.array(block("code", none, F.array_join(F.slice(ls, opened + 1, last - opened + 1), "\n"), False))
            before = _with(F.slice(ls, begin + 1, F.coalesce(opened, F.size(ls)) - begin), prose)
            return F.when(opened.isNull(), before).otherwise(F.concat(before, code))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(fences) / 2).cast("int")), piece))

    def whole(ls: Column) -> Column:
        fences = F.filter(positions(ls), lambda i: T.trim(F.get(ls, i)).rlike("^(```|~~~)"))
        return _with(fences, lambda fs: cut_code(ls, fs))

    return F.when(text.isNotNull(), _with(lines(text), whole))


def text_blocks(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.struct(F.lit("paragraph").alias("block_type"), F.lit(None).cast("string").alias("marker"), p.alias("text"), F.lit(True).alias("translate")))


def parse(docs: DataFrame, fmt: Column, key: str = "doc_id") -> DataFrame:
    """One row per block: key, block_id, block_order (from 1), block_type, marker, source_text, translate."""
    blocks = F.when(fmt == "markdown", markdown_blocks(F.col("text"))).otherwise(text_blocks(F.col("text")))
    out = docs.select(key, F.posexplode(blocks).alias("i", "b"))
    return out.select(key, F.concat(F.col(key).cast("string"), F.lit("-block-"), (F.col("i") + 1).cast("string")).alias("block_id"), (F.col("i") + 1).alias("block_order"), "b.block_type", "b.marker", F.col("b.text").alias("source_text"), "b.translate")


def block_segments(blocks: DataFrame, limit: int = MAX_SEGMENT) -> DataFrame:
    """Segments of the translatable blocks: segment_id {block}-segment-{n}, index from 1."""
    at = blocks.where("translate").select("*", F.posexplode(segments(F.col("source_text"), limit)).alias("i", "segment_text"))
    return at.select(*[c for c in blocks.columns if c != "source_text"], F.concat("block_id", F.lit("-segment-"), (F.col("i") + 1).cast("string")).alias("segment_id"), (F.col("i") + 1).alias("segment_index"), F.col("segment_text").alias("source_text"))


def reference_items(text: Column) -> Column:
    """Items that begin with [n] at the start or after a blank or full stop; fewer than two give none."""
    mark = rf"(?<=^|[{T.BLANK}.])\[[0-9]+\]"
    marked = F.regexp_replace(text, mark, "\u0001$0")
    cut = F.split(marked, "\u0001")
    parts = F.transform(F.slice(cut, 2, F.size(cut)), T.trim)
    return F.when(F.regexp_count(text, F.lit(mark)) >= 2, F.filter(parts, lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def chunks_of(position: Column, size: int) -> Column:
    """Number of the fixed-size chunk of a row by its position from 1."""
    return F.floor((position - 1) / size).cast("int")
