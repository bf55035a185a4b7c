"""Rendering of blocks and ordered documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import text as T


def render_block(kind: Column, marker: Column, source: Column, translation: Column, fmt: Column, bilingual: bool) -> Column:
    """A block as export text; Markdown keeps its marks, bilingual puts the source before."""
    mark = F.coalesce(marker, F.lit(""))
    md = F.when(kind.isin("heading", "list_item"), F.concat(mark, F.lit(" "), translation)).when(kind == "blockquote", F.concat(F.lit("> "), translation)).otherwise(translation)
    if bilingual:
        return F.when(fmt == "markdown", F.concat(F.lit("> Original: "), source, F.lit("\n\n"), md)).otherwise(F.concat(F.lit("Original:\n"), source, F.lit("\n\nChinese:\n"), translation))
    return F.when(fmt == "markdown", md).otherwise(translation)


def without_extra_blanks(blocks: Column) -> Column:
    """Repeated blank entries become one; none at either end."""
    blank = lambda x: T.is_blank(x)
    at = F.transform(blocks, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.filter(at, lambda s: ~(blank(s["x"]) & (F.when(s["i"] == 0, F.lit(True)).otherwise(blank(F.get(blocks, s["i"] - 1))))))
    size = F.size(kept)
    kept = F.when((size > 0) & blank(F.element_at(kept, -1)["x"]), F.slice(kept, 1, F.greatest(size - 1, F.lit(0)))).otherwise(kept)
    return F.transform(kept, lambda s: s["x"])


def text_document(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Blocks of a document in order, joined by blank lines."""
    g = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("xs"))
    return g.select(key, F.array_join(without_extra_blanks(F.transform("xs", lambda x: x[text])), "\n\n").alias("document"))


def markdown_document(blocks: DataFrame, key: str, order: str, kind: str, text: str) -> DataFrame:
    """Blocks in order; list items that follow each other take one line end, others a blank line.

    A blank block ends a list and adds no further blank line.
    """
    g = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, kind, text))).alias("xs"))
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("prev"))

    def step(acc: Column, x: Column) -> Column:
        body = F.regexp_replace(x[text], "^\n+|\n+$", "")
        open_ = (acc["out"] != "") & ~acc["out"].endswith("\n\n")
        sep = F.when(~open_, "").when((acc["prev"] == "list_item") & (x[kind] == "list_item"), "\n").otherwise("\n\n")
        return F.when(T.is_blank(body), F.struct(F.concat(acc["out"], F.when(open_, "\n\n").otherwise("")).alias("out"), F.lit(None).cast("string").alias("prev"))).otherwise(F.struct(F.concat(acc["out"], sep, body).alias("out"), x[kind].alias("prev")))

    return g.select(key, T.trim(F.aggregate("xs", start, step, lambda a: a["out"])).alias("document"))
