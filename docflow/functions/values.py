"""Numbers, times, page sets and JSON values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 2) -> Column:
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(done * 100.0 / total + 0.5))).cast("int")


def rate(count: Column, ms: Column, digits: int = 2) -> Column:
    """Per second; 0 without time."""
    return F.when(ms > 0, round_half_up(count * 1000.0 / ms, digits)).otherwise(F.lit(0.0))


def whole_mean(total: Column, n: Column) -> Column:
    """Mean cut to a whole number; 0 of nothing."""
    return F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")


def batch_size(supported: list[int], hint: Column) -> Column:
    top = max([1, *supported])
    return F.when(hint == 0, F.lit(top)).otherwise(F.greatest(F.lit(1), F.least(hint, F.lit(top)))).cast("int")


def batch_cap(ceiling: int, longest: Column) -> Column:
    """Slots of a batch whose longest text has so many characters."""
    half, third = -(-ceiling // 2), -(-ceiling // 3)
    cap = F.when(longest <= 800, ceiling).when(longest <= 1600, half).when(longest <= 2500, third).otherwise(1)
    return F.greatest(F.lit(1), F.least(cap, F.lit(max(1, ceiling))))


def run_chunk_size(provider: Column, pages: Column) -> Column:
    return F.when((provider == "lightning") & (pages <= 30), 100).otherwise(10)


def text_batch_size(provider: Column) -> Column:
    return F.when(provider == "lightning", 100).otherwise(16)


def age(ms: Column) -> Column:
    """now, m, h, d, mo or y for an age in milliseconds."""
    s = F.floor(ms / 1000)
    m = F.floor(s / 60)
    h = F.floor(m / 60)
    d = F.floor(h / 24)
    mo = F.floor(d / 30)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(s < 60, "now").when(m < 60, text(m, "m")).when(h < 24, text(h, "h")).when(d < 30, text(d, "d")).when(mo < 12, text(mo, "mo")).otherwise(text(F.floor(mo / 12), "y"))


def now_ms_string() -> Column:
    return F.unix_millis(F.current_timestamp()).cast("string")


def page_set(pages: Column, count: Column | None = None) -> Column:
    """Sorted distinct pages from 1, up to count if given."""
    kept = F.filter(pages, lambda p: (p >= 1) & (F.lit(True) if count is None else p <= count))
    return F.array_sort(F.array_distinct(kept))


def with_page(pages: Column, page: Column) -> Column:
    return F.array_sort(F.array_union(pages, F.array(page)))


def default_pages(count: Column) -> Column:
    return F.when(count < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.when(count <= 30, count).otherwise(10).cast("int")))


def confirm_long(selected: Column) -> Column:
    return selected > 50


def selected_pages(selection: Column, count: Column, strict: bool = True) -> Column:
    """Pages of a selection like "1-3,5".

    Strict: an empty or malformed part, a falling range or a page outside 1..count is an
    error.  Otherwise bad parts are skipped, falling ranges turned, pages clipped to 1..count, and
    a blank selection or "all" means every page.
    """
    blank = r"[\s\xA0\u2000-\u200A\u3000]*"
    parts = F.transform(F.split(selection, ","), lambda p: F.regexp_replace(p, rf"^{blank}|{blank}$", ""))
    single, ranged = r"^[0-9]{1,9}$", rf"^([0-9]{{1,9}}){blank}-{blank}([0-9]{{1,9}})$"
    low = lambda p: F.when(p.rlike(single), p.try_cast("int")).otherwise(F.regexp_extract(p, ranged, 1).try_cast("int"))
    high = lambda p: F.when(p.rlike(single), p.try_cast("int")).otherwise(F.regexp_extract(p, ranged, 2).try_cast("int"))
    if strict:
        parts = F.filter(parts, lambda p: p != "")
        bad = F.exists(parts, lambda p: ~(p.rlike(single) | p.rlike(ranged))) | F.exists(parts, lambda p: (low(p) < 1) | (high(p) > count) | (low(p) > high(p))) | (F.size(parts) == 0)
        pages = F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))
        return F.when(bad, F.raise_error(F.concat(F.lit("bad page selection: "), selection)).cast("array<int>")).otherwise(F.array_sort(F.array_distinct(pages)))
    good = F.filter(parts, lambda p: p.rlike(single) | p.rlike(ranged))
    clip = lambda n: F.greatest(F.lit(1), F.least(n, count))
    inside = lambda p: (F.greatest(low(p), high(p)) >= 1) & (F.least(low(p), high(p)) <= count)
    pages = F.flatten(F.transform(F.filter(good, inside), lambda p: F.sequence(clip(F.least(low(p), high(p))), clip(F.greatest(low(p), high(p))))))
    everything = F.lower(F.regexp_replace(selection, rf"^{blank}|{blank}$", "")).isin("", "all")
    return F.when(everything & (count >= 1), F.sequence(F.lit(1), count)).otherwise(F.array_sort(F.array_distinct(pages)))


def selection_text(pages: Column) -> Column:
    """A sorted distinct page array as "1-3,5"."""
    first = F.filter(pages, lambda p: ~F.array_contains(pages, p - 1))
    last = F.filter(pages, lambda p: ~F.array_contains(pages, p + 1))
    return F.array_join(F.zip_with(first, last, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))), ",")


_CHOICE = "struct<index:int,message:struct<content:string>,delta:struct<content:string>>"
RESPONSE = f"struct<choices:array<{_CHOICE}>>"


def translations(response: Column, expected: Column) -> Column:
    """struct(texts, error) of a provider response with choices by index.

    Choices outside the expected range are ignored, the last of equal indexes counts; malformed
    JSON, an empty content or a missing index is an error.
    """
    choices = F.filter(F.coalesce(F.from_json(response, RESPONSE)["choices"], F.array().cast(f"array<{_CHOICE}>")), lambda c: (c["index"] >= 0) & (c["index"] < expected))
    blank = F.filter(choices, lambda c: F.coalesce(c["message"]["content"], F.lit("")).rlike(r"^\s*$"))
    texts = F.transform(F.sequence(F.lit(0), expected - 1), lambda i: F.regexp_replace(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(choices, lambda c: c["index"] == i), lambda c: c["message"]["content"])), -1), r"^\s+|\s+$", ""))
    missing = F.filter(F.sequence(F.lit(0), expected - 1), lambda i: ~F.exists(choices, lambda c: c["index"] == i))
    error = F.when(F.from_json(response, RESPONSE)["choices"].isNull(), F.lit("bad JSON")).when(F.size(blank) > 0, F.concat(F.lit("empty content for choice "), blank[0]["index"].cast("string"))).when(F.size(missing) > 0, F.concat(F.lit("missing choice "), missing[0].cast("string")))
    return F.struct(F.when(error.isNull(), texts).alias("texts"), error.alias("error"))


def streamed_translations(response: Column, expected: Column) -> Column:
    """struct(texts, error) of a server-sent stream: contents joined per index in line order."""
    lines = F.filter(F.transform(F.split(response, "\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("data:"))
    chunks = F.filter(F.transform(lines, lambda x: F.trim(F.substr(x, F.lit(6)))), lambda x: (x != "") & (x != "[DONE]"))
    parsed = F.transform(chunks, lambda x: F.from_json(x, RESPONSE)["choices"])
    bad = F.exists(parsed, lambda x: x.isNull())
    choices = F.flatten(F.filter(parsed, lambda x: x.isNotNull()))
    text = lambda c: F.coalesce(c["delta"]["content"], c["message"]["content"], F.lit(""))
    texts = F.transform(F.sequence(F.lit(0), expected - 1), lambda i: F.regexp_replace(F.array_join(F.transform(F.filter(choices, lambda c: c["index"] == i), text), ""), r"^\s+|\s+$", ""))
    error = F.when(bad, F.lit("bad JSON")).when(F.exists(texts, lambda t: t == ""), F.lit("missing choice"))
    return F.struct(F.when(error.isNull(), texts).alias("texts"), error.alias("error"))


def completion(response: Column) -> Column:
    """struct(text, error) of a single completion; truncated, limited or empty answers are errors."""
    got = F.from_json(response, "struct<content:string,truncated:boolean,stop_type:string,error:struct<message:string>>")
    text = F.regexp_replace(F.coalesce(got["content"], F.lit("")), r"^\s+|\s+$", "")
    error = F.when(got["error"]["message"].isNotNull(), got["error"]["message"]).when(F.coalesce(got["truncated"], F.lit(False)), F.lit("truncated")).when(got["stop_type"] == "limit", F.lit("limit")).when(text == "", F.lit("empty"))
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))
