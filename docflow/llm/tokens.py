"""Operator 6: token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer version, n_tokens).  The
tokenizer version is a digest of the vocabulary file and the way of counting, the
content digest SHA-256 of the normalised content, which is the text itself with null
as empty: any stronger normalisation could change a count.  Texts are joined to the
cache by digest; only distinct misses are encoded, and their counts are appended.
Copies of a text meet in a partial aggregation by digest, so one encoding serves them.

Encoding a miss: between two non-blank characters a single space always starts a new
pre-token, and so do a lone line end and ASCII punctuation after a letter; a text is the
sequence of these pieces and its count the sum of theirs.  The pieces of a batch are cut and dictionary-encoded by Arrow; the library
itself encodes each distinct piece, once per worker as long as a bounded memo holds it.
Texts with runs of blanks or special strings are cut at the plain spaces only; a tokenizer
without this property (anything but byte-level pre-tokenising without normaliser) encodes
whole texts.

The digests that make up more than a thousandth of the rows (fewer than a thousand, so the
list may be broadcast) are salted in the join with the cache: copies of one text,
however many, spread over tasks.

Null text has 0 bytes and the tokens of the empty text.  Repeated rows and null ids
keep their rows.  An empty table gives an empty result and adds nothing to the cache.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stash, table
from .kernel import slices, utf8

#: Pieces that a worker remembers.
MEMO = 800_000
#: Bytes of text cut into pieces at once.
PIECE_BYTES = 12 << 20
#: Rows of one digest are salted where they are more than one in SHARE, over SALTS tasks.
SHARE, SALTS = 1000, 64
CACHE = "digest binary, version string, n_tokens long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(b"count-1:" + f.read()).hexdigest()


class Counter:
    """Counts tokens of texts as the tokenizer file's library gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.memo: dict[str, int] = {}
        self.special: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.pieces = False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_padding()
            model.no_truncation()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            self.special = [t["content"] for t in spec.get("added_tokens") or []]
            blank = any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
            self.pieces = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not blank

    def _known(self, pieces: list[str]) -> np.ndarray:
        """Counts of distinct pieces."""
        memo = self.memo
        new = [w for w in pieces if w not in memo]
        if new and len(memo) + len(new) > MEMO:
            for w in list(itertools.islice(memo, len(memo) // 2)):  # the older half goes
                del memo[w]
            new = [w for w in pieces if w not in memo]
        fresh: dict[str, int] = {}
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            fresh.update(zip(part, self.encode(part)))
        out = np.fromiter((memo[w] if w in memo else fresh[w] for w in pieces) if fresh else map(memo.__getitem__, pieces), np.int64, len(pieces))
        memo.update(itertools.islice(fresh.items(), max(0, MEMO - len(memo))))
        return out

    def _sums(self, pieces: pa.LargeListArray | pa.ListArray) -> np.ndarray:
        """Sum of the counts of each list's pieces."""
        first = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.values.dictionary_encode()
        total = np.concatenate([[0], np.cumsum(self._known(coded.dictionary.to_pylist())[coded.indices.to_numpy()])])
        return total[first[1:]] - total[first[:-1]]

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of texts without odd blanks, _MARK or special strings."""
        marked = pc.replace_substring(texts, " ", _MARK + " ")
        for pattern, by in _EDGES:
            marked = pc.replace_substring_regex(marked, pattern, by)
        return pc.split_pattern(marked, _MARK)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.pieces:
            return np.array(self.encode(texts.to_pylist()) if len(texts) else [], np.int64)
        out = np.zeros(len(texts), np.int64)
        full = pc.greater(pc.binary_length(texts), 0)
        odd = pc.match_substring_regex(texts, _ODD)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        plain = pc.and_not(full, odd)
        for rows, cut in ((plain, self._cut), (pc.and_(full, odd), lambda t: pa.array([_split(x) for x in t.to_pylist()], pa.large_list(pa.large_string())))):
            at = np.flatnonzero(rows.to_numpy(zero_copy_only=False))
            if len(at):
                out[at] = self._sums(cut(texts.take(pa.array(at))))
        return out


def _split(text: str) -> list[str]:
    """Pieces of any text: cut only at single spaces between non-blank characters."""
    parts = _SINGLE.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


_BLANK = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: Stands between pieces; a text that holds it is an odd one.
_MARK = "\x01"
#: Odd texts: a blank next to a space, at an end, or a line end next to a blank (RE2; Unicode's blanks).
_ODD = f"^[ \\n]|[ \\n]$|[{_BLANK}][ \\n]|[ \\n][{_BLANK}]|\x01"
#: Further places where a pre-token always ends: a lone line end, and a letter before ASCII punctuation.
_EDGES = [("\n", "\x01\n\x01"), ("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([!-/:-@\\[-`{-~])", "\\1\x01\\2")]
#: A single space between non-blank characters.
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_counters: dict[str, Counter] = {}


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """digest and n_tokens; a Python worker keeps its counter, and with it the memo, between tasks."""
    for batch in batches:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        _, off = utf8(batch.column(1))
        for a, b in slices(off, PIECE_BYTES):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter.counts(part.column(1)), pa.int64())], ["digest", "n_tokens"])


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at path; a new one is created empty."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
        return spark.read.schema(CACHE).parquet(path)


def count_tokens(docs: DataFrame, cache_path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of docs; misses are added to the cache.

    tokenizer is a vocabulary file that every executor can open.  Without cache_path a
    new cache is made in the shared folder.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    cache_path = cache_path or fresh_path(spark, "token-cache")
    own = version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest")
    d = stash(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest), "digests")
    cached = open_cache(spark, cache_path).where(F.col("version") == own).select("digest", "n_tokens")
    misses = docs.select(digest, text.alias("text")).groupBy("digest").agg(F.first("text").alias("text")).join(cached, "digest", "left_anti")
    added = misses.select("digest", "text").mapInArrow(lambda it: _encode(it, tokenizer), "digest binary, n_tokens long")
    added.select("digest", F.lit(own).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    known = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == own).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    often = d.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(1, d.count() // SHARE)).select("digest")
    salted = d.join(F.broadcast(often.withColumn("hot", F.lit(True))), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    spread = known.join(F.broadcast(often.withColumn("hot", F.lit(True))), "digest", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.select("doc_id", "n_bytes", "digest", "salt").join(spread.select("digest", F.col("salt").cast("long").alias("salt"), "n_tokens"), ["digest", "salt"]).select("doc_id", "n_bytes", "n_tokens")


def op6_digest_cache_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)
