"""Byte-level BPE of a whole corpus in Spark's own expressions.

Texts are cut into words by the tokenizer's pattern; each distinct word is encoded once by folding ranked merges over the
array of its bytes with a literal rank map; the texts get the ids of their words from that dictionary, broadcast or joined.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.session import cut

#: Words of more bytes are merged by a heap in an Arrow UDF: the fold's cost grows with the square of a word's length.
LONG_WORD_BYTES = 96
#: A dictionary of at most so many bytes (words, ids and 60 bytes a row) is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 24_000_000
#: The literal rank map is an array of so many small maps, since a lookup in a map literal walks through it.
BUCKETS = 16384
_NO_RANK = 2**31 - 1
#: White space as the tokenizer's \s has it.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The tokenizer's pattern.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a vocabulary file lies: in the installed package public_tokenizers, else in /opt/tokenizers."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _bucketed(path: str) -> str:
    """The ranks as JSON: an array of maps by CRC-32, keys in Latin-1 (one character a byte)."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in load_ranks(path).items():
        key = token.decode("latin-1")
        maps[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return json.dumps(maps, ensure_ascii=True, separators=(",", ":"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rank_of(ranks: Column):
    def rank(piece: Column) -> Column:
        return _let(piece, lambda x: F.coalesce(F.try_element_at(F.get(ranks, (F.crc32(x.cast("binary")) % BUCKETS).cast("int")), x), F.lit(_NO_RANK)))

    return rank


def word_ids(word: Column, path: str) -> Column:
    """The ids of a word: its bytes, in which the adjacent pair of the lowest rank is merged until none has a rank."""
    rank = _rank_of(F.from_json(F.lit(_bucketed(path)), "array<map<string,int>>"))
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    octets = F.transform(F.sequence(F.lit(1), F.length(latin)), lambda i: F.substring(latin, i, F.lit(1)))

    def step(state: Column, _: Column) -> Column:
        pieces = state["pieces"]
        n = F.size(pieces)
        ranks = F.zip_with(F.slice(pieces, F.lit(1), n - 1), F.slice(pieces, F.lit(2), n - 1), lambda a, b: rank(F.concat(a, b)))

        def merged(r: Column) -> Column:
            at = F.array_position(r, F.array_min(r)).cast("int")
            one = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
            joined = F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(one), F.slice(pieces, at + 2, F.greatest(n - at - 1, F.lit(0))))
            return F.when(F.coalesce(F.array_min(r), F.lit(_NO_RANK)) == _NO_RANK, F.struct(pieces.alias("pieces"), F.lit(True).alias("done"))).otherwise(F.struct(joined.alias("pieces"), F.lit(False).alias("done")))

        return F.when(state["done"], state).otherwise(_let(ranks, merged))

    start = F.struct(octets.alias("pieces"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.length(latin)), start, step, lambda s: F.transform(s["pieces"], rank))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, O(n log n)."""
    import heapq

    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two was merged meanwhile
        end[i], alive[j], after[i] = end[j], False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n:
                piece = word[start[a] : end[after[a]]]
                if piece in ranks:
                    heapq.heappush(heap, (ranks[piece], a, end[after[a]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[start[i] : end[i]]])
        i = after[i]
    return out


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for null and empty text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def dictionary(texts: DataFrame, text: str, path: str) -> DataFrame:
    """(word, ids) of all distinct words, each encoded once; words are made distinct in each text and task before the shuffle."""
    words = texts.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("word")).distinct()
    short = F.octet_length("word") <= LONG_WORD_BYTES

    @F.pandas_udf("array<int>")
    def long_ids(word: pd.Series) -> pd.Series:
        ranks = load_ranks(path)
        return word.map(lambda w: merge_long(w.encode(), ranks))

    words = cut(words)
    return cut(words.filter(short).withColumn("ids", word_ids(F.col("word"), path)).unionByName(words.filter(~short).withColumn("ids", long_ids("word"))))


def _look_up(known: DataFrame, rows: DataFrame, kind: str, carry: list[str]) -> DataFrame:
    """rows (key, carry..., words) with the ids of their words, looked up in the broadcast dictionary by Arrow, whole batches at a time."""
    shared = rows.sparkSession.sparkContext.broadcast(known.select("word", "ids").toArrow())  # at most BROADCAST_BYTES, checked by the caller

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = (shared.value[c].combine_chunks() for c in ("word", "ids"))
        for batch in batches:
            mine = batch["words"]
            offsets = mine.offsets.to_numpy()
            found = ids.take(pc.index_in(mine.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(words.type), value_set=words))
            if found.null_count:
                raise ValueError("a word isn't in the dictionary: the texts changed between two reads")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))])
            packed = pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]], pa.int32()), found.flatten())
            yield pa.RecordBatch.from_arrays([batch["key"], *[batch[c] for c in carry], packed], names=["key", *carry, "ids"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"key {kind}, {kinds + ', ' if kinds else ''}ids array<int>")


def encode(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry..., ids): the token ids of each text without special tokens, an empty list for empty and for null text.

    Strings of special tokens in a text are ordinary text. Every row of the input gives a row, whatever its key, so repeated
    rows repeat their ids. Of the other columns those named in `carry` are kept.

    Where the dictionary of distinct words is small enough (measured), it is broadcast and the texts aren't shuffled at all;
    beyond, words are joined by a shuffle. The ids are the same.
    """
    path = path or vocabulary_path()
    known = dictionary(texts, text, path)
    small = (known.agg(F.sum(F.octet_length("word") + 4 * F.size("ids") + 60)).first()[0] or 0) <= BROADCAST_BYTES
    held = [f"_carry{i}" for i in range(len(carry))]
    rows = texts.select(F.col(key).alias("key"), *[F.col(c).alias(h) for c, h in zip(carry, held)], words_of(F.col(text)).alias("words"))
    if small:
        out = _look_up(known, rows, texts.schema[key].dataType.simpleString(), held)
    else:
        # a row's number: the same in each run over the same files
        tokens = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "key", *held, F.posexplode_outer("words").alias("pos", "word"))
        parts = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "ids"))).alias("parts")
        packed = tokens.join(known, "word", "left").groupBy("_row", "key", *held).agg(parts)
        out = packed.select("key", *held, F.flatten(F.transform(F.array_sort("parts"), lambda x: x["ids"])).alias("ids"))
    return out.select(F.col("key").alias(key), *[F.col(h).alias(c) for c, h in zip(carry, held)], "ids")


def decode_ids(ids: Column, path: str) -> Column:
    """The text of token ids: their binary pieces, concatenated. Null stays null; bytes that aren't UTF-8 give U+FFFD."""
    pieces = [b""] * (max(load_ranks(path).values()) + 1)
    for token, rank in load_ranks(path).items():
        pieces[rank] = token
    table = F.from_json(F.lit(json.dumps([p.decode("latin-1") for p in pieces], separators=(",", ":"))), "array<string>")
    return F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1"), "UTF-8")
