"""Problem 6: fill windows of fixed capacity with texts of varying token counts.

Plan: one Arrow pass counts tokens with a public tokenizer (texts never leave it); from there rows
are a few numbers.  Items of a provider are spread over shards of bounded size by a hash, and each
shard is packed on its own by *large-item matching*: items above a third of the capacity go at
most two to a window, paired greedily (the largest with the largest partner that fits); smaller
items then go, largest first, into the window with the least gap that takes them (best fit), and
only into a new window if none does.  A text longer than a window fills whole windows and its rest
is an item like any other.  A shard loses at most its last windows, so with tens of thousands of
items a shard the sharding costs next to nothing, and no provider's rows meet in one task.

A window is named by provider_id, shard and window together.

Defined results: a null or empty text is an item of size 0 and still gets a window; null or unknown
providers take the default provider; the second delivery of a doc_id is dropped; ties go by doc_id.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import materialize, ship
from tracelake.llm.chunking import with_limits

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHARD_ITEMS = 50_000
#: Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE: dict = {}


def _where(folder: str, vocabulary: str) -> str:
    """The vocabulary file: the copy that the driver sent to the workers, else that in the folder."""
    try:
        sent = SparkFiles.get(vocabulary)
    except Exception:  # outside a session
        sent = ""
    return sent if sent and os.path.exists(sent) else os.path.join(folder, vocabulary)


def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer, built once per Python worker."""
    key = (folder, vocabulary)
    if key not in _CACHE:
        import tiktoken

        with open(_where(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CACHE[key] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[key]


def _counter(folder: str, vocabulary: str):
    def count(batches):
        enc = encoding(folder, vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("provider_id"), pa.array(n, pa.int32())], names=["doc_id", "provider_id", "n_tokens"])

    return count


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, provider_id, n_tokens), one row per doc_id."""
    ship(docs.sparkSession)
    path = os.path.join(folder, vocabulary)
    if os.path.exists(path) and not any(x.endswith("/" + vocabulary) for x in docs.sparkSession.sparkContext.listFiles):
        docs.sparkSession.sparkContext.addFile(path)  # once a session; a megabyte, whatever the data
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "provider_id", "text")
    counted = src.mapInArrow(_counter(folder, vocabulary), "doc_id long, provider_id string, n_tokens int")
    return counted.groupBy("doc_id").agg(F.min_by("provider_id", "n_tokens").alias("provider_id"), F.min("n_tokens").alias("n_tokens"))


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Window number of each item; every size is at most the capacity. Sizes are in any order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    window = [-1] * len(sizes)
    gap: list[int] = []
    large = [i for i in order if 3 * sizes[i] > capacity]
    # Unmatched large items by size, with a bit set for every size still present.
    by_size: dict[int, list[int]] = {}
    bits = 0
    for i in reversed(large):
        by_size.setdefault(sizes[i], []).append(i)
        bits |= 1 << sizes[i]

    def take(s: int) -> int:
        nonlocal bits
        i = by_size[s].pop()
        if not by_size[s]:
            bits &= ~(1 << s)
        return i

    for i in large:
        if window[i] >= 0:
            continue
        by_size[sizes[i]].remove(i) if by_size[sizes[i]][-1] != i else by_size[sizes[i]].pop()
        if not by_size[sizes[i]]:
            bits &= ~(1 << sizes[i])
        w = len(gap)
        window[i] = w
        room = capacity - sizes[i]
        partner = bits & ((1 << (room + 1)) - 1)
        if partner:
            j = take(partner.bit_length() - 1)
            window[j] = w
            room -= sizes[j]
        gap.append(room)
    # Best fit of the small items: windows by gap, with a bit set for every gap present.
    at: dict[int, list[int]] = {}
    open_bits = 0
    for w, g in enumerate(gap):
        at.setdefault(g, []).append(w)
        open_bits |= 1 << g
    for i in order:
        if window[i] >= 0:
            continue
        s = sizes[i]
        fit = open_bits >> s
        if fit:
            g = s + (fit & -fit).bit_length() - 1
            w = at[g].pop()
            if not at[g]:
                open_bits &= ~(1 << g)
        else:
            w, g = len(gap), capacity
            gap.append(capacity)
        window[i] = w
        g -= s
        gap[w] = g
        at.setdefault(g, []).append(w)
        open_bits |= 1 << g
    return window


_PLACED = "provider_id string, shard int, window int, seq_length int, doc_id long, piece int, n_pieces int, start_token long, n_tokens int"


def _pack_shard(d: pd.DataFrame) -> pd.DataFrame:
    cap = int(d.seq_length.iloc[0])
    d = d.sort_values("doc_id", kind="stable")
    docs, pieces, starts, sizes, parts = [], [], [], [], []
    for doc, n in zip(d.doc_id.tolist(), d.n_tokens.tolist()):
        k = max(1, -(-n // cap))
        for p in range(k):
            docs.append(doc)
            pieces.append(p)
            parts.append(k)
            starts.append(p * cap)
            sizes.append(min(cap, n - p * cap))
    return pd.DataFrame(
        {"provider_id": d.provider_id.iloc[0], "shard": int(d.shard.iloc[0]), "window": pack(sizes, cap), "seq_length": cap, "doc_id": docs}
        | {"piece": pieces, "n_pieces": parts, "start_token": starts, "n_tokens": sizes}
    )


def fill_windows(docs: DataFrame, providers: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per placed text or part: its window, and which tokens of the text lie there."""
    sized = materialize(with_limits(token_counts(docs, folder, vocabulary), providers).drop("overlap_tokens"), "sizes")
    shards = sized.groupBy("provider_id").agg(F.ceil(F.count("*") / shard_items).cast("int").alias("n_shards"))
    spread = sized.join(shards, "provider_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.col("n_shards")).cast("int"))
    return spread.groupBy("provider_id", "shard").applyInPandas(_pack_shard, _PLACED)


def windows(filled: DataFrame) -> DataFrame:
    """One row per window: its capacity, the tokens in it, the room left and the number of parts."""
    w = filled.groupBy("provider_id", "shard", "window").agg(F.max("seq_length").alias("seq_length"), F.sum("n_tokens").alias("used"), F.count("*").alias("n_parts"))
    return w.withColumn("unused", F.col("seq_length") - F.col("used"))


def window_report(filled: DataFrame) -> DataFrame:
    """Per provider: windows, the least number any filling needs, tokens, unused share of all capacity, texts and divided texts."""
    w = filled.groupBy("provider_id", "shard", "window").agg(F.max("seq_length").alias("cap"), F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    d = filled.groupBy("provider_id").agg(F.count_if(F.expr("piece = 0")).alias("n_docs"), F.count_if(F.expr("piece = 0 and n_pieces > 1")).alias("n_divided"))
    return w.groupBy("provider_id").agg(
        F.count("*").alias("n_windows"), F.ceil(F.sum("used") / F.max("cap")).alias("least_windows"), F.sum("used").alias("n_tokens"), F.max(F.col("used") - F.col("cap")).alias("most_over"),
        F.round(1 - F.sum("used") / F.sum("cap"), 6).alias("unused_share"),
    ).join(d, "provider_id")


def filling_faults(filled: DataFrame) -> DataFrame:
    """Per provider: texts placed, and what a filling must not do: texts placed twice or with tokens missing, windows over capacity, texts divided that fit."""
    d = filled.groupBy("provider_id", "doc_id").agg(
        F.count("*").alias("n"), F.max("n_pieces").alias("n_pieces"), F.count_distinct("piece").alias("k"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("upto"), F.max("seq_length").alias("cap")
    )
    d = d.groupBy("provider_id").agg(
        F.count("*").alias("n_docs"), F.count_if((F.col("n") != F.col("n_pieces")) | (F.col("k") != F.col("n_pieces"))).alias("n_not_once"), F.count_if(F.col("tokens") != F.col("upto")).alias("n_with_gaps"),
        F.count_if((F.col("n_pieces") > 1) & (F.col("tokens") <= F.col("cap"))).alias("n_divided_for_nothing"),
    )
    over = windows(filled).groupBy("provider_id").agg(F.count_if(F.col("unused") < 0).alias("n_over_capacity"))
    return d.join(over, "provider_id")
