"""Problem 3: cut oversized contents at natural boundaries, with overlap.

Plan: one narrow join gives each content its limit, only contents over their limit leave the JVM, and
each is cut by agglomerative merging within one Arrow pass; no shuffle but the one that drops
second deliveries of the (few) oversized rows.

Merging: the text is divided into atomic segments at its natural boundaries (paragraph, line,
sentence, clause, word; inside a word only for unbroken strings longer than a piece).  Adjacent
pairs wait in a heap ordered by the strength of the boundary between them; the weakest boundary is
merged first while the combined segments plus the overlap still fit.  What remains apart when
nothing fits any more are the pieces.  Piece k starts exactly ``overlap`` code points before its own
segment (or at the start of the piece before, if that is shorter).

Defined results: null and empty contents give no piece; a content within its limit gives none here
(it needs no cutting); an overlap of at least the limit counts as limit - 1; null or unknown
providers take the default provider's limit; a limit below 1 counts as 1.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import ship

#: Boundary strengths, strongest first: the position after a match is the boundary.
LEVELS = ("paragraph", "line", "sentence", "clause", "word", "inside")
_CUTS = (
    re.compile(r"\r?\n[^\S\n]*\r?\n\s*"),
    re.compile(r"\r?\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]}]*\s+|[。！？；…]+[”’」』）】》]*\s*"),
    re.compile(r"[,;:)\]}]+[\"'”’]*\s+|[，、：—]+\s*|\|\s+"),
    re.compile(r"\s+|[_/&=?.,;:-]+(?=\w)|(?<=[぀-ヿ㐀-鿿])(?=[぀-ヿ㐀-鿿])"),
)
_JOINERS = {"‍", "️", "︎", "⃣"}


def _glued(text: str, at: int) -> bool:
    """Whether a cut before ``text[at]`` would divide one visible character."""
    c, b = text[at], text[at - 1]
    if c in _JOINERS or b == "‍" or unicodedata.combining(c) or (b == "\r" and c == "\n"):
        return True
    if "\U0001f3fb" <= c <= "\U0001f3ff":
        return True
    return "\U0001f1e6" <= c <= "\U0001f1ff" and "\U0001f1e6" <= b <= "\U0001f1ff"


def atoms(text: str, budget: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments and the level (index into LEVELS) of the boundary at each end."""
    ends: list[int] = []
    levels: list[int] = []

    def divide(lo: int, hi: int, level: int, closing: int) -> None:
        if hi - lo <= budget and level > 0:
            ends.append(hi)
            levels.append(closing)
            return
        if level == len(_CUTS):
            at = lo
            while hi - at > budget:
                cut, back = at + budget, 0
                while back < 16 and cut - at > 1 and _glued(text, cut):
                    cut -= 1
                    back += 1
                if back == 16:
                    cut = at + budget
                ends.append(cut)
                levels.append(len(_CUTS))
                at = cut
            ends.append(hi)
            levels.append(closing)
            return
        at = lo
        for m in _CUTS[level].finditer(text, lo, hi):
            e = m.end()
            if at < e < hi:
                divide(at, e, level + 1, level)
                at = e
        divide(at, hi, level + 1, closing)

    divide(0, len(text), 0, -1)
    return ends, levels


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces as (start, core_start, end, boundary): text[start:end] is the piece and
    text[start:core_start] what it shares with the piece before; the last boundary is ``end``."""
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    if len(text) <= limit:
        return [(0, 0, len(text), "end")] if text else []
    ends, levels = atoms(text, limit - overlap)
    n = len(ends)
    starts = [0] + ends[:-1]
    nxt, prv, alive, version = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [0] * n
    end = list(ends)

    def fits(i: int, j: int) -> bool:
        return end[j] - starts[i] + (overlap if starts[i] else 0) <= limit

    heap = [(-levels[i], ends[i + 1] - starts[i], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, i, vi, vj = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj or not fits(i, j):
            continue
        end[i], alive[j], nxt[i], levels[i] = end[j], False, nxt[j], levels[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            version[i] += 1
            heapq.heappush(heap, (-levels[i], end[nxt[i]] - starts[i], i, version[i], version[nxt[i]]))
        else:
            version[i] += 1
        p = prv[i]
        if p >= 0:
            heapq.heappush(heap, (-levels[p], end[i] - starts[p], p, version[p], version[i]))
    out: list[tuple[int, int, int, str]] = []
    i = 0
    while i < n:
        before = out[-1][0] if out else 0
        start = max(before, starts[i] - overlap) if out else 0
        out.append((start, starts[i], end[i], LEVELS[levels[i]] if levels[i] >= 0 else "end"))
        i = nxt[i]
    return out


_OUT = pa.schema(
    [("message_id", pa.int64()), ("provider_id", pa.string()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]
    + [("overlap_chars", pa.int32()), ("boundary", pa.string()), ("piece_text", pa.string())]
)


def _cut(batches):
    for b in batches:
        cols: list[list] = [[] for _ in _OUT]
        for mid, prov, text, limit, over in zip(*[b.column(c).to_pylist() for c in ("message_id", "provider_id", "content", "seq_length", "overlap_tokens")]):
            pieces = split_text(text, limit, over)
            for k, (s, core, e, how) in enumerate(pieces):
                for col, v in zip(cols, (mid, prov, k, len(pieces), s, e, core - s, how, text[s:e])):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def with_limits(df: DataFrame, providers: DataFrame) -> DataFrame:
    """Add the seq_length and overlap_tokens that apply; the provider table has a row a provider."""
    p = providers.groupBy("provider_id").agg(
        F.max("seq_length").alias("seq_length"), F.max("overlap_tokens").alias("overlap_tokens"), F.max(F.coalesce("is_default", F.lit(False))).alias("is_default")
    )
    known = p.where("provider_id is not null").select(F.col("provider_id").alias("_p"), F.col("seq_length").alias("_l"), F.col("overlap_tokens").alias("_o"))
    default = p.where("is_default").agg(F.min_by("provider_id", "provider_id").alias("_dp"), F.min_by("seq_length", "provider_id").alias("_dl"), F.min_by("overlap_tokens", "provider_id").alias("_do"))
    d = df.drop("seq_length", "overlap_tokens").join(known, F.col("provider_id") == F.col("_p"), "left").crossJoin(default)  # one row
    return d.withColumns(
        {"provider_id": F.coalesce("_p", "_dp"), "seq_length": F.coalesce("_l", "_dl"), "overlap_tokens": F.coalesce("_o", "_do", F.lit(0))}
    ).drop("_p", "_l", "_o", "_dp", "_dl", "_do")


def split_oversized(messages: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per piece of each content longer than the limit that applies to it."""
    ship(messages.sparkSession)
    m = with_limits(messages.select("message_id", "content", "provider_id", "ingested_at"), providers)
    long = m.where(F.length("content") > F.greatest("seq_length", F.lit(1)))
    once = long.groupBy("message_id").agg(F.min_by(F.struct("provider_id", "content", "seq_length", "overlap_tokens"), "ingested_at").alias("r"))
    src = once.select(F.col("message_id").cast("long").alias("message_id"), "r.provider_id", "r.content", F.col("r.seq_length").cast("int").alias("seq_length"), F.col("r.overlap_tokens").cast("int").alias("overlap_tokens"))
    return src.mapInArrow(_cut, "message_id long, provider_id string, piece int, n_pieces int, start_pos int, end_pos int, overlap_chars int, boundary string, piece_text string")


def found(messages: DataFrame, providers: DataFrame) -> DataFrame:
    """message_id of every content that had to be cut."""
    return split_oversized(messages, providers).where("piece = 0 and n_pieces > 1").select("message_id")


def reassembled(pieces: DataFrame) -> DataFrame:
    """(message_id, n_chars, text_md5) of the contents put together again from their pieces without the overlaps."""
    core = F.struct("piece", F.expr("substring(piece_text, overlap_chars + 1)").alias("core"))
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(core)), lambda x: x["core"]))  # the pieces of one content
    return pieces.groupBy("message_id").agg(whole.alias("text")).select("message_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))
