"""Problem 7: evaluation items that leaked into training documents.

Plan
----
1. Texts are brought into one notation (escapes, width, case, line breaks, quote marks, punctuation)
   and cut into tokens: words, and single characters of Chinese.
2. Template canonicalisation with typed placeholders: <N> for numbers in digits or words, <U> for the unit behind
   a number, <X> for names: words that the items only write with a capital and that few of them have, and
   words that no item has.  The tokens behind the placeholders are the slots.  Every window of five
   canonical tokens gets a template hash and a slot hash.  A window of four or five slots says nothing
   as a template; its tokens themselves are its template.  A window without slots counts unless several
   items have it.  An item of fewer than five tokens is one window of its length.
3. Hash join of the documents' windows with the items' windows on the template; windows that agree on
   the slots too are literal.  Where enough of an item's templates meet in one passage its slots are
   compared: the same, renamed consistently, or otherwise.  ``found`` reports the passages that are
   literal, ``reparameterised`` the pattern under other parameters, consistently renamed.  The
   items' windows are bounded by the evaluation set, whose size is checked; within the bound their
   templates travel to the scan as a sorted array, so that documents without any template window
   never leave it; beyond the bound all windows are joined.
4. Pairs with literal windows are aligned token by token around the densest place, and the share of
   the item's own text (without stock instructions) found in one passage is measured.

Defined results: null or empty texts leak nothing and are no items; a passage of fewer than LEAST_TOKENS tokens is
a leak only if it is the whole item; items with the same text all come out; a doc_id delivered twice counts once.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import materialize, ship

WINDOW = 5
#: Share of the item's own text that makes a leak.
SHARE = 0.29
#: Tokens of an item that must be found, unless the whole item is.
LEAST_TOKENS = 8
#: Share of an item's windows whose templates make its pattern, and share of slots that may go against the renaming.
PATTERN_SHARE, SLIPS = 0.3, 0.2
#: Items and windows up to which the evaluation set travels to the scan.
MAX_ITEMS, MAX_WINDOWS = 200_000, 5_000_000
#: Different items in which a capitalised word occurs at least to be part of the patterns rather than a name.
COMMON = 4
#: Different items that must share a sentence for it to be a stock instruction, or a window without slots to say nothing.
STOCK = 3
#: Numbers in words, and units, which are slots behind a number.
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil "
    "nol dua tiga empat lima enam tujuh delapan sembilan sepuluh sebelas seratus seribu".split()
)
UNITS = frozenset(
    "mm cm m km mi ft in yd mg g kg t oz lb ml l s ms min h hz khz mhz kb mb gb tb kw kwh w v a °c °f usd eur percent second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres mile miles gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents degree degrees sekunde sekunden minuten stunde stunden tag tage tagen woche wochen "
    "monat monate jahr jahre jahren prozent segundo segundos minuto minutos hora horas día días semana semanas mes meses año años kilómetro kilómetros metro metros litro litros por ciento detik menit jam hari minggu "
    "bulan tahun persen".split()
)

_ESC = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrt\"/\\])")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？；])")
_ENTITY = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[a-zA-Z]{2,8});")
_ZERO = re.compile("[​‌‍⁠﻿­]")


def notation(text: str) -> str:
    t = text
    if "\\" in t:
        t = _ESC.sub(lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "r": "\n", "t": " "}.get(m[2], m[2]), t)
    if "&" in t and _ENTITY.search(t):
        t = html.unescape(t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _ZERO.sub("", t))
    return t.casefold()


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(notation(text)) if text else []


def _mix(a: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (the finaliser of splitmix64)."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


_SLOT, _TYPE = 1 << 62, 3 << 60
#: Types of placeholders, in two bits beside the mark of a slot.
NAME, NUMBER, UNIT = 0, 1, 2


def _token_hash(t: str) -> int:
    h = 1469598103934665603
    for b in t.encode():
        h = ((h ^ b) * 1099511628211) & 0x0FFFFFFFFFFFFFFF
    return h


class Canon:
    """Tokens to hashes; slots carry a mark and their type, so that one array holds template and slot values."""

    def __init__(self, common: set[str]):
        self.ids: dict[str, int] = {}
        self.units: dict[int, int] = {_token_hash(u): _token_hash(u) | _SLOT | UNIT << 60 for u in UNITS}
        self.common = common

    def ids_of(self, toks: list[str]) -> np.ndarray:
        ids, common, units = self.ids, self.common, self.units
        if len(ids) > 500_000:
            ids.clear()
        out, number = [], False
        for t in toks:
            v = ids.get(t)
            if v is None:
                v = _token_hash(t)
                if t.isdigit() or t in NUMBER_WORDS:
                    v |= _SLOT | NUMBER << 60
                elif t not in common:
                    v |= _SLOT | NAME << 60
                ids[t] = v
            if number:
                v = units.get(v & ~(_SLOT | _TYPE), v)
            number = v & (_SLOT | _TYPE) == _SLOT | NUMBER << 60
            out.append(v)
        return np.array(out, dtype=np.uint64)

    def slot_places(self, toks: list[str]) -> np.ndarray:
        return (self.ids_of(toks) & np.uint64(_SLOT)) != 0

    def windows(self, toks: list[str], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions, template hashes, slot hashes, numbers of slots) of all windows of ``size`` tokens."""
        n = len(toks) - size + 1
        if n <= 0:
            z = np.empty(0, np.uint64)
            return np.empty(0, np.int64), z, z, np.empty(0, np.int64)
        raw = self.ids_of(toks)
        slot = (raw & np.uint64(_SLOT)) != 0
        canon = np.where(slot, np.uint64(7) + (raw & np.uint64(_TYPE)), raw)
        value = np.where(slot, raw, np.uint64(0))
        th, sh, ns = np.full(n, size, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        with np.errstate(over="ignore"):
            for k in range(size):
                th = _mix(th * np.uint64(0x9E3779B97F4A7C15) + canon[k : k + n])
                sh = _mix(sh * np.uint64(0xD6E8FEB86659FD93) + value[k : k + n])
                ns += slot[k : k + n]
            # Nearly only placeholders: the tokens themselves are the template.
            th = np.where((ns > size - 2) & (ns > 0), _mix(th ^ sh), th)
        return np.arange(n), th, sh, ns


def own_tokens(item_text: str, stock: set[str]) -> list[str]:
    """Tokens of an item without the stock instructions."""
    return [t for s in _SENTENCE.split(item_text or "") if notation(s).strip() not in stock for t in tokens(s)]


def densest(hits: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The run of hits, without gaps of ``n`` tokens in the document, that holds most places of the item."""
    best: list[tuple[int, int]] = []
    cur: list[tuple[int, int]] = []
    for h in sorted(hits, key=lambda h: h[1]):
        if cur and h[1] - cur[-1][1] > n:
            cur = []
        cur.append(h)
        if len({x for x, _ in cur}) > len({x for x, _ in best}):
            best = list(cur)
    return best


def slot_agreement(item: list[str], doc: list[str], hits: list[tuple[int, int]], common: set[str], canon: Canon | None = None) -> tuple[int, int, int, int]:
    """(places of the item, slots the same, renamed consistently, otherwise) in its densest passage.

    A renaming is consistent if a value always becomes the same other value, and no two values the same one.
    """
    slots = (canon or Canon(common)).slot_places(item)
    best = densest(hits, len(item))
    at = sorted(d - i for i, d in best)[len(best) // 2]
    place: dict[int, int] = {}
    for i, d in best:
        if i not in place or abs(d - i - at) < abs(place[i] - i - at):
            place[i] = d
    pairs: dict[int, tuple[str, str]] = {}
    for i, d in sorted(place.items()):
        for k in range(min(WINDOW, len(item))):
            if slots[i + k]:
                pairs.setdefault(i + k, (item[i + k], doc[d + k]))
    counts = Counter(pairs.values())
    image: dict[str, str] = {}
    origin: dict[str, str] = {}
    for (a, b), _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        image.setdefault(a, b)
        origin.setdefault(b, a)
    same = sum(k for (a, b), k in counts.items() if a == b)
    renamed = sum(k for (a, b), k in counts.items() if a != b and image[a] == b and origin[b] == a)
    return len(place), same, renamed, len(pairs) - same - renamed


def covered(item: list[str], doc: list[str], hits: list[tuple[int, int]]) -> tuple[float, int]:
    """(share of the item's characters, number of its tokens) found in the document around its densest hits.

    ``hits`` are (position in the item, position in the document) of literal windows.  Only
    runs of several tokens count, so words that any text has do not add up.
    """
    n = len(item)
    best = densest(hits, n)
    lo = max(0, min(d - i for i, d in best) - 8)
    lo = min(lo, max(0, best[0][1] - n))
    hi = min(len(doc), best[-1][1] + n + 8)
    lo = max(lo, best[0][1] - n - 8)
    sm = difflib.SequenceMatcher(None, item, doc[max(0, lo) : hi], autojunk=False)
    size = sum(map(len, item))
    got = k_all = 0
    for a, _, k in sm.get_matching_blocks():
        run = item[a : a + k]
        if k >= min(n, 4 if run and len(run[0]) == 1 and not run[0].isascii() else 3):
            got += sum(map(len, run))
            k_all += k
    return (got / size if size else 0.0), k_all


def _scan(common: set[str], sizes: list[int], templates: np.ndarray | None):
    def scan(batches):
        canon = Canon(common)
        for b in batches:
            ids, pos, ths, shs, toks = [], [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                t = tokens(text)
                parts = [canon.windows(t, size)[:3] for size in sizes]
                p, th, sh = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3
                if templates is not None and not len(templates):
                    p = p[:0]
                elif templates is not None and len(p):
                    at = np.searchsorted(templates, th)
                    hit = templates[np.minimum(at, len(templates) - 1)] == th
                    p, th, sh = p[hit], th[hit], sh[hit]
                if len(p):
                    ids.append(doc)
                    pos.append(p.astype(np.int32))
                    ths.append(th.astype(np.int64))
                    shs.append(sh.astype(np.int64))
                    toks.append(" ".join(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pos, pa.list_(pa.int32())), pa.array(ths, pa.list_(pa.int64())), pa.array(shs, pa.list_(pa.int64())), pa.array(toks, pa.string())],
                names=["doc_id", "pos", "template", "slots", "tokens"],
            )

    return scan


_ALIGNED = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.string()), ("n_windows", pa.int32()), ("share", pa.float64()), ("n_templates", pa.int32()), ("n_same", pa.int32()), ("n_renamed", pa.int32()), ("n_other", pa.int32()), ("is_renamed", pa.bool_())]
)
_ALIGNED_DDL = "doc_id long, item_id string, n_windows int, share double, n_templates int, n_same int, n_renamed int, n_other int, is_renamed boolean"


def _align(common: set[str]):
    def align(batches):
        canon = Canon(common)
        for b in batches:
            rows = []
            for doc, item, it, dt, hits, of in zip(*[b.column(c).to_pylist() for c in ("doc_id", "item_id", "item_tokens", "tokens", "hits", "n_form")]):
                own, text = it.split(" "), dt.split(" ")
                literal = [(h["item_pos"], h["doc_pos"]) for h in hits if h["literal"]]
                share, found_ = covered(own, text, literal) if literal else (0.0, 0)
                if found_ < min(LEAST_TOKENS, len(own)):
                    share = 0.0
                k, same, renamed, other = slot_agreement(own, text, [(h["item_pos"], h["doc_pos"]) for h in hits], common, canon)
                pattern = k + WINDOW > min(LEAST_TOKENS, len(own)) and k >= PATTERN_SHARE * of and renamed > same and other <= SLIPS * (same + renamed + other)
                rows.append((doc, item, len({i for i, _ in literal}), share, k, same, renamed, other, pattern))
            cols = list(zip(*rows)) if rows else [()] * len(_ALIGNED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ALIGNED)], schema=_ALIGNED)

    return align


def prepare_items(items: DataFrame):
    """(rows of items, pattern words) of the evaluation set; its size is checked first."""
    n = items.count()
    if n > MAX_ITEMS:
        raise ValueError(f"{n} evaluation items; the bound for one pass is {MAX_ITEMS}: split the evaluation set")
    rows = [(r.item_id, r.item_text) for r in items.select("item_id", "item_text").collect() if r.item_id is not None and r.item_text]
    # The same text under several ids counts once.
    texts = {notation(t).strip(): t for _, t in rows}
    sentences = Counter(s for t in texts.values() for s in {notation(x).strip() for x in _SENTENCE.split(t)} if s)
    stock = {s for s, k in sentences.items() if k >= STOCK}
    own = [(i, own_tokens(t, stock)) for i, t in rows]
    own = [(i, t) for i, t in own if t]
    df = Counter(w for t in {tuple(t) for _, t in own} for w in set(t))
    # Words that an item writes in small letters are no names.
    small = {w for t in texts.values() for w in _TOKEN.findall(unicodedata.normalize("NFKC", t)) if not w[:1].isupper()}
    common = {w for w, k in df.items() if (k >= COMMON or w in small) and not w.isdigit()}
    return own, common


def item_windows(own: list[tuple[str, list[str]]], common: set[str]):
    """(sizes of windows, item_id, item_pos, template, slots as arrays, (item_id, tokens, windows, those of a template) per item)."""
    canon = Canon(common)
    parts, toks = [], []
    for item, t in own:
        size = min(WINDOW, len(t))
        p, th, sh, ns = canon.windows(t, size)
        parts.append((np.full(len(p), len(toks)), p, th, sh, ns == 0, ns <= size - 2))
        toks.append([item, " ".join(t), 0, 0])
    if not parts:
        z = np.empty(0, np.uint64)
        return [], z, z, z, z, []
    at, pos, th, sh, plain, form = (np.concatenate(x) for x in zip(*parts))
    # A window without slots that several different items have says nothing.
    text_no = {x: k for k, x in enumerate(dict.fromkeys(t[1] for t in toks))}
    text_of = np.array([text_no[t[1]] for t in toks])[at]
    seen, of = np.unique(th, return_inverse=True)
    pairs = np.unique(np.stack([of, text_of]), axis=1)[0] if len(of) else of
    shared = np.bincount(pairs, minlength=len(seen))[of] >= STOCK
    # An item of nothing but such windows keeps them: it can be found only by them.
    keep = ~(plain & shared)
    keep |= ~np.isin(at, at[keep])
    at, pos, th, sh, form = at[keep], pos[keep], th[keep], sh[keep], form[keep]
    for k, n in zip(*np.unique(at, return_counts=True)):
        toks[k][2] = int(n)
    for k, n in zip(*np.unique(at[form], return_counts=True)):
        toks[k][3] = int(n)
    return sorted({min(WINDOW, len(t)) for _, t in own}), at, pos, th, sh, toks


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for every pair with two literal windows (or all of an item's) or PATTERN_SHARE of the item's
    windows that have a template.

    ``n_windows`` and ``share`` are literal; ``n_templates`` and the slots (``n_same``, ``n_renamed``, ``n_other``) are
    of the densest passage; ``is_renamed`` marks the item's pattern with most parameters renamed (whatever ``share`` of the words is literal).
    """
    spark = docs.sparkSession
    ship(spark)
    own, common = prepare_items(items)
    sizes, at, pos, th, sh, toks = item_windows(own, common)
    known = np.unique(th)
    names = np.array([t[0] for t in toks], dtype=object)
    windows = pa.table(
        {"item_id": pa.array(names[at] if len(at) else [], pa.string()), "item_pos": pa.array(pos, pa.int32()), "template": pa.array(th.astype(np.int64)), "item_slots": pa.array(sh.astype(np.int64))}
    )
    item_w = spark.createDataFrame(windows)
    item_t = spark.createDataFrame([tuple(t) for t in toks], "item_id string, item_tokens string, n_item int, n_form int")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    scanned = materialize(
        src.mapInArrow(_scan(common, sizes, known if len(known) <= MAX_WINDOWS else None), "doc_id long, pos array<int>, template array<long>, slots array<long>, tokens string"), "windows"
    )
    exploded = scanned.select("doc_id", F.explode(F.arrays_zip("pos", "template", "slots")).alias("w")).select("doc_id", F.col("w.pos").alias("doc_pos"), "w.template", "w.slots")
    literal = F.col("slots") == F.col("item_slots")
    pairs = exploded.join(item_w, "template").groupBy("doc_id", "item_id").agg(
        F.collect_list(F.struct("item_pos", "doc_pos", literal.alias("literal"))).alias("hits"), F.count_if(literal).alias("n_literal")  # at most the windows of one text
    )
    enough = (F.col("n_literal") >= F.least(F.lit(2), "n_item")) | ((F.col("n_form") > 0) & (F.size(F.array_distinct("hits.item_pos")) >= PATTERN_SHARE * F.col("n_form")))
    once = scanned.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    full = pairs.join(item_t, "item_id").where(enough).join(once, "doc_id").select("doc_id", "item_id", "item_tokens", "tokens", "hits", "n_form")
    return full.mapInArrow(_align(common), _ALIGNED_DDL)


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items).where(F.col("share") >= SHARE).select("doc_id", "item_id")


def reparameterised(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold an item's pattern with other, consistently renamed parameters."""
    return leaks(docs, items).where("is_renamed").select("doc_id", "item_id", "n_templates", "n_same", "n_renamed", "n_other")


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that hold it, documents that quote some words of it, and those with its pattern under other parameters."""
    return leaks(docs, items).groupBy("item_id").agg(
        F.count_if(F.col("share") >= SHARE).alias("n_docs"), F.count_if((F.col("share") < SHARE) & (F.col("n_windows") >= 1)).alias("n_touched"), F.count_if("is_renamed").alias("n_renamed"), F.round(F.max("share"), 6).alias("most")
    )
