"""Problem 8: texts cut by a field limit or a broken transfer, and how often each source cuts.

Plan
----
1. One Arrow pass reads each text once.  It judges how the text ends (``endings``) and counts the texts
   of each word inside it; counts leave the pass combined per task, texts never do.
2. Corpus vocabulary trie as a table: the known words (seen inside at least KNOWN texts)
   exploded into their proper prefixes, aggregated to one row per trie node.  Final tokens are
   looked up by a join, so the trie is spread over the cluster and never collected.
3. Length evidence: per source, lengths (in code points and in bytes) at which unfinished texts pile up.
4. A text is cut if it ends in a mark of a cut, a stem or an unclosed structure.  Where only the final mark
   of a sentence is missing, evidence decides: the final token is an unknown proper prefix of known words
   (``word``), the text is as long as a limit (``limit``), or it ends in a comma, a joining word or a word
   that the corpus has inside sentences but not at their ends (``inside``).  A text that ends like a
   signature, heading, file, reference or link is cut if its final token is an unknown proper prefix or
   the text is as long as a limit.
   ``evidence`` names what speaks for the cut.

Defined results: null and empty texts are not cut; a null source is a source of its own; a text as
long as a limit that ends in a whole sentence or structure is not cut; a doc_id delivered twice counts once.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import materialize, ship
from tracelake.llm.endings import _CLOSERS, _SPACE, ending

#: Texts in which a word must occur to be known.
KNOWN = 3
#: A length is a limit of a source if this many unfinished texts, and this share of the source's, have it.
LIMIT_COUNT, LIMIT_SHARE = 4, 0.05
_WORD = re.compile(r"[^\W_]{2,}")
#: It also stands out this much from the mean of so many lengths on either side.
SPIKE_RATIO, SPIKE_WIDTH = 5, 10
#: A word stands inside sentences if it ends a sentence in at most INNER_SHARE of the texts that have it, and is known in
#: enough of them (INNER_LEAST) to say so: none of 300 is below 1 in 100 with 95 % confidence.
INNER_LEAST, INNER_SHARE = 300, 0.01
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{5,}\Z")
_END = re.compile(r"[.!?。！？；\n]+")
_WEAK_END = re.compile(r"(?:[,，、;:：(（\[{—–=+&/-]|\s[-–—])\Z")
_FLUSH = 200_000

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("state", pa.string()), ("why", pa.string()), ("token", pa.string())]
    + [("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("weak", pa.bool_()), ("word", pa.string()), ("n", pa.int64()), ("n_end", pa.int64())]
)
_DDL = "doc_id long, source string, state string, why string, token string, n_chars long, n_bytes long, weak boolean, word string, n long, n_end long"


def _rows(docs, words, ends):
    cols = [list(c) for c in zip(*docs)] if docs else [[] for _ in range(8)]
    k, w = len(docs), len(words)
    cols = [c + [None] * w for c in cols] + [[None] * k + list(words), [None] * k + list(words.values()), [None] * k + [ends[x] for x in words]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def last_word(t: str) -> str:
    """The unit that is looked up as the end of a sentence: the final word, or the final character of Chinese."""
    i = len(t)
    while i and t[i - 1].isalnum():
        if "\u3400" <= t[-1] <= "\u9fff":
            return t[-1]
        i -= 1
    return t[i:]


def sentence_ends(t: str) -> set[str]:
    """Last words of the sentences and lines of a text that has been put in lower case."""
    return {last_word(x[-40:].rstrip(_CLOSERS + _SPACE)) for x in _END.split(t)[:-1]} - {""}


def _read(batches):
    words: Counter = Counter()
    ends: Counter = Counter()
    for b in batches:
        docs = []
        for doc, source, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "source", "text")]):
            state, why, token = ending(text)
            low = (text or "").lower()
            weak = state == "open" and bool(_WEAK_END.search(low.rstrip(_SPACE)))
            docs.append((doc, source, state, why, token.lower(), len(text or ""), len((text or "").encode()), weak))
            found = _WORD.findall(low)
            if state == "open" and token and found and found[-1] == token.lower():
                found.pop()  # the broken word itself is what is in question
            here = set(found)
            if not low.isascii():
                here.update(c for c in set(low) if "\u3400" <= c <= "\u9fff")
            words.update(here)
            ends.update(sentence_ends(low) & here)
        flush = len(words) > _FLUSH
        yield _rows(docs, words if flush else {}, ends)
        if flush:
            words, ends = Counter(), Counter()
    yield _rows([], words, ends)


#: Longer prefixes are named by their first so many characters, their length and their hash.
NODE_CHARS = 64


def node(prefix: Column) -> Column:
    """Name of a trie node: the prefix itself, or for a very long one its beginning, length and hash."""
    long_ = F.concat(F.left(prefix, F.lit(NODE_CHARS)), F.lit("~"), F.length(prefix).cast("string"), F.lit("~"), F.md5(prefix))
    return F.when(F.length(prefix) <= NODE_CHARS, prefix).otherwise(long_)


def trie_nodes(words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(prefix, n_below): every proper prefix of a known word, one row a trie node.

    With ``asked`` (token) only the depths at which a token ends are built; one very long word would
    otherwise give as many nodes as it has letters.
    """
    known = words.where(F.col("n") >= KNOWN).where(~F.col("word").rlike(_HEX.pattern.replace(r"\Z", "$"))).where(F.length("word") >= 2)
    if asked is None:
        depths = F.sequence(F.lit(1), F.length("word") - 1)
    else:
        # One row: the distinct lengths of the tokens.
        known = known.crossJoin(asked.agg(F.collect_set(F.length("token")).alias("_depths")))
        depths = F.filter("_depths", lambda i: (i > 0) & (i < F.length("word")))
    nodes = known.select(F.explode(F.transform(depths, lambda i: node(F.left(F.col("word"), i)))).alias("prefix"), "n")
    return nodes.groupBy("prefix").agg(F.sum("n").alias("n_below"))


def judge_endings(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_chars, is_cut, evidence) for every document."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    read = materialize(src.mapInArrow(_read, _DDL), "endings")
    d = (
        read.where("word is null and state is not null").groupBy("doc_id")
        .agg(F.min(F.struct("source", "state", "why", "token", "n_chars", "n_bytes", "weak")).alias("r")).select("doc_id", "r.*")
    )
    words = read.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
    asked = d.where("token <> ''").select("token").distinct()
    nodes = trie_nodes(words, asked)
    known = asked.join(words, F.col("token") == F.col("word"), "left").select("token", F.coalesce("n", F.lit(0)).alias("n_known"))
    seen = known.join(nodes, node(F.col("token")) == F.col("prefix"), "left").select(
        "token", ((F.col("n_known") < KNOWN) & (F.coalesce("n_below", F.lit(0)) >= KNOWN) & ~F.col("token").rlike("^[0-9]+$")).alias("unknown_prefix")
    )
    # In Chinese the final character is looked up instead of the run of characters.
    last = F.when(F.col("token").rlike(r"[\u3400-\u9fff]$"), F.right("token", F.lit(1))).otherwise(F.col("token"))
    inner = words.where((F.col("n") >= INNER_LEAST) & (F.col("n_end") <= INNER_SHARE * F.col("n")) & ~F.col("word").rlike("[0-9]"))
    inner = asked.withColumn("last", last).join(inner.select(F.col("word").alias("last"), F.lit(True).alias("inner")), "last", "left").select("token", F.coalesce("inner", F.lit(False)).alias("inner"))
    seen = seen.join(inner, "token")
    is_open = F.col("state") == "open"
    per_source = d.groupBy("source").agg(F.count_if(is_open).alias("n_open"))
    limits = []
    for col in ("n_chars", "n_bytes"):
        h = d.where(is_open).groupBy("source", col).agg(F.count("*").alias("n_at"))
        h = h.withColumn("n_beside", F.sum("n_at").over(Window.partitionBy("source").orderBy(col).rangeBetween(-SPIKE_WIDTH, SPIKE_WIDTH)) - F.col("n_at"))
        h = h.join(per_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        h = h.where((F.col("n_at") >= LIMIT_COUNT) & (F.col("n_at") >= LIMIT_SHARE * F.col("n_open")))
        h = h.where(F.col("n_at") * 2 * SPIKE_WIDTH >= SPIKE_RATIO * F.col("n_beside"))
        limits.append(h.select(F.col("source").alias(f"s_{col}"), F.col(col).alias(f"v_{col}"), F.lit(True).alias(f"at_{col}")))
    # Most texts end properly and ask for no word; they stay out of the join, where they would be one hot key.
    j = d.where("token <> ''").join(seen, "token", "left")
    j = j.unionByName(d.where("token = ''").withColumn("unknown_prefix", F.lit(False)).withColumn("inner", F.lit(False)))
    for col, lim in zip(("n_chars", "n_bytes"), limits):
        j = j.join(lim, F.col("source").eqNullSafe(F.col(f"s_{col}")) & (F.col(col) == F.col(f"v_{col}")), "left")
    prefix = F.coalesce("unknown_prefix", F.lit(False))
    limit = F.coalesce("at_n_chars", F.lit(False)) | F.coalesce("at_n_bytes", F.lit(False))
    half = (F.col("state") == "closed") & F.col("why").isin("signature", "heading", "file", "reference", "link") & ((prefix & (F.length("token") >= 2)) | limit)
    inside = F.col("weak") | (F.col("inner") & ~prefix)
    # A mark of a cut or an open structure speaks for itself; a sentence without its final mark does not.
    is_cut = half | (is_open & ((F.col("why") != "sentence") | prefix | limit | inside))
    evidence = F.array_join(
        F.array_compact(
            F.array(
                F.when(is_open | half, F.col("why")), F.when(prefix & (is_open | half), F.lit("word")), F.when(limit & (is_open | half), F.lit("limit")),
                F.when(is_open & (F.col("why") == "sentence") & inside, F.lit("inside")),
            )
        ),
        "+",
    )
    return j.select("doc_id", "source", "n_chars", is_cut.alias("is_cut"), F.when(is_cut, evidence).otherwise("").alias("evidence"))


def found(docs: DataFrame) -> DataFrame:
    return judge_endings(docs).where("is_cut").select("doc_id")


def rates(docs: DataFrame) -> DataFrame:
    """Per source: documents, cut documents and their share."""
    return judge_endings(docs).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if("is_cut").alias("n_cut"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("share_cut")
    )
