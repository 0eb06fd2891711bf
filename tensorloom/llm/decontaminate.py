"""Benchmark decontamination with a distributed positional inverted index.

DataFrame functions only.  Documents are cut into words once, and the postings
(term, document, position) of the benchmark's terms are stored, each file of
the index holding the postings of its own documents sorted by term.  A phrase
is looked up from its rarest term: that list, moved by the term's offset, gives
candidate starts; the second rarest term's list is intersected with them; the
remaining lists are intersected for the documents that are left.  Proximity
matches let every other term lie up to ``slop`` words from its exact place.

Every document has one more posting of a term that no text can hold, at the
position after its last word: its length, so texts are read only once.

Lookup tables of the benchmark are written out and joined by plain joins, so
Spark broadcasts one where its files' size allows it and shuffles it otherwise.

Defined cases: a null or empty text has no words.  Rows are told apart by
doc_id and a hash of their text, so repeated rows get equal results and rows
that share a doc_id their own.  Benchmark rows with a null item_id or without a
word are left out.  A very long text is cut whole; its words become rows of
their own, so no row of the index grows with it.  Ties in a phrase's rarest term
go to the earlier one.  Empty tables on either side give whole results without
hits.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, without

WINDOW = 8
LEAST_ITEMS = 2
#: Between words: everything in ASCII but digits and lower-case letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term of a document's length; words never hold capitals.
_LENGTH = "A"
_DOC = ["dk", "th"]


def words(text: Column) -> Column:
    """The words of a text, its ASCII capitals lowered."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def text_hash(ident: str, text: str) -> Column:
    return F.xxhash64(F.isnull(ident), F.isnull(text), F.col(text))


def doc_key(ident: str) -> Column:
    return F.coalesce(F.col(ident), F.lit(-(1 << 63)))


@dataclass
class Phrases:
    """Distinct phrases: which items hold them, and their terms."""

    items: DataFrame  # phrase, item_id
    terms: DataFrame  # phrase, size, j, tid
    dictionary: DataFrame  # term, tid

    @classmethod
    def of(cls, benchmark: DataFrame, *, ident: str = "item_id", text: str = "text", window: int = WINDOW) -> Phrases:
        """All windows of ``window`` (63 at most) successive words; a shorter item is one window."""
        if not 1 <= window <= 63:
            raise ValueError(f"windows of {window} words")
        rows = benchmark.where(F.col(ident).isNotNull()).select(F.col(ident).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
        starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
        cut = rows.select("item_id", "w", starts.alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("win"))
        cut = staged(cut.distinct(), "windows")
        n = cut.count()
        numbered = staged(cut.select("win").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases", rows=n)
        flat = numbered.select("phrase", F.size("win").alias("size"), F.posexplode("win").alias("j", "term"))
        dictionary = staged(flat.select("term").distinct().withColumn("tid", F.monotonically_increasing_id() + 1), "dictionary", rows=n * window)
        items = staged(cut.join(numbered, "win").select("phrase", "item_id"), "items", rows=n)
        terms = staged(flat.join(dictionary, "term").select("phrase", "size", "j", "tid"), "phrase-terms", rows=n * window)
        return cls(items, terms, dictionary)


@dataclass
class Index:
    """Stored postings: tid, doc_id, th, pos; tid 0 gives a document's length."""

    postings: DataFrame

    @classmethod
    def build(cls, documents: DataFrame, dictionary: DataFrame, *, ident: str = "doc_id", text: str = "text") -> Index:
        spark = documents.sparkSession
        length = spark.range(1).select(F.lit(_LENGTH).alias("term"), F.lit(0).cast("long").alias("tid"))
        known = staged(dictionary.select("term", "tid").unionByName(length), "terms")
        cut = documents.select(F.col(ident).alias("doc_id"), text_hash(ident, text).alias("th"), F.concat(words(F.col(text)), F.array(F.lit(_LENGTH))).alias("w"))
        flat = cut.select("doc_id", "th", F.posexplode_outer("w").alias("pos", "term"))
        found = flat.join(known, "term").select("tid", "doc_id", "th", "pos")
        return cls(staged(found.sortWithinPartitions("tid", "doc_id", "pos"), "postings"))

    def lengths(self) -> DataFrame:
        """One row per document row: doc_id, th, n_words."""
        return self.postings.where("tid = 0").select("doc_id", "th", F.col("pos").cast("long").alias("n_words"))

    def _lists(self) -> DataFrame:
        return self.postings.where("tid > 0").select("tid", doc_key("doc_id").alias("dk"), "th", "pos")

    def matches(self, phrases: Phrases, *, slop: int = 0) -> DataFrame:
        """Places of phrases: phrase, size, dk, th, start; exact for slop zero."""
        counts = self.postings.where("tid > 0").groupBy("tid").agg(F.count("*").alias("n"))
        counts = staged(counts, "term-counts")
        whole = Window.partitionBy("phrase")
        ranked = (
            phrases.terms.join(counts, "tid", "left")
            .withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(whole))
            .where("least > 0")  # else a term occurs nowhere, and so neither does the phrase
            .withColumn("rank", F.row_number().over(whole.orderBy("n", "j")))
            .select("phrase", "size", "j", "tid", "rank")
        )
        ranked = staged(ranked, "ranked-terms")
        lists = self._lists()
        first = lists.join(ranked.where("rank = 1"), "tid").select("phrase", "size", "dk", "th", (F.col("pos") - F.col("j")).alias("start"))
        first = first.where("start >= 0") if not slop else first
        second = self._intersect(first, ranked.where("rank = 2"), lists.join(ranked.where("rank = 2").select("tid").distinct(), "tid", "left_semi"), slop)
        single = first.where("size = 1")
        left = staged(second.unionByName(single).distinct(), "candidates")
        docs = staged(left.select(*_DOC).distinct(), "candidate-documents")
        third = self._intersect(left, ranked.where("rank > 2"), lists.join(docs, _DOC, "left_semi"), slop)
        return third.unionByName(left.where("size <= 2"))

    @staticmethod
    def _intersect(candidates: DataFrame, terms: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
        """Candidates of which every one of ``terms`` lies at, or near, its place."""
        need = terms.groupBy("phrase").agg(F.count("*").alias("need"))
        wanted = candidates.join(terms.select("phrase", "j", "tid"), "phrase")
        if slop:
            wanted = wanted.withColumn("off", F.explode(F.sequence(F.lit(-slop), F.lit(slop))))
            wanted = wanted.withColumn("pos", F.col("start") + F.col("j") + F.col("off")).drop("off")
        else:
            wanted = wanted.withColumn("pos", F.col("start") + F.col("j"))
        hit = wanted.join(lists, [*_DOC, "pos", "tid"], "left_semi")
        got = hit.groupBy("phrase", "size", *_DOC, "start").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("got"))
        got = got.withColumn("got", F.bit_count("got"))
        return got.join(need, "phrase").where("got = need").select("phrase", "size", *_DOC, "start")


def report(documents: DataFrame, benchmark: DataFrame, *, ident: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, least_items: int = LEAST_ITEMS) -> DataFrame:
    """One row per document row: doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated."""
    phrases = Phrases.of(benchmark, ident=item, window=window)
    index = Index.build(documents, phrases.dictionary, ident=ident, text=text)
    found = staged(index.matches(phrases), "matches")
    end = F.col("start") + F.col("size")
    before = Window.partitionBy(*_DOC).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select(*_DOC, "start", "size").distinct().withColumn("before", F.coalesce(F.max(end).over(before), F.lit(0)))
    hits = spans.groupBy(*_DOC).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    # A document's phrases are as many as its words at most, an item's name is short.
    held = found.select("phrase", *_DOC).distinct().join(phrases.items, "phrase").select(*_DOC, F.col("item_id").cast("string").alias("item")).distinct()
    items = held.groupBy(*_DOC).agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    told = staged(hits.join(items, _DOC), "told")
    rows = index.lengths().withColumn("dk", doc_key("doc_id"))
    out = rows.join(told, _DOC, "left")
    return out.select(
        "doc_id",
        "th",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_items", F.lit(0)) >= least_items).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, *, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The input's rows and columns without contaminated documents."""
    bad = report(documents, benchmark, ident=ident, text=text, **options).where("contaminated").select(doc_key("doc_id").alias("dk"), "th").distinct()
    return without(documents, staged(bad, "contaminated"), {"dk": doc_key(ident), "th": text_hash(ident, text)})
