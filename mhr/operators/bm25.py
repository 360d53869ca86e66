"""Keyword search: postings, BM25 with phrase bonus, phrase search.

A document's length rides along with each of its tokens, so lengths need no join.  Asked terms alone leave their text, and
a phrase is looked for where its rarest term stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mhr.functions.text import STOP_WORDS, cached_stem, code_of, cut_words, stem_column, word_codes, words_with_positions
from mhr.sources.shared import stored

from .search import ranked

K1, B, BONUS = 1.5, 0.75, 2.0
#: Distinct terms that are asked for in one pass over the texts.
ASKED = 500_000


def tokens(docs: DataFrame, stem: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_num, pos, term) without stop words, which pos counts."""
    out = words_with_positions(docs, F.col(text_col), F.col(id_col).cast("bigint").alias("doc_num")).where(~F.col("term").isin(*STOP_WORDS))
    return out.withColumn("term", stem_column("term")) if stem else out


def index(toks: DataFrame) -> DataFrame:
    """(term, doc_num, tf, positions)"""
    return toks.groupBy("term", "doc_num").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def statistics(toks: DataFrame) -> DataFrame:
    """One row: documents with a token, distinct terms, postings, mean length."""
    per = toks.groupBy("doc_num", "term").count().groupBy("doc_num").agg(F.sum("count").alias("dl"), F.count("*").alias("terms"))
    return per.agg(F.count("*").alias("docs"), F.sum("terms").alias("postings"), F.round(F.avg("dl"), 6).alias("mean_length")).crossJoin(toks.agg(F.countDistinct("term").alias("terms")))


def _occurrences(shared, stem: bool):
    """Postings of asked terms over a task's texts, and a row without term: how many documents they are, and of what length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        number = {t: i for i, t in enumerate(terms)}
        codes = np.array([code_of(t) for t in terms], np.uint64)
        order = np.argsort(codes)
        codes, names = codes[order], pa.array([terms[i] for i in order], pa.string())
        place_of = np.argsort(order)
        stops = np.sort(np.array([code_of(w) for w in STOP_WORDS], np.uint64))
        stems: dict[int, int] = {}
        docs, total = 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, starts, ends, row, place in cut_words(batch.column(1)):
                h = word_codes(buf, starts, ends)
                keep = np.flatnonzero(~_among(stops, h)[1])
                h, row, place = h[keep], row[keep], place[keep]
                length = np.bincount(row, minlength=hi - lo)
                docs, total = docs + int((length > 0).sum()), total + int(length.sum())
                if stem:
                    seen, first, back = np.unique(h, return_index=True, return_inverse=True)
                    if len(stems) > 1 << 20:
                        stems.clear()
                    for x, k in zip(seen.tolist(), keep[first].tolist()):
                        if x not in stems:
                            n = number.get(cached_stem(buf[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")))
                            stems[x] = -1 if n is None else int(place_of[n])
                    term = np.array([stems[x] for x in seen.tolist()], np.int64)[back] if len(seen) else np.empty(0, np.int64)
                    hit = np.flatnonzero(term >= 0)
                else:
                    term, found = _among(codes, h)
                    hit = np.flatnonzero(found)
                term, row, place = term[hit], row[hit], place[hit]
                by = np.lexsort((place, term, row))
                term, row, place = term[by], row[by], place[by]
                edge = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))) if len(term) else np.empty(0, np.int64)
                at = np.append(edge, len(term)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(term[edge])), pa.array(ids[lo:hi][row[edge]].astype(np.int64)), pa.array(length[row[edge]].astype(np.int64)), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(place.astype(np.int32)))], _NAMES)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([total]), pa.array([docs]), pa.array([None], pa.list_(pa.int32()))], _NAMES)

    return run


_NAMES = ["term", "doc_num", "dl", "tf", "at"]


def _among(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in sorted `known` of each, and whether it is there."""
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return at, known[at] == h


class Postings:
    """What a set of queries needs of a corpus: the stored postings of their terms, and the number and mean length of documents.

    One pass over the texts for each ASKED distinct terms, which are counted first and broadcast; words that aren't asked for
    never leave Python.  Ids tell documents apart: rows that share one are documents of one number.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame, stem: bool = False, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        asked = stored(terms.select("term").where(~F.col("term").isin("", *STOP_WORDS)).distinct(), "asked")
        flat = docs.select(F.col(id_col).cast("bigint").alias("doc_num"), F.col(text_col).cast("string").alias("text")).where("doc_num is not null and text is not null")
        parts, out = max(1, -(-asked.count() // ASKED)), None
        for part in range(parts):
            some = sorted(r.term for r in asked.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect())  # ASKED, about
            one = flat.mapInArrow(_occurrences(spark.sparkContext.broadcast(some), stem), "term string, doc_num bigint, dl bigint, tf bigint, at array<int>")
            out = one if out is None else out.unionByName(one)
        found = stored(out, "postings")
        r = found.where("term is null").agg(F.sum("tf"), F.sum("dl")).first()
        self.docs = (r[0] or 0) // parts
        self.mean = (r[1] or 0) / parts / max(1, self.docs)
        self.rows = found.where("term is not null")
        self.df = self.rows.groupBy("term").agg(F.count("*").alias("df"))

    def scored(self, asked: DataFrame, *by: str, only: DataFrame | None = None) -> DataFrame:
        """(by, doc_num, score) by asked terms (by, term, weight); `only` of documents in (by, doc_num)."""
        rows = self.rows.select("term", "doc_num", "dl", "tf").join(asked.join(self.df, "term"), "term")
        if only is not None:
            rows = rows.join(only, [*by, "doc_num"], "left_semi")
        idf = F.log((self.docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / self.mean))
        return rows.groupBy(*by, "doc_num").agg(F.sum(F.col("weight") * idf * gain).alias("score"))

    def matches(self, phrases: DataFrame) -> DataFrame:
        """(qid, phrase, doc_num): documents where all terms of (qid, phrase, off, term) stand at consecutive positions.

        A phrase's rarest term (ties: the first) is its anchor: only documents that have it are looked at.
        """
        w = Window.partitionBy("qid", "phrase")
        known = phrases.join(self.df, "term", "left").withColumn("missing", F.max(F.col("df").isNull()).over(w)).where("not missing")
        known = known.withColumn("need", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("df", "off")))
        anchors = known.where("i = 1").select("qid", "phrase", F.col("off").alias("first"), "term", "need")
        at = anchors.join(self.rows.select("term", "doc_num", F.explode("at").alias("pos")), "term").select("qid", "phrase", "doc_num", (F.col("pos") - F.col("first")).alias("start"), "need")
        alone = at.where("need = 1").select("qid", "phrase", "doc_num")
        rest = known.where("i > 1").select("qid", "phrase", "off", "term")
        near = at.where("need > 1").join(rest, ["qid", "phrase"]).join(self.rows.select("term", "doc_num", "at"), ["term", "doc_num"])
        near = near.where(F.array_contains("at", (F.col("start") + F.col("off")).cast("int")))
        held = near.groupBy("qid", "phrase", "doc_num", "start", "need").agg(F.countDistinct("off").alias("got")).where("got = need - 1")
        return alone.unionByName(held.select("qid", "phrase", "doc_num")).distinct()


def _weighed(query_tokens: DataFrame, *by: str) -> DataFrame:
    """(by, term, weight): a repeated query term counts repeatedly."""
    return query_tokens.groupBy(*by, "term").agg(F.count("*").alias("weight"))


def search(docs: DataFrame, query_tokens: DataFrame, k: int | None = 10, stem: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(qid, rank, doc_num, score) of every document with a term of (qid, term), stemmed as the documents are to be; a repeated one counts repeatedly.

    The postings are built and stored while the result is built.
    """
    found = Postings(docs, query_tokens, stem, id_col, text_col).scored(_weighed(query_tokens, "qid"), "qid").withColumn("score", F.round("score", 9))
    return ranked(found, ["qid"], k).select("qid", "rank", "doc_num", "score")


def search_with_phrases(docs: DataFrame, query_tokens: DataFrame, phrases: DataFrame, k: int | None = 10) -> DataFrame:
    """BM25 plus a bonus for each phrase that stands in the document, once; documents may match by phrase alone."""
    posts = Postings(docs, query_tokens.select("term").unionByName(phrases.select("term")))
    bonus = posts.matches(phrases).groupBy("qid", "doc_num").agg((F.count("*") * BONUS).alias("bonus"))
    both = posts.scored(_weighed(query_tokens, "qid"), "qid").join(bonus, ["qid", "doc_num"], "full")
    found = both.select("qid", "doc_num", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0)), 9).alias("score"))
    return ranked(found, ["qid"], k).select("qid", "rank", "doc_num", "score")


def search_phrase(docs: DataFrame, phrases: DataFrame, k: int | None = 10) -> DataFrame:
    """Only documents that hold a phrase, scored by BM25 of its terms; each phrase ranks by itself."""
    posts = Postings(docs, phrases)
    held = stored(posts.matches(phrases), "matches")
    asked = _weighed(phrases.join(held.select("qid", "phrase").distinct(), ["qid", "phrase"], "left_semi"), "qid", "phrase")
    found = posts.scored(asked, "qid", "phrase", only=held).withColumn("score", F.round("score", 9))
    return ranked(found, ["qid", "phrase"], k).select("qid", "phrase", "rank", "doc_num", "score")
