"""Full text over a table: a boolean query is a predicate on each row's terms, so a search is one scan and a
ranked one two, without a shuffle of postings. `postings` and the functions on it serve a stored index."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound
from ..functions.text import folded, terms
from ..plans.boolquery import Node, Op, Term, parse, positive


def document(fields: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


def _fold(text: str) -> str:
    import unicodedata

    text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return text.replace("ß", "ss").replace("’", "'").replace("_", "")


def holds(node: Node, of: Column) -> Column:
    """Whether a row's terms satisfy the query. A leaf of several words never matches, as no positions are kept."""
    if isinstance(node, Op):
        left, right = holds(node.left, of), holds(node.right, of)
        return left & right if node.kind == "AND" else left | right if node.kind == "OR" else left & ~right
    if "*" in node.text:
        if node.text.strip("*") == "":
            raise ValueError("a lone wildcard")
        stem = _fold(node.text)
        if stem.endswith("*") and "*" not in stem[:-1]:
            return F.exists(of, lambda x: x.startswith(stem[:-1]))
        pattern = "^" + ".*".join(re.escape(p) for p in stem.split("*"))
        return F.exists(of, lambda x: x.rlike(pattern))
    words = _fold(node.text).split()
    return F.array_contains(of, words[0]) if len(words) == 1 else F.lit(False)


def search(df: DataFrame, query: str, doc_id: str, fields: Sequence[str], mode: str = "boolean", k1: float = 1.5, b: float = 0.75, deleted: DataFrame | None = None) -> DataFrame:
    """Rows of df that satisfy the query, with a score (null for boolean). Statistics are over all rows, deleted ones included."""
    if mode not in ("boolean", "bm25", "tfidf"):
        raise ValueError(f"no mode {mode}")
    tree = parse(query)
    work = df.select("*", F.explode(F.array(terms(document(fields)))).alias("__t"))  # a generator, so that texts are cut once
    hits = work.where(holds(tree, F.col("__t")))
    if deleted is not None:
        hits = hits.join(deleted, doc_id, "left_anti")
    if mode == "boolean":
        return hits.withColumn("score", F.lit(None).cast("double")).drop("__t")
    wanted = sorted({w for t in positive(tree) if "*" not in t and len(ws := _fold(t).split()) == 1 for w in ws})
    stats = work.agg(F.count("*").alias("n"), F.avg(F.size("__t")).alias("avgdl"), *[F.count_if(F.array_contains("__t", w)).alias(f"d{i}") for i, w in enumerate(wanted)]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    parts = []
    for i, w in enumerate(wanted):
        df_w = stats[f"d{i}"]
        if not df_w:
            continue
        tf = times("__t", w)
        if mode == "bm25":
            idf = math.log(1 + (n - df_w + 0.5) / (df_w + 0.5))
            parts.append(F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("__t") / avgdl)))
        else:
            parts.append(F.when(tf > 0, (1 + F.log(tf)) * math.log(n / df_w)).otherwise(0.0))
    return hits.withColumn("score", reduce(lambda x, y: x + y, parts, F.lit(0.0))).drop("__t")


def times(of: str, word: str) -> Column:
    return F.size(F.filter(of, lambda x: x == word)).cast("double")


def _tokens(df: DataFrame, doc_id: str, fields: Sequence[str], once: bool, case: bool = True, accent: bool = True) -> DataFrame:
    """(doc_id, t): each document's terms, those of rows with one id together; a generator, so that texts are cut once. once: no id comes twice."""
    each = df.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(terms(document(fields), case, accent))).alias("t"))
    return each if once else each.groupBy("doc_id").agg(F.flatten(F.collect_list("t")).alias("t"))


def _counted(tokens: DataFrame, heads: bool = False) -> DataFrame:
    """(term, doc_id, tf, dl), counted within each row, so without a shuffle; with heads also a row without a term for each document."""
    work = tokens.select("doc_id", F.size("t").cast("long").alias("dl"), F.explode(F.array(F.sort_array("t"))).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    starts = F.when(F.size("t") > 0, starts).otherwise(F.array().cast("array<int>"))
    work = work.select("*", F.explode(F.array(F.concat(F.array(F.lit(-1)), starts) if heads else starts)).alias("s"))
    runs = work.select("*", F.posexplode("s").alias("p", "at"))
    tf = F.when(F.col("at") < 0, 0).otherwise(F.coalesce(F.get("s", F.col("p") + 1), F.size("t")) - F.col("at"))
    term = F.when(F.col("at") >= 0, F.get("t", "at"))
    return runs.select(term.alias("term"), "doc_id", F.least(F.lit(65535), tf).cast("long").alias("tf"), "dl")


def postings(df: DataFrame, doc_id: str, fields: Sequence[str]) -> DataFrame:
    """(term, doc_id, tf, dl): an inverted index, to be written sorted by term. tf stops at 65535. A first job over the ids alone tells whether one comes twice; if none does, nothing is shuffled."""
    once = df.groupBy(doc_id).count().where("count > 1").isEmpty()
    return _counted(_tokens(df, doc_id, fields, once))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def matching(index: DataFrame, everything: Node | str) -> DataFrame:
    """Ids of documents that satisfy the query, by set operations on postings of the query's terms alone."""
    node = parse(everything) if isinstance(everything, str) else everything
    if isinstance(node, Op):
        left, right = matching(index, node.left), matching(index, node.right)
        if node.kind == "OR":
            return left.union(right).distinct()
        return left.join(right, "doc_id", "left_semi" if node.kind == "AND" else "left_anti")
    return index.where(_of_leaf(node.text)).select("doc_id").distinct()


@dataclass(frozen=True)
class SearchIndex:
    """A stored inverted index: postings in order of term, lengths of documents, and tombstones, in folders of their own.

    Each add writes new folders and nothing else, and a delete writes ids. A search reads the postings of its
    terms alone: each file has some documents' postings sorted by term, so a scan passes over the other pages by their statistics. Frequencies and
    lengths count deleted documents until `merged`. The manifest is written last and anew; one writer at a time.
    """

    spark: SparkSession
    folder: str
    fields: tuple[str, ...]
    segments: tuple[str, ...] = ()
    tombstones: tuple[str, ...] = ()
    n: int = 0
    total: int = 0
    case: bool = True
    accent: bool = True

    _POSTINGS, _DOCS = "term string, doc_id long, tf long, dl long", "doc_id long, dl long"
    _PART, _MANY = 16_000_000, 2_000_000  # bytes of text and postings that a task sorts at once, about

    @classmethod
    def create(cls, spark: SparkSession, folder: str, fields: Sequence[str], case: bool = True, accent: bool = True) -> SearchIndex:
        return cls(spark, folder.rstrip("/"), tuple(fields), case=case, accent=accent)._published()

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SearchIndex:
        got = json.loads(spark.read.text(f"{folder.rstrip('/')}/index.json", wholetext=True).first()[0])
        return cls(spark, folder.rstrip("/"), **{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})

    def _published(self) -> SearchIndex:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/index.json")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps({k: getattr(self, k) for k in ("fields", "segments", "tombstones", "n", "total", "case", "accent")}).encode()))
        out.close()
        return self

    def add_many(self, df: DataFrame, doc_id: str) -> SearchIndex:
        """Documents, whose ids must be new to the index. Texts are counted once, in parts of about _PART bytes by document: a part
        is sorted by term in a task's memory, and no posting is shuffled. A first pass over the texts gives their size and whether an id comes twice."""
        name = f"{self.folder}/{uuid.uuid4().hex}"
        text = document(self.fields).alias("text")
        docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), text)
        most, size = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
        docs = docs.repartition(-(-size // self._PART) or 1, "doc_id")
        each = _counted(_tokens(docs, "doc_id", ["text"], most < 2, self.case, self.accent), heads=True)
        each.sortWithinPartitions("term", "doc_id").write.parquet(f"{name}/postings")
        self.spark.read.schema(self._POSTINGS).parquet(f"{name}/postings").where("term is null").select("doc_id", "dl").write.parquet(f"{name}/documents")
        n, total = self.spark.read.schema(self._DOCS).parquet(f"{name}/documents").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return replace(self, segments=(*self.segments, name), n=self.n + n, total=self.total + total)._published()

    def delete(self, ids: DataFrame | Sequence[int]) -> SearchIndex:
        """Documents that no search finds from now on."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "doc_id long")
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).distinct()
        if bad := gone.join(self.documents(), "doc_id", "left_anti").limit(1).collect():
            raise NotFound(bad[0][0])
        name = f"{self.folder}/{uuid.uuid4().hex}"
        gone.write.parquet(name)
        return replace(self, tombstones=(*self.tombstones, name))._published()

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{s}/{part}" for s in self.segments]) if self.segments else self.spark.createDataFrame([], schema)

    def postings(self) -> DataFrame:
        return self._read("postings", self._POSTINGS).where("term is not null")

    def _gone(self) -> DataFrame:
        return self.spark.read.parquet(*self.tombstones) if self.tombstones else self.spark.createDataFrame([], "doc_id long")

    def documents(self) -> DataFrame:
        """(doc_id, dl) of what isn't deleted."""
        return self._read("documents", self._DOCS).join(self._gone(), "doc_id", "left_anti")

    def __len__(self) -> int:
        return self.documents().count()

    def __contains__(self, doc_id: int) -> bool:
        return not self.documents().where(F.col("doc_id") == doc_id).isEmpty()

    def get_document(self, doc_id: int, store: DataFrame, key: str) -> DataFrame:
        """The document from the table it came from; deleted ones too."""
        known = self._read("documents", self._DOCS).where(F.col("doc_id") == doc_id).select(F.col("doc_id").alias(key))
        return store.join(known, key, "left_semi")

    def merged(self) -> SearchIndex:
        """One segment, without what is deleted; the old folders can be removed once nobody reads them."""
        name = f"{self.folder}/{uuid.uuid4().hex}"
        live = self._read("postings", self._POSTINGS).join(self._gone(), "doc_id", "left_anti")
        parts = -(-self._read("postings", self._POSTINGS).count() // self._MANY) or 1
        live.repartition(parts, "doc_id").sortWithinPartitions("term", "doc_id").select("term", "doc_id", "tf", "dl").write.parquet(f"{name}/postings")
        self.documents().write.parquet(f"{name}/documents")
        n, total = self.spark.read.parquet(f"{name}/documents").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return replace(self, segments=(name,), tombstones=(), n=n, total=total)._published()

    def search(self, query: str, mode: str = "boolean", k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(doc_id, score) of the documents that satisfy the query; score is null for boolean."""
        if mode not in ("boolean", "bm25", "tfidf"):
            raise ValueError(f"no mode {mode}")
        tree = parse(query)
        leaves: dict[str, Column] = {}

        def walk(node: Node) -> Column:
            if isinstance(node, Op):
                left, right = walk(node.left), walk(node.right)
                return left & right if node.kind == "AND" else left | right if node.kind == "OR" else left & ~right
            leaves[node.text] = _of_leaf(node.text)
            return F.col(f"`l{list(leaves).index(node.text)}`")

        holds_all = walk(tree)
        read = self.postings().where(reduce(lambda x, y: x | y, leaves.values()))
        wanted = sorted({_fold(t) for t in positive(tree) if "*" not in t and len(_fold(t).split()) == 1}) if mode != "boolean" else []
        score = F.lit(None).cast("double")
        if wanted:
            df = {r["term"]: r["n"] for r in read.where(F.col("term").isin(wanted)).groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row for each term
            average = (self.total / self.n if self.n else 0) or 1.0
            parts = F.lit(0.0)
            for w in (w for w in wanted if df.get(w)):
                tf = F.col("tf").cast("double")
                if mode == "bm25":
                    weight = F.lit(math.log(1 + (self.n - df[w] + 0.5) / (df[w] + 0.5))) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / average))
                else:
                    weight = (1 + F.log(tf)) * math.log(self.n / df[w])
                parts = F.when(F.col("term") == w, weight).otherwise(parts)
            score = F.sum(parts)
        elif mode != "boolean":
            score = F.lit(0.0)
        flags = [F.bool_or(test).alias(f"l{i}") for i, test in enumerate(leaves.values())]
        found = read.groupBy("doc_id").agg(*flags, *([score.alias("score")] if wanted else [])).where(holds_all)
        found = found.select("doc_id", F.col("score") if wanted else score.alias("score"))
        return found.join(self._gone(), "doc_id", "left_anti") if self.tombstones else found


def _of_leaf(text: str) -> Column:
    """Whether a posting is of this leaf."""
    stem = _fold(text)
    if "*" in stem:
        if stem.strip("*") == "":
            raise ValueError("a lone wildcard")
        return F.col("term").startswith(stem[:-1]) if stem.endswith("*") and "*" not in stem[:-1] else F.col("term").rlike("^" + ".*".join(re.escape(p) for p in stem.split("*")))
    return F.col("term") == stem if len(stem.split()) == 1 else F.lit(False)


__all__ = ["SearchIndex", "document", "document_frequency", "folded", "holds", "matching", "postings", "search", "Term"]
