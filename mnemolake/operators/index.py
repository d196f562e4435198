"""A stored keyword index whose blocks are skipped where they cannot hold one of the best rows.

Rows are dealt into buckets of like length, about BUCKET_ROWS each. For every term and bucket there is a head: how many rows hold
it, its largest count and the shortest of these rows, which bound what the term can add to a BM25 score there. A
search scores the buckets of the highest bounds, takes the k-th best score as a floor, and reads the postings of those other
buckets only whose bound reaches it, so its rows are those of a scan. More than FEW queries, which would need nearly all
buckets, are scored together: the postings of their terms are dealt by bucket, and each task keeps the best rows of every query.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from .search import TERM_PARTS, best_by_words, postings, scope_predicate, tokens

BUCKET_ROWS = 4096
#: Buckets that are scored first, for a floor.
FIRST = 4
#: Queries that are searched bucket by bucket; more are scored together.
FEW = 16
#: Values that are written into a filter as they are; more are joined.
LITERALS = 1000
STATS = "segment string, rows long, words double"
#: Scores are equal up to this, whatever the order of their sums.
SLACK = 1e-9


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_PARTS)).cast("int")


def _name() -> str:
    return f"s{uuid.uuid4().hex}"  # never read as a number


class Index:
    """The index of rows (id, text) under path: postings, heads and ids by segment, and for each segment that is whole its rows and words.

    A segment is one addition or removal; its line in `stats` is written last, and searches read those that have one.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows

    def _there(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def exists(self) -> bool:
        return self._there("stats")

    def add(self, rows: DataFrame) -> None:
        """Appends rows (id, text) that the index does not hold, as buckets of their own; rows is read three times."""
        segment = _name()
        like = F.floor(4 * F.log2(F.col("dl") + F.lit(1.0)))
        sized = rows.select("id", F.size(tokens(F.col("text"))).alias("dl"))
        counts = sized.groupBy(like.alias("like")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").cast("double").alias("words")).collect()  # some 80 rows: four for each doubling of the length
        if not counts:
            return
        pieces = F.create_map(*(x for r in counts for x in (F.lit(r.like), F.lit(math.ceil(r.n / self.bucket_rows)))))
        bucket = F.xxhash64(F.lit(segment), F.col("like"), F.pmod(F.xxhash64("id"), F.element_at(pieces, F.col("like"))))
        found = postings(rows.select("id", "text")).withColumn("like", like).withColumn("bucket", bucket).withColumn("part", _part(F.col("term")))
        # a frequent term is dealt over tasks by bucket
        spread = found.repartition("part", F.pmod(F.col("bucket"), F.lit(8))).sortWithinPartitions("part", "term", "bucket", "id")
        self._write(spread.select("term", "bucket", "id", "tf", "dl", "part"), "postings", segment)
        written = self.spark.read.parquet(f"{self.path}/postings").where(F.col("segment") == segment)
        heads = written.groupBy("part", "term", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.max("tf").alias("most"), F.min("dl").cast("long").alias("least"))
        self._done(segment, rows.select("id", F.lit(False).alias("gone")), heads, sum(r.n for r in counts), sum(r.words for r in counts))

    def remove(self, rows: DataFrame) -> None:
        """Takes rows (id, text) that the index holds out of its counts and results; rows is read three times."""
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(tokens(F.col("text")))), F.lit(0)).cast("double").alias("words")).first()
        if n["n"]:
            none = F.lit(None).cast("long")
            heads = postings(rows.select("id", "text")).groupBy("term").agg((-F.count(F.lit(1))).alias("rows")).select("term", none.alias("bucket"), "rows", none.alias("most"), none.alias("least"), _part(F.col("term")).alias("part"))
            self._done(_name(), rows.select("id", F.lit(True).alias("gone")), heads, -n["n"], -n["words"])

    def _done(self, segment: str, ids: DataFrame, heads: DataFrame, rows: int, words: float) -> None:
        ids.write.mode("append").parquet(f"{self.path}/ids/segment={segment}")
        self._write(heads.select("term", "bucket", "rows", "most", "least", "part").repartition("part").sortWithinPartitions("part", "term", "bucket"), "heads", segment)
        self.spark.createDataFrame([(segment, int(rows), float(words))], STATS).coalesce(1).write.mode("append").parquet(f"{self.path}/stats")

    def _write(self, df: DataFrame, name: str, segment: str) -> None:
        df.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment", "part").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        """What whole segments hold; their names are as many as changes were made."""
        whole = [r.segment for r in self.spark.read.schema(STATS).parquet(f"{self.path}/stats").select("segment").collect()]
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("segment").isin(whole))

    def ids(self) -> DataFrame:
        """id, gone of every row that was ever added; gone tells whether it was removed."""
        return self._read("ids").groupBy("id").agg(F.max("gone").alias("gone"))

    def sync(self, live: DataFrame, ever: DataFrame) -> None:
        """Brings the index to the rows (id, text) of live; the texts of those that went come from ever."""
        if not self.exists():
            return self.add(live)
        known = self.ids()
        self.add(live.join(known.select("id"), "id", "left_anti"))
        went = known.where("not gone").select("id").join(live.select("id"), "id", "left_anti")
        self.remove(ever.join(went, "id", "left_semi"))

    def statistics(self) -> DataFrame:
        """n and avg of the rows that are left; one row."""
        return self.spark.read.schema(STATS).parquet(f"{self.path}/stats").agg(F.sum("rows").cast("double").alias("n"), (F.sum("words") / F.sum("rows")).alias("average"))

    def search(self, asked: DataFrame, k: int = 20) -> DataFrame:
        """qid, id, raw, place: for each query the k best rows of its different terms (qid, term), ties to the smaller id."""
        asked = asked.distinct()
        terms = [r.term for r in asked.select("term").distinct().limit(LITERALS + 1).collect()]
        some = lambda df: df.where(F.col("part").isin(self._parts(terms)) & F.col("term").isin(terms)) if len(terms) <= LITERALS else df
        if not terms:
            return self.spark.createDataFrame([], "qid string, id string, raw double, place long")
        heads = some(self._read("heads"))
        stats = self.statistics()
        df = heads.groupBy("term").agg(F.sum("rows").cast("double").alias("df")).join(F.broadcast(stats)).select("term", S.idf(F.col("n"), F.col("df")).alias("idf"), "average")
        gain = lambda tf, dl: F.col("idf") * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * dl / F.col("average")))
        stored = some(self._read("postings"))
        gone = self._read("ids").where("gone").select("id")
        if asked.select("qid").distinct().limit(FEW + 1).count() > FEW:
            return self._together(stored, gone, asked, df, k)
        wanted = asked.join(df, "term")
        bound = gain(F.col("most").cast("double"), F.col("least").cast("double"))
        bounds = heads.where("bucket is not null").join(wanted, "term").groupBy("qid", "bucket").agg(F.sum(bound).alias("bound"))
        bounds = bounds.withColumn("turn", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "bucket")))

        def scored(buckets: DataFrame) -> DataFrame:
            few = [r.bucket for r in buckets.select("bucket").distinct().limit(LITERALS + 1).collect()]
            read = stored.where(F.col("bucket").isin(few)) if len(few) <= LITERALS else stored
            hits = read.join(wanted, "term").join(buckets.select("qid", "bucket"), ["qid", "bucket"])
            raws = hits.groupBy("qid", "id").agg(F.sum(gain(F.col("tf").cast("double"), F.col("dl").cast("double"))).alias("raw"))
            raws = raws.join(gone, "id", "left_anti")
            best = W.partitionBy("qid").orderBy(F.desc(F.round("raw", 9)), "id")
            return raws.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= k)

        first = scored(bounds.where(F.col("turn") <= FIRST))
        floor = first.where(F.col("place") == k).select("qid", F.col("raw").alias("floor"))
        return scored(bounds.join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)))

    def _together(self, stored: DataFrame, gone: DataFrame, asked: DataFrame, weights: DataFrame, k: int) -> DataFrame:
        """search() of many queries; weights are (term, idf, average)."""
        read = stored.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        if gone.limit(1).count():
            read = read.join(gone, "id", "left_anti")
        dealt = read.select("bucket", "id", "dl", "term", "tf").repartition("bucket").sortWithinPartitions("bucket", "id")
        return best_by_words(dealt, asked, weights.select("term", "idf"), self.statistics().first()["average"], k)

    def _parts(self, terms: list[str]) -> list[int]:
        return sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_part(F.col("t"))).collect()})


def bm25_from_blocks(index: Index, df: DataFrame, query: list[str], k: int = 5, scopes: list[str] | None = None, key: str = "id") -> DataFrame:
    """The rows of bm25_topk by an index that knows df's rows by `key`; df is read for the k best rows alone."""
    terms = index.spark.createDataFrame([("", t) for t in dict.fromkeys(query)], "qid string, term string")
    best = index.search(terms, k)
    few = {r.id: r.raw for r in best.select("id", "raw").collect()}  # k at most
    raw = F.element_at(F.create_map(*(F.lit(x) for pair in few.items() for x in pair)), F.col(key)) if few else F.lit(None).cast("double")
    rows = df.where(F.col(key).isin(list(few))).withColumn("raw", raw).where(scope_predicate(scopes))
    return rows.withColumn("score", S.bm25_sigmoid(F.col("raw"))).withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("raw", 9)), "id")).cast("long"))
