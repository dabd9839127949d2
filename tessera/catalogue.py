"""Queries on the test tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import capitals
from .functions.types import cut_bytes, dt_key, stored, struct
from .operators import fulltext, structures, vectors
from .operators.collection import Collection, Many, Range, Search, Unique, Vector, dangling
from .operators.dataset import Blobs, Dataset, addressed
from .operators.graph import Graph
from .operators.sketches import Bloom, CountingBloom
from .session import shared_folder
from .sources.catalog import Catalog
from .streaming.counters import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _orders(spark: SparkSession, d: str) -> Collection:
    return Collection(table(spark, d, "orders"), "o_orderkey", {"by_customer": Many("o_custkey", "o_orderdate", True), "by_priority": Many("o_orderpriority", counted=True), "price": Range("o_totalprice"), "date": Range("o_orderdate"), "status": Many("o_orderstatus", "o_totalprice", False, True)})


def _customers(spark: SparkSession, d: str) -> Collection:
    return Collection(table(spark, d, "customer"), "c_custkey", {"name": Unique("c_name"), "segment": Many("c_mktsegment", "c_acctbal", True, True), "balance": Range("c_acctbal")})


# collections


@query("select o_orderkey, o_custkey, o_orderdate, o_totalprice from orders where o_custkey = 7")
def many_find_desc(spark, d):
    return _orders(spark, d).find("by_customer", 7, fields=["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])


@query("select o_orderkey, o_orderdate from orders where o_custkey between 7 and 7 and o_orderdate between timestamp '1993-01-01' and timestamp '1997-12-31' order by o_orderdate desc, o_orderkey::varchar limit 5")
def many_find_window(spark, d):
    return _orders(spark, d).find("by_customer", 7, "1997-12-31", "1993-01-01", 5, ["o_orderkey", "o_orderdate"])


@query("select o_custkey, o_orderkey, o_orderdate from orders where o_custkey is not null qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey::varchar) <= 3")
def many_topn_per_group(spark, d):
    return _orders(spark, d).top_per_group("by_customer", 3, ["o_custkey", "o_orderkey", "o_orderdate"])


@query("select o_orderkey, o_totalprice from orders where o_totalprice between 1000 and 50000")
def range_asc(spark, d):
    return _orders(spark, d).range("price", 1000, 50000, fields=["o_orderkey", "o_totalprice"])


@query("select o_orderkey, o_totalprice from orders where o_totalprice <= 200000 order by o_totalprice desc, o_orderkey::varchar desc limit 20")
def range_desc_limit(spark, d):
    return _orders(spark, d).range("price", None, 200000, 20, True, ["o_orderkey", "o_totalprice"])


@query("select * from customer where c_name = (select min(c_name) from customer)")
def unique_get(spark, d):
    c = _customers(spark, d)
    return c.get("name", c.df.agg(F.min("c_name")).first()[0])


@query("select * from customer where c_name = 'Customer#000000042'")
def unique_get_literal(spark, d):
    return _customers(spark, d).get("name", "Customer#000000042")


@query("select o_orderpriority as value, count(*) as n from orders group by 1")
def group_counts(spark, d):
    return _orders(spark, d).groups("by_priority")


@query("select c_mktsegment as value, count(*) as n from customer group by 1 order by n desc, value desc limit 2")
def group_counts_top(spark, d):
    return _customers(spark, d).groups("segment", limit=2)


@query("select count(*) as n from orders where o_orderstatus = 'O' and o_totalprice between 10000 and 100000")
def count_window(spark, d):
    return _orders(spark, d).count("status", "O", 10000, 100000)


@query("select o_orderkey, o_orderdate from (select * from orders order by o_orderdate desc, o_orderkey::varchar desc limit 1) union all select o_orderkey, o_orderdate from (select * from orders order by o_orderdate, o_orderkey::varchar limit 1)")
def latest_first(spark, d):
    c = _orders(spark, d)
    return c.latest("date").union(c.first("date")).select("o_orderkey", "o_orderdate")


@query("select p_partkey, p_name, p_size from part")
def projection(spark, d):
    return Collection(table(spark, d, "part"), "p_partkey", {}).where(None, ["p_partkey", "p_name", "p_size"])


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R' and l_quantity >= 45 and l_discount between 0.02 and 0.05")
def where_combo(spark, d):
    return Collection(table(spark, d, "lineitem"), "l_orderkey", {}).where({"l_returnflag": "R", "l_quantity": (45, None), "l_discount": (0.02, 0.05)}, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("select p_partkey, p_retailprice from part where p_size = 7 or p_retailprice > (select avg(p_retailprice) from part)")
def where_column(spark, d):
    part = table(spark, d, "part")
    mean = part.agg(F.avg("p_retailprice")).first()[0]
    return Collection(part, "p_partkey", {}).where((F.col("p_size") == 7) | (F.col("p_retailprice") > mean), ["p_partkey", "p_retailprice"])


@query("select * from nation where n_nationkey = 3")
def primary_get(spark, d):
    return Collection(table(spark, d, "nation"), "n_nationkey", {}).get_primary(3)


# ordered maps, sequences, sets


@query("select c_custkey, c_name from customer where starts_with(c_name, 'Customer#0000000')")
def ordered_prefix(spark, d):
    return structures.OrderedMap(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name").prefix("Customer#0000000")


@query("select o_orderkey, o_totalprice from orders where o_orderkey > 100 and o_orderkey < 500")
def ordered_range_exclusive(spark, d):
    return structures.OrderedMap(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").range(100, 500, (False, False))


@query("select min(o_orderkey) as min, max(o_orderkey) as max from orders")
def ordered_extremes(spark, d):
    return structures.OrderedMap(table(spark, d, "orders"), "o_orderkey").extremes()


@query("select strftime(ts, '%Y%m') as month, count(*) as n from events group by 1")
def dtkey_month_counts(spark, d):
    return table(spark, d, "events").groupBy(dt_key(F.col("ts"), "month").alias("month")).agg(F.count("*").alias("n"))


@query("select strftime(ts, '%Y%m%d%H') as key, event_id from events where strftime(ts, '%Y%m%d%H') between '2024010100' and '2024010523'")
def dtkey_range(spark, d):
    keyed = table(spark, d, "events").select(dt_key(F.col("ts"), "hour").alias("key"), "event_id")
    return structures.OrderedMap(keyed, "key").range_dt("2024-01-01", "2024-01-05 23:00:00", "hour")


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey in (select s_suppkey from supplier)")
def keyed_get_many(spark, d):
    return structures.KeyedMap(table(spark, d, "customer"), "c_custkey").get_many(table(spark, d, "supplier").select("s_suppkey")).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("select i as _index, event_id from (select event_id, row_number() over (order by event_id) - 1 as i from events where event_id % 7 <> 0) where i between 10 and 199 and (i - 10) % 3 = 0")
def sequence_slice(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_id").alias("_pos"), (F.col("event_id") % 7 != 0).alias("_valid"))
    return structures.Sequence(rows).slice(10, 200, 3).select(F.col("_index").cast("long").alias("_index"), "event_id")


@query("select 'both' as kind, count(*) as n from (select c_custkey from customer intersect select o_custkey from orders) union all select 'none', count(*) from (select c_custkey from customer except select o_custkey from orders) union all select 'any', count(*) from (select c_custkey from customer union select o_custkey from orders)")
def set_operations(spark, d):
    a = structures.StringSet(table(spark, d, "customer").select(F.col("c_custkey").alias("member")))
    b = structures.StringSet(table(spark, d, "orders").select(F.col("o_custkey").alias("member")).distinct())
    parts = [s.df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, s in (("both", a.intersection(b)), ("none", a.difference(b)), ("any", a.union(b)))]
    return parts[0].union(parts[1]).union(parts[2])


@query("select conv_id, list(text order by turn) as texts from conversations group by 1")
def nested_regroup(spark, d):
    return structures.regrouped(table(spark, d, "conversations"), "conv_id", "turn", ["text"]).select("conv_id", F.col("items.text").alias("texts"))


@query("select turn, role, text from conversations where conv_id = 1")
def nested_read(spark, d):
    return structures.nested("map", "sequence", table(spark, d, "conversations"), "conv_id", 1)


# queues and caches


@query("select event_id, row_number() over (order by event_id) as place from events where event_id >= 100")
def queue_drain(spark, d):
    return structures.Fifo(table(spark, d, "events").select("event_id"), "event_id", 100).places()


@query("select event_id, value from events order by value desc, event_id limit 100")
def priority_drain(spark, d):
    return structures.drain_priority(table(spark, d, "events").select("event_id", "value"), "value", "event_id", limit=100)


@query("select event_id from events where event_id not in (select event_id from events order by value, event_id limit 50)")
def priority_pop_rest(spark, d):
    return structures.pop_priority(table(spark, d, "events").select("event_id", "value"), "value", "event_id", 50, False)[1].select("event_id")


@query("select user_id, event_type, m as event_id from (select user_id, event_type, max(event_id) as m from events group by all) qualify row_number() over (partition by user_id order by m desc) <= 3")
def lru_state(spark, d):
    return structures.lru_of_puts(table(spark, d, "events"), "user_id", "event_type", "event_id", 3)


@query("with recursive log as (select user_id, event_type as k, case when event_id % 4 = 1 then 'get' when event_id % 7 = 2 then 'delete' else 'set' end as op, row_number() over (partition by user_id order by event_id) as i from events), walk as (select distinct user_id, 0::bigint as i, []::varchar[] as ks from log union all select walk.user_id, log.i, case when op = 'set' then list_slice(list_prepend(k, list_filter(ks, lambda x: x <> k)), 1, 3) when op = 'get' and list_contains(ks, k) then list_prepend(k, list_filter(ks, lambda x: x <> k)) when op = 'delete' then list_filter(ks, lambda x: x <> k) else ks end from walk join log on log.user_id = walk.user_id and log.i = walk.i + 1), last as (select user_id, ks from walk qualify row_number() over (partition by user_id order by i desc) = 1) select user_id, unnest(ks) as key, unnest(range(len(ks))) as rank from last")
def lru_replay(spark, d):
    op = F.when(F.col("event_id") % 4 == 1, "get").when(F.col("event_id") % 7 == 2, "delete").otherwise("set")
    log = table(spark, d, "events").select("user_id", "event_type", "event_id", op.alias("op"))
    return structures.lru_replay(log, "user_id", "event_type", "event_id", "op", 3).select(F.col("cache").alias("user_id"), "key", "rank")


# graphs

_EDGES = "edges as (select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on o_orderkey = l_orderkey)"


def _trade(spark: SparkSession, d: str, directed: bool = True) -> Graph:
    """Customers who bought of suppliers; ids of suppliers are -1 and below."""
    edges = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct()
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("type"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.col("s_acctbal").alias("balance"))
    return Graph(c.union(s), edges, directed, "type")


def _places(spark: SparkSession, d: str) -> Graph:
    """region -> nation -> customer and supplier; ids are strings."""
    r, n, c, s = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))

    def key(kind: str, column: str):
        return F.concat(F.lit(kind), F.col(column).cast("string"))

    nodes = r.select(key("r", "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("name")).union(n.select(key("n", "n_nationkey"), F.lit("nation"), "n_name")).union(c.select(key("c", "c_custkey"), F.lit("customer"), "c_name")).union(s.select(key("s", "s_suppkey"), F.lit("supplier"), "s_name"))
    edges = n.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")).union(c.select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(s.select(key("n", "s_nationkey"), key("s", "s_suppkey")))
    return Graph(nodes, edges, True, "type")


_PLACES = """edges as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'n' || s_nationkey, 's' || s_suppkey from supplier),
nodes as (select 'r' || r_regionkey as id, 'region' as type, r_name as name from region union all select 'n' || n_nationkey, 'nation', n_name from nation union all select 'c' || c_custkey, 'customer', c_name from customer union all select 's' || s_suppkey, 'supplier', s_name from supplier)"""


@query(f"with {_EDGES} select src as \"id(a)\", -1 - dst as \"id(b)\", s_name as \"b.name\" from edges join customer on c_custkey = src join supplier on s_suppkey = dst where c_acctbal > 9000")
def graph_1hop(spark, d):
    return _trade(spark, d).query("MATCH (a:customer)-[r]->(b:supplier) WHERE a.balance > 9000 RETURN id(a), id(b), b.name")


@query(f"with {_EDGES} select -1 - dst as \"id(s)\", src as \"id(c)\" from edges where dst in (0, 1)")
def graph_in(spark, d):
    return _trade(spark, d).query("MATCH (s)<-[r]-(c) WHERE id(s) IN [-1, -2] RETURN id(s), id(c)")


@query(f"with {_EDGES} select src as \"id(x)\", -1 - dst as \"id(y)\" from edges where src = 5 union all select -1 - dst, src from edges where dst = 2")
def graph_both(spark, d):
    return _trade(spark, d, False).query("MATCH (x)--(y) WHERE id(x) = 5 OR id(x) = -3 RETURN id(x), id(y)")


@query(f"with {_PLACES} select a.src as \"id(r)\", a.dst as \"id(n)\", b.dst as \"id(c)\" from edges a join edges b on a.dst = b.src join nodes r on r.id = a.src join nodes c on c.id = b.dst where r.type = 'region' and c.type = 'customer' and r.name = 'ASIA'")
def graph_chain3(spark, d):
    return _places(spark, d).query('MATCH (r:region {name: "ASIA"})-->(n:nation)-->(c:customer) RETURN id(r), id(n), id(c)')


@query(f"with {_PLACES} select id from nodes where type = 'nation'")
def graph_label_filter(spark, d):
    return _places(spark, d).nodes_with_label("nation")


_WALK = _PLACES + """, walk as (select id as source, id, 0 as depth from nodes where type = 'region' union all select source, dst, depth + 1 from walk join edges on src = walk.id where depth < 3),
shortest as (select source, id, min(depth) as depth from walk group by all)"""


@query(f"with recursive {_WALK} select source as \"id(r)\", id as \"id(x)\" from shortest where depth = 2")
def graph_bfs_exact(spark, d):
    return _places(spark, d).query("MATCH (r:region)-[*2]->(x) RETURN id(r), id(x)")


@query(f"with recursive {_WALK} select source as \"id(r)\", id as \"id(x)\" from shortest where depth between 1 and 3")
def graph_bfs_range(spark, d):
    return _places(spark, d).query("MATCH (r:region)-[*1..3]->(x) RETURN id(r), id(x)")


@query("with recursive edges as (select distinct event_type as src, nxt as dst from (select event_type, lead(event_type) over (partition by user_id order by event_id) as nxt from events) where nxt is not null), walk as (select distinct src as source, src as id, 0 as depth from edges union select source, dst, depth + 1 from walk join edges on src = walk.id where depth < 4) select source, id, cast(min(depth) as int) as depth from walk group by source, id")
def graph_bfs_cycles(spark, d):
    from pyspark.sql import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    edges = table(spark, d, "events").select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null").distinct()
    nodes = edges.select(F.col("src").alias("id")).distinct()
    return Graph(nodes, edges).reachable(nodes, 0, 4)


@query(f"with {_PLACES} select src as \"id(n)\", dst as \"id(x)\" from edges where src = 'n3' union all select 'n3', 'n3'")
def graph_optional(spark, d):
    return _places(spark, d).query('MATCH (n)-[?]->(x) WHERE id(n) = "n3" RETURN id(n), id(x)')


@query(f"with {_EDGES} select src as id, count(*) as degree from edges group by 1")
def graph_degree(spark, d):
    return _trade(spark, d).degrees("out")


@query(f"with {_PLACES} select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges")
def graph_counts(spark, d):
    return _places(spark, d).counts()


@query(f"with {_PLACES} select src as id from edges where dst = 'n7'")
def graph_predecessors(spark, d):
    return _places(spark, d).predecessors("n7")


@query(f"with {_PLACES} select count(*) as n from edges where src <> 'n3' and dst <> 'n3'")
def graph_remove_nodes(spark, d):
    g = _places(spark, d)
    return g.remove_nodes(g.nodes.where("id = 'n3'")).edges.agg(F.count("*").alias("n"))


# full text

_TOKENS = r"""toks as (select doc_id, lang, unnest(regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\p{L}\p{N}_]+|"')) as raw from documents),
words as (select doc_id, replace(raw, '_', '') as term from toks where replace(raw, '_', '') <> ''),
dl as (select doc_id, count(*) as dl from words group by 1), n as (select count(*) as n from documents), av as (select sum(dl) / (select n from n) as avgdl from dl),
post as (select term, doc_id, count(*) as tf from words group by all), df as (select term, count(*) as df from post group by 1)"""


def _documents(spark: SparkSession, d: str) -> Collection:
    return Collection(table(spark, d, "documents"), "doc_id", {"text": Search(("text",), "bm25"), "plain": Search(("text",))})


@query(f"with {_TOKENS} select term, doc_id, tf, dl from post join dl using (doc_id)")
def text_postings(spark, d):
    return fulltext.postings(table(spark, d, "documents"), "doc_id", ["text"])


@query(f"with {_TOKENS} select term, df from df")
def document_frequency(spark, d):
    return fulltext.document_frequency(fulltext.postings(table(spark, d, "documents"), "doc_id", ["text"]))


def _holds(word: str) -> str:
    return f"doc_id in (select doc_id from post where term = '{word}')"


@query(f"with {_TOKENS} select doc_id from documents where {_holds('the')} and {_holds('of')}")
def text_and(spark, d):
    return _documents(spark, d).search("plain", "the AND of").select("doc_id")


@query(f"with {_TOKENS} select doc_id from documents where {_holds('und')} or {_holds('les')}")
def text_or(spark, d):
    return _documents(spark, d).search("plain", "und OR les").select("doc_id")


@query(f"with {_TOKENS} select doc_id from documents where {_holds('the')} and not ({_holds('of')} and not {_holds('in')})")
def text_assoc(spark, d):
    return _documents(spark, d).search("plain", "the AND NOT of AND NOT in").select("doc_id")


@query(f"with {_TOKENS} select distinct doc_id from post where starts_with(term, 'that') and {_holds('is')}")
def text_wildcard(spark, d):
    return _documents(spark, d).search("plain", "that* AND is").select("doc_id")


@query(f"with {_TOKENS} select doc_id from documents where {_holds('in')}")
def text_phrase_leaf(spark, d):
    """A leaf of several words matches nothing, so the other side is what is found."""
    return _documents(spark, d).search("plain", "the of OR in").select("doc_id")


_BM25 = f"with {_TOKENS}, s as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from post join df using (term) join dl using (doc_id), n, av where term in ('the', 'of', 'en') group by 1)"


@query(f"{_BM25} select doc_id, round(score, 6) as score from s where {_holds('the')} and ({_holds('of')} or {_holds('en')}) order by score desc, doc_id limit 20")
def text_bm25(spark, d):
    return _documents(spark, d).search("text", "the AND of OR en", limit=20, with_scores=True).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {_TOKENS} select doc_id, round(sum((1 + ln(tf)) * ln(n / df)), 6) as score from post join df using (term), n where term in ('the', 'les') group by 1")
def text_tfidf(spark, d):
    return _documents(spark, d).search("text", "the OR les", mode="tfidf", with_scores=True).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_BM25} select doc_id, round(score, 6) as score from s join documents using (doc_id) where {_holds('the')} and ({_holds('of')} or {_holds('en')}) and lang = 'en' and n_chars >= 500")
def text_where(spark, d):
    return _documents(spark, d).search("text", "the AND of OR en", {"lang": "en", "n_chars": (500, None)}, with_scores=True).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {_TOKENS} select doc_id from documents where {_holds('the')} and not {_holds('with')}")
def text_postings_andnot(spark, d):
    return fulltext.matching(fulltext.postings(table(spark, d, "documents"), "doc_id", ["text"]), "the AND NOT with")


# vectors

_Q = [((i * 37) % 19 - 9) / 9 for i in range(64)]
_QSQL = "[" + ", ".join(repr(x) for x in _Q) + "]::double[]"


def _vectors(spark: SparkSession, d: str, metric: str) -> Collection:
    return Collection(table(spark, d, "embeddings"), "vec_id", {"v": Vector("embedding", metric)})


@query(f"select vec_id, round(list_cosine_similarity(embedding::double[], {_QSQL}), 6) as score from embeddings order by list_cosine_similarity(embedding::double[], {_QSQL}) desc, vec_id::varchar limit 10")
def vec_cosine(spark, d):
    return _vectors(spark, d, "cosine").nearest("v", _Q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"select vec_id, round(list_dot_product(embedding::double[], {_QSQL}), 6) as score from embeddings order by list_dot_product(embedding::double[], {_QSQL}) desc, vec_id::varchar limit 10")
def vec_dot(spark, d):
    return _vectors(spark, d, "dot").nearest("v", _Q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"select vec_id, round(list_distance(embedding::double[], {_QSQL}), 6) as score from embeddings order by list_distance(embedding::double[], {_QSQL}), vec_id::varchar limit 10")
def vec_l2(spark, d):
    return _vectors(spark, d, "l2").nearest("v", _Q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"select vec_id, round(list_cosine_similarity(embedding::double[], {_QSQL}), 6) as score from embeddings where label = 3 order by list_cosine_similarity(embedding::double[], {_QSQL}) desc, vec_id::varchar limit 5")
def vec_prefilter(spark, d):
    return _vectors(spark, d, "cosine").nearest("v", _Q, 5, {"label": 3}).select("vec_id", F.round("score", 6).alias("score"))


@query(f"select vec_id as id, round(-power(list_distance(embedding::double[], {_QSQL}), 2), 6) as score from embeddings order by list_distance(embedding::double[], {_QSQL}), vec_id limit 10")
def vec_flat_l2(spark, d):
    return vectors.flat_search(table(spark, d, "embeddings"), _Q, 10, "l2", "vec_id", "embedding").select("id", F.round("score", 6).alias("score"))


@query("select a.vec_id as query_id, b.vec_id as id from embeddings a, embeddings b where a.vec_id % 20 = 0 qualify row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) <= 5")
def vec_batch(spark, d):
    df = table(spark, d, "embeddings")
    return vectors.batch_search(df, df.where("vec_id % 20 = 0"), 5, "cosine", "vec_id", "embedding").select("query_id", "id")


@query()
def ivf_batch(spark, d):
    """The index probed by every row whose id is divisible by 20; tests hold its recall against brute force."""
    df = table(spark, d, "embeddings")
    index = vectors.InvertedFile("cosine", 16).train(df, "vec_id", "embedding")
    return index.batch_search(index.assign(df, "vec_id", "embedding"), df.where("vec_id % 20 = 0"), 5, 12, "vec_id", "embedding").select("query_id", "id")


@query()
def vec_batch_all(spark, d):
    """As vec_batch, for every row; tests hold it against brute force."""
    df = table(spark, d, "embeddings")
    return vectors.batch_search(df, df, 5, "cosine", "vec_id", "embedding").select("query_id", "id")


def _ivf(spark: SparkSession, d: str, probe: int | None, n_sub: int = 0) -> DataFrame:
    df = table(spark, d, "embeddings")
    index = vectors.InvertedFile("cosine", 16, n_sub, 6).train(df, "vec_id", "embedding")
    return index.search(index.assign(df, "vec_id", "embedding"), _Q, 10, probe).select("id", F.round("score", 6).alias("score"))


@query(f"select vec_id as id, round(list_cosine_similarity(embedding::double[], {_QSQL}), 6) as score from embeddings order by list_cosine_similarity(embedding::double[], {_QSQL}) desc, vec_id limit 10")
def ivf_full_probe(spark, d):
    return _ivf(spark, d, 16)


@query()
def ivf_probe(spark, d):
    return _ivf(spark, d, None)


@query()
def ivf_pq(spark, d):
    return _ivf(spark, d, 16, 16)


# sketches

_BLOOM, _COUNTING = Bloom(2000, 0.01), CountingBloom(500, 0.05)


def _bits(f: Bloom, column: str) -> str:
    h1, h2 = (f"('0x' || substr(md5({column}::varchar), {p}, 13))::bigint" for p in (1, 14))
    return f"list_transform(range({f.k}), lambda i: ({h1} + i * {h2}) % {f.m})"


@query(f"select distinct unnest({_bits(_BLOOM, 'c_name')}) as bit from customer")
def bloom_bits(spark, d):
    return _BLOOM.build(table(spark, d, "customer"), "c_name")


@query(f"with bits as (select distinct unnest({_bits(_BLOOM, 'c_custkey')}) as bit from customer), k as (select distinct o_orderkey, unnest({_bits(_BLOOM, 'o_orderkey')}) as bit from orders) select o_orderkey, count(bits.bit) = count(*) as maybe from k left join bits using (bit) group by 1")
def bloom_probe(spark, d):
    return _BLOOM.might_contain(_BLOOM.build(table(spark, d, "customer"), "c_custkey"), table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query(f"with c as (select unnest(list_distinct({_bits(_COUNTING, 'event_type')})) as bit, case when event_id % 3 = 0 then -1 else 1 end as d from events) select bit, cast(greatest(0, sum(d)) as bigint) as n from c group by 1 having sum(d) > 0")
def counting_bloom(spark, d):
    return _COUNTING.counters(table(spark, d, "events").withColumn("d", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)), "event_type", "d")


# changes


@query("select o_orderkey, o_custkey, o_orderstatus, case when o_custkey % 10 = 3 then o_totalprice + 2 else o_totalprice end as o_totalprice from orders")
def upsert_last_wins(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    part = df.where("o_custkey % 10 = 3")
    changes = part.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "at": F.lit(1)}).union(part.withColumns({"o_totalprice": F.col("o_totalprice") + 2, "at": F.lit(2)}))
    return Collection(df, "o_orderkey", {}).insert_many(changes, "at").df


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)")
def delete_anti(spark, d):
    c = Collection(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", {})
    return c.delete(table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))).df


@query("select n_nationkey, case when n_nationkey in (1, 2) then 'X' else n_name end as n_name, n_regionkey from nation")
def update_partial(spark, d):
    return Collection(table(spark, d, "nation"), "n_nationkey", {}).update([1, 2], n_name="X").df


@query("select p_partkey, case when p_partkey in (5, 6) then p_size + 10 else p_size end as p_size, case when p_partkey in (5, 6) then p_retailprice + 0.5 else p_retailprice end as p_retailprice from part")
def increment(spark, d):
    c = Collection(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", {})
    return c.increment([5, 6], "p_size", 10).increment([5, 6], "p_retailprice", 0.5).df


@query("select 'c_mktsegment' as field, c_mktsegment as value, count(*) as n from customer group by 2 having count(*) > 1")
def unique_violations(spark, d):
    return Collection(table(spark, d, "customer"), "c_custkey", {"s": Unique("c_mktsegment")}).violations()


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20)")
def dangling_pk(spark, d):
    return dangling(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_nationkey < 20"), "c_custkey")


@query("select c_custkey, split_part(c_name, '#', 1) as kind, split_part(c_name, '#', 2) as number, 0 as visits from customer")
def migrate_transform(spark, d):
    c = Collection(table(spark, d, "customer"), "c_custkey", {})
    return c.migrate({"c_custkey": F.col("c_custkey"), "kind": F.split_part("c_name", F.lit("#"), F.lit(1)), "number": F.split_part("c_name", F.lit("#"), F.lit(2)), "visits": F.lit(0)}).df


@query("select doc_id, left(text, 12) as u12 from documents")
def stored_fixed_width(spark, d):
    return table(spark, d, "documents").select("doc_id", stored(F.col("text"), "U12").alias("u12"))


@query("select doc_id, text[:(select max(k) from range(0, 21) t(k) where octet_length(encode(text[:k])) <= 20)] as cut from documents")
def stored_byte_budget(spark, d):
    return table(spark, d, "documents").select("doc_id", cut_bytes(F.col("text"), 20).alias("cut"))


@query("select user_id as id, count(distinct event_type) as types, count(*) as n from events group by 1")
def triple_degree(spark, d):
    each = table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("event_id").alias("dst"))
    kinds = table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst")).distinct()
    types, n = (Graph(e.select(F.col("src").alias("id")), e).degrees() for e in (kinds, each))
    return types.withColumnRenamed("degree", "types").join(n.withColumnRenamed("degree", "n"), "id")


@query("select event_type, count(*) as n, count(*) filter (json_extract_string(props, '$.k') is not null) as with_k from events group by 1")
def json_field(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_event_counts(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("total", F.round("total", 4))


@query("select count(*) as n from events")
def live_count(spark, d):
    return spark.createDataFrame([(len(structures.Fifo(table(spark, d, "events"), "event_id")),)], "n long")


@query()
def sampled(spark, d):
    return _orders(spark, d).sample(20, 7)


@query()
def declared_types(spark, d):
    fields = {"id": "int64", "name": "utf8[16!]", "score": "float64", "ok": "bool", "at": "datetime", "meta": "json", "emb": "float32[8]"}
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in struct(fields).fields], "field string, type string")


# records, handles, blobs


def _nations(spark: SparkSession, d: str) -> Dataset:
    """Nations with row ids 0 on, in order of their keys."""
    empty = spark.createDataFrame([], "n_nationkey int, n_name string, n_regionkey int, _addr long, _deleted boolean")
    return Dataset(empty, "nation").insert(table(spark, d, "nation"), "n_nationkey")[0]


@query("select n_nationkey, n_name, row_number() over (order by n_nationkey) - 1 as _addr from nation")
def dataset_insert(spark, d):
    return _nations(spark, d).live().select("n_nationkey", "n_name", "_addr")


@query("select n_nationkey, n_name, n_regionkey from (select *, row_number() over (order by n_nationkey) - 1 as a from nation) where a = 7")
def dataset_read(spark, d):
    return _nations(spark, d).read(7).select("n_nationkey", "n_name", "n_regionkey")


@query("select n_nationkey, a as _addr, a <> 6 as valid from (select *, row_number() over (order by n_nationkey) - 1 as a from nation) where a between 5 and 8")
def dataset_read_many(spark, d):
    s = _nations(spark, d)
    return s.delete(s.df.where("_addr = 6").select("_addr")).read_many(5, 4).select("n_nationkey", "_addr", "valid")


@query("select row_number() over (order by n_nationkey) - 1 as _addr, n_name from nation")
def dataset_fields(spark, d):
    return _nations(spark, d).fields("n_name")


@query("select case when a = 3 then 300 else n_nationkey end as n_nationkey, case when a = 3 then null when a = 4 then 'FOUR' else n_name end as n_name from (select *, row_number() over (order by n_nationkey) - 1 as a from nation)")
def dataset_write(spark, d):
    return _nations(spark, d).write(3, n_nationkey=300).write_field(4, "n_name", "FOUR").live().select("n_nationkey", "n_name")


@query("select a as _addr, a < 25 and a % 2 = 1 as exists, a < 25 and a % 2 = 0 as is_deleted from (select unnest(range(20, 30)) as a) where a < 25 or true")
def dataset_exists(spark, d):
    s = _nations(spark, d)
    return s.delete(s.df.where("_addr % 2 = 0").select("_addr")).exists(spark.range(20, 30))


@query("select n_nationkey, case when n_nationkey = 2 then 'TWO' else n_name end as n_name from nation")
def ref_update(spark, d):
    c = Collection(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", {})
    return c.ref(2).set("n_name", "TWO").df


@query("select row_number() over (order by doc_id) - 1 as blob_id, octet_length(encode(text)) as size, md5(text) as digest from documents")
def blobs_write(spark, d):
    heap = Blobs(spark.createDataFrame([], "blob_id long, data binary")).write_many(table(spark, d, "documents"), "text", "doc_id")
    return heap.df.select("blob_id", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("digest"))


# the catalog


def _store(spark: SparkSession) -> Catalog:
    return Catalog(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")


@query("select n_nationkey::bigint as k, n_name as name from nation union all select r_regionkey + 100, r_name from region")
def catalog_append(spark, d):
    db = _store(spark)
    db.create("places", "dataset", {"k": "int64", "name": "text"})
    db.write("places", table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    db.append("places", table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("k"), F.col("r_name").alias("name")))
    return Catalog(spark, db.folder, "r").read("places")


@query("select 'a' as name, (select count(*) from nation) as rows union all select 'b', (select count(*) from region)")
def catalog_transaction(spark, d):
    """Both tables are there after the commit; a third, of a commit that fails, isn't."""
    db = _store(spark)
    with db.durable():
        for name, t in (("a", "nation"), ("b", "region")):
            df = table(spark, d, t)
            db.create(name, "dataset", {df.columns[0]: "int64"})
            db.write(name, df.select(df.columns[0]))
    try:
        with db.durable():
            db.create("c")
            raise KeyError("c")
    except KeyError:
        pass
    stats = Catalog(spark, db.folder, "r").stats()
    return spark.createDataFrame([(k, v["rows"]) for k, v in stats.items()], "name string, rows long")


@query("select c_custkey as id, upper(c_name) as title, 0::double as score from customer")
def catalog_migrate(spark, d):
    db = _store(spark)
    db.create("c", "dataset", {"id": "int64", "name": "text"})
    db.write("c", table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    db.migrate("c", {"id": "int64", "title": "text", "score": "float64"}, {"title": F.upper("name")})
    db.vacuum()
    return db.read("c")


@query("select kind, options::bigint as options from (values ('bloom', 2), ('counting_bloom', 3), ('sequence', 2), ('map', 1), ('set', 1), ('ordered', 1), ('queue', 1), ('priority', 3), ('lru', 3), ('flat', 2), ('ivf', 6)) t(kind, options)")
def catalog_kinds(spark, d):
    db = _store(spark)
    with db.durable():
        for kind in ("bloom", "counting_bloom", "sequence", "map", "set", "ordered", "queue", "priority", "lru"):
            db.create(kind, kind)
        db.create("flat", "flat", dim=8)
        db.create("ivf", "ivf", dim=8)
    return spark.createDataFrame([(db.entry(n)["kind"], len(db.entry(n)["options"])) for n in db.names()], "kind string, options long")


@query("select 'customer.c_mktsegment = ' || c_mktsegment || ': ' || count(*) || ' records' as issue from customer group by c_mktsegment having count(*) > 1 union all select 'orders.o_custkey: ' || count(*) || ' without a record in customer' from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20)")
def catalog_verify(spark, d):
    db = _store(spark)
    db.collection("customer", {"c_custkey": "int64", "c_mktsegment": "text"}, "c_custkey", {"s": Unique("c_mktsegment")})
    db.write("customer", table(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    db.collection("near", {"c_custkey": "int64"}, "c_custkey")
    db.write("near", table(spark, d, "customer").where("c_nationkey < 20").select("c_custkey"))
    db.create("orders", "dataset", {"o_custkey": "int64"})
    db.write("orders", table(spark, d, "orders").select("o_custkey"))
    issues = db.verify([("orders", "o_custkey", "near", "c_custkey")])["issues"]
    return spark.createDataFrame([(i.replace("in near", "in customer"),) for i in issues], "issue string")


# maps, lists, sets


def _balances(spark: SparkSession, d: str) -> structures.OrderedMap:
    return structures.OrderedMap(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


@query("select c_custkey, c_name, case when c_custkey % 5 = 2 then c_acctbal + 2 else c_acctbal end as c_acctbal from customer where c_custkey <> 4 union all select -1, 'new', 0.5")
def map_put(spark, d):
    """Keys that come twice in a batch, without an order: the last wins."""
    m = _balances(spark, d)
    some = m.df.where("c_custkey % 5 = 2")
    twice = some.withColumn("c_acctbal", F.col("c_acctbal") + 1).union(some.withColumn("c_acctbal", F.col("c_acctbal") + 2))
    return m.put(twice).put_one(-1, c_name="new", c_acctbal=0.5).remove([4]).df


@query("select c_name, c_acctbal from customer where c_custkey = 5")
def map_get(spark, d):
    return _balances(spark, d).get_fields(5, ["c_name", "c_acctbal"])


@query("select c_custkey from customer where c_custkey > 10 and c_custkey <= 40")
def map_range_keys(spark, d):
    return _balances(spark, d).range_keys(10, 40, (False, True))


@query("select c_custkey, c_name, c_acctbal from customer order by c_custkey desc limit 30")
def map_items_reverse(spark, d):
    return _balances(spark, d).items(True).limit(30)


@query("select c_custkey, case when c_custkey = 3 then 'X' else c_name end as c_name from customer")
def map_ref(spark, d):
    return _balances(spark, d).get_ref(3).set("c_name", "X").df.select("c_custkey", "c_name")


@query("select strftime(ts, '%Y%m%d%H%M%S') as key, event_id from events where event_id = (select min(event_id) from events) union all select '20300101000000', 7")
def map_datetime(spark, d):
    first = table(spark, d, "events").orderBy("event_id").limit(1).select(dt_key(F.col("ts")).alias("key"), "event_id", "ts")
    at = first.first()["ts"]
    m = structures.OrderedMap(first.drop("ts"), "key").set_dt("2030-01-01", event_id=7)
    return m.get_dt(at).union(m.get_dt("2030-01-01"))


@query("select p_partkey from part where p_retailprice between 1000 and 1500")
def map_bulk_load(spark, d):
    loaded = structures.OrderedMap(table(spark, d, "part").select("p_retailprice", "p_partkey"), "p_retailprice").laid_out()
    return structures.OrderedMap(loaded, "p_retailprice").range(1000, 1500).select("p_partkey")


def _list(spark: SparkSession, d: str) -> structures.Sequence:
    return structures.Sequence(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("_pos"), F.lit(True).alias("_valid"), "n_name"))


@query("select row_number() over (order by k) - 1 as _index, case when k = 2 then 'TWO' else name end as name from (select n_nationkey as k, n_name as name from nation where n_nationkey <> 5 union all select 100 + r_regionkey, r_name from region)")
def list_changes(spark, d):
    s = _list(spark, d).append(table(spark, d, "region").select(F.col("r_name").alias("n_name"), "r_regionkey"), "r_regionkey")
    return s.set(2, n_name="TWO").delete_at(5).live().select("_index", F.col("n_name").alias("name"))


@query("select n_name from nation order by n_nationkey limit 1 offset 3")
def list_at(spark, d):
    return _list(spark, d).at(3).select("n_name")


@query("select n_name from nation where n_nationkey % 3 = 0 and n_nationkey between 3 and 21")
def list_slice_back(spark, d):
    return _list(spark, d).slice(21, 2, -3).select("n_name")


@query("select n_nationkey::bigint as _pos, n_name from nation where n_nationkey between 4 and 9")
def list_array(spark, d):
    return spark.createDataFrame(_list(spark, d).slice_array(4, 10))


def _names(spark: SparkSession, d: str) -> structures.StringSet:
    return structures.StringSet(table(spark, d, "nation").select(F.col("n_name").alias("member")))


@query("select n_name as member from nation where n_name <> (select min(n_name) from nation) union select r_name from region union select 'new'")
def set_changes(spark, d):
    return _names(spark, d).pop()[1].update(table(spark, d, "region").select("r_name")).add("new").df


@query("select r_name as member, r_name in (select n_name from nation) as found from region union select n_name, true from nation")
def set_contains(spark, d):
    asked = table(spark, d, "region").select("r_name").union(table(spark, d, "nation").select("n_name"))
    return _names(spark, d).contains(asked)


@query("select 'subset' as relation, true as holds union all select 'superset', false union all select 'disjoint', false")
def set_relations(spark, d):
    a = structures.StringSet(table(spark, d, "orders").select(F.col("o_custkey").alias("member")).distinct())
    b = structures.StringSet(a.df.union(spark.createDataFrame([(-1,)], "member long")))
    return spark.createDataFrame([("subset", a.issubset(b)), ("superset", a.issuperset(b)), ("disjoint", a.isdisjoint(b))], "relation string, holds boolean")


# queues and caches that change


@query("select row_number() over (order by k) - 1 as _seq, name from (select n_nationkey as k, n_name as name from nation union all select 100 + r_regionkey, r_name from region union all select 200, 'last') qualify _seq > 0")
def queue_push_pop(spark, d):
    q = structures.Fifo(spark.createDataFrame([], "name string, _seq long"))
    q = q.push(table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), "n_nationkey")
    q = q.push(table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey"), "r_regionkey").push_one(name="last")
    return q.pop()[1].drain().select("_seq", "name")


@query("select priority, name from (select n_regionkey::double as priority, n_name as name, n_nationkey as k from nation union all select 2.0, 'late', 1000) order by priority desc, k limit 20 offset 2")
def priority_push_pop(spark, d):
    q = structures.PriorityQueue(spark.createDataFrame([], "priority double, name string, _seq long"))
    q = q.push(table(spark, d, "nation").select(F.col("n_regionkey").cast("double").alias("priority"), F.col("n_name").alias("name"), "n_nationkey"), "n_nationkey").push_one(priority=2.0, name="late")
    return q.pop(2)[1].drain(20).select("priority", "name")


@query("select * from (values ('b', 2.0::double, 0::bigint), ('a', 10.0, 1), ('e', 5.0, 2)) t(_key, v, rank)")
def lru_changes(spark, d):
    m = structures.LruMap(spark.createDataFrame([], "_key string, v double, w long, _used long"), 3)
    for k, v in (("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0), ("a", 10.0), ("e", 5.0), ("b", 2.0)):
        m = m.set(k, v=v, unknown=0)
        m = m.get("a")[1] if k in ("c", "e") and "a" in m else m
    m = m.delete("d") if "d" in m else m
    from pyspark.sql import Window

    return m.df.select("_key", "v", (F.row_number().over(Window.orderBy(F.col("_used").desc())) - 1).cast("long").alias("rank"))


@query("select conv_id, turn, case when conv_id = 1 then upper(text) else text end as text from conversations where not (conv_id = 2 and turn = (select min(turn) from conversations where conv_id = 2))")
def nested_write_back(spark, d):
    base = table(spark, d, "conversations").select("conv_id", "turn", "text")
    outer = structures.Nested(base, "conv_id", structures.KeyedMap, ("turn",))
    one, two = outer.open(1), outer.from_ref(outer.to_ref(2))
    outer = outer.write_back(1, one.put(one.df.withColumn("text", capitals(F.col("text")))))
    least = two.df.agg(F.min("turn")).first()[0]
    return (outer if least is None else outer.write_back(2, two.remove([least]))).df


@query("select conv_id, count(*) as n from conversations group by 1")
def nested_keys(spark, d):
    outer = structures.Nested(table(spark, d, "conversations"), "conv_id")
    return outer.keys().join(structures.regrouped(outer.df, "conv_id", "turn", ["text"]), "conv_id").select("conv_id", F.size("items").cast("long").alias("n"))


# graphs that change


@query(f"with {_PLACES} select src, dst from edges where src = 'r1' union all select src, dst from edges where dst = 'n3'")
def graph_in_out_edges(spark, d):
    g = _places(spark, d)
    out = g.out_edges("r1").select(F.lit("r1").alias("src"), F.col("id").alias("dst"))
    return out.union(g.in_edges("n3").select(F.col("id").alias("src"), F.lit("n3").alias("dst")))


@query(f"with {_PLACES}, d as (select src as id from edges union all select dst from edges) select id, count(*) as degree from d group by 1")
def graph_degree_both(spark, d):
    return _places(spark, d).degrees("both")


@query(f"with {_PLACES} select id, name from nodes where id = 'n4' union all select dst, null from edges where src = 'n4'")
def graph_node_neighbors(spark, d):
    g = _places(spark, d)
    return g.node("n4").select("id", "name").union(g.neighbors("n4").select("id", F.lit(None).cast("string")))


@query(f"with {_PLACES} select id, case when type = 'nation' then name || '2' else name end as name from nodes union all select 'x', 'second'")
def graph_add_nodes(spark, d):
    """Ids that come twice, without an order: the last wins."""
    g = _places(spark, d)
    nation = g.nodes.where("type = 'nation'")
    twice = nation.withColumn("name", F.concat("name", F.lit("1"))).union(nation.withColumn("name", F.concat("name", F.lit("2"))))
    return g.add_nodes(twice).add_nodes(spark.createDataFrame([("x", "t", "first"), ("x", "t", "second")], "id string, type string, name string").coalesce(1)).nodes.select("id", "name")


@query(f"with {_PLACES} select src, dst, case when src = 'r1' then 2 else 0 end as w from edges union all select 'r1', 'c1', 9 union all select 'y', 'z', 1")
def graph_add_edges(spark, d):
    g = _places(spark, d)
    g = Graph(g.nodes, g.edges.withColumn("w", F.lit(0)))
    some = g.edges.where("src = 'r1'")
    g = g.add_edges(some.withColumn("w", F.lit(1)).union(some.withColumn("w", F.lit(2))))
    return g.add_edges(spark.createDataFrame([("r1", "c1", 8), ("r1", "c1", 9), ("y", "z", 1)], "src string, dst string, w int").coalesce(1)).edges


@query(f"with {_PLACES} select count(*) as n from edges")
def graph_declared_edges(spark, d):
    g = _places(spark, d)
    return g.add_edges(spark.createDataFrame([("y", "z")], "src string, dst string")).declared_edges().agg(F.count("*").alias("n"))


@query(f"with {_PLACES} select src as \"id(n)\", type as \"label(x)\", dst as \"id(x)\" from edges join nodes on id = dst where src = 'n6' and type = 'supplier'")
def graph_label_of(spark, d):
    return _places(spark, d).query('MATCH (n)-->(x) WHERE id(n) = "n6" AND label(x) = "supplier" RETURN id(n), label(x), id(x)')


# a stored search index

_INDEX: dict[str, str] = {}


def _index(spark: SparkSession, d: str) -> fulltext.SearchIndex:
    """The index over documents, made once for each folder and size of the table, and opened from then on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    key = f"{shared_folder(spark)} {d} {size}"
    if key not in _INDEX:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        fulltext.SearchIndex.create(spark, folder, ["text"]).add_many(table(spark, d, "documents"), "doc_id")
        _INDEX[key] = folder
    return fulltext.SearchIndex.open(spark, _INDEX[key])


@query(f"with {_TOKENS} select doc_id from documents where {_holds('the')} and {_holds('of')}")
def index_and(spark, d):
    return _documents(spark, d).search("plain", "the AND of", index=_index(spark, d)).select("doc_id")


@query(f"{_BM25} select doc_id, round(score, 6) as score from s where {_holds('the')} and ({_holds('of')} or {_holds('en')}) order by score desc, doc_id limit 20")
def index_bm25(spark, d):
    return _documents(spark, d).search("text", "the AND of OR en", limit=20, with_scores=True, index=_index(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {_TOKENS} select doc_id, round(sum((1 + ln(tf)) * ln(n / df)), 6) as score from post join df using (term), n where term in ('the', 'les') group by 1")
def index_tfidf(spark, d):
    return _index(spark, d).search("the OR les", "tfidf").select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {_TOKENS} select distinct doc_id from post where starts_with(term, 'that') and not ({_holds('is')})")
def index_wildcard(spark, d):
    return _index(spark, d).search("that* AND NOT is").select("doc_id")


@query(f"with {_TOKENS} select doc_id from documents where doc_id % 3 <> 0 and ({_holds('und')} or {_holds('les')}) union all select 1000000 + doc_id from documents where doc_id % 3 = 1 and ({_holds('und')} or {_holds('les')})")
def index_changes(spark, d):
    """Documents that come later are found, deleted ones aren't."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = fulltext.SearchIndex.create(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", ["text"]).add_many(docs, "doc_id")
    index = index.add_many(docs.where("doc_id % 3 = 1").withColumn("doc_id", F.col("doc_id") + 1000000), "doc_id")
    return index.delete(docs.where("doc_id % 3 = 0").select("doc_id")).search("und OR les").select("doc_id")


@query("select doc_id, lang from documents where doc_id = 3")
def index_get_document(spark, d):
    docs = table(spark, d, "documents")
    return _index(spark, d).get_document(3, docs, "doc_id").select("doc_id", "lang")


@query(f"with {_TOKENS} select (select count(*) from documents) as n, round((select avgdl from av), 6) as avgdl")
def index_sizes(spark, d):
    index = _index(spark, d)
    return spark.createDataFrame([(len(index), round(index.total / index.n, 6))], "n long, avgdl double")


# vectors that change


@query(f"with v as (select vec_id, case when vec_id % 2 = 0 then list_reverse(embedding) else embedding end as e from embeddings where vec_id <> 3) select vec_id as id, round(list_cosine_similarity(e::double[], {_QSQL}), 6) as score from v order by list_cosine_similarity(e::double[], {_QSQL}) desc, vec_id limit 10")
def flat_changes(spark, d):
    df = table(spark, d, "embeddings")
    new = df.where("vec_id % 2 = 0")
    index = vectors.FlatIndex.empty(spark, 64).add_many(df, "vec_id", "embedding")
    index = index.add_many(new.union(new.withColumn("embedding", F.reverse("embedding"))), "vec_id", "embedding").remove([3])
    return index.search(_Q, 10).select("id", F.round("score", 6).alias("score"))


@query(f"select id, round(list_cosine_similarity(embedding::double[], {_QSQL}), 6) as score from (select vec_id as id, embedding from embeddings where vec_id <> 3 union all select vec_id, embedding from embeddings where vec_id % 50 = 0) order by list_cosine_similarity(embedding::double[], {_QSQL}) desc, id limit 10")
def ivf_changes(spark, d):
    """An id that is added again is there twice."""
    df = table(spark, d, "embeddings")
    index = vectors.InvertedFile("cosine", 16).train(df, "vec_id", "embedding")
    assigned = index.remove(index.add(index.assign(df, "vec_id", "embedding"), df.where("vec_id % 50 = 0"), "vec_id", "embedding"), [3])
    return index.search(assigned, _Q, 10, 16).select("id", F.round("score", 6).alias("score"))


# collections that change


@query("select c_custkey, c_name, case when c_custkey % 5 = 2 then c_acctbal + 2 else c_acctbal end as c_acctbal from customer where c_custkey <> 4 union all select -1, 'new', 0.5")
def insert_last_wins(spark, d):
    c = Collection(_balances(spark, d).df, "c_custkey", {})
    some = c.df.where("c_custkey % 5 = 2")
    twice = some.withColumn("c_acctbal", F.col("c_acctbal") + 1).union(some.withColumn("c_acctbal", F.col("c_acctbal") + 2))
    return c.insert_many(twice).insert(c_custkey=-1, c_name="new", c_acctbal=0.5).delete([4]).df


@query("select n_nationkey as key, n_name as name from nation")
def collection_items(spark, d):
    return Collection(table(spark, d, "nation"), "n_nationkey", {}).items().select("key", F.col("record.n_name").alias("name"))


@query("select n_nationkey, n_name from nation where n_nationkey in (2, 3) and n_nationkey <> 3 union all select 3, 'gone'")
def missing_keys_are_refused(spark, d):
    """update, increment and delete of a key that isn't there are errors."""
    from .errors import NotFound

    c = Collection(table(spark, d, "nation"), "n_nationkey", {})
    refused = 0
    for act in (lambda: c.update([-5], n_name="x"), lambda: c.increment([-5], "n_regionkey"), lambda: c.delete([2, -5])):
        try:
            act()
        except NotFound:
            refused += 1
    return c.get_primary(2).select("n_nationkey", "n_name").union(spark.createDataFrame([(refused, "gone")], "n_nationkey int, n_name string"))


@query("select 2000 as expected, round(power(1 - exp(-7.0 * 1500 / 19171), 7), 8) as rate, 7 as k, 19171 as m")
def bloom_rate(spark, d):
    return spark.createDataFrame([(2000, round(_BLOOM.false_alarm_rate(1500), 8), _BLOOM.k, _BLOOM.m)], "expected int, rate double, k int, m int")
