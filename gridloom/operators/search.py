"""Lexical, vector and hybrid ranking of whole query tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.plans.lineage import cut


def tokens(text: Column, least: int = 1, most: int | None = None) -> Column:
    """Words of letters and digits in lower case; shorter or longer ones than asked for are left out."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")), " ")
    return F.filter(words, lambda t: (F.length(t) >= least) & (F.lit(True) if most is None else F.length(t) <= most))


def prefixes(token: Column, least: int = 2, most: int = 20) -> Column:
    n = F.least(F.lit(most), F.length(token))
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda k: F.substring(token, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


# Boosts of a concept's fields in lexical search, and the fields of a full-text lookup of concepts and terms.
CONCEPT_FIELDS = {"name_he": 4.0, "name": 3.0, "aliases": 2.0, "description": 1.0, "description_he": 1.0}
CONCEPT_FULLTEXT = {"name": 1.0, "description": 1.0, "name_he": 1.0, "description_he": 1.0}
TERM_FULLTEXT = {"surface_form": 1.0, "normalized_form": 1.0}


def field_tokens(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, len, t): the tokens of each field that has any; a field may be an array of texts."""
    as_text = lambda f: F.array_join(f, " ") if docs.schema[f].dataType.typeName() == "array" else F.col(f)
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(as_text(f)).alias("t")) for f in fields])
    return docs.select("id", F.inline(each)).filter(F.size("t") > 0).select("id", "field", F.size("t").alias("len"), "t")


def index_terms(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(term, occurrences, n_docs): each term's places and documents over all fields."""
    each = field_tokens(docs, fields).select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return each.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("n_docs"))


def bm25(queries: DataFrame, docs: DataFrame, fields: dict[str, float], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top k per query (query_id, text): boosted BM25 summed over fields and terms.

    Texts are split into tokens once. Only tokens that some query asks for are exploded; their counts are dealt by
    document, so all that a document scores for a query is added up where the document is, and only each task's k best
    per query are shuffled. Query terms are broadcast by Spark as long as their table is small on disk."""
    asked = cut(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
    wanted = cut(asked.select("term").distinct())
    split = cut(field_tokens(docs, list(fields)))
    stats = split.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    mine = split.select("id", "field", "len", F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("field", "term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    mine = cut(mine)
    df = cut(mine.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")))
    boost = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])[F.col("field")]
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = mine.repartition("id").join(df, ["field", "term"]).join(F.broadcast(stats), "field").select("term", "id", F.round(1e9 * (boost * idf * tf)).cast("long").alias("s"))  # billionths, whose sum has no order
    total = scored.join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum("s") / 1e9, 6).alias("score"))
    return top_k(total, k)


def best_hit(names: DataFrame, concepts: DataFrame, fields: dict[str, float] = CONCEPT_FULLTEXT) -> DataFrame:
    """(name, id, score): the best full-text hit of each name, deprecated concepts left out. concepts: id, status and the
    fields that they have."""
    live = concepts.filter("NOT status <=> 'DEPRECATED'")
    hits = bm25(names.select(F.col("name").alias("query_id"), F.col("name").alias("text")), live, {f: w for f, w in fields.items() if f in concepts.columns}, 1)
    return hits.select(F.col("query_id").alias("name"), "id", "score")


def find(queries: DataFrame, docs: DataFrame, mode: str = "hybrid", k: int = 10, fields: dict[str, float] = CONCEPT_FIELDS) -> DataFrame:
    """Search in one of three modes: lexical, semantic, or both fused. queries: query_id, text, v; docs: id, v and the fields,
    filtered before (see `allowed`)."""
    fields = {f: w for f, w in fields.items() if f in docs.columns}
    lexical = lambda n: bm25(queries, docs, fields, n)
    semantic = lambda n: knn(queries.select("query_id", "v"), docs.select("id", "v"), n)
    if mode == "lexical":
        return lexical(k)
    if mode == "semantic":
        return semantic(k)
    return fuse([lexical(2 * k), semantic(2 * k)], k)


def top_k(scored: DataFrame, k: int, offset: int = 0) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def knn(queries: DataFrame, docs: DataFrame, k: int = 10, block_rows: int = 4096) -> DataFrame:
    """Exact top k by cosine: a stated query set (query_id, v) meets all docs (id, v) block by block, a block of about
    `block_rows` docs with a block of as many queries, so the number of tasks follows the input. Each block pair keeps k
    per query. A matrix product finds the docs that may be among them, whose scores are then summed component by component.
    Missing components take no part; a score is null if no component is in both vectors, and NaN, which ranks first, if a
    vector is zero or a component is not finite. For large query sets take an approximate search; this one checks it."""
    n_docs, n_queries = (max(1, -(-x.count() // block_rows)) for x in (docs, queries))
    dealt = lambda id_col, n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    numbers = lambda c: F.col(c).cast("array<double>") if "double" in dict(docs.dtypes)["v"] + dict(queries.dtypes)["v"] else F.col(c).cast("array<float>")
    d = docs.select("id", numbers("v").alias("v"), dealt("id", n_docs).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("query_block"))
    q = queries.select("query_id", numbers("v").alias("v"), dealt("query_id", n_queries).alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(n_docs - 1))).alias("block"))
    kinds = ", ".join(f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((q, "query_id"), (d, "id")))
    scored = q.groupBy("block", "query_block").cogroup(d.groupBy("block", "query_block")).applyInArrow(_best_of_block(k), f"{kinds}, score double")
    return top_k(scored.withColumn("score", F.round("score", 6)), k)


#: Pairs whose components a task holds at a time, and how far a rounded score may be from a matrix product, twice.
PAIRS, APART = 1 << 15, 1.01e-6


def _best_of_block(k: int):
    """A function of the queries (query_id, v) and docs (id, v) of a block pair, for their query_id, id, score: the k best docs
    of each query by rounded score, then id. Where rounding is not certain, more of them."""

    def meet(asked, known):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def matrix(rows):
            """Components with 0 where there is none, and whether there is one."""
            v = rows.column("v").combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(v)
            m = np.zeros((len(lengths), max(1, lengths.max())))
            there = np.zeros(m.shape, bool)
            at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            m[at], there[at] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
            return m, there

        def norms(m):
            total = np.zeros(len(m))
            for i in range(m.shape[1]):  # in this order, as every sum here
                total += m[:, i] * m[:, i]
            return np.sqrt(total)

        def exact(qi, di):
            total, any_there = np.zeros(len(qi)), np.zeros(len(qi), bool)
            for i in range(min(q.shape[1], d.shape[1])):
                both = q_there[qi, i] & d_there[di, i]
                total += np.where(both, q[qi, i] * d[di, i], 0.0)
                any_there |= both
            return np.where(any_there, total / (q_norm[qi] * d_norm[di]), -np.inf)  # -inf: null

        if not asked.num_rows or not known.num_rows:
            return pa.table({"query_id": asked.column("query_id").slice(0, 0), "id": known.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        with np.errstate(all="ignore"):
            (q, q_there), (d, d_there) = matrix(asked), matrix(known)
            q_norm, d_norm, width = norms(q), norms(d), max(q.shape[1], d.shape[1])
            plain = lambda m, there, norm: there.all(1) & np.isfinite(norm) & (norm > 0) & (m.shape[1] == width)
            q_plain, d_plain = plain(q, q_there, q_norm), plain(d, d_there, d_norm)
            place = np.empty(len(d), np.int64)
            place[pc.sort_indices(known.column("id")).to_numpy()] = np.arange(len(d))
            every, usual, odd = np.arange(len(d)), np.flatnonzero(d_plain), np.flatnonzero(~d_plain)
            near = (d[usual] / d_norm[usual, None]).T
            found = []
            for begin in range(0, len(q), 256):
                rows = np.arange(begin, min(begin + 256, len(q)))
                here, qi, di = rows[q_plain[rows]], [], []
                if len(here) and len(usual):
                    like = (q[here] / q_norm[here, None]) @ near
                    least = np.partition(like, like.shape[1] - k, axis=1)[:, like.shape[1] - k] if like.shape[1] > k else np.full(len(here), -np.inf)
                    a, b = np.nonzero(like >= least[:, None] - APART)
                    qi, di = [here[a]], [usual[b]]
                for of, docs in ((here, odd), (rows[~q_plain[rows]], every)):
                    qi, di = [*qi, np.repeat(of, len(docs))], [*di, np.tile(docs, len(of))]
                qi, di = np.concatenate(qi), np.concatenate(di)
                score = np.concatenate([np.empty(0), *[exact(qi[i : i + PAIRS], di[i : i + PAIRS]) for i in range(0, len(qi), PAIRS)]])
                units = np.where(np.isnan(score), np.inf, score) * 1e6  # NaN ranks first, null last
                low, high = np.floor(units + 0.5 - 1e-6), np.floor(units + 0.5 + 1e-6)
                order = np.lexsort((place[di], -low, qi))
                first = np.searchsorted(qi[order], rows)
                count = np.diff(np.append(first, len(order)))
                last = order[np.minimum(first + k - 1, first + count - 1)]  # the k-th of each query
                worst, until = low[last][qi - begin], place[di[last]][qi - begin]
                keep = (count[qi - begin] <= k) | (high > worst) | ((high == worst) & (place[di] <= until))
                found.append((qi[keep], di[keep], score[keep]))
            qi, di, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": asked.column("query_id").take(pa.array(qi)), "id": known.column("id").take(pa.array(di)), "score": pa.array(score, mask=score == -np.inf)})

    return meet


#: Projections of a vector's signature, hash tables, and buckets that a query looks into in each table.
SIGNATURE_BITS, TABLES, PROBES = 256, 24, 9
#: Distinct vectors that a bucket holds on average.
BUCKET_ROWS = 64


def _signed(rows: DataFrame, tables: int, bits: int, probes: int, seed: int) -> DataFrame:
    """(key, v, sign, tab, bucket): the signs of a vector's projections, and for each hash table the bucket that `bits` of
    them name, with the probes - 1 buckets that differ in one of the signs nearest to zero."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        rng, planes = np.random.default_rng(seed), {}
        picked = np.stack([rng.permutation(SIGNATURE_BITS)[:bits] for _ in range(tables)])
        powers = 1 << np.arange(bits)
        for b in batches:
            for row in range(b.num_rows):  # lengths may differ
                v = np.array(b.column(1)[row].as_py(), float)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([seed, len(v)]).standard_normal((len(v), SIGNATURE_BITS))
                p = v @ planes[len(v)]
                sign = np.packbits(p > 0).view(np.int64)
                of_table = p[picked]
                own = (of_table > 0) @ powers
                near = np.argsort(np.abs(of_table), axis=1)[:, : probes - 1]
                found = np.concatenate([own[:, None], own[:, None] ^ powers[near]], 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), b.column(1).slice(row, 1), pa.array([sign.tolist()], pa.list_(pa.int64())), pa.array([found.tolist()], pa.list_(pa.list_(pa.int64())))], ["key", "v", "sign", "found"])

    signed = rows.select("key", F.col("v").cast("array<double>").alias("v")).mapInArrow(scan, "key long, v array<double>, sign array<long>, found array<array<long>>")
    each = signed.select("key", "v", "sign", F.posexplode("found").alias("tab", "buckets"))
    return each.select("key", "v", "sign", "tab", F.explode("buckets").alias("bucket"))


def candidate_knn(queries: DataFrame, docs: DataFrame, k: int = 10, candidates: int | None = None, tables: int = TABLES, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """Approximate top k by cosine of queries (query_id, v) over docs (id, v), which are filtered before (see `allowed`).

    Hash tables of sign projections give the docs to look at, with probing of near buckets; the number of buckets follows
    the distinct vectors. Of those met, the max(100, 10 k) whose signatures differ least are scored exactly. Equal vectors
    are one entry, so copies of one vector make no hot bucket; each entry hands in its k first ids. Vectors that are null,
    empty, zero or hold null or non-finite components take no part. Ids are numbers.
    """
    most = candidates or max(100, 10 * k)
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = lambda c: F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (squares(c) > 0), F.lit(False))
    d, q = docs.select("id", "v").filter(fine(F.col("v"))), queries.select("query_id", "v").filter(fine(F.col("v")))
    w = W.partitionBy("v").orderBy("id")
    members = d.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k).join(d.groupBy("v").agg(F.min("id").alias("key")), "v").select("key", "id")
    entries, asked = cut(d.groupBy("v").agg(F.min("id").alias("key"))), cut(q.groupBy("v").agg(F.min("query_id").alias("key")))
    bits = min(40, max(1, (entries.count() // BUCKET_ROWS).bit_length()))
    left = _signed(asked, tables, bits, min(probes, bits + 1), seed).select(F.col("key").alias("q"), F.col("sign").alias("q_sign"), "tab", "bucket")
    right = cut(_signed(entries, tables, bits, 1, seed).select("key", "sign", "tab", "bucket"))
    apart = F.aggregate(F.zip_with("q_sign", "sign", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    met = left.join(right, ["tab", "bucket"]).groupBy("q", "key").agg(F.min(apart).alias("apart"))
    near = met.withColumn("at", F.row_number().over(W.partitionBy("q").orderBy("apart", "key"))).filter(F.col("at") <= most).select("q", "key")
    dot = F.aggregate(F.zip_with("q_v", "v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = near.join(entries, "key").join(asked.select(F.col("key").alias("q"), F.col("v").alias("q_v")), "q").filter(F.size("v") == F.size("q_v"))
    scored = scored.select("q", "key", F.round(dot / F.sqrt(squares("q_v") * squares("v")), 6).alias("score"))
    best = cut(top_k(scored.withColumnRenamed("q", "query_id").withColumnRenamed("key", "id"), k).select(F.col("query_id").alias("q"), F.col("id").alias("key"), "score"))
    asking = q.join(asked.select("v", F.col("key").alias("q")), "v").select("query_id", "q")
    return top_k(asking.join(best, "q").join(members, "key").select("query_id", "id", "score"), k)


def fuse(lists: list[DataFrame], k: int = 10, constant: int = 20) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank)."""
    union = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    return top_k(union.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score")), k)


def page(scored: DataFrame, id_col: str, offset: int, size: int) -> DataFrame:
    """A page of results: highest scores first, ties by id."""
    return scored.orderBy(F.desc("score"), id_col).offset(offset).limit(size)


def allowed(docs: DataFrame, types=None, domains=None, statuses=None, least: float | None = None, deprecated: bool = False) -> DataFrame:
    """Filters that hold before scoring."""
    out = docs if deprecated else docs.filter("status <> 'DEPRECATED'")
    for column, values in (("concept_type", types), ("status", statuses)):
        out = out.filter(F.col(column).isin(values)) if values else out
    out = out.filter(F.arrays_overlap("domain", F.array(*map(F.lit, domains)))) if domains else out
    return out if least is None else out.filter(F.col("confidence") >= least)
