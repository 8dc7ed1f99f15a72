"""The queries opN_<name>: each operator on its whole table with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import assigned, cluster_vectors
from .cluster import saved, shared_dir
from .dedup_exact import exact_dedup, text_sha256
from .dedup_near import near_components
from .mixing import mix_sources
from .packing import pack, token_pieces
from .quality_model import classify
from .quality_rules import quality_rules
from .sharding import shard_rows
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .toxicity import fit_toxicity, held_out, score_toxicity
from .url_filters import filter_urls, path_rules
from .whitening import fit_whitening, whiten

CAPACITY = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_rows(docs, n_shards=16, seed=20_240_601)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, end_id=2, keep=["doc_id"])
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, CAPACITY)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024, keep=["doc_id"])


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return classify(table(spark, sf_dir, "documents"), trusted, keep=["doc_id", "lang"])


#: Target weights of the corpus mix, in parts: each known source its own, falling, and all others together.
MIX = {f"src{i}": 30 - i for i in range(20)}
MIX_OTHERS = 15
#: Shares of at most this weight may run out before the mix ends.
MIX_SLACK = 0.1


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs, MIX, MIX_OTHERS, seed=7, slack=MIX_SLACK)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are hashed once; what is read again is a row of 40 bytes or so per document
    docs = saved(table(spark, sf_dir, "documents").select("doc_id", text_sha256(F.col("text")).alias("key")))
    return exact_dedup(docs, key_col="key").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


URL_RULES = path_rules({"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"})


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


CENTROIDS, CENTROID_ROUNDS = 8, 10


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", CENTROIDS, CENTROID_ROUNDS)
    return assigned(found, "vec_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, "embedding", fit_whitening(vectors, "embedding", most_components=4), keep=["vec_id"])


OP6_SQL = r"""
with n as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept,
       text_sha256
from n window w as (partition by text_sha256 order by doc_id nulls last)
"""



def _op12_sql(k: int, rounds: int) -> str:
    """Rounds of the clustering over (row, dimension, entry), one pair of tables a round."""
    parts = [
        """with kept as materialized (
  select row_number() over () as r, vec_id, [floor(1024 * e::double)::bigint for e in embedding] as x from embeddings
  where len(embedding) = 64 and len([e for e in embedding if e is null or not isfinite(e)]) = 0
), entries as materialized (
  select r, unnest(x) as x, generate_subscripts(x, 1) as d from kept
)""",
        f"""c0 as materialized (
  select n, unnest(x) as x, generate_subscripts(x, 1) as d
  from (select x, row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, '')), x) - 1 as n from kept qualify n < {k})
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (
  select r, n, far from (select r, n, sum((e.x - c.x) * (e.x - c.x))::bigint as far from entries e join c{i} c using (d) group by r, n)
  qualify row_number() over (partition by r order by far, n) = 1
)""")
        if i < rounds:
            parts.append(f"""m{i} as materialized (
  select n, d, floor(sum(x)::double / count(*))::bigint as x from entries join a{i} using (r) group by n, d
), c{i + 1} as materialized (
  select c.n, c.d, coalesce(m.x, c.x) as x from c{i} c left join m{i} m using (n, d)
)""")
    return ",\n".join(parts) + f"""
select vec_id, n::int as cluster, far as distance, sum(far) over (partition by n)::bigint as cluster_inertia, sum(far) over ()::bigint as inertia, s.centroid_sha256
from a{rounds} join kept using (r) join (select n, sha256(string_agg(x::varchar, ',' order by d)) as centroid_sha256 from c{rounds} group by n) s using (n)
"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_token_files": op8_token_files,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_toxicity": op11_toxicity,
    "op12_centroids": op12_centroids,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op6_exact_dedup": OP6_SQL,
    "op12_centroids": _op12_sql(CENTROIDS, CENTROID_ROUNDS),
}
